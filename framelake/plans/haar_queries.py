"""Queries of the detector on frames made of ``embeddings``: 64 vectors are the tiles of a frame of 64 by 64 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import haar, pyramid
from ..sources.cascades import DIAGONAL_EDGE, HORIZONTAL_CENTER, HORIZONTAL_EDGE, VERTICAL_CENTER, VERTICAL_EDGE, CascadeFile, WeakFeature
from .pixel_queries import PIXELS_SQL, pixels
from .tables import materialise

TILES = 8
WIDTH = HEIGHT = 8 * TILES
#: Value of tiles that no vector fills.
GROUND = 128

_CASCADE = haar.demo_cascade()
_LEVELS = haar.levels(WIDTH, HEIGHT)


def every_kind() -> haar.Cascade:
    """A cascade with a feature of each named kind, on grids of its own, tilted one included; thresholds and votes are made up."""
    kinds = ((VERTICAL_EDGE, 2, 2), (DIAGONAL_EDGE, 4, 4), (HORIZONTAL_CENTER, 3, 3), (HORIZONTAL_EDGE, 2, 2), (VERTICAL_CENTER, 6, 6), (DIAGONAL_EDGE, 6, 6))
    features = tuple(haar.named_kind(*k) for k in kinds)
    votes = (((0, -0.02, 1), (1, 0.01, 1)), ((2, 0.03, -1), (5, -0.01, 1)), ((3, 0.0, 1), (4, 0.0, -1)))
    stages = tuple((-0.25 - k / 4, tuple(WeakFeature(f, t, sign, 0.75 + f / 4, -0.5) for f, t, sign in stage)) for k, stage in enumerate(votes))
    return haar.from_file(CascadeFile(haar.SIDE, haar.SIDE, features, stages))


def tiled(spark: SparkSession, sf_dir: str, across: int = TILES) -> DataFrame:
    """``frame``, ``x``, ``y``, ``v``: ``across`` by ``across`` vectors in the order of their ids are a frame; what is missing is GROUND."""
    count = across * across
    own = pixels(spark, sf_dir)
    tile = F.col("frame") % count
    placed = own.select(F.expr(f"frame div {count}").alias("of"), tile.alias("tile"), "x", "y", "v")
    frames = own.select(F.expr(f"frame div {count}").alias("of")).distinct()
    missing = frames.select("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("tile")).join(placed.select("of", "tile").distinct(), ["of", "tile"], "left_anti")
    grid = missing.select("of", "tile", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("of", "tile", (F.col("i") % 8).alias("x"), F.expr("cast(i div 8 as int)").alias("y"), F.lit(GROUND).alias("v"))
    return placed.unionByName(grid).select(F.col("of").alias("frame"), (F.col("x") + 8 * (F.col("tile") % across)).cast("int").alias("x"), (F.col("y") + 8 * F.expr(f"tile div {across}")).cast("int").alias("y"), "v")


def tiled_sql(across: int = TILES) -> str:
    count = across * across
    return f"""{PIXELS_SQL}, placed AS (SELECT frame // {count} AS frame, CAST(x + 8 * (frame % {count} % {across}) AS INT) AS x, CAST(y + 8 * (frame % {count} // {across}) AS INT) AS y, v FROM pixels),
l0 AS MATERIALIZED (SELECT f.frame AS frame, CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, coalesce(p.v, {GROUND}) AS v FROM (SELECT DISTINCT frame FROM placed) f CROSS JOIN range({8 * across}) a(i) CROSS JOIN range({8 * across}) b(i) LEFT JOIN placed p ON p.frame = f.frame AND p.x = a.i AND p.y = b.i)"""


def _levels_sql() -> str:
    out = []
    for before, level in zip(_LEVELS, _LEVELS[1:], strict=False):
        k = level["level"]
        for c, key in (("x", "width"), ("y", "height")):
            size, to = before[key], level[key]
            out.append(f"c{c}{k} AS (SELECT s.i AS src, d.i AS dst, least(s.i + 1.0::DOUBLE, (d.i + 1.0::DOUBLE) * {size} / {to}) - greatest(s.i * 1.0::DOUBLE, d.i * 1.0::DOUBLE * {size} / {to}) AS part FROM range({size}) s(i), range({to}) d(i))")
        out.append(f"l{k} AS MATERIALIZED (SELECT frame, CAST(a.dst AS INT) AS x, CAST(b.dst AS INT) AS y, CAST(floor(round(sum(a.part * b.part * v) / sum(a.part * b.part), 6) + 0.5) AS INT) AS v FROM l{k - 1} JOIN cx{k} a ON a.src = x AND a.part > 1e-9 JOIN cy{k} b ON b.src = y AND b.part > 1e-9 GROUP BY 1, 2, 3)")
    return ",\n".join(out)


PYRAMID_SQL = f"""{tiled_sql()},
{_levels_sql()},
pyr AS MATERIALIZED ({" UNION ALL ".join(f"SELECT frame, {x['level']} AS level, x, y, v FROM l{x['level']}" for x in _LEVELS)})"""
TABLES_SQL = f"""{PYRAMID_SQL},
rowsums AS (SELECT frame, level, x, y, sum(v) OVER r AS s, sum(v*v) OVER r AS s2, sum(v) OVER a AS d FROM pyr WINDOW r AS (PARTITION BY frame, level, y ORDER BY x), a AS (PARTITION BY frame, level, x - y ORDER BY x)),
tables AS MATERIALIZED (SELECT frame, level, x, y, CAST(sum(s) OVER c AS BIGINT) AS ii, CAST(sum(s2) OVER c AS BIGINT) AS ii2, CAST(d AS BIGINT) AS d FROM rowsums WINDOW c AS (PARTITION BY frame, level, x ORDER BY y)),
sizes(level, width, height, stride, scale, box) AS (VALUES {", ".join(str(tuple(x[k] for k in ("level", "width", "height", "stride", "scale", "box"))) for x in _LEVELS)}),
win AS MATERIALIZED (SELECT f.frame AS frame, s.level AS level, CAST(a.i * stride AS INT) AS wx, CAST(b.i * stride AS INT) AS wy FROM (SELECT DISTINCT frame FROM l0) f CROSS JOIN sizes s CROSS JOIN range({WIDTH}) a(i) CROSS JOIN range({HEIGHT}) b(i) WHERE a.i * stride + 24 <= width AND b.i * stride + 24 <= height),
vc(dx, dy, k) AS (VALUES (22, 22, 1), (0, 22, -1), (22, 0, -1), (0, 0, 1)),
vs AS (SELECT w.frame AS frame, w.level AS level, wx, wy, CAST(sum(k * ii) AS BIGINT) AS s, CAST(sum(k * ii2) AS BIGINT) AS s2 FROM win w CROSS JOIN vc JOIN tables t ON t.frame = w.frame AND t.level = w.level AND t.x = wx + dx AND t.y = wy + dy GROUP BY 1, 2, 3, 4),
ok AS MATERIALIZED (SELECT frame, level, wx, wy, CAST(1 / sqrt(CAST(s2*484 - s*s AS DOUBLE)) AS FLOAT) AS norm FROM vs WHERE s2*484 >= s*s + 200*484*484 AND s2*484 > s*s)"""


def _cascade_sql(cascade: haar.Cascade, windows: str = "ok") -> str:
    """``resp``: raw responses of every feature; ``weak`` and ``stages``: the cascade. Rectangles are summed by corners, tilted ones by seven places."""
    rect = []
    for f, rects in enumerate(cascade.features):
        for x, y, w, h, k in rects:
            rect.append((f, int(f in cascade.tilted), x, y, x + w, y + h, k))
    weak = [(s, n, w.feature, w.threshold, w.left, w.right, w.sign) for s, (_, ws) in enumerate(cascade.stages) for n, w in enumerate(ws)]
    return f"""rects(feature, tilted, x1, y1, x2, y2, weight) AS (VALUES {", ".join(map(str, rect))}),
mid AS (SELECT *, (x1 + x2) // 2 AS xm, (y1 + y2) // 2 AS ym FROM rects),
spots AS (SELECT feature, 0 AS tilted, weight, unnest([{{'x': x2, 'y': y2, 'k': 1}}, {{'x': x1, 'y': y2, 'k': -1}}, {{'x': x2, 'y': y1, 'k': -1}}, {{'x': x1, 'y': y1, 'k': 1}}]) AS c FROM mid WHERE tilted = 0
UNION ALL SELECT feature, 1, weight, unnest([{{'x': xm, 'y': y1, 'k': 1}}, {{'x': x1, 'y': y1, 'k': -1}}, {{'x': xm, 'y': ym, 'k': -2}}, {{'x': x1, 'y': ym, 'k': 1}}, {{'x': x2, 'y': ym, 'k': 1}}, {{'x': x2, 'y': y2, 'k': -1}}, {{'x': xm, 'y': y2, 'k': 1}}]) FROM mid WHERE tilted = 1),
weak(stage, no, feature, threshold, l, r, sign) AS (VALUES {", ".join(map(str, weak))}),
stages(stage, least) AS (VALUES {", ".join(str((s, t)) for s, (t, _) in enumerate(cascade.stages))}),
resp AS MATERIALIZED (SELECT w.frame AS frame, w.level AS level, wx, wy, feature, coalesce(sum(CAST(weight AS DOUBLE) * c.k * CASE WHEN tilted = 1 THEN d ELSE ii END), 0) AS raw FROM {windows} w CROSS JOIN spots
LEFT JOIN tables t ON t.frame = w.frame AND t.level = w.level AND t.x = wx + c.x - 1 AND t.y = wy + c.y - 1 GROUP BY 1, 2, 3, 4, 5)"""


_VOTES_SQL = """st AS (SELECT frame, level, wx, wy, stage, round(CAST(sum(CASE WHEN CAST(raw AS FLOAT) * norm < CAST(threshold AS FLOAT) THEN l ELSE r END) AS DOUBLE), 5) AS total FROM resp JOIN ok USING (frame, level, wx, wy) JOIN weak USING (feature) GROUP BY 1, 2, 3, 4, 5),
acc AS (SELECT frame, level, wx, wy, round(sum(total), 4) AS score FROM st JOIN stages USING (stage) GROUP BY 1, 2, 3, 4 HAVING bool_and(total >= least))"""
_PLACE = "CAST(greatest(0, least(floor(CAST(CAST({c} AS FLOAT) / CAST(scale AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT)), greatest(0, {size} - box))) AS INT)"
_BOXES_SQL = f"""boxes AS MATERIALIZED (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, level, wy, wx) AS INT) AS rank, {_PLACE.format(c="wx", size=WIDTH)} AS x, {_PLACE.format(c="wy", size=HEIGHT)} AS y, CAST(box AS INT) AS w, CAST(box AS INT) AS h, score FROM acc JOIN sizes USING (level))"""
_INTER = "(greatest(least(k.x+k.w,t.x+t.w)-greatest(k.x,t.x),0)*greatest(least(k.y+k.h,t.y+t.h)-greatest(k.y,t.y),0))"


def _detect_sql(cascade: haar.Cascade) -> str:
    return f"""WITH RECURSIVE {TABLES_SQL}, {_cascade_sql(cascade)}, {_VOTES_SQL}, {_BOXES_SQL},
fold(frame, n, kept) AS (SELECT frame, 1, [{{'rank': rank, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score}}] FROM boxes WHERE rank = 1
UNION ALL SELECT f.frame, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda k: {_INTER} > 0 AND CAST({_INTER} AS FLOAT) / CAST(k.w*k.h + t.w*t.h - {_INTER} AS FLOAT) > CAST(0.3 AS FLOAT))) > 0 THEN f.kept
ELSE list_append(f.kept, {{'rank': t.rank, 'x': t.x, 'y': t.y, 'w': t.w, 'h': t.h, 'score': t.score}}) END FROM fold f JOIN boxes t ON t.frame = f.frame AND t.rank = f.n + 1),
done AS (SELECT frame, max_by(kept, n) AS kept FROM fold GROUP BY frame)
SELECT frame, k.rank AS rank, k.x AS x, k.y AS y, k.w AS w, k.h AS h, round(k.score, 4) AS score FROM (SELECT frame, unnest(kept) AS k FROM done)"""


def pyramid_pixels(spark, sf_dir):
    """Pixels of every level of every frame, each level an area mean of the one before it."""
    return pyramid.pyramid(tiled(spark, sf_dir), WIDTH, HEIGHT)


PIXELS_OF_LEVELS_SQL = f"WITH {PYRAMID_SQL} SELECT frame, CAST(level AS INT) AS level, x, y, v FROM pyr"


def haar_levels(spark, sf_dir):
    """Levels of frames of the sizes that ``part`` holds: width by p_size, height by p_retailprice."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    sizes = t.select((F.col("p_size") * 37 + 24).cast("int").alias("width"), (F.floor(F.col("p_retailprice") / 100) * 50 + 24).cast("int").alias("height")).distinct()
    return pyramid.level_table(sizes)


_half_up = lambda x: f"CAST(floor({x} + CAST(0.5 AS FLOAT)) AS INT)"
_smaller = lambda c: f"greatest({haar.SIDE}, {_half_up(f'CAST({c} AS FLOAT) / CAST(1.2 AS FLOAT)')})"
_BOX = _half_up(f"CAST({haar.SIDE} AS FLOAT) * scale")
LEVELS_SQL = f"""WITH RECURSIVE sizes AS (SELECT DISTINCT CAST(p_size * 37 + 24 AS INT) AS fw, CAST(floor(p_retailprice / 100) * 50 + 24 AS INT) AS fh FROM part),
l(fw, fh, level, width, height, scale) AS (SELECT fw, fh, 0, fw, fh, CAST(1 AS FLOAT) FROM sizes WHERE least(fw, fh) >= {haar.SIDE} UNION ALL
SELECT fw, fh, level + 1, nw, nh, CAST(fw AS FLOAT) / CAST(nw AS FLOAT) FROM (SELECT *, {_smaller("width")} AS nw, {_smaller("height")} AS nh FROM l) WHERE nw < width AND nh < height AND least(nw, nh) > {haar.SIDE}),
b AS (SELECT *, {_BOX} AS box, greatest(2, {_half_up("CAST(4 AS FLOAT) * scale")}) AS stride FROM l)
SELECT fw AS width, fh AS height, CAST(level AS INT) AS level, width AS level_width, height AS level_height, scale, box, stride, CAST(((width - {haar.SIDE}) // stride + 1) * ((height - {haar.SIDE}) // stride + 1) AS INT) AS windows FROM b WHERE box <= 1024"""


def _open_windows(spark, sf_dir, tilted: bool = False):
    base = tiled(spark, sf_dir)
    table = materialise(pyramid.prefix_tables(pyramid.pyramid(base, WIDTH, HEIGHT), tilted), "prefix")
    return pyramid.normed(pyramid.all_windows(base.select("frame").distinct(), WIDTH, HEIGHT, haar.Settings()), table, haar.Settings().variance), table


def haar_responses(spark, sf_dir):
    """Normalised responses of every feature in every window of every level that passes the variance filter."""
    open_, table = _open_windows(spark, sf_dir)
    found = pyramid.looked_up(open_, table, pyramid.features_of(_CASCADE, range(len(_CASCADE.stages)))).join(open_, pyramid.WINDOW)
    return found.select(*pyramid.WINDOW, "feature", F.round((F.col("response").cast("float") * F.col("norm")).cast("double"), 5).alias("value"))


RESPONSES_SQL = f"WITH {TABLES_SQL}, {_cascade_sql(_CASCADE)} SELECT frame, CAST(level AS INT) AS level, wx, wy, CAST(feature AS INT) AS feature, round(CAST(CAST(raw AS FLOAT) * norm AS DOUBLE), 5) AS value FROM resp JOIN ok USING (frame, level, wx, wy) WHERE feature IN (SELECT feature FROM weak)"


def haar_stages(spark, sf_dir):
    """Totals of every stage in the windows that pass the variance filter, without early ends."""
    open_, table = _open_windows(spark, sf_dir)
    found = pyramid.looked_up(open_, table, pyramid.features_of(_CASCADE, range(len(_CASCADE.stages)))).join(open_, pyramid.WINDOW)
    value = (F.col("response").cast("float") * F.col("norm")).cast("float")
    held = found.groupBy(*pyramid.WINDOW).agg(F.map_from_entries(F.collect_list(F.struct("feature", value.alias("value")))).alias("values"))
    totals = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(float(t)).alias("least"), F.round(pyramid.stage_total(weak, lambda f: F.element_at("values", f)).cast("double"), 5).alias("total")) for s, (t, weak) in enumerate(_CASCADE.stages)))
    return held.select(*pyramid.WINDOW, F.explode(totals).alias("t")).select(*pyramid.WINDOW, "t.stage", "t.total", (F.col("t.total") >= F.col("t.least")).alias("passed"))


STAGES_SQL = f"WITH {TABLES_SQL}, {_cascade_sql(_CASCADE)}, {_VOTES_SQL} SELECT frame, CAST(level AS INT) AS level, wx, wy, CAST(stage AS INT) AS stage, total, total >= least AS passed FROM st JOIN stages USING (stage)"


def haar_accepted(spark, sf_dir):
    """Windows of all levels that pass all stages, found by a chain of filters."""
    return pyramid.accepted_windows(tiled(spark, sf_dir), WIDTH, HEIGHT).select(*pyramid.WINDOW, F.round(F.col("score").cast("double"), 4).alias("score"))


ACCEPTED_SQL = f"WITH {TABLES_SQL}, {_cascade_sql(_CASCADE)}, {_VOTES_SQL} SELECT frame, CAST(level AS INT) AS level, wx, wy, score FROM acc"


def haar_detect(spark, sf_dir):
    """Boxes of every frame: all levels, windows, stages and suppression as one plan."""
    return pyramid.detect_pyramid(tiled(spark, sf_dir), WIDTH, HEIGHT).withColumn("score", F.round("score", 4))


def haar_kinds(spark, sf_dir):
    """Windows that pass a cascade of all kinds of features, tilted ones included."""
    return pyramid.accepted_windows(tiled(spark, sf_dir), WIDTH, HEIGHT, every_kind()).select(*pyramid.WINDOW, F.round(F.col("score").cast("double"), 4).alias("score"))


KINDS_SQL = f"WITH {TABLES_SQL}, {_cascade_sql(every_kind())}, {_VOTES_SQL} SELECT frame, CAST(level AS INT) AS level, wx, wy, score FROM acc"


def stage_trace(spark, sf_dir):
    """Un-normalised responses, signed votes, stage totals and the first failing stage of every window."""
    out = pyramid.stage_trace(tiled(spark, sf_dir), WIDTH, HEIGHT, every_kind())
    return out.select(*pyramid.WINDOW, "stage", "weak", "feature", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("response", "vote", "total")), "failed")


TRACE_SQL = f"""WITH {TABLES_SQL}, {_cascade_sql(every_kind(), "win")},
votes AS (SELECT frame, level, wx, wy, stage, no, feature, CAST(raw AS FLOAT) AS response, CASE WHEN (CAST(raw AS FLOAT) > CAST(threshold AS FLOAT)) = (sign > 0) THEN r ELSE l END AS vote FROM resp JOIN weak USING (feature)),
totals AS (SELECT *, sum(vote) OVER (PARTITION BY frame, level, wx, wy, stage) AS total FROM votes)
SELECT frame, CAST(level AS INT) AS level, wx, wy, CAST(stage AS INT) AS stage, CAST(no AS INT) AS weak, CAST(feature AS INT) AS feature, round(CAST(response AS DOUBLE), 4) AS response, round(CAST(vote AS DOUBLE), 4) AS vote, round(CAST(total AS DOUBLE), 4) AS total,
CAST(min(CASE WHEN total < least THEN stage END) OVER (PARTITION BY frame, level, wx, wy) AS INT) AS failed FROM totals JOIN stages USING (stage)"""

QUERIES = {
    "pyramid_pixels": (pyramid_pixels, PIXELS_OF_LEVELS_SQL), "haar_levels": (haar_levels, LEVELS_SQL), "haar_responses": (haar_responses, RESPONSES_SQL), "haar_stages": (haar_stages, STAGES_SQL),
    "haar_accepted": (haar_accepted, ACCEPTED_SQL), "haar_detect": (haar_detect, _detect_sql(_CASCADE)), "haar_kinds": (haar_kinds, KINDS_SQL), "stage_trace": (stage_trace, TRACE_SQL),
}
