"""Queries on the job store. Jobs are orders, frames their lines, faces the lines with a large quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import jobs as j

JOBS_SQL = """jobs AS (SELECT o_orderkey AS id, c_name AS display_name, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'queued' ELSE 'running' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE 'error' END END AS status,
CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lower(substr(o_orderpriority, 3)) END AS algo, epoch_ms(o_orderdate) AS created_ms, CAST(floor(o_totalprice) AS BIGINT) AS elapsed_ms, o_custkey % 50 AS detections, o_custkey % 300 AS frames_processed, o_custkey % 90 AS frames_with_face,
's3://in/' || o_orderkey AS original_key, o_custkey AS owner FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
frames AS (SELECT DISTINCT l_orderkey AS job_id, l_linenumber AS idx, CASE WHEN l_linenumber > 1 THEN 'local://' || l_orderkey || '/' || l_linenumber END AS annotated_key FROM lineitem),
faces AS (SELECT l_orderkey AS job_id, l_linenumber AS idx, l_extendedprice AS score FROM lineitem WHERE l_quantity > 25)"""


def jobs(spark: SparkSession, sf_dir: str, merge: bool = False) -> DataFrame:
    """``merge``: customers are never broadcast, whatever Spark guesses of their size."""
    o, c = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", F.when(key % 7 == 0, "queued").otherwise("running")).otherwise(F.when(key % 2 == 0, "cancelled").otherwise("error"))
    return o.join(c.hint("merge") if merge else c, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        key.alias("id"), F.col("c_name").alias("display_name"), status.alias("status"), F.when(key % 11 == 0, "").otherwise(F.lower(F.substring("o_orderpriority", 3, 99))).alias("algo"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"),
        F.floor("o_totalprice").alias("elapsed_ms"), (F.col("o_custkey") % 50).alias("detections"), (F.col("o_custkey") % 300).alias("frames_processed"), (F.col("o_custkey") % 90).alias("frames_with_face"), F.concat(F.lit("s3://in/"), key.cast("string")).alias("original_key"), F.col("o_custkey").alias("owner"),
    )


def frames(spark, sf_dir):
    l, n = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_linenumber")
    return l.select(F.col("l_orderkey").alias("job_id"), n.alias("idx"), F.when(n > 1, F.concat(F.lit("local://"), F.col("l_orderkey").cast("string"), F.lit("/"), n.cast("string"))).alias("annotated_key")).distinct()


def faces(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 25").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("idx"), F.col("l_extendedprice").alias("score"))


def algo_stats(spark, sf_dir):
    return j.algo_stats(jobs(spark, sf_dir))


ALGO_SQL = f"""WITH {JOBS_SQL}, s AS (SELECT coalesce(nullif(algo, ''), 'pending') AS algo, count(*) FILTER (status IN ('done','cancelled','error')) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'cancelled') AS cancelled,
count(*) FILTER (status = 'error') AS error, count(*) FILTER (status IN ('queued','running')) AS active, CAST(coalesce(sum(elapsed_ms) FILTER (status IN ('done','cancelled','error')), 0) AS BIGINT) AS elapsed_ms, CAST(sum(detections) AS BIGINT) AS detections FROM jobs GROUP BY 1)
SELECT *, coalesce(elapsed_ms // nullif(total, 0), 0) AS avg_elapsed_ms FROM s"""


def metrics_totals(spark, sf_dir):
    return j.metrics(jobs(spark, sf_dir))


METRICS_SQL = f"""WITH {JOBS_SQL} SELECT count(*) FILTER (status='running') AS running, count(*) FILTER (status='queued') AS queued, count(*) FILTER (status='error') AS errored, count(*) FILTER (status='cancelled') AS cancelled,
CAST(sum(frames_processed) AS BIGINT) AS total_frames_processed, CAST(sum(frames_with_face) AS BIGINT) AS total_frames_with_face, CAST(sum(detections) AS BIGINT) AS total_detections FROM jobs"""


def job_page(spark, sf_dir):
    return j.page(jobs(spark, sf_dir).select("id", "status", "created_ms"), 50, 100)


PAGE_SQL = f"WITH {JOBS_SQL} SELECT id, status, created_ms, (SELECT count(*) FROM jobs) AS total_jobs FROM jobs ORDER BY created_ms DESC, id LIMIT 50 OFFSET 100"


def tab_counts(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy(j.group_of(F.col("status")).alias("tab")).agg(F.count("*").alias("n"))


TAB_SQL = f"WITH {JOBS_SQL} SELECT CASE WHEN status IN ('queued','running') THEN 'running' WHEN status = 'done' THEN 'done' ELSE 'error' END AS tab, count(*) AS n FROM jobs GROUP BY 1"


def dashboard_hours(spark, sf_dir):
    """Ages against the newest job; an order's hour is its key within the day, for orders carry dates only."""
    base = jobs(spark, sf_dir).select((F.col("created_ms") + F.col("id") % 86400 * 1000).alias("created_ms"))
    now = base.agg(F.max("created_ms").alias("now"))
    return j.hourly(base.join(F.broadcast(now)), F.col("now"))


HOURS_SQL = f"""WITH {JOBS_SQL}, b AS (SELECT created_ms + id % 86400 * 1000 AS created_ms FROM jobs), a AS (SELECT 23 - CAST(floor(((SELECT max(created_ms) FROM b) - created_ms) / 3600000) AS BIGINT) AS bucket FROM b)
SELECT r.i AS bucket, count(a.bucket) AS n FROM range(24) r(i) LEFT JOIN a ON a.bucket = r.i GROUP BY 1"""


def dashboard_algos(spark, sf_dir):
    """Boxes by algorithm, a job without any counts as one; algorithms without jobs are listed with 0."""
    known = spark.createDataFrame([(a,) for a in ("haar", "cnn", "yunet", "mtcnn", "hog")], "algo string").withColumn("n", F.lit(0).cast("bigint"))
    own = jobs(spark, sf_dir).where("algo != ''").select("algo", F.when(F.col("detections") > 0, F.col("detections")).otherwise(1).alias("n"))
    return own.union(known).groupBy("algo").agg(F.sum("n").alias("n"))


ALGOS_SQL = f"WITH {JOBS_SQL}, u AS (SELECT algo, greatest(detections, 1) AS n FROM jobs WHERE algo != '' UNION ALL SELECT unnest(['haar','cnn','yunet','mtcnn','hog']), 0) SELECT algo, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY algo"


def job_search(spark, sf_dir):
    return j.search(jobs(spark, sf_dir), "R#00000012", group="done").select("id", "display_name", "status")


SEARCH_SQL = f"WITH {JOBS_SQL} SELECT id, display_name, status FROM jobs WHERE status = 'done' AND (contains(lower(display_name), 'r#00000012') OR contains(CAST(id AS VARCHAR), 'r#00000012'))"


def job_search_regex(spark, sf_dir):
    return j.search(jobs(spark, sf_dir), "mer#0+1[0-4]+$|^77", regex=True, group="running").select("id", "display_name", "status")


REGEX_SQL = f"WITH {JOBS_SQL} SELECT id, display_name, status FROM jobs WHERE status IN ('queued','running') AND (regexp_matches(display_name, '(?i)mer#0+1[0-4]+$|^77') OR regexp_matches(CAST(id AS VARCHAR), '(?i)mer#0+1[0-4]+$|^77'))"


def job_detail(spark, sf_dir):
    return j.detail(jobs(spark, sf_dir), frames(spark, sf_dir), faces(spark, sf_dir))


DETAIL_SQL = f"""WITH {JOBS_SQL}, pf AS (SELECT job_id, idx, count(*) AS n, max(score) AS top FROM faces GROUP BY 1, 2), pj AS (SELECT job_id, count(*) AS n_frames, count(n) AS n_face_frames, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_faces, max(top) AS top_score,
arg_min(annotated_key, idx) FILTER (annotated_key IS NOT NULL) AS cover FROM frames LEFT JOIN pf USING (job_id, idx) GROUP BY 1)
SELECT id, coalesce(n_frames, 0) AS n_frames, coalesce(n_face_frames, 0) AS n_face_frames, coalesce(n_faces, 0) AS n_faces, top_score, coalesce(cover, original_key) AS cover_key FROM jobs LEFT JOIN pj ON job_id = id"""


def upsert_latest(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = [c for c in l.columns if c != "id"]
    return j.latest(l, "id", order).select("id", F.col("l_linenumber").alias("seq"), F.col("l_extendedprice").alias("value"))


_LAST = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC)"
UPSERT_SQL = f"SELECT l_orderkey AS id, l_linenumber AS seq, l_extendedprice AS value FROM lineitem QUALIFY {_LAST} = 1"


def insert_ignore(spark, sf_dir):
    """Frames that are stored, and of new ones those whose key is not: the first write wins."""
    all_frames = frames(spark, sf_dir).select("job_id", "idx")
    old = all_frames.where("idx <= 3").withColumn("origin", F.lit("old"))
    return j.insert_ignore(old, all_frames.where("idx >= 2").withColumn("origin", F.lit("new")), ["job_id", "idx"])


INSERT_SQL = f"WITH {JOBS_SQL} SELECT DISTINCT job_id, idx, CASE WHEN idx <= 3 THEN 'old' ELSE 'new' END AS origin FROM frames"


def batch_delete(spark, sf_dir):
    """Frames that are left when all failed jobs are deleted."""
    gone = jobs(spark, sf_dir).where(F.col("status").isin(*j.FAILED)).select(F.col("id").alias("job_id"))
    return frames(spark, sf_dir).select("job_id", "idx").join(gone, "job_id", "left_anti")


DELETE_SQL = f"WITH {JOBS_SQL} SELECT job_id, idx FROM frames WHERE job_id NOT IN (SELECT id FROM jobs WHERE status IN ('error','cancelled'))"


def admission(spark, sf_dir):
    return j.admitted(jobs(spark, sf_dir), 2, "owner")


ADMISSION_SQL = f"WITH {JOBS_SQL}, a AS (SELECT owner, id, CAST(row_number() OVER (PARTITION BY owner ORDER BY created_ms, id) AS INT) AS at FROM jobs WHERE status IN ('queued','running')) SELECT owner, id, \"at\", CASE WHEN \"at\" <= 2 THEN 'run' WHEN \"at\" <= 6 THEN 'wait' ELSE 'reject' END AS state FROM a".replace("AS at FROM", 'AS "at" FROM')


def pinned_first(spark, sf_dir):
    """Each owner's jobs, pinned ones (every ninth id) first, then the newest, with their place."""
    from pyspark.sql import Window

    pin = F.when(F.col("id") % 9 == 0, 0).otherwise(1)
    return jobs(spark, sf_dir).select("owner", "id", F.row_number().over(Window.partitionBy("owner").orderBy(pin, F.desc("created_ms"), "id")).alias("place"))


PINNED_SQL = f"WITH {JOBS_SQL} SELECT owner, id, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN id % 9 = 0 THEN 0 ELSE 1 END, created_ms DESC, id) AS INT) AS place FROM jobs"


def range_header(spark, sf_dir):
    """Byte ranges asked of objects: all forms of a header, on every part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("bigint").alias("total"))
    k = F.col("p_partkey").cast("string")
    forms = F.array(F.concat(F.lit("bytes="), k, F.lit("-")), F.concat(F.lit("bytes=-"), k), F.concat(F.lit("bytes=3-"), k), F.lit("bytes=0-1,4-5"), F.lit("items=0-1"), F.lit("bytes=x-2"))
    p = p.withColumn("header", F.element_at(forms, (F.col("p_partkey") % 6 + 1).cast("int")))
    return p.select("p_partkey", "header", *(c.alias(n) for n, c in t.byte_range(F.col("header"), F.col("total")).items()))


RANGE_SQL = """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS total, ['bytes='||p_partkey||'-', 'bytes=-'||p_partkey, 'bytes=3-'||p_partkey, 'bytes=0-1,4-5', 'items=0-1', 'bytes=x-2'][p_partkey % 6 + 1] AS header FROM part),
q AS (SELECT *, regexp_matches(header, '^bytes=\\d*-\\d*$') AS form, TRY_CAST(regexp_extract(header, '^bytes=(\\d*)-(\\d*)$', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(header, '^bytes=(\\d*)-(\\d*)$', 2) AS BIGINT) AS b FROM p)
SELECT p_partkey, header, CASE WHEN form AND a >= total THEN 'unsatisfiable' WHEN form AND (a IS NOT NULL OR b IS NOT NULL) THEN 'range' ELSE 'full' END AS state,
CASE WHEN form AND a IS NULL AND b IS NOT NULL THEN greatest(total-b, 0) WHEN form AND a < total THEN a END AS first, CASE WHEN form AND a IS NULL AND b IS NOT NULL THEN greatest(total-1, 0) WHEN form AND a < total THEN least(b, total-1) END AS last FROM q"""


def media_keys(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    scheme = F.element_at(F.array(*map(F.lit, ("s3://", "local://", "inline://", "ftp://"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    key = F.concat(scheme, F.col("o_orderpriority"), F.lit("."), F.col("o_orderstatus"), F.lit("_Jpeg7!"))
    return o.select("o_orderkey", t.storage_of(key).alias("storage"), t.safe_extension(key).alias("ext"), t.job_id(F.col("o_orderkey") * 100000, F.col("o_custkey") % 70000).alias("job"), t.highlight(F.col("o_orderpriority"), "e").alias("marked"))


KEYS_SQL = """WITH k AS (SELECT *, ['s3://','local://','inline://','ftp://'][o_orderkey % 4 + 1] || o_orderpriority || '.' || o_orderstatus || '_Jpeg7!' AS key FROM orders)
SELECT o_orderkey, regexp_extract(key, '^(s3|local|inline)://', 1) AS storage, substr(regexp_replace(lower(regexp_extract(key, '\\.([^.]*)$', 1)), '[^a-z0-9]', '', 'g'), 1, 5) AS ext,
lower(to_hex(o_orderkey * 100000)) || '-' || lpad(lower(to_hex(o_custkey % 70000)), 4, '0') AS job, regexp_replace(o_orderpriority, '(?i)(e)', '<mark>\\1</mark>', 'g') AS marked FROM k"""

def deleted_everywhere(spark, sf_dir):
    """What is left of each table when failed jobs are deleted with their frames and faces."""
    gone = jobs(spark, sf_dir).where(F.col("status").isin(*j.FAILED)).select(F.col("id").alias("job_id"))
    kinds = {"jobs": jobs(spark, sf_dir).select(F.col("id").alias("job_id")), "frames": frames(spark, sf_dir), "faces": faces(spark, sf_dir)}
    counts = [df.join(gone, "job_id", "left_anti").agg(F.count("*").alias("left")).select(F.lit(k).alias("kind"), "left") for k, df in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_KEPT = "NOT IN (SELECT id FROM jobs WHERE status IN ('error','cancelled'))"
EVERYWHERE_SQL = f"WITH {JOBS_SQL} SELECT 'jobs' AS kind, count(*) AS \"left\" FROM jobs WHERE id {_KEPT} UNION ALL SELECT 'frames', count(*) FROM frames WHERE job_id {_KEPT} UNION ALL SELECT 'faces', count(*) FROM faces WHERE job_id {_KEPT}"


def tab_counts_in_range(spark, sf_dir):
    """Jobs by tab among those of the last 365 days before the newest."""
    base = jobs(spark, sf_dir)
    newest = base.agg(F.max("created_ms").alias("newest"))  # one row
    recent = base.join(F.broadcast(newest)).where(F.col("created_ms") >= F.col("newest") - 365 * 86_400_000)
    return recent.groupBy(j.group_of(F.col("status")).alias("tab")).agg(F.count("*").alias("n"))


RANGE_TAB_SQL = TAB_SQL.replace("FROM jobs GROUP BY", "FROM jobs WHERE created_ms >= (SELECT max(created_ms) FROM jobs) - 365 * 86400000::BIGINT GROUP BY")


def face_frames(spark, sf_dir):
    """Frames with faces: how many, the best score, and the neighbours within the job."""
    from pyspark.sql import Window

    by = faces(spark, sf_dir).groupBy("job_id", "idx").agg(F.count("*").alias("n_faces"), F.max("score").alias("top_score"))
    order = Window.partitionBy("job_id").orderBy("idx")
    return by.select("job_id", "idx", "n_faces", "top_score", F.lag("idx").over(order).alias("previous"), F.lead("idx").over(order).alias("next"))


FACE_FRAMES_SQL = f"WITH {JOBS_SQL}, b AS (SELECT job_id, idx, count(*) AS n_faces, max(score) AS top_score FROM faces GROUP BY job_id, idx) SELECT *, lag(idx) OVER w AS previous, lead(idx) OVER w AS next FROM b WINDOW w AS (PARTITION BY job_id ORDER BY idx)"

def job_export(spark, sf_dir):
    """Each job as one JSON text: its numbers, and its frames in order with their faces; nulls are written."""
    face = F.struct(F.col("score").cast("long").alias("score"), F.col("key").alias("key"), media_url(F.col("key")).alias("url"))
    by_frame = faces(spark, sf_dir).withColumn("key", F.concat_ws("/", F.lit("s3://crops"), "job_id", "idx")).groupBy("job_id", "idx").agg(F.array_sort(F.collect_list(face)).alias("faces"))
    shown = F.struct(F.col("idx").alias("index"), "annotated_key", media_url(F.col("annotated_key")).alias("annotated_url"), F.coalesce("faces", F.array()).alias("faces"))
    by_job = frames(spark, sf_dir).join(by_frame, ["job_id", "idx"], "left").groupBy("job_id").agg(F.array_sort(F.collect_list(shown)).alias("frames"), F.sum(F.size(F.coalesce("faces", F.array()))).alias("face_count"))
    stats = F.struct("frames_processed", "frames_with_face", F.col("detections").alias("total_detections"))
    made = F.struct("id", "display_name", "status", "created_ms", stats.alias("stats"), F.coalesce("face_count", F.lit(0)).alias("face_count"), F.size(F.coalesce("frames", F.array())).cast("long").alias("frame_count"), F.coalesce("frames", F.array()).alias("frames"))
    return jobs(spark, sf_dir).join(by_job, F.col("id") == F.col("job_id"), "left").select("id", F.to_json(made, {"ignoreNullFields": "false"}).alias("json"))


def media_url(key):
    """The address under which a key is shown: what follows the scheme, behind the media path; null for null."""
    return F.concat(F.lit("/media/"), F.regexp_replace(key, "^[a-z0-9]+://", ""))


_URL = lambda k: f"'/media/' || regexp_replace({k}, '^[a-z0-9]+://', '')"
EXPORT_SQL = f"""WITH {JOBS_SQL}, f AS (SELECT job_id, idx, CAST(score AS DOUBLE) AS score, concat_ws('/', 's3://crops', job_id, idx) AS key FROM faces),
bf AS (SELECT job_id, idx, list({{'score': CAST(trunc(score) AS BIGINT), 'key': key, 'url': {_URL("key")}}} ORDER BY trunc(score), key) AS faces FROM f GROUP BY job_id, idx),
bj AS (SELECT job_id, list({{'index': fr.idx, 'annotated_key': annotated_key, 'annotated_url': {_URL("annotated_key")}, 'faces': coalesce(faces, [])}} ORDER BY fr.idx, annotated_key) AS frames, CAST(sum(coalesce(len(faces), 0)) AS BIGINT) AS face_count FROM frames fr LEFT JOIN bf USING (job_id, idx) GROUP BY job_id)
SELECT id, CAST(to_json({{'id': id, 'display_name': display_name, 'status': status, 'created_ms': created_ms, 'stats': {{'frames_processed': frames_processed, 'frames_with_face': frames_with_face, 'total_detections': detections}}, 'face_count': coalesce(face_count, 0), 'frame_count': coalesce(len(bj.frames), 0), 'frames': coalesce(bj.frames, [])}}) AS VARCHAR) AS json FROM jobs LEFT JOIN bj ON job_id = id"""


def store_rows(spark, sf_dir):
    """What a store holds after jobs were put in, frames and faces added twice (the second time with other values), and every third customer's jobs deleted."""
    from ..sources.store import Store
    from .tables import new_path

    every = jobs(spark, sf_dir, merge=True)
    rows = every.select(F.col("id").alias("job_id"), F.lit("video").alias("kind"), "display_name", "status", "created_ms", "frames_processed", "frames_with_face", F.col("detections").alias("total_detections"), "original_key", "algo")
    shot = frames(spark, sf_dir).select("job_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") * 33).cast("long").alias("timestamp_ms"), "annotated_key")
    found = faces(spark, sf_dir).groupBy("job_id", "idx").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    found = found.select("job_id", F.col("idx").cast("long").alias("frame_idx"), F.lit(0).alias("face_idx"), F.lit("k").alias("key"), F.lit(1).alias("x"), F.lit(1).alias("y"), F.col("n").cast("int").alias("w"), F.lit(9).alias("h"), F.col("score").cast("float").alias("score"))
    store = Store(spark, new_path(spark, "store"))
    store.upsert_jobs(rows)
    store.upsert_jobs(rows.where("status = 'running'").select("job_id", F.lit("done").alias("status")))
    store.add_frames(shot, found)
    store.add_frames(shot.withColumn("timestamp_ms", F.lit(-1).cast("long")), found.withColumn("h", F.lit(-1)))
    store.delete_jobs(every.where("owner % 3 = 0").select(F.col("id").alias("job_id")))
    per_frame = store.read("frames").groupBy("job_id").agg(F.count("*").alias("n_frames"), F.sum("timestamp_ms").alias("times"))
    per_face = store.read("faces").groupBy("job_id").agg(F.sum("w").alias("n_faces"), F.max("h").alias("h"))
    left = store.read("jobs").join(per_frame, "job_id", "full").join(per_face, "job_id", "full")
    return left.select("job_id", "status", "total_detections", "algo", "n_frames", "times", "n_faces", "h")


STORE_SQL = f"""WITH {JOBS_SQL}, j AS (SELECT * FROM jobs WHERE owner % 3 <> 0 OR owner IS NULL),
f AS (SELECT job_id, count(*) AS n_frames, CAST(sum(idx * 33) AS BIGINT) AS times FROM frames GROUP BY job_id), c AS (SELECT job_id, count(*) AS n_faces FROM faces GROUP BY job_id)
SELECT j.id AS job_id, CASE WHEN status = 'running' THEN 'done' ELSE status END AS status, detections AS total_detections, algo, n_frames, times, n_faces, CASE WHEN n_faces > 0 THEN 9 END AS h FROM j LEFT JOIN f ON f.job_id = j.id LEFT JOIN c ON c.job_id = j.id
UNION ALL SELECT coalesce(f.job_id, c.job_id), NULL, NULL, NULL, n_frames, times, n_faces, CASE WHEN n_faces > 0 THEN 9 END FROM f FULL JOIN c ON c.job_id = f.job_id WHERE coalesce(f.job_id, c.job_id) NOT IN (SELECT id FROM jobs)"""

def job_rules(spark, sf_dir):
    """Whether each job can be run again; a kind by the id, every eighth without an input."""
    kind = F.element_at(F.array(*map(F.lit, ("image", "video", "stream"))), (F.col("id") % 3 + 1).cast("int"))
    return jobs(spark, sf_dir).select("id", kind.alias("kind"), j.retry_rule(kind, F.when(F.col("id") % 8 != 0, F.col("original_key"))).alias("rule"))


RULES_SQL = f"WITH {JOBS_SQL}, k AS (SELECT id, ['image', 'video', 'stream'][id % 3 + 1] AS kind FROM jobs) SELECT id, kind, CASE WHEN id % 8 = 0 THEN 'no original input' WHEN kind = 'image' THEN 'image retry requires a new upload' ELSE 'retry' END AS rule FROM k"


def batch_operations(spark, sf_dir):
    """Jobs after a batch of requests: the lines of an order ask for it to be deleted, archived or exported, by their flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 40")
    op = F.when(F.col("l_returnflag") == "A", "archive").when(F.col("l_returnflag") == "R", "export").when(F.col("l_linestatus") == "O", F.lit(None)).otherwise("other")
    return j.batch_operation(jobs(spark, sf_dir).select("id", "status"), lines.select(F.col("l_orderkey").alias("id"), op.alias("op")))


OPERATIONS_SQL = f"""WITH {JOBS_SQL}, w AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'N' AND l_linestatus = 'O') AS d, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS e FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT jobs.id AS id, CASE WHEN coalesce(d, false) AND status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status, coalesce(a, false) AS archived, coalesce(d, false) AS removed, coalesce(e, false) AS exported FROM jobs LEFT JOIN w USING (id)"""


def config_status(spark, sf_dir):
    """Mode and file states of a configuration for each part: size and brand say what is set and what is there."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = j.config_status(F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.col("p_size") % 4 < 2, F.col("p_size") % 5 > 0)
    return t.select("p_partkey", found.alias("c")).select("p_partkey", "c.*")


CONFIG_SQL = """SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN 'cnn' ELSE 'haar' END AS mode, CASE WHEN p_size % 2 <> 0 AND p_size % 3 <> 0 THEN 'n/a' WHEN p_size % 3 <> 0 THEN 'template' WHEN p_size % 4 < 2 THEN 'available' ELSE 'missing' END AS weights_status,
CASE WHEN p_size % 5 > 0 THEN 'available' ELSE 'missing' END AS cascade_status FROM part"""

QUERIES = {
    "job_rules": (job_rules, RULES_SQL), "batch_operations": (batch_operations, OPERATIONS_SQL), "config_status": (config_status, CONFIG_SQL),
    "job_export": (job_export, EXPORT_SQL), "store_rows": (store_rows, STORE_SQL),
    "deleted_everywhere": (deleted_everywhere, EVERYWHERE_SQL), "tab_counts_in_range": (tab_counts_in_range, RANGE_TAB_SQL), "face_frames": (face_frames, FACE_FRAMES_SQL),
    "algo_stats": (algo_stats, ALGO_SQL), "metrics_totals": (metrics_totals, METRICS_SQL), "job_page": (job_page, PAGE_SQL), "tab_counts": (tab_counts, TAB_SQL), "dashboard_hours": (dashboard_hours, HOURS_SQL), "dashboard_algos": (dashboard_algos, ALGOS_SQL),
    "job_search": (job_search, SEARCH_SQL), "job_search_regex": (job_search_regex, REGEX_SQL), "job_detail": (job_detail, DETAIL_SQL), "upsert_latest": (upsert_latest, UPSERT_SQL), "insert_ignore": (insert_ignore, INSERT_SQL), "batch_delete": (batch_delete, DELETE_SQL),
    "admission": (admission, ADMISSION_SQL), "pinned_first": (pinned_first, PINNED_SQL), "range_header": (range_header, RANGE_SQL), "media_keys": (media_keys, KEYS_SQL),
}
