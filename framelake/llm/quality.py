"""Quality rules whose cutoffs limit false rejections: exact binomial bounds on a labelled holdout, per stratum.

One half of the labelled documents, by a hash of their ids, puts the cutoffs of all rules in one order, best first. The other
half, the holdout, tests the growing sets of them in that order: the set's joint false rejections must be so few that a true
rate above RISK is ruled out. A fixed sequence needs no correction within a stratum, as it ends at the first set that does not
pass; between strata delta is divided.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hint, let, materialise, text_or_empty, whole_row, word_list

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
#: Strata by language; every other value, null included, is one more stratum.
STRATA = ("en", "fr", "de", "es")
OTHER = "other"


class Rule(NamedTuple):
    """Reject where ``feature`` exceeds a cutoff; features are whole numbers, shares in thousandths."""

    feature: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols_pm", (5, 10, 20, 40, 80, 160, 320)),
    Rule("digits_pm", (20, 40, 80, 160, 320, 640)),
    Rule("dup_lines_pm", (50, 100, 200, 300, 400, 600, 800)),
    Rule("repeats_pm", (50, 100, 150, 200, 300, 400)),
    Rule("word_length_c", (700, 800, 900, 1000, 1200, 1500, 2000)),
    Rule("short_words_c", (-450, -400, -350, -300, -250, -200)),
)
#: Share of good documents of a stratum that all rules together may reject, and the chance that a bound fails anywhere.
RISK, DELTA = 0.02, 0.05
#: Good documents rejected count as so many bad ones when cutoffs are put in order.
COST = 10
#: Seed of the hash that parts the labelled documents.
HALVES = 7


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by a 64-bit hash."""

    def count(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - at, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def twice(windows: Column) -> Column:
        def equal(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(windows, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(windows, equal), lambda x: x["i"]))

    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    return let(words, lambda w: F.when(F.size(w) < 3, 0).otherwise(let(windows(w), lambda s: let(twice(s), count)))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    spaces = F.length(text) - F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    found = let(word_list(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "found": found, "by_line": by_line, "word_chars": (F.length(text) - spaces).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"), "n_digits": (F.length(text) - F.length(F.translate(text, DIGITS, ""))).cast("long"),
    }


def features(df: DataFrame, columns: list[Column], text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``columns``, ``stratum`` and the measures and rule features of every whole text; null counts as empty."""
    lang = F.col(stratum_col) if stratum_col in df.columns else F.lit(None).cast("string")
    stratum = F.when(lang.isin(*STRATA), lang).otherwise(F.lit(OTHER))
    raw = df.select(*columns, stratum.alias("stratum"), *(c.alias(k) for k, c in measures(text_or_empty(text_col)).items()))
    flat = raw.select(*[c for c in raw.columns if c not in ("found", "by_line")], "found.*", "by_line.*")
    per = lambda a, b, times: F.expr(f"coalesce(({times} * {a}) div nullif({b}, 0), 0)")
    return flat.select(
        "*", per("n_symbols", "word_chars", 1000).alias("symbols_pm"), per("n_digits", "word_chars", 1000).alias("digits_pm"), per("n_dup_lines", "n_lines", 1000).alias("dup_lines_pm"),
        per("n_repeat_words", "n_words", 1000).alias("repeats_pm"), per("word_chars", "n_words", 100).alias("word_length_c"), (-per("word_chars", "n_words", 100)).alias("short_words_c"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) of a binomial variable of ``n`` trials with chance ``risk``: the exact sum, its terms by recurrence in logs."""
    odds = math.log(risk / (1 - risk))
    first = n * math.log(1 - risk)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.cast("double").alias("term"), F.exp(first).alias("sum")), add, lambda acc: acc["sum"])


def ordered_cutoffs(tune: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``stratum``, ``step`` (from 1), ``feature``, ``cutoff``: the cutoffs that reject bad documents at a fair price, in order.

    ``tune``: ``stratum``, ``good`` boolean and the features. A cutoff is fair if it rejects more than COST bad documents for
    each good one; they stand by good ones per bad one, then by most bad ones, then as in ``rules``, mild before strict.
    Counts combine before the shuffle: one row of sums for each stratum and task.
    """
    good = F.coalesce(F.col("good"), F.lit(False))
    steps = [(r.feature, c) for r in rules for c in sorted(r.cutoffs, reverse=True)]
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = lambda i, f, c: F.struct(F.lit(i).alias("place"), F.lit(f).alias("feature"), F.lit(c).cast("long").alias("cutoff"), count(good & (F.col(f) > c)).alias("k"), count(~good & (F.col(f) > c)).alias("b")).alias(f"t_{i}")
    sums = tune.groupBy("stratum").agg(*(one(i, f, c) for i, (f, c) in enumerate(steps)))
    rows = sums.select("stratum", F.explode(F.array(*(f"t_{i}" for i in range(len(steps))))).alias("t")).select("stratum", "t.*")
    order = Window.partitionBy("stratum").orderBy(F.col("k") / F.col("b"), F.desc("b"), "place")
    return rows.where(F.col("b") > COST * F.col("k")).select("stratum", F.row_number().over(order).alias("step"), "feature", "cutoff")


def first_step(steps: list[tuple[str, int, str, int]]) -> Column:
    """The first of a stratum's steps (stratum, step, feature, cutoff) that rejects a row, null if none does."""
    hit = [F.when((F.col("stratum") == s) & (F.col(f) > c), F.lit(i)) for s, i, f, c in sorted(steps)]
    return F.array_min(F.array(*hit)) if hit else F.lit(None).cast("int")


def passed_steps(holdout: DataFrame, steps: list[tuple[str, int, str, int]], risk: float = RISK, delta: float = DELTA, strata: int = len(STRATA) + 1) -> DataFrame:
    """``stratum``, ``step``, ``n_good``, ``false_rejections``, ``p_value`` of every step up to the last that passes.

    ``holdout``: as ``tune``, other documents. A step passes if the binomial probability of so few good documents rejected by
    the steps up to it, were the true share ``risk``, is ``delta / strata`` at most, and all steps before it pass.
    """
    counts = holdout.where(F.coalesce(F.col("good"), F.lit(False))).groupBy("stratum", first_step(steps).alias("first")).agg(F.count("*").alias("k"))
    by_step = counts.groupBy("stratum").agg(F.sum("k").alias("n_good"), F.collect_list(F.struct("first", "k")).alias("hits"))  # one for each step at most
    in_stratum = [F.when(F.col("stratum") == s, F.sequence(F.lit(1), F.lit(max(i for t, i, _, _ in steps if t == s)))) for s in sorted({x[0] for x in steps})]
    rows = by_step.withColumn("step", F.explode(F.coalesce(*in_stratum, F.array().cast("array<int>"))))
    rows = rows.withColumn("false_rejections", F.expr("aggregate(filter(hits, h -> h.first <= step), 0L, (a, h) -> a + h.k)"))
    rows = rows.select("stratum", "step", "n_good", "false_rejections", tail(F.col("false_rejections"), F.col("n_good"), risk).alias("p_value"))
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("worst", F.max("p_value").over(so_far)).where(F.col("worst") <= delta / strata).drop("worst")


def cutoffs(labelled: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA, strata: int = len(STRATA) + 1) -> list[tuple[str, str, int]]:
    """(stratum, feature, cutoff) of the cutoffs that stand. At most (strata x cutoffs) rows reach the driver.

    ``labelled``: ``label_key``, ``stratum``, ``good`` boolean and the features; written. Of ``strata`` times the cutoffs of
    ``rules``, those up to each stratum's last passed step are returned, the strictest of each feature.
    """
    half = F.pmod(F.xxhash64(F.lit(HALVES), F.col("label_key").cast("string")), F.lit(2))
    steps = [tuple(r) for r in ordered_cutoffs(labelled.where(half == 0), rules).collect()]
    last = {r.stratum: r.step for r in passed_steps(labelled.where(half == 1), steps, risk, delta, strata).groupBy("stratum").agg(F.max("step").alias("step")).collect()}
    found: dict[tuple[str, str], int] = {}
    for stratum, step, feature, cutoff in steps:
        if step <= last.get(stratum, 0):
            found[stratum, feature] = min(cutoff, found.get((stratum, feature), cutoff))
    return [(*key, cutoff) for key, cutoff in sorted(found.items())]


def rejected_by(found: list[tuple[str, str, int]]) -> Column:
    """Whether a cutoff of a row's stratum rejects it; ``found``: (stratum, feature, cutoff), at most strata times rules."""
    out = F.lit(False)
    for stratum, feature, cutoff in sorted(found):
        out = out | ((F.col("stratum") == stratum) & (F.col(feature) > cutoff))
    return out


def label_table(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """``label_key`` and ``good``, one row for each labelled id; of contradicting labels the lowest holds, null labels count
    for nothing."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("label_key")).agg(F.min(quality_col).alias("quality")).select("label_key", (F.col("quality") > 0).alias("good"))


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``id_col``, the measures, ``stratum``, ``base_failed`` and ``kept`` of every row of ``df``.

    ``kept``: neither the base rule nor a cutoff of :func:`cutoffs` on ``labels`` rejects the text. Cutoffs are found on the
    documents that the base rule keeps, as only these reach them. A null text has no words and fails the base rule; a null or
    unknown language is in the stratum "other"; a stratum with fewer good holdout documents than an exact bound needs (228
    without a false rejection) has no cutoffs. Features are computed once and written. DataFrame functions only. Empty tables
    give empty results; other columns are not read, whatever their names.
    """
    rows = materialise(features(df, [F.col(id_col).alias("__id")], text_col, stratum_col), "features")
    labelled = rows.where(~base_failed()).join(label_table(labels), F.col("__id") == F.col("label_key"))
    chosen = cutoffs(materialise(labelled, "labelled"))
    out = rows.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~(F.col("base_failed") | rejected_by(chosen))).withColumnRenamed("__id", id_col)


def quality_filter(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that :func:`quality_rules` keeps, with all their columns; nulls and empty tables as there.

    Features are computed of the labelled rows for the cutoffs, then of every row as it passes; whole rows are not shuffled
    while the labels are few enough to be broadcast. Columns of any names pass through.
    """
    known = hint(materialise(label_table(labels), "labels"), 24)
    lang = F.col(stratum_col) if stratum_col in df.columns else F.lit(None).cast("string")
    rows = df.select(whole_row(df).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), lang.alias("__lang"))
    labelled = rows.drop("__row").join(known, F.col("__id") == F.col("label_key"))
    labelled = materialise(features(labelled, [F.col("label_key"), F.col("good")], "__text", "__lang").where(~base_failed()), "labelled")
    chosen = cutoffs(labelled)
    judged = features(rows, [F.col("__row")], "__text", "__lang")
    return judged.where(~(base_failed() | rejected_by(chosen))).select("__row.*")
