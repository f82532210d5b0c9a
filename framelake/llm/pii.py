"""Personal data: exact kinds by pattern, more by contextual bootstrapping.

Seed entities are the spans of the exact kinds and long hexadecimal strings (kind "secret"). They seed a graph: its instances
are tokens with a digit or an at sign, its patterns a kind with the one to three words before them, or the words on both
sides. A pattern needs an anchor, a word that stands beside such tokens in a fair share of all its places in the corpus; function
words are none. Patterns are scored by their known instances of their kind, unknown instances by their patterns, in turns.
Patterns of a high score are trusted: their unknown instances become known, at a discount, and patterns that share them are
scored in the next turn, until a turn adds no pattern. Trusted patterns mark the unknown tokens that stand in them. Only
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import BROADCAST_BYTES, hint_measured, text_bytes
from .common import let, materialise, text_or_empty

#: Kinds in their order. Possessive forms and \\G keep matching linear; they find what the plain patterns find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A short text without which there is no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = tuple(PATTERNS)
#: Kind of the seeds that the method adds, what such a token consists of, and the kinds of patterns.
SECRET, SECRET_FORM = "secret", r"^(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}$"
SEEDS = (*KINDS, SECRET)
#: Spans found by patterns of a base kind carry its name with this ending.
LIKE = "_like"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Scoring: rounds of a turn, weight of doubt (of so many unknown instances), least score of a trusted pattern, share of a word's
#: places beside tokens that makes it an anchor.
ROUNDS, DOUBT, LEAST, ANCHOR = 2, 1.0, 0.8, 0.25
#: What an instance that a trusted pattern has made known is worth, of the pattern's score.
DISCOUNT = 0.95
#: Sums that are carried on together.
CHUNK = 256

LONGS = "array<bigint>"


def running(values: Column, start: Column) -> Column:
    """Sums of all values before each one; quadratic, for short arrays."""
    begin = F.struct(start.alias("at"), F.array().cast(LONGS).alias("out"))
    return F.aggregate(values, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def before(values: Column) -> Column:
    """Sums of all values before each one, in chunks, and chunk by chunk."""
    zero = F.lit(0).cast("long")

    def chunked(v: Column) -> Column:
        part = lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK))
        chunks = F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int"))
        starts = running(F.transform(chunks, lambda k: total(part(k))), zero)
        return F.flatten(F.zip_with(chunks, starts, lambda k, at: running(part(k), at)))

    return let(values, lambda v: F.when(F.size(v) <= CHUNK, running(v, zero)).otherwise(chunked(v)))


def places(text: Column, pattern: str, more=None) -> Column:
    """Array of ``value``, ``start``, ``end`` (code points) of every match, leftmost, without overlap.

    ``more``: makes further fields of a match from the text before it and after it, up to the next matches. Lengths of the matches and
    of what lies between them add up to the places.
    """

    def located(found: Column) -> Column:
        def joined(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
            ends = let(steps, lambda s: F.zip_with(before(s), s, lambda a, b: a + b))
            return F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(gaps, F.lit(2), F.size(found)).alias("a"), ends.alias("e")), lambda x: F.struct(x["m"].alias("value"), (x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), *(more(x["g"], x["a"]) if more else [])))

        return let(F.split(text, pattern, -1), joined)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, located(found)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    value = lambda x, k: F.when(k % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
TOKENS = "array<struct<value:string,start:bigint,end:bigint,contexts:array<string>,kind:string>>"


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(places(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))
    spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    if kind in NEEDS:
        spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans)
    return F.coalesce(spans, F.array().cast(SPANS))


def contexts(before_: Column, after: Column) -> Column:
    """The last one, two and three words before a token, and the words on both sides: what there is of these."""
    words = F.split(F.lower(F.regexp_extract(F.reverse(before_), r"^\s+(\S+(?:\s+\S+){0,2})", 1)), r"\s+")
    right = F.lower(F.regexp_extract(after, r"^\s+(\S+)", 1))

    def phrases(w: Column) -> Column:
        left = F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.reverse(F.array_join(F.slice(w, F.lit(1), n), " ")))
        both = F.when(right != "", F.array(F.concat(F.reverse(F.get(w, 0)), F.lit(" _ "), right))).otherwise(F.array().cast("array<string>"))
        return F.when(F.get(w, 0) != "", F.concat(left, both)).otherwise(F.array().cast("array<string>"))

    return let(words, phrases)


def tokens(text: Column, spans: Column) -> Column:
    """Tokens with a digit or an at sign, without signs at their ends: contexts, and the kind of the span each shares characters with."""

    def labelled(x: Column) -> Column:
        inner = F.regexp_replace(x["value"], r"^[^\p{L}\p{N}@+]++", "")
        cut = F.length(x["value"]) - F.length(inner)
        core = F.regexp_extract(inner, r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++)*+", 0)

        def struct(v: Column) -> Column:
            start = x["start"] + cut
            end = start + F.length(v)
            touching = F.filter(spans, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))
            kind = F.coalesce(F.get(touching, 0)["kind"], F.when(v.rlike(SECRET_FORM), F.lit(SECRET)))
            return F.struct(v.alias("value"), start.alias("start"), end.alias("end"), x["contexts"].alias("contexts"), kind.alias("kind"))

        return let(core, struct)

    found = F.transform(places(text, TOKEN, lambda g, a: [contexts(g, a).alias("contexts")]), labelled)
    return F.coalesce(F.filter(found, lambda t: t["value"].rlike(r"[0-9]|[\p{L}\p{N}]@|@[\p{L}\p{N}]")), F.array().cast(TOKENS))


def anchors(words: DataFrame, texts: DataFrame, text_col: str, least: float = ANCHOR) -> DataFrame:
    """``word``: those of ``words`` (``word``, ``beside``: places beside tokens) of which ``least`` of all places are beside tokens.

    The words of all texts are counted, within tasks first; while ``words`` are few enough to be broadcast, only these.
    """
    every = texts.select(F.explode(F.split(F.lower(text_or_empty(text_col)), r"\s+")).alias("word"))
    if text_bytes(words, "word") <= BROADCAST_BYTES:
        every = every.join(F.broadcast(words.select("word")), "word", "left_semi")
    places_ = every.groupBy("word").agg(F.count("*").alias("places"))
    return words.join(places_, "word").where(F.col("beside") >= least * F.col("places")).select("word")


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern``, ``score``, ``known`` of every pattern that has known instances.

    ``edges``: ``pattern``, ``value``, ``worth`` (1: a seed of the pattern's kind; 0: unknown; between: made known; -1: a seed of
    another kind), written. A pattern's score is the mean of its instances' worth, with DOUBT unknown ones added; an unknown
    instance is worth the chance that at least one of its patterns is right.
    """
    known = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.greatest("worth", F.lit(0.0))).alias("worth"), F.count_if(F.col("worth") > 0).alias("known")).where("known > 0")
    scores = materialise(known.withColumn("score", F.col("worth") / (F.col("n") + DOUBT)), "patterns")
    for _ in range(rounds):
        doubt = edges.where("worth = 0").join(scores.select("pattern", "score"), "pattern").groupBy("value", F.col("pattern.kind").alias("kind")).agg(F.sum(F.log(1 - F.col("score"))).alias("doubt"))
        judged = doubt.select("value", "kind", (1 - F.exp("doubt")).alias("right"))
        unknown = edges.where("worth = 0").withColumn("kind", F.col("pattern.kind"))
        gained = unknown.join(judged, ["value", "kind"]).groupBy("pattern").agg(F.sum("right").alias("gained"))
        scores = scores.select("pattern", "n", "worth", "known").join(gained, "pattern", "left")
        scores = materialise(scores.select("pattern", "n", "worth", "known", ((F.col("worth") + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + DOUBT)).alias("score")), "patterns")
    return scores.select("pattern", "score", "known")


def trusted_patterns(occurrences: DataFrame, texts: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``kind``, ``context`` and ``score`` of the patterns of score ``least``, by turns.

    ``occurrences``: ``contexts``, ``value``, ``kind`` (null: unknown). Instances are distinct values. After each turn the
    unknown instances of all trusted patterns are known, of the pattern's kind: worth DISCOUNT times the chance that one of
    these is right. Every pattern that has such an instance is scored in the next turn. A pattern stays trusted, with its first
    score; the turn that adds none is the last. Contexts of so few instances that no score can reach ``least`` are left out,
    which changes nothing. Edges are counted before they are shuffled; Spark splits a pattern that has many.
    """
    found = occurrences.select("value", "kind", F.explode("contexts").alias("context")).groupBy("context", "value").agg(F.min("kind").alias("kind"))
    found = materialise(found, "contexts")
    often = found.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= least * (F.col("n") + DOUBT)).select("context")
    often = materialise(often, "often")
    words = often.select("context", F.explode(F.array_remove(F.array_distinct(F.split("context", " ")), "_")).alias("word"))
    near = occurrences.select(F.explode(F.array_distinct(F.flatten(F.transform("contexts", lambda c: F.split(c, " "))))).alias("word")).groupBy("word").agg(F.count("*").alias("beside"))
    near = materialise(near.join(words.select("word").distinct(), "word", "left_semi"), "beside")
    anchored = words.join(anchors(near, texts, text_col), "word", "left_semi").select("context").distinct()
    found = materialise(found.join(anchored, "context", "left_semi"), "anchored")
    pattern = F.struct(F.col("as").alias("kind"), "context").alias("pattern")
    worth = F.when(F.col("kind").isNull(), 0.0).when(F.col("kind") == F.col("as"), 1.0).otherwise(-1.0)
    edges = now = materialise(found.withColumn("as", F.explode(F.array(*map(F.lit, SEEDS)))).select(pattern, "value", worth.alias("worth")), "edges")
    passed = lambda df: df.where(F.col("score") >= least).select("pattern", "score")
    trusted = added = materialise(passed(pattern_scores(now)), "trusted")
    while not added.isEmpty():
        behind = edges.where("worth = 0").join(trusted, "pattern")
        gained = behind.groupBy("value", F.col("pattern.kind").alias("as")).agg((DISCOUNT * (1 - F.exp(F.sum(F.log(1 - F.col("score")))))).alias("gained"))
        raised = edges.withColumn("as", F.col("pattern.kind")).join(gained, ["value", "as"], "left")
        now = materialise(raised.select("pattern", "value", F.when(F.col("worth") == 0, F.coalesce("gained", F.lit(0.0))).otherwise(F.col("worth")).alias("worth")), "edges")
        added = materialise(passed(pattern_scores(now)).join(trusted, "pattern", "left_anti"), "added")
        trusted = materialise(trusted.union(added), "trusted")
    return trusted.select("pattern.kind", "pattern.context", "score")


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    spanned = texts.select("rid", "id", let(F.col("text"), lambda t: let(F.concat(*(base_spans(t, kind) for kind in KINDS)), lambda s: F.struct(s.alias("spans"), tokens(t, s).alias("tokens")))).alias("x"))
    return materialise(spanned.select("rid", "id", "x.spans", "x.tokens"), "scanned")


def pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``id_col``, ``spans`` array<struct<kind, start, end>> by kind and start, and ``found`` of every row of ``df``.

    ``spans``: email, ip, card and phone in this order, as PATTERNS and :func:`valid` have them, code points, end
    exclusive. ``found``: further spans by kind and start: seeds of kind "secret", and tokens that no seed touches and that stand in
    a trusted pattern (:func:`trusted_patterns`), of its kind ("secret", else the kind with "_like"); of several patterns the
    one of the best score holds. A null or empty text has none; a null id stays null; repeated rows are alike; texts are
    searched whole. An empty table gives an empty result; other columns are not read.
    """
    rows = scanned(df, id_col, text_col)
    occurrences = rows.select("rid", F.explode("tokens").alias("t")).select("rid", "t.*")
    trusted = materialise(trusted_patterns(occurrences, df, text_col, least), "trusted").select(F.col("kind").alias("as"), "context", "score")
    unknown = occurrences.where(F.col("kind").isNull()).select("rid", "start", "end", F.explode("contexts").alias("context")).join(hint_measured(trusted, "context"), "context")
    name = F.when(F.col("best.as") == SECRET, F.lit(SECRET)).otherwise(F.concat(F.col("best.as"), F.lit(LIKE)))
    marked = unknown.groupBy("rid", "start", "end").agg(F.max(F.struct("score", "as")).alias("best")).select("rid", "start", "end", name.alias("kind"))
    marked = marked.union(occurrences.where(F.col("kind") == SECRET).select("rid", "start", "end", "kind"))
    more = marked.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
    out = rows.select("rid", "id", "spans").join(more, "rid", "left")
    return out.select(F.col("id").alias(id_col), "spans", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def digest(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
