"""Near-duplicates by Order MinHash, verified by banded alignment.

A sketch keeps the few smallest of a text's two-word runs (of a short text's words), each labelled with how often it has
stood before, in the order of the text; equal sketches therefore point to texts that are close in edit distance, not only in vocabulary. Texts
with an equal sketch meet in a bucket; each is aligned with hubs of its buckets, their most central texts, then with all others
of its buckets that it is not connected with. Links make components, components classes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, merged
from .common import bound_batches, counted, discard, hint, materialise, rows_of, text_or_empty, whole_row

#: Words of a run, runs of a sketch, sketches of a text, and the edit similarity of a link.
RUN, ORDERED, SKETCHES, SIMILARITY = 2, 3, 48, 0.8
#: Texts of so many words at most have sketches of single words. Those of SIMILARITY of the next length or more have sketches
#: of runs, so that two texts of similar lengths have one kind in common.
SHORT = 24
#: Members of a bucket that all its members are compared with first.
HUBS = 12
#: Members of a block of a larger bucket, about, and the most blocks of one side: a member is sent to so many groups at most for each side.
BLOCK, SPLITS = 1024, 16
#: Words of each side's texts that are aligned at once, about.
AT_ONCE_WORDS = 1 << 18
#: Hash values that are ranked at once.
AT_ONCE = 1 << 18
#: Characters of texts whose words a worker holds at once, about: of a batch for Python, lists of words take more than ten times as much as its texts.
AT_ONCE_CHARS = 1 << 19
#: Bins of a text's words by hash; what two texts' bins differ by bounds their edits from below.
BINS = 192

_ODD = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def labelled_runs(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashes of the runs of ``run`` words (of all words, if there are fewer), each with its number among equal ones."""
    n = max(1, len(words) - run + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(run, len(words))):
        h = spread(h * np.uint64(31) + words[k : k + n])
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.arange(n)
    number = np.empty(n, dtype=np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return spread(h + number * _ODD)


def order_sketches(runs: np.ndarray, seeds: np.ndarray, ordered: int = ORDERED) -> np.ndarray:
    """One value per seed: the ``ordered`` runs that are smallest under it, in the order of the text."""
    out = np.empty(len(seeds), dtype=np.uint64)
    k = min(ordered, len(runs))
    step = max(1, AT_ONCE // len(runs))
    for a in range(0, len(seeds), step):
        keyed = (runs[None, :] ^ seeds[a : a + step, None]) * _ODD
        least = np.sort(np.argpartition(keyed, k - 1, axis=1)[:, :k], axis=1)
        value = np.zeros(len(least), dtype=np.uint64)
        for i in range(k):
            value = spread(value * np.uint64(31) + runs[least[:, i]])
        out[a : a + step] = value
    return out


def text_sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES values of a text's single words, of its runs, or of both; another kind or seed gives other values."""
    out = []
    for run, fits in ((1, len(words) <= SHORT), (RUN, len(words) >= SIMILARITY * (SHORT + 1))):
        if fits:
            seeds = spread(np.arange(1 + run * SKETCHES, 1 + (run + 1) * SKETCHES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            out.append(spread(order_sketches(labelled_runs(words, run), seeds) ^ seeds))
    return np.concatenate(out)


def banded_distance(x: list, y: list, most: int) -> int:
    """Edits (insert, delete, replace) from ``x`` to ``y``, or ``most + 1`` if there are more.

    Bit-parallel, after Hyyro's banded form of Myers's algorithm: a column of the alignment's band, ``2 * most + 1`` cells along the diagonal, is one integer.
    """
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > most:
        return most + 1
    a = 0
    while a < len(y) and x[a] == y[a]:
        a += 1
    b = 0
    while b < len(y) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if not y:
        return len(x)
    most_here = min(most, len(x))
    width = 2 * most_here + 1
    full = (1 << width) - 1
    at: dict = {}
    for i, word in enumerate(x):
        at[word] = at.get(word, 0) | 1 << i
    up, down, score = full >> most_here << most_here, 0, most_here
    last_row, turn = 1 << (width - 1), len(x) - most_here
    give_up = most_here + len(y) - turn
    for j, word in enumerate(y):
        found = at.get(word, 0)
        shift = j - most_here
        match = (found >> shift if shift >= 0 else found << -shift) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        if j < turn:
            score += not diagonal & last_row
            if score > give_up:
                return most + 1
        else:
            last_row >>= 1
            score += bool(right & last_row)
            score -= bool(left & last_row)
        down_shifted = diagonal >> 1
        up, down = (left | (full & ~(down_shifted | right))) & full, down_shifted & right
    return score if score <= most else most + 1


def similar(x: list, y: list, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity, 1 - edits / words of the longer text, is ``least`` or more."""
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(x), len(y)) > most:
        return False
    common = sum((Counter(x) & Counter(y)).values())
    return longer - common <= most and banded_distance(x, y, most) <= most


def words_of(text: str) -> list[str]:
    return text.lower().split()


def in_parts(batches: Iterator[pd.DataFrame], *texts: str) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in their order, cut wherever another AT_ONCE_CHARS characters of ``texts`` are reached; a text is never cut."""
    for batch in batches:
        part = sum(batch[c].map(len).to_numpy(dtype=np.int64) for c in texts).cumsum() // AT_ONCE_CHARS
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip([0, *ends], ends, strict=False):
            yield batch.iloc[a:b]


def sketched(numbered: DataFrame) -> DataFrame:
    """``rid``, ``id``, ``n`` (words), ``same`` (a digest of the words) and ``sketch`` of the rows of (``rid``, ``id``, ``text``)."""
    kind = numbered.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches, "text"):
            texts = [words_of(text) for text in batch["text"]]
            length = [len(x) for x in texts]
            flat = pd.util.hash_array(np.array([w for x in texts for w in x], dtype=object)) if sum(length) else np.empty(0, dtype=np.uint64)
            ends = np.cumsum(length)
            yield pd.DataFrame({
                "rid": batch["rid"],
                "id": batch["id"],
                "n": np.array(length, dtype=np.int64),
                "same": [hashlib.blake2b(" ".join(x).encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts],
                "bins": [np.bincount((flat[b - n : b] % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.int32) for b, n in zip(ends.tolist(), length, strict=True)],
                "sketch": [text_sketches(flat[b - n : b]).view(np.int64) for b, n in zip(ends.tolist(), length, strict=True)],
            })

    out = numbered.select("rid", F.col("id").cast("string"), "text").mapInPandas(sketch, "rid long, id string, n long, same binary, bins array<int>, sketch array<long>")
    return out.withColumn("id", F.col("id").cast(kind))


def aligned(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose texts (``rid``, ``text``) are similar; those whose bins differ too much are not read."""
    pairs = counted(pairs, "pairs")
    if not rows_of(pairs):
        return pairs
    wanted = counted(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct(), "needed")
    needed = hint(wanted, 24)
    bins = nodes.join(needed, "rid", "left_semi").select("rid", F.struct("n", "bins").alias("of"))
    texts = texts.join(needed, "rid", "left_semi")

    def more(x: str, y: str):
        return F.aggregate(F.zip_with(f"{x}.bins", f"{y}.bins", lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda a, b: a + b)

    def with_ends(df: DataFrame, ends: DataFrame, name: str, *to: str) -> DataFrame:
        for end, column in zip(("a", "b"), to, strict=True):
            df = df.join(ends.select(F.col("rid").alias(end), F.col(name).alias(column)), end)
        return df

    bound = F.greatest(more("p", "q"), more("q", "p")) <= F.floor((1 - SIMILARITY) * F.greatest("p.n", "q.n") + 1e-9)
    pairs = with_ends(pairs, bins, "of", "p", "q").where(bound).select("a", "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[str]] = {}
        for batch in in_parts(batches, "x", "y"):
            for text in batch["y"].unique():
                held[text] = words_of(text)
            close = [similar(words_of(x), held[y]) for x, y in zip(batch["x"], batch["y"], strict=True)]
            held.clear()
            yield batch.loc[close, ["a", "b"]]

    both = with_ends(pairs, texts, "text", "x", "y").select("a", "b", "x", "y")
    links = counted(both.mapInPandas(verify, "a long, b long"), "links")
    discard(pairs, wanted)
    return links


def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``rid`` and its hubs, each once, those of the most common sketches first (then the smallest ``rid``)."""
    for batch in batches:
        out = []
        for hubs in batch["hubs"]:
            found, times = np.unique(np.concatenate(hubs), return_counts=True)
            out.append(found[np.argsort(-times, kind="stable")])
        yield pd.DataFrame({"rid": batch["rid"], "hubs": out})


def placed(pairs: DataFrame, parts: DataFrame, *names: str) -> DataFrame:
    """``pairs`` with the component of each of the columns ``names``; a text without links is one of its own."""
    for name in names:
        part = parts.select(F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
        pairs = pairs.join(hint(part, 24, parts), name, "left").withColumn(f"{name}_part", F.coalesce(f"{name}_part", name))
    return pairs


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct()


def possible(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of a bucket, the members of pairs of different components that lengths and bins leave possible.

    A row on the left has the rows of its pairs in ``others``. A pair with several buckets in common is left to the first. The members
    of pairs are cut into runs of about AT_ONCE_WORDS words on either side; two runs are a part (``k``), and a member stands in each part that has a pair of it.
    """
    left, right = blocks[blocks["left"]], blocks[~blocks["left"]]
    n, rid, part, rest = (right[c].to_numpy() for c in ("n", "rid", "rid_part", "rest"))
    bins, met = np.stack(right["bins"].to_numpy()) if len(right) else None, [frozenset(x.tolist()) for x in right["buckets"]]
    pairs, wanted = [], np.zeros(len(right), dtype=bool)
    for own in left.itertuples():
        longer = np.maximum(n, own.n)
        most = np.floor((1 - SIMILARITY) * longer + 1e-9)
        at = np.flatnonzero((longer - np.minimum(n, own.n) <= most) & (part != own.rid_part) & (~rest | (rid > own.rid)))
        if len(at):
            at = at[longer[at] - np.minimum(bins[at], own.bins).sum(axis=1) <= most[at]]
            buckets = own.buckets.tolist()
            at = np.array([i for i in at.tolist() if min(met[i].intersection(buckets)) == own.bucket], dtype=np.int64)
        if len(at):
            pairs.append((own, at))
            wanted[at] = True
    run = np.cumsum(n * wanted) // AT_ONCE_WORDS
    of_left = np.cumsum([own.n for own, _ in pairs]) // AT_ONCE_WORDS
    lefts, rights = [], set()
    for (own, at), a in zip(pairs, of_left.tolist(), strict=True):
        for some in np.split(at, np.flatnonzero(np.diff(run[at])) + 1):
            k = int(a * (run[-1] + 1) + run[some[0]])
            lefts.append((k, True, own.rid, own.rid_part, rid[some]))
            rights.update((k, i) for i in some.tolist())
    rights = [(k, False, rid[i], part[i], None) for k, i in sorted(rights)]
    out = pd.DataFrame(lefts + rights, columns=["k", "left", "rid", "rid_part", "others"])
    return out.assign(**{c: blocks[c].iloc[0] for c in ("bucket", "i", "j")})[["bucket", "i", "j", "k", "left", "rid", "rid_part", "others"]]


def links_between(blocks: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a part of :func:`possible` that are similar and join their components, which may hold others of the part by then."""
    right = blocks[~blocks["left"]].set_index("rid")
    words, part = {rid: words_of(text) for rid, text in right["text"].items()}, right["rid_part"].to_dict()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    out = []
    for own in blocks[blocks["left"]].itertuples():
        text = words_of(own.text)
        for other in own.others.tolist():
            x, y = find(own.rid_part), find(part[other])
            if x != y and similar(text, words[other]):
                root[x] = y
                out.append((own.rid, other))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def apart(crowd: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``a`` and ``b``: similar texts of a bucket of ``crowd`` (``bucket``, ``rid``, ``rid_part``, written), enough of them to
    join all components that a bucket's similar texts lie in.

    Members outside a bucket's largest component meet all of its members, so the work is in proportion to the pairs that are
    still apart. Both sides are dealt by a hash into blocks of about BLOCK members, SPLITS blocks at most, and two blocks
    are a group of their own: a large bucket is spread over many tasks, and the rows moved grow with its members, not with their pairs. Lengths and bins are moved there first; texts follow only
    where these leave a pair possible, in parts of a bounded size. Pairs are made and aligned inside groups, not as rows.
    """
    counts = crowd.groupBy("bucket", "rid_part").agg(F.count("*").alias("members"))
    most = counts.groupBy("bucket").agg(F.max(F.struct("members", "rid_part")).alias("most"), F.sum("members").alias("members")).where("members > most.members")
    blocks = lambda members: F.least(F.ceil(members / BLOCK), F.lit(SPLITS).cast("long"))
    lefts, rights = blocks(F.col("members") - F.col("most.members")).alias("lefts"), blocks(F.col("members")).alias("rights")
    most = counted(most.select("bucket", F.col("most.rid_part").alias("most_part"), lefts, rights), "mixed")
    mixed = crowd.join(hint(most, 40), "bucket").withColumn("rest", F.col("rid_part") != F.col("most_part"))
    mixed = counted(mixed.select("bucket", "rid", "rid_part", "rest", "lefts", "rights"), "apart")
    if not rows_of(mixed):
        return mixed.select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    needed = counted(mixed.groupBy("rid").agg(F.collect_set("bucket").alias("buckets")), "needed")
    of = needed.join(nodes.select("rid", "n", "bins"), "rid")
    block = lambda of: F.pmod(F.xxhash64("rid"), of)
    every = lambda of, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(of) - 1), f)
    pair = lambda left, i, j: F.struct(F.lit(left).alias("left"), i.alias("i"), j.alias("j"))
    as_right = every("lefts", lambda i: pair(False, i, block(F.col("rights"))))
    as_left = F.when(F.col("rest"), every("rights", lambda j: pair(True, block(F.col("lefts")), j)))
    dealt = mixed.join(of, "rid").select("bucket", "rid", "rid_part", "rest", "n", "bins", "buckets", F.inline(F.concat(as_right, F.coalesce(as_left, F.array()))))
    schema = "bucket long, i long, j long, k long, left boolean, rid long, rid_part long, others array<long>"
    members = counted(dealt.groupBy("bucket", "i", "j").applyInPandas(possible, schema), "possible")
    wanted = counted(members.select("rid").distinct(), "wanted")
    members_texts = members.join(texts.join(hint(wanted, 16), "rid", "left_semi"), "rid")
    links = counted(members_texts.groupBy("bucket", "i", "j", "k").applyInPandas(links_between, "a long, b long"), "links")
    discard(most, mixed, needed, members, wanted)
    return links


def linked(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node`` and ``component`` of the texts of ``nodes`` (``rid``, ``n``, ``sketch``, ``bins``) that are similar to another.

    A text meets the HUBS most central members of each of its buckets, those whose own buckets hold the most texts, so
    buckets of up to HUBS + 1 texts are compared whole. Hubs of all buckets of a text are gathered first and ranked by the sketches in common: each text is aligned with its
    best hub, then with those of its other hubs that it is not connected with. At last every pair of a larger bucket that is still apart is
    compared (:func:`apart`): hubs only leave fewer of them, so no link between texts with an equal sketch is lost.
    """
    spread_out = nodes.select("rid", "n", F.explode("sketch").alias("bucket"))
    sizes = counted(spread_out.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    met = counted(spread_out.join(hint(sizes, 24), "bucket"), "met")
    weights = counted(met.groupBy("rid").agg(F.sum("members").alias("weight")), "weights")
    members = counted(met.join(hint(weights, 24), "rid").select("bucket", "rid", "n", "weight"), "members")
    central = Window.partitionBy("bucket").orderBy(F.desc("weight"), "rid")
    hubs = members.withColumn("place", F.row_number().over(central)).where(F.col("place") <= HUBS)  # cut before the shuffle, too
    hubs = counted(hubs.groupBy("bucket").agg(F.collect_list(F.struct("rid", "n")).alias("hubs")), "hubs")
    longer = lambda h: F.greatest(F.col("n"), h["n"])
    fits = lambda h: (h["rid"] != F.col("rid")) & (longer(h) - F.least(F.col("n"), h["n"]) <= F.floor((1 - SIMILARITY) * longer(h) + 1e-9))
    is_hub = F.exists("hubs", lambda h: h["rid"] == F.col("rid"))
    both_ways = members.join(hint(hubs, 16 + 24 * HUBS), "bucket").withColumn("is_hub", is_hub)  # two hubs meet once: the later one has the earlier
    near = both_ways.select("rid", F.transform(F.filter("hubs", lambda h: fits(h) & (~F.col("is_hub") | (h["rid"] < F.col("rid")))), lambda h: h["rid"]).alias("hubs")).where(F.size("hubs") > 0)
    near = counted(near.groupBy("rid").agg(F.collect_list("hubs").alias("hubs")).mapInPandas(ranked, "rid long, hubs array<long>"), "ranked")
    discard(met, weights, members, hubs)
    links = aligned(ordered(near.select("rid", F.get("hubs", F.lit(0)).alias("hub"))), nodes, texts)
    parts = counted(connected_components(links), "components")
    rest = placed(ordered(near.select("rid", F.explode(F.slice("hubs", 2, SKETCHES * 2 * HUBS)).alias("hub"))), parts, "a", "b")
    more = aligned(rest.where("a_part != b_part").select("a", "b"), nodes, texts)
    parts = merged(parts, more)
    discard(near, links, more)
    large = sizes.where(F.col("members") > HUBS + 1).select("bucket")
    crowd = spread_out.join(hint(counted(large, "large"), 16), "bucket", "left_semi")
    rest = counted(placed(crowd.select("bucket", "rid"), parts, "rid"), "crowd")
    others = apart(rest, nodes, texts)
    parts = merged(parts, others)
    discard(sizes, rest, others)
    return parts


def near_classes(numbered: DataFrame) -> DataFrame:
    """``rid``, ``id``, ``class_rid`` (the row that stands for the class) and ``class_id`` (its id) for every row.

    ``numbered``: ``rid``, ``id``, ``text``, written. Texts of the same words are one node; nodes are linked when their edit
    similarity in words is SIMILARITY or more and they share a sketch; a class is a connected component, and its row of the
    smallest id (null ids first), then the smallest ``rid``, stands for it.
    """
    bound_batches(numbered.sparkSession)
    rows = materialise(sketched(numbered), "sketches")
    firsts = rows.groupBy("same").agg(F.min(F.struct("id", "rid")).alias("first"), F.count("*").alias("copies"))
    firsts = counted(firsts.select("same", F.col("first.rid").alias("rid"), F.col("first.id").alias("id"), "copies"), "firsts")
    copied = firsts.where("copies > 1").select("same", F.col("rid").alias("first"))
    others = counted(rows.select("rid", "same").join(hint(copied, 48), "same").where("rid != first").select("rid"), "copies")
    nodes = materialise(rows.join(hint(others, 16), "rid", "left_anti").select("rid", "n", "bins", "sketch"), "nodes")
    linked_parts = linked(nodes, numbered.select("rid", "text"))
    parts = linked_parts.withColumnRenamed("node", "rid")
    member = firsts.join(hint(parts, 24, linked_parts), "rid", "left")
    member = materialise(member.where("copies > 1 or component is not null").select("same", "rid", "id", F.coalesce("component", "rid").alias("component")), "members")
    stands = member.groupBy("component").agg(F.min(F.struct("id", "rid")).alias("first"))
    member = counted(member.join(stands, "component").select("same", F.col("first.rid").alias("class_rid"), F.col("first.id").alias("class_id")), "classes")
    discard(nodes, others, linked_parts)
    out = rows.select("rid", "id", "same").join(hint(member, 96), "same", "left")
    return out.select("rid", "id", F.coalesce("class_rid", "rid").alias("class_rid"), F.when(F.col("class_rid").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``class_id`` and ``kept`` of every row of ``df``.

    ``kept``: one row of each class, that of the smallest id. A null text counts as empty; empty texts are equal. Texts
    of SHORT words at most meet by single words. A null id is kept as null. Repeated rows are members like others. Long texts are
    aligned whole. An empty table gives an empty result; other columns are not read.
    """
    numbered = materialise(df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "texts")
    return near_classes(numbered).select(F.col("id").alias(id_col), "class_id", (F.col("rid") == F.col("class_rid")).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`near_duplicates` keeps, with all their columns."""
    whole = materialise(df.select(F.monotonically_increasing_id().alias("rid"), whole_row(df).alias("row")), "numbered")
    numbered = whole.select("rid", F.col("row")[id_col].alias("id"), F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text"))
    dropped = counted(near_classes(numbered).where("rid != class_rid").select("rid"), "dropped")
    return whole.join(hint(dropped, 16), "rid", "left_anti").select("row.*")
