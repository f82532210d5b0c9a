"""Token ids in fixed-width bits, in blocks of documents that can be read one by one.

A shard is a run of documents in ascending order of their ids. Its table has one row for each block: the shard, the
block's number, the ids of the shard before it, the lengths of its documents and one binary value that holds all ids of
the block in the fewest bits that the vocabulary needs. Every block starts on a byte, so any document is unpacked from its
own block alone; :func:`document_index` says where each one stands. Blocks are rows of Parquet files, whose commit makes writing safe against lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, hint, text_or_empty

#: Tokens of a block, if no document alone has more.
BLOCK = 1 << 17
#: Bytes of text of a shard, about.
SHARD_BYTES = 32 << 20
#: Words that a Python worker keeps.
KEEP = 500_000
#: The normaliser and splitter (fixed values of the format) under which a text's pieces do not depend on each other.
PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

FILE_SCHEMA = "shard int, block int, start long, bits int, keys array<string>, lengths array<int>, payload binary"


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.arange(bits, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> planes) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` on, without reading what lies before them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype(np.uint32)
    a, b = first * bits, (first + count) * bits
    flat = np.unpackbits(np.frombuffer(payload, dtype=np.uint8, offset=a // 8, count=(b + 7) // 8 - a // 8), bitorder="little")
    return (flat[a % 8 : a % 8 + b - a].reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class WordTokenizer:
    """A tokenizer of the ``tokenizers`` library. Where its file has the normaliser and splitter PIECEWISE and a plain BPE model
    with a suffix that ends words, pieces are encoded once; texts of any other tokenizer are encoded whole."""

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer, normalizers
        from tokenizers import pre_tokenizers as splitters

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        #: Characters other than these, and apostrophes, make a text be cut at white space only.
        self.plain = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
        self.cut = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-/:-@\[-`{-~]+")
        self.runs = re.compile(r"[^\t-\r ]+")
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        model = form["model"]
        plain = model.get("type", "BPE") == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"))
        self.piecewise = plain and bool(suffix := model.get("end_of_word_suffix")) and all(form.get(k) == v for k, v in PIECEWISE.items())
        if not self.piecewise:
            return
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        #: For pieces of the plain kind, which the normaliser leaves as they are and white space and digits divide as the splitter does.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = splitters.Sequence([splitters.WhitespaceSplit(), splitters.Digits(individual_digits=True), splitters.ByteLevel(add_prefix_space=False, use_regex=False)])

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces of the plain kind, many to a text: a run of letters or signs is one word of it, digits are one each."""
        for a in range(0, len(pieces), 10_000):
            some = [pieces[i : i + 250] for i in range(a, min(a + 10_000, len(pieces)), 250)]
            for group, e in zip(some, self.bare.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False), strict=True):
                words = np.cumsum([len(p) if "0" <= p[0] <= "9" else 1 for p in group])
                found = np.array(e.ids, dtype=np.uint32)
                ids, ends = found.tobytes(), (4 * (np.flatnonzero(self.ends_word[found])[words - 1] + 1)).tolist()
                for p, x, y in zip(group, [0, *ends], ends, strict=False):
                    self.known[p] = ids[x:y]

    def plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of plain characters only, without capitals: each run without white space is looked up once, and cut if it is not a known piece."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        runs = lists.flatten().dictionary_encode()
        own = runs.dictionary.to_pylist()
        found = list(map(self.known.get, own))
        unknown = [i for i, x in enumerate(found) if x is None]
        cuts = [(r,) if (r := own[i]).isalpha() else self.cut.findall(r) for i in unknown]
        self.learn(list(set(chain.from_iterable(cuts)) - self.known.keys()))
        get = self.known.__getitem__
        for i, x in zip(unknown, cuts, strict=True):
            found[i] = get(x[0]) if len(x) == 1 else b"".join(map(get, x))
        ids, sizes, at = np.frombuffer(b"".join(found), dtype=np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4, runs.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.piecewise:
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > KEEP:
            self.known = {}
        plain, other = {}, {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                other[i] = [text]
            elif self.plain.fullmatch(text):
                plain[i] = text.lower()
            else:
                other[i] = self.runs.findall(text)
        out = dict(zip(plain, self.plain_ids(list(plain.values())), strict=True))
        rest = list(set().union(*other.values()) - self.known.keys())
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, dtype=np.uint32).tobytes()
        out |= {i: np.frombuffer(b"".join(map(self.known.__getitem__, x)), dtype=np.uint32) for i, x in other.items()}
        for p in rest:
            if len(p) > 1000:
                del self.known[p]
        return [out[i] for i in range(len(texts))]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write_packed(df: DataFrame, target: str, path: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode every whole text, end it with ``end_id``, and write shards to ``target``, a path of Spark's file systems.

    Documents stand in ascending order of ``id_col``, null ids first, repeated ids by a hash of their texts. One shuffle sorts the
    texts by range, into shards of about SHARD_BYTES of text (but one for each core at least, unless ``shards`` says otherwise),
    so shards are even whatever the ids; ids are packed where they are made and are not moved again. A null or
    empty text has the end id alone. A text longer than a block makes a block of its own. An empty table writes none.
    """
    spark = df.sparkSession
    bound_batches(spark)
    bits = width_of(vocabulary)
    rows = df.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(size // SHARD_BYTES + 1, spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(shards, "key", "h").sortWithinPartitions("key", "h", "text").select(F.spark_partition_id().alias("shard"), F.col("key").cast("string"), "text")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        shard, block, start, held, keys, size = 0, 0, 0, [], [], 0

        def row() -> pd.DataFrame:
            ids = np.concatenate(held)
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [start], "bits": [bits], "keys": [keys], "lengths": [[len(x) for x in held]], "payload": [pack(ids, bits)]})

        for batch in batches:
            shard = int(batch["shard"].iloc[0]) if len(batch) else shard
            for key, ids in zip(batch["key"], own.encode(batch["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                if held and size + len(ids) > BLOCK:
                    yield row()
                    block, start, held, keys, size = block + 1, start + size, [], [], 0
                held.append(ids)
                keys.append(key)
                size += len(ids)
        if held:
            yield row()

    ordered.mapInPandas(blocks, FILE_SCHEMA).write.parquet(target)


def shard_offsets(files: DataFrame) -> DataFrame:
    """``shard`` and ``before``, the ids of all shards before it; one row per shard."""
    sizes = files.groupBy("shard").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


def read_packed(spark, target: str, id_type: str = "long", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``id_col``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian
    32-bit integers) and, with ``with_ids``, ``ids`` array<long> of every document of ``target``, block by block."""
    bound_batches(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(target)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lengths = np.asarray(row.lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                ids = [unpack(row.payload, row.bits, b - n, n) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = pd.DataFrame({"key": list(row.keys), "shard": row.shard, "at": row.start + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})
                if with_ids:
                    out["ids"] = [x.astype(np.int64) for x in ids]
                yield out

    schema = "key string, shard int, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = files.mapInPandas(read, schema).join(hint(shard_offsets(files), 16), "shard")
    return docs.select(F.col("key").cast(id_type).alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def document_index(files: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """``id_col``, ``shard``, ``block``, ``first`` (ids of the block before it) and ``n_tokens`` of every document."""
    each = files.select("shard", "block", "lengths", F.posexplode("keys").alias("place", "key"))
    first = F.aggregate(F.slice("lengths", F.lit(1), F.col("place")), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select(F.col("key").cast(id_type).alias(id_col), "shard", "block", first.alias("first"), F.get("lengths", "place").cast("long").alias("n_tokens"))


def document_at(files: DataFrame, shard: int, block: int, first: int, n_tokens: int) -> np.ndarray:
    """The ids of one document of :func:`document_index`, by random access: one row is read, one slice unpacked."""
    row = files.where((F.col("shard") == shard) & (F.col("block") == block)).select("payload", "bits").first()
    return unpack(bytes(row["payload"]), row["bits"], first, n_tokens)
