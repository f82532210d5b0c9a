"""Byte-level BPE by merge replay over many texts at once.

A block of documents is cut into its distinct pieces (matches of the tokenizer's pattern). All pieces lie in one array of
tokens; an inverted index leads from the token that a neighbouring pair would form (that is, from the pair's rank) to the
places of such pairs. Ranks are taken from the lowest up, each is applied to all its places together, and only the
neighbours of the places touched are looked up again. Results of pieces are kept between blocks in a bounded table.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty

#: White space as the tokenizer's pattern has it (the Unicode property), for Python's engines, which differ at 1C-1F.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Runs that a pattern of this kind never crosses: other characters with one space before them, or white space.
COARSE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Runs that a Python worker keeps between blocks.
KEEP = 500_000
#: Rows of a batch that is handed back.
ROWS = 500
#: Characters of the texts that are encoded together.
BLOCK = 8_000_000


pack = struct.Struct("=i").pack


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class MergeReplay:
    """Encoder for a rank file; ``pattern`` cuts a text into the pieces that are encoded separately."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, np.iinfo(np.int64).max], dtype=np.int64)
        self.pair_ranks = np.array([*map(pairs.__getitem__, keys), -1], dtype=np.int64)
        self.known, self.ids_of, self.uses = Numbers(), list[bytes](), np.zeros(0, dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair forms, -1 if none."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def one(self, piece: bytes) -> list[int]:
        """A single piece, pair by pair: the lowest rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1))
            if rank == self.size:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of every piece, as int32 in bytes."""
        out = [pack(rank) if (rank := self.ranks.get(piece)) is not None else b"" for piece in pieces]
        todo = [i for i, ids in enumerate(out) if not ids and pieces[i]]
        if not todo:
            return out
        length = np.array([len(pieces[i]) for i in todo], dtype=np.int64)
        end = np.cumsum(length)
        token = self.byte_rank[np.frombuffer(b"".join(pieces[i] for i in todo), dtype=np.uint8)].astype(np.int32)
        owner = np.repeat(np.arange(len(todo), dtype=np.int32), length)
        following, before = np.arange(1, len(token) + 1, dtype=np.int32), np.arange(-1, len(token) - 1, dtype=np.int32)
        following[end - 1], before[end - length] = -1, -1
        lower = np.zeros(len(todo), dtype=bool)

        # the inverted index: places by rank, those of the start and those that merges added
        place = np.flatnonzero(following >= 0)
        rank = self.rank_of(token[place], token[place + 1])
        place, rank = place[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        ranks, cuts = np.unique(rank[order], return_index=True)
        start = dict(zip(ranks.tolist(), np.split(place[order], cuts[1:]), strict=True)) if len(ranks) else {}
        added: dict[int, list[np.ndarray]] = {}
        queue = sorted(start)
        while queue:
            now = heapq.heappop(queue)
            at = start.pop(now, None)
            if (more := added.pop(now, None)) is not None:
                at = np.unique(np.concatenate(more if at is None else [at, *more]))
            if at is None:
                continue
            at = at[(token[at] >= 0) & (following[at] >= 0)]
            at = at[self.rank_of(token[at], token[following[at]]) == now]
            if len(at) > 1 and (chained := following[at[:-1]] == at[1:]).any():  # aaa: from the left, without overlap
                fresh = np.concatenate(([True], ~chained))
                at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            after = following[gone]
            token[at], token[gone], following[at] = now, -1, after
            has_after = after >= 0
            before[after[has_after]] = at[has_after]
            left = before[at]
            touched = np.concatenate((left[left >= 0], at[has_after]))
            rank = self.rank_of(token[touched], token[following[touched]])
            formed = rank >= 0
            touched, rank = touched[formed], rank[formed]
            lower[owner[touched[rank < now]]] = True  # a lower rank than the one at work: such a piece is done by itself
            if not len(rank):
                continue
            order = np.argsort(rank)
            touched, rank = touched[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()]
            for r, a, b in zip(rank[cuts].tolist(), cuts, [*cuts[1:], len(rank)], strict=True):
                if r in added:
                    added[r].append(touched[a:b])
                else:
                    added[r] = [touched[a:b]]
                    if r not in start:
                        heapq.heappush(queue, r)
        alive = token >= 0
        ids = token[alive].tobytes()
        ends = (4 * np.cumsum(np.bincount(owner[alive], minlength=len(todo)))).tolist()
        a = 0
        for k, (i, b) in enumerate(zip(todo, ends, strict=True)):
            out[i] = b"".join(map(pack, self.one(pieces[i]))) if lower[k] else ids[a:b]
            a = b
        return out

    def number(self, texts: Iterable[str]) -> list[array]:
        """The numbers of every text's runs; runs not met before are encoded, all together."""
        if len(self.known) > KEEP:  # runs met once are the most and the least use
            often = np.flatnonzero(self.uses > 1).tolist() if (self.uses > 1).sum() <= KEEP // 2 else []
            order = list(self.known)
            self.known, self.ids_of = Numbers((order[i], n) for n, i in enumerate(often)), [self.ids_of[i] for i in often]
            self.uses = np.zeros(len(often), dtype=np.int64)
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects, none in cycles
        try:
            out = [array("i", map(self.known.__getitem__, COARSE.findall(text))) for text in texts]
            uses = np.zeros(len(self.known), dtype=np.int64)
            uses[: len(self.uses)] = self.uses
            for runs in out:
                np.add.at(uses, np.frombuffer(runs, dtype=np.int32), 1)
            self.uses = uses
            piece_no = Numbers()
            cut = [[piece_no[piece] for piece in self.pattern.findall(run)] for run in islice(self.known, len(self.ids_of), None)]
            ids = self.replay([piece.encode() for piece in piece_no])
            self.ids_of += [ids[at[0]] if len(at) == 1 else b"".join([ids[k] for k in at]) for at in cut]
        finally:
            if collecting:
                gc.enable()
        return out

    def ids(self, runs: array) -> np.ndarray:
        """The ids that numbered runs stand for, int32; before the next call of ``number``."""
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, runs)), dtype=np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(runs) for runs in self.number(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple[str, str], MergeReplay] = {}


def encoder(path: str, pattern: str) -> MergeReplay:
    """The worker's encoder for this file, with what it has kept."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = MergeReplay(path, pattern)
    return _ENCODERS[path, pattern]


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """Batches of about BLOCK characters together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch["text"].str.len().sum()
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lengths_only: bool = False, decoded: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens`` long and, unless ``lengths_only``, ``ids`` array<int> of every row's whole text.

    ``decoded``: also ``decoded`` binary, the bytes that the ids stand for.

    ``path``: a rank file that every executor has. Special tokens are ordinary text. A null or empty text has no ids; a
    null id stays null; repeated rows are encoded each; no other column is read. There is no shuffle, and a lost task is
    simply run again. Blocks are of about BLOCK characters, or of one text where that is longer.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for held in blocks(batches):
            numbered = own.number(text for batch in held for text in batch["text"])
            keys = pd.concat([batch[id_col] for batch in held])
            del held
            for a in range(0, len(numbered), ROWS):
                ids = [own.ids(runs) for runs in numbered[a : a + ROWS]]
                out = pd.DataFrame({id_col: keys.iloc[a : a + ROWS].to_numpy(), "n_tokens": np.array([len(x) for x in ids], dtype=np.int64)})
                if not lengths_only:
                    out["ids"] = ids
                if decoded:
                    out["decoded"] = [own.decode(x) for x in ids]
                yield out

    schema = f"`{id_col}` string, n_tokens long" + ("" if lengths_only else ", ids array<int>") + (", decoded binary" if decoded else "")
    return df.select(F.col(id_col).cast("string").alias(id_col), text_or_empty(text_col).alias("text")).mapInPandas(encode, schema).withColumn(id_col, F.col(id_col).cast(kind))


def bpe_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids_col`` and ``decoded`` binary: the bytes that the ids of every row stand for (null ids: none)."""
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for batch in batches:
            ids = [np.empty(0, dtype=np.int32) if x is None else x for x in batch["ids"]]
            yield pd.DataFrame({id_col: batch[id_col].to_numpy(), ids_col: ids, "decoded": [own.decode(x) for x in ids]})

    return df.select(F.col(id_col).cast("string").alias(id_col), F.col(ids_col).alias("ids")).mapInPandas(decode, f"`{id_col}` string, `{ids_col}` array<int>, decoded binary").withColumn(id_col, F.col(id_col).cast(kind))
