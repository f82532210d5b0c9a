"""SentencePiece encoding that keeps offsets.

A text is normalised by longest prefixes: at each place the compiled character map of the model is walked as far as it
goes, the longest key found is replaced, and every byte made is given the byte of the source that it came from. Pieces
are merged on the normalised text, and each one is projected through that alignment to its span of source bytes.

Where a model has no character map and keeps all white space, the alignment is known without a walk: every character
stands for itself, and words can be merged once each. Other models and texts take the general way; both give the same.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty

#: What stands for a space in pieces, and for bytes that are no UTF-8.
SPACE, BROKEN = "▁", "�"
#: Kinds of pieces (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker keeps, characters of a word that is kept, symbols that are merged without a heap.
KEEP, KEPT_LENGTH, FEW = 600_000, 32, 24
#: Characters of the texts that are encoded at once, and words that are merged side by side.
AT_ONCE, MERGED_AT_ONCE = 4_000_000, 4096
#: Rank of a pair that makes no piece.
NEVER = 1 << 30


class Encoded(NamedTuple):
    """Ids of pieces with the span of source bytes of each; control ids have empty spans."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 keys and the strings that replace them.

    A unit's 32 bits hold a label (lowest 8 and the highest), whether a value hangs on it (bit 8), and the offset of its
    children (from bit 10, shifted by 8 if bit 9 is set); a unit with a value has the highest bit and 31 bits of value.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size :]

    def longest(self, source: bytes, start: int) -> tuple[bytes, int] | None:
        """What replaces the longest key at ``start``, and the bytes of that key."""
        units, found = self.units, None
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        at = offset(units[0])
        for k in range(start, len(source)):
            at ^= source[k]
            if at >= len(units):
                break
            unit = units[at]
            if unit & 0x800000FF != source[k]:
                break
            at ^= offset(unit)
            if unit >> 8 & 1:
                found = units[at] & 0x7FFFFFFF, k + 1 - start
        if found is None:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]


class PieceModel:
    """A model file of the sentencepiece library, of the kind that merges pairs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError(f"{path}: not a model that merges pairs")
        form = model.normalizer_spec
        self.map = CharacterMap(form.precompiled_charsmap) if form.precompiled_charsmap else None
        self.prefix, self.suffix = (form.add_dummy_prefix and not model.trainer_spec.treat_whitespace_as_suffix), (form.add_dummy_prefix and model.trainer_spec.treat_whitespace_as_suffix)
        self.trims, self.escapes = form.remove_extra_whitespaces, form.escape_whitespaces
        kinds = [p.type for p in model.pieces]
        self.scores = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.unused = {p.piece for p in model.pieces if p.type == UNUSED}
        self.symbols = sorted((p.piece for p in model.pieces if p.type == USER), key=len, reverse=True)
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = [i for i, kind in enumerate(kinds) if kind == BYTE] if model.trainer_spec.byte_fallback else []
        named = {p.piece: i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.begin, self.end = named.get(model.trainer_spec.bos_piece, self.unknown), named.get(model.trainer_spec.eos_piece, self.unknown)
        # a piece never holds a space behind another character, so words never merge with each other
        self.by_words = self.escapes and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores)
        self.plain = self.by_words and self.map is None and not self.trims and self.prefix and not self.symbols
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.user = re.compile("|".join(map(re.escape, self.symbols))) if self.symbols else None
        self.plain = self.plain and not self.unused
        self.table = MergeTable(self) if self.plain else None
        self.known: dict[str, bytes] = {}

    # normalising

    def _step(self, source: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the longest prefix at ``at``, and the bytes of that prefix."""
        if self.symbols:
            own = next((b for s in self.symbols if source.startswith(b := s.encode(), at)), None)
            if own:
                return own, len(own)
        found = self.map.longest(source, at) if self.map else None
        if found:
            return found
        size = _character(source, at)
        return (source[at : at + size], size) if size else (BROKEN.encode(), 1)

    def normalise(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for their end, the byte of the source where its prefix begins."""
        made, origin, at = bytearray(), [], 0
        space = SPACE.encode() if self.escapes else b" "

        def put(piece: bytes) -> None:
            made.extend(piece)
            origin.extend([at] * len(piece))

        if self.trims:
            while at < len(source) and (step := self._step(source, at))[0] == b" ":
                at += step[1]
        if at == len(source):
            return b"", np.array([at] if source else [0])
        if self.prefix:
            put(space)
        after_space = self.trims
        while at < len(source):
            piece, size = self._step(source, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", space))
                after_space = piece.endswith(b" ")
            at += size
            after_space = after_space and self.trims
        if self.trims:
            while made.endswith(space):
                at = origin[len(made) - len(space)]
                del made[-len(space) :]
                del origin[-len(space) :]
        if self.suffix:
            put(space)
        return bytes(made), np.array([*origin, at])

    # merging

    def merge(self, word: str) -> list[str]:
        """The pieces of a normalised string: the pair of the best score is joined first, of equal scores the leftmost."""
        symbols, fixed, at = [], [], 0
        for found in self.user.finditer(word) if self.user else ():
            symbols += [*word[at : found.start()], found.group()]
            fixed += [False] * (found.start() - at) + [True]
            at = found.end()
        symbols += word[at:]
        fixed += [False] * (len(word) - at)
        pieces = self._merge_few(symbols) if len(symbols) <= FEW and not self.symbols else self._merge_many(symbols, fixed)
        return [p for whole in pieces for p in self._split(whole[0], whole[1])] if self.unused else [whole[0] if isinstance(whole, tuple) else whole for whole in pieces]

    def _merge_few(self, symbols: list[str]) -> list:
        get = self.scores.get
        whole = (float("inf"), -1)
        pairs = [get(a + b, whole)[0] for a, b in zip(symbols, symbols[1:], strict=False)]
        parts: list = list(symbols)
        trees: list = [None] * len(symbols)
        while pairs and (best := min(pairs)) != whole[0]:
            k = pairs.index(best)
            trees[k : k + 2] = [((parts[k], trees[k]), (parts[k + 1], trees[k + 1]))]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], whole)[0]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], whole)[0]
        return list(zip(parts, trees, strict=True)) if self.unused else parts

    def _merge_many(self, symbols: list[str], fixed: list[bool]) -> list:
        parts, trees = list(symbols), [None] * len(symbols)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and not fixed[a] and not fixed[b] and (found := self.scores.get(parts[a] + parts[b])):
                heapq.heappush(heap, (found[0], a, b, len(parts[a]) + len(parts[b])))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            trees[a] = ((parts[a], trees[a]), (parts[b], trees[b]))
            parts[a], parts[b] = parts[a] + parts[b], ""
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [(p, t) for p, t in zip(parts, trees, strict=True) if p]

    def _split(self, piece: str, tree) -> Iterator[str]:
        """A piece that is not to be used is what it was merged from."""
        if piece in self.unused and tree:
            for part in tree:
                yield from self._split(*part)
        else:
            yield piece

    def ids_of(self, piece: str) -> list[int]:
        found = self.scores.get(piece)
        if found:
            return [found[1]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    # texts

    def encode(self, text: str) -> Encoded:
        """Ids and source spans of ``text`` in the general way. The last of the bytes of an unknown character has its span; the bytes before it have the empty span where it begins."""
        made, origin = self.normalise(text.encode())
        normal = made.decode()
        ids, begins, ends, at = [], [], [], 0
        unknown_before = False
        for word in self.words.findall(normal) if self.by_words and not self.symbols else [normal] * bool(normal):
            for piece in self.merge(word):
                size = len(piece.encode())
                a, b = int(origin[at]), int(origin[at + size])
                own = self.ids_of(piece)
                if own == [self.unknown] and unknown_before:
                    ends[-1] = b  # unknown neighbours are one
                else:
                    ids += own
                    begins += [a] * len(own)
                    ends += [a] * (len(own) - 1) + [b]
                unknown_before = own == [self.unknown]
                at += size
        return Encoded(np.array(ids, dtype=np.uint32), np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64))

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of ``words``: short ones are merged side by side, a pair of every word at a time."""
        short = sorted((w for w in words if len(w) <= FEW), key=len)
        for a in range(0, len(short), MERGED_AT_ONCE):
            some = short[a : a + MERGED_AT_ONCE]
            for word, ids in zip(some, self.table.merge(some), strict=True):
                if ids is not None:
                    self.known[word] = ids
        for word in words:
            if word not in self.known:
                self.known[word] = np.array([i for piece in self.merge(word) for i in self.ids_of(piece)], dtype=np.uint32).tobytes()

    def encode_all(self, texts: list[str]) -> list[Encoded]:
        """Ids and source spans of every text, from words that are merged once where the alignment is plain."""
        plain = [bool(text) and self.plain and SPACE not in text for text in texts]
        cut = [self.words.findall(SPACE + text.replace(" ", SPACE)) if p else [] for text, p in zip(texts, plain, strict=True)]
        if len(self.known) > KEEP:
            self.known = {}
        fresh = list(set().union(*cut) - self.known.keys())
        self._learn(fresh)
        get, out = self.known.__getitem__, []
        for text, p, words in zip(texts, plain, cut, strict=True):
            if p:
                ids = np.frombuffer(b"".join(map(get, words)), dtype=np.uint32)
                ends = np.cumsum(self.table.sizes_of(ids)) - 1  # the first space is not of the source
                out.append(Encoded(ids, np.concatenate(([0], ends[:-1])), ends))
            else:
                out.append(self.encode(text))
        for word in fresh:
            if len(word) > KEPT_LENGTH:
                del self.known[word]
        return out


class MergeTable:
    """All pairs of pieces that make a piece, as a hash table of arrays, for merging many words side by side."""

    def __init__(self, model: PieceModel):
        self.ids = {p: i for p, (_, i) in model.scores.items()}
        self.byte_ids = np.array(model.bytes, dtype=np.int64)
        self.vocabulary = 1 + max([*self.ids.values(), *model.bytes, model.unknown])
        order = {s: r for r, s in enumerate(sorted({s for s, _ in model.scores.values()}))}
        pairs = [(self.ids[p[:k]] * self.vocabulary + self.ids[p[k:]], order[s], i) for p, (s, i) in model.scores.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        keys, ranks, made = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, dtype=np.int64),) * 3
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.key, self.rank, self.made = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NEVER, dtype=np.int32), np.zeros(1 << self.bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # those whose slot is taken go one on
            free = self.key[slot] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            first &= free
            put = left[first]
            self.key[slot[first]], self.rank[slot[first]], self.made[slot[first]] = keys[put], ranks[put], made[put]
            left, slot = left[~first], (slot[~first] + 1) & ((1 << self.bits) - 1)
        length = np.ones(self.vocabulary, dtype=np.int64)
        for p, i in self.ids.items():
            length[i] = len(p.replace(SPACE, " ").encode())
        self.length, self.byte = length, np.full(self.vocabulary, -1, dtype=np.int64)
        self.byte[self.byte_ids] = np.arange(len(self.byte_ids))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; NEVER-ranked if there is none."""
        keys = np.where((a < self.vocabulary) & (b < self.vocabulary) & (a >= 0) & (b >= 0), a.astype(np.int64) * self.vocabulary + b, -2)
        slot = self._slot(keys)
        at = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            at = at[(self.key[slot[at]] != keys[at]) & (self.key[slot[at]] >= 0)]
        return slot

    def merge(self, words: list[str]) -> list[bytes | None]:
        """Ids of every word; None for words of which nothing is known (their unknown characters have no bytes)."""
        sizes = np.array([len(w) for w in words])
        characters, at = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
        known = np.array([self.ids.get(chr(c), self.vocabulary + k) for k, c in enumerate(characters.tolist())], dtype=np.int32)
        width = int(sizes.max(initial=1))
        symbols = np.full((len(words), width), -1, dtype=np.int32)
        symbols[np.arange(width) < sizes[:, None]] = known[at]
        slots = self.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(words), width - 1)
        rank = np.where((symbols[:, :-1] >= 0) & (symbols[:, 1:] >= 0), self.rank[slots], NEVER)
        # keys that were not found end at a free slot, whose rank is NEVER
        live = np.arange(len(words))
        done = symbols.copy()
        while width > 1 and len(live):
            k = rank.argmin(axis=1)
            row = np.arange(len(live))
            going = rank[row, k] < NEVER
            if not going.all():
                done[live[~going], : symbols.shape[1]] = symbols[~going]
                done[live[~going], symbols.shape[1] :] = -1
                live, symbols, rank, slots, k = live[going], symbols[going], rank[going], slots[going], k[going]
                row = np.arange(len(live))
                if not len(live):
                    break
            made = self.made[slots[row, k]]
            symbols[row, k] = made
            keep = np.arange(symbols.shape[1] - 1)
            take = keep + (keep > k[:, None])
            symbols = np.take_along_axis(symbols, take, axis=1)
            if symbols.shape[1] == 1:
                done[live, 0], done[live, 1:] = symbols[:, 0], -1
                break
            pair = np.arange(symbols.shape[1] - 1)
            take = pair + (pair >= k[:, None])
            rank, slots = np.take_along_axis(rank, take, axis=1), np.take_along_axis(slots, take, axis=1)
            for offset in (-1, 0):
                here = np.flatnonzero((k + offset >= 0) & (k + offset < rank.shape[1]))
                p = k[here] + offset
                slot = self.find(symbols[here, p], symbols[here, p + 1])
                slots[here, p] = slot
                rank[here, p] = np.where(symbols[here, p + 1] >= 0, self.rank[slot], NEVER)
        lengths = (done >= 0).sum(axis=1)
        flat = done[done >= 0]
        odd = (flat >= self.vocabulary).any() and np.logical_or.reduceat(flat >= self.vocabulary, np.cumsum(lengths) - lengths)
        ends = (4 * np.cumsum(lengths)).tolist()
        data = flat.astype(np.uint32).tobytes()
        out: list[bytes | None] = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for w in np.flatnonzero(odd).tolist():
            out[w] = None
            if len(self.byte_ids):
                own = [self.byte_ids[list(chr(characters[i - self.vocabulary]).encode())] if i >= self.vocabulary else [i] for i in done[w, : lengths[w]].tolist()]
                out[w] = np.concatenate(own).astype(np.uint32).tobytes()
        return out

    def sizes_of(self, ids: np.ndarray) -> np.ndarray:
        """Source bytes of every piece of a text; of a character's bytes, the last has them all."""
        sizes, byte = self.length[ids], self.byte[ids]
        at = np.flatnonzero(byte >= 0)
        if len(at):
            inner = (byte[at] & 0xC0) == 0x80
            last = ~np.append(inner[1:] & (at[1:] == at[:-1] + 1), False)
            first = np.maximum.accumulate(np.where(inner, 0, np.arange(len(at))))
            sizes[at] = np.where(last, np.arange(len(at)) - first + 1, 0)
        return sizes


def _character(source: bytes, at: int) -> int:
    """Bytes of the character at ``at``; 0 if it is no valid UTF-8."""
    first = source[at]
    size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    try:
        source[at : at + size].decode()
    except UnicodeDecodeError:
        return 0
    return size


_MODELS: dict[str, PieceModel] = {}
_DECODERS: dict[str, object] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def decoder(path: str):
    if path not in _DECODERS:
        import sentencepiece

        _DECODERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _DECODERS[path]


def in_runs(texts: list[str], most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of ``texts`` of ``most`` characters, or of one text."""
    a, held = 0, 0
    for b, text in enumerate(texts):
        if b > a and held + len(text) > most:
            yield slice(a, b)
            a, held = b, 0
        held += len(text)
    if a < len(texts):
        yield slice(a, len(texts))


def piece_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True, digests: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids``, ``begins`` and ``stops`` (source bytes of every piece, end exclusive) and ``decoded`` of every whole text.

    ``path``: a model of the sentencepiece library that all executors can read. ``ends``: with begin and end ids, whose spans
    are empty. ``digests``: instead of the three arrays and the text, ``ids_sha256``, ``spans_sha256`` (begin and end of every piece as little-endian
    64-bit integers) and ``decoded_sha256``. A null text counts as empty and has the begin and end ids alone. Ids and decoded
    texts are those of the library. Repeated rows are encoded each; null ids stay null; other columns are not read; an empty
    table gives an empty result. A worker holds one Arrow batch, or one text if that is longer, and KEEP words.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("string").alias("key"), text_or_empty(text_col).alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        own, library = piece_model(path), decoder(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for part in in_runs(batch["text"].tolist()):
                some = batch.iloc[part]
                out: dict[str, list] = {name: [] for name in ("n_tokens", "ids", "begins", "stops", "decoded")}
                texts = some["text"].tolist()
                for text, (ids, begins, stops) in zip(texts, own.encode_all(texts), strict=True):
                    if ends:
                        last = len(text.encode())
                        ids = np.concatenate(([own.begin], ids, [own.end])).astype(np.uint32)
                        begins, stops = np.concatenate(([0], begins, [last])), np.concatenate(([0], stops, [last]))
                    decoded = library.decode(ids.tolist())
                    out["n_tokens"].append(len(ids))
                    if digests:
                        out["ids"].append(sha(ids.astype("<u4").tobytes()))
                        out["begins"].append(sha(np.stack((begins, stops), axis=1).astype("<i8").tobytes()))
                        out["decoded"].append(sha(decoded.encode()))
                    else:
                        for name, value in (("ids", ids.astype(np.int64)), ("begins", begins), ("stops", stops), ("decoded", decoded)):
                            out[name].append(value)
                if digests:
                    out = {"n_tokens": out["n_tokens"], "ids_sha256": out["ids"], "spans_sha256": out["begins"], "decoded_sha256": out["decoded"]}
                yield pd.DataFrame({"key": some["key"].tolist(), **out})

    tail = "ids_sha256 string, spans_sha256 string, decoded_sha256 string" if digests else "ids array<long>, begins array<long>, stops array<long>, decoded string"
    found = rows.mapInPandas(encode, f"key string, n_tokens long, {tail}")
    return found.select(F.col("key").cast(kind).alias(id_col), *found.columns[1:])
