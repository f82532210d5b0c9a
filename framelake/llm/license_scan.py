"""License scan: short notices, exact and with a bounded number of edits.

A notice of L characters that may differ in k edits is split into k + 1 pieces; at least one piece then stands unchanged
in any such occurrence (pigeonhole). One Aho-Corasick pass over the words of a text finds all pieces of all notices; each
hit says where the notice can begin and end, and the ``regex`` library verifies each such stretch of whole words with at most k
edits. Of occurrences of one notice that overlap, that with the fewest edits counts, then the first, then the shortest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty


class Notice(NamedTuple):
    phrase: str
    label: str
    edits: int


#: Exact phrases: label by phrase.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices looked for with edits. About one edit for nine characters.
NOTICES = (
    Notice("general public license", "gpl", 2),
    Notice("all rights reserved", "reserved", 2),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("licensed under the apache license", "apache", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("bsd 3 clause license", "bsd", 2),
    Notice("licensed under cc by", "cc-by", 2),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("released into the public domain", "public-domain", 3),
    Notice("dedicated to the public domain", "public-domain", 3),
    Notice("lesser general public license", "lgpl", 3),
    Notice("affero general public license", "agpl", 3),
    Notice("eclipse public license", "epl", 2),
    Notice("common development and distribution license", "cddl", 4),
    Notice("boost software license", "bsl", 2),
    Notice("permission to use copy modify and or distribute this software", "isc", 5),
    Notice("server side public license", "sspl", 2),
    Notice("sil open font license", "ofl", 2),
    Notice("creative commons zero", "cc0", 2),
    Notice("attribution sharealike", "cc-by-sa", 2),
    Notice("attribution noncommercial", "cc-by-nc", 2),
    Notice("no part of this publication may be reproduced", "reserved", 4),
    Notice("unauthorized copying of this file", "proprietary", 3),
    Notice("proprietary and confidential", "proprietary", 3),
)

SCHEMA_TAIL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long, edits: int>>"
)

#: Letters A-Z become small, digits, small letters and bytes of other alphabets stay, all else separates words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised_words(text: str) -> str:
    """The words of a text in small letters, each between single spaces, a space at either end."""
    words = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else " "


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): ``edits + 1`` pieces of nearly equal length that cover the phrase."""
    n, k = len(notice.phrase), notice.edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def spaces(words: str, first: int, last: int) -> list[int]:
    """Places of spaces from ``first`` to ``last``."""
    out, at = [], words.find(" ", max(0, first), max(0, last + 1))
    while at >= 0:
        out.append(at)
        at = words.find(" ", at + 1, last + 1)
    return out


class Scanner:
    def __init__(self, base: dict[str, str], notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.base, self.notices = base, notices
        self.verify = [regex.compile(rf"(?b)(?:{regex.escape(x.phrase)}){{e<={x.edits}}}") for x in notices]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for at, piece in pieces(notice):
                found.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def exact(self, words: str) -> list[tuple[int, str]]:
        """(place of the space before it, phrase) of every occurrence of a base phrase."""
        out = []
        for phrase in self.base:
            at = words.find(f" {phrase} ")
            while at >= 0:
                out.append((at, phrase))
                at = words.find(f" {phrase} ", at + 1)
        return sorted(out)

    def stretches(self, words: str) -> set[tuple[int, int, int]]:
        """(notice, start, end): stretches of whole words, given by the spaces around them, that a seed allows a notice to fill."""
        out = set()
        for last, (length, uses) in self.seeds.iter(words):
            for i, at in uses:
                phrase, k = self.notices[i].phrase, self.notices[i].edits
                start = last + 1 - length - at  # of the phrase, if there was no edit before the seed
                for a in spaces(words, start - k - 1, start + k - 1):
                    for b in spaces(words, max(a + 2, a + 1 + len(phrase) - k), a + 1 + len(phrase) + k):
                        out.add((i, a, b))
        return out

    def fuzzy(self, words: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of the verified occurrences, those of one notice without overlap."""
        out: list[tuple[int, int, int, int]] = []
        verified = []
        for i, a, b in self.stretches(words):
            m = self.verify[i].fullmatch(words, a + 1, b)
            if m:
                verified.append((i, sum(m.fuzzy_counts), a, b))
        for i, own in groupby(sorted(verified), key=lambda x: x[0]):
            free: list[tuple[int, int]] = []  # apart from each other, in order
            for _, edits, a, b in own:
                at = bisect_left(free, (a, b))
                if not (at and free[at - 1][1] > a) and not (at < len(free) and free[at][0] < b):
                    free.insert(at, (a, b))
                    out.append((a, b, i, edits))
        return sorted(out)

    def scan(self, text: str) -> tuple:
        words = normalised_words(text)
        n_words = words.count(" ") - 1
        exact, fuzzy = self.exact(words), self.fuzzy(words)
        word_at, at, n = {}, 0, 0
        for place in sorted({x[0] for x in exact} | {x[0] for x in fuzzy} | {x[1] for x in fuzzy}):
            n += words.count(" ", at, place)
            word_at[place], at = n, place
        starts = [word_at[place] for place, _ in exact]
        base = {self.base[phrase] for _, phrase in exact}
        labels = base | {self.notices[i].label for _, _, i, _ in fuzzy}
        score = 1.0 if exact else max((1.0 - e / len(self.notices[i].phrase) for _, _, i, e in fuzzy), default=0.0)
        spans = [{"label": self.notices[i].label, "first_word": word_at[s], "last_word": word_at[t] - 1, "edits": e} for s, t, i, e in fuzzy]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return n_words, len(exact), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Notices of every text of ``df``; one row per row of ``df``, no shuffle.

    ``n_base``, ``first_word``, ``last_word``, ``base_labels``: places where a phrase of ``base`` stands word for word.
    ``labels``, ``spans``: these and the ``notices`` found with edits; a span is in words, both ends included. ``score``:
    1 for an exact notice, else the largest share of a notice's characters that needed no edit, else 0.

    A null text counts as empty: no words, null ``first_word``, empty labels, score 0. A null id stays null. Repeated rows
    give repeated results. Long texts are scanned whole, in time linear in the text and its candidate windows. Other
    columns of ``df``, whatever their names, are not read. An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(base, notices)
        for batch in batches:
            rows = [scanner.scan(text) for text in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    return df.select(F.col(id_col).cast("string").alias(id_col), text_or_empty(text_col).alias("text")).mapInPandas(scan, f"`{id_col}` string, {SCHEMA_TAIL}").withColumn(id_col, F.col(id_col).cast(kind))
