"""Fuzzy search for short licence notices.

A notice that may differ by k edits is split into k + 1 pieces; by the pigeonhole principle every match
has one of them unchanged.  One automaton finds all pieces of all notices in a text; around
each the regex library looks for the notice with at most k edits and tells the span.
Texts are compared as lower-cased words joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm import words as W


class Notice(NamedTuple):
    """Words of a notice, its label, the edits it may have, and whether exact places count as base places."""

    words: str
    label: str
    edits: int
    base: bool = False


#: fixed values: phrases and labels of the contract
BASE = (
    Notice("gnu general public license", "gpl", 2, True),
    Notice("apache license", "apache", 1, True),
    Notice("cc by", "cc-by", 0, True),
    Notice("mit license", "mit", 1, True),
)
#: wording of common public notices
MORE = (
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("bsd license", "bsd", 0),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("cc by sa", "cc-by-sa", 0),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("licensed under the apache license version 2 0", "apache", 4),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    Notice("redistribute it and or modify it under the terms of the gnu general public license", "gpl", 7),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 6),
    Notice("all rights reserved", "all-rights-reserved", 1),
)
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def byte_table() -> bytes:
    """A-Z to a-z, all other ASCII but digits and a-z to a space."""
    table = bytearray(range(256))
    for c in SEPARATORS:
        table[c] = 32
    for c in range(65, 91):
        table[c] = c + 32
    return bytes(table)


class Scanner:
    """Automaton and patterns of some notices."""

    def __init__(self, notices: Sequence[Notice]) -> None:
        import ahocorasick
        import regex

        self.notices, self.patterns = notices, []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            # the surrounding spaces make word borders part of the text that is compared
            cuts = np.linspace(0, len(notice.words), notice.edits + 2).round().astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(notice.words[a:b], []).append((k, a))
            self.patterns.append(regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice.words, literal_spaces=True)}){{e<={notice.edits}}}(?![^ ])"))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, first character, character after the last, edits) of all places in a text of joined words."""
        exact: set[tuple[int, int]] = set()
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                words, edits = self.notices[k].words, self.notices[k].edits
                begin = last + 1 - size - offset
                end = begin + len(words)
                if begin >= 0 and text.startswith(words, begin):
                    if (begin == 0 or text[begin - 1] == " ") and (end == len(text) or text[end] == " "):
                        exact.add((k, begin))
                        continue
                if edits:
                    windows.setdefault(k, []).append((max(0, begin - edits), min(len(text), end + edits)))
        found = [(k, begin, begin + len(self.notices[k].words), 0) for k, begin in exact]
        for k, places in windows.items():
            own = sorted((b, b + len(self.notices[k].words)) for n, b in exact if n == k)
            reached = -1
            for lo, hi in merged(places):
                # whole words at both ends, so that borders of the window aren't taken for those of words
                lo, hi = text.rfind(" ", 0, lo) + 1, text.find(" ", hi)
                for m in self.patterns[k].finditer(text[max(lo, reached):hi if hi >= 0 else len(text)]):
                    begin, end = m.start() + max(lo, reached), m.end() + max(lo, reached)
                    if not any(a < end and begin < b for a, b in own):
                        found.append((k, begin, end, sum(m.fuzzy_counts)))
                reached = max(reached, hi if hi >= 0 else len(text))
        return sorted(found, key=lambda x: x[1:] + x[:1])


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPAN = "array<struct<label string, first_word long, last_word long, edits long, similarity double, base boolean>>"


def spans_of(notices: Sequence[Notice]):
    """Batches of (id, text) as (id, n_words, spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, table = Scanner(notices), byte_table()
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()),
                                   ("similarity", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1)):
                raw, rows, sizes = data.tobytes().translate(table), [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    found = raw[a:b].split()
                    sizes.append(len(found))
                    text = b" ".join(found).decode()
                    spans, place, word = [], 0, 0
                    for k, begin, end, edits in scanner.scan(text):
                        word += text.count(" ", place, begin)
                        place, notice = begin, notices[k]
                        spans.append((notice.label, word, word + text.count(" ", begin, end), edits, 1 - edits / len(notice.words), notice.base and edits == 0))
                    rows.append(spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(
                    [[dict(zip(("label", "first_word", "last_word", "edits", "similarity", "base"), s, strict=True)) for s in r] for r in rows], kind)], ["id", "n_words", "spans"])

    return run


def license_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", notices: Sequence[Notice] = (*BASE, *MORE)) -> DataFrame:
    """(id, n_words, spans) of every row: each place of each notice with its words, edits and similarity, in order.

    A null or empty text has no words and no spans.  Fuzzy places that overlap an exact place of the same notice, or each
    other, count once.  Repeated rows and null ids stay rows of their own; other columns are ignored.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(spans_of(notices), f"id long, n_words long, spans {SPAN}").withColumnRenamed("id", id_column)


def license_summary(spans: DataFrame) -> DataFrame:
    """Counts, first and last base place, labels and best similarity of each row of ``license_spans``."""
    base = F.filter("spans", lambda s: s.base)
    labels = lambda s: F.array_join(F.array_sort(F.array_distinct(F.transform(s, lambda x: x.label))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s.similarity)), F.lit(0.0))
    return spans.select(
        "*", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda s: s.first_word)).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s.first_word)).alias("last_word"), labels(base).alias("base_labels"),
        labels("spans").alias("labels"), score.alias("score"))
