"""License scans: exact phrases, and short notices with a few edits."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ambientspark.llm.common import id_text, per_batch

#: Words that stand consecutively, and their label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Short notices, as words in lower case, and their label.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

#: A-Z become a-z; ASCII signs that are neither letters nor digits become spaces.
FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = "struct<label: string, by: string, first_word: bigint, last_word: bigint, start: bigint, end: bigint, errors: int, chars: int>"


@dataclass(frozen=True)
class Notice:
    text: str
    label: str

    @property
    def edits(self) -> int:
        return max(1, len(self.text) // CHARS_PER_EDIT)

    def seeds(self) -> list[tuple[int, str]]:
        """edits + 1 pieces (offset, text): with no more edits than allowed, one of them stands unchanged."""
        pieces = self.edits + 1
        cuts = [len(self.text) * k // pieces for k in range(pieces + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def compiled(notices: tuple[tuple[str, str], ...]):
    """The notices, their bounded-error patterns, and the automaton of all seeds."""
    import ahocorasick
    import regex

    known, seeds = [Notice(*x) for x in notices], {}
    for k, notice in enumerate(known):
        for offset, piece in notice.seeds():
            seeds.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return known, [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in known], automaton


def fuzzy_spans(text: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, int]]:
    """(start, end, errors, number of the notice) in a normalised text; overlapping finds give way to those with fewer errors, then longer ones."""
    known, patterns, automaton = compiled(notices)
    places: dict[int, list[int]] = {}
    for end, (length, hits) in automaton.iter(text):
        for k, offset in hits:
            places.setdefault(k, []).append(end + 1 - length - offset)
    found = []
    for k, starts in places.items():
        notice, begin, until = known[k], None, -1
        windows = []
        for s in sorted(set(starts)):
            low, high = s - notice.edits, s + len(notice.text) + notice.edits
            if begin is None or low > until:
                if begin is not None:
                    windows.append((begin, until))
                begin = max(0, low)
            until = high
        windows.append((begin, until))
        for low, high in windows:
            parts = [(low, min(high, len(text)))]
            while parts:  # the best match, then what lies before and after it
                low, high = parts.pop()
                if (m := patterns[k].search(text, low, high)) and m.end() > m.start():
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts), k))
                    parts += [(low, m.start()), (m.end(), high)]
    found.sort(key=lambda x: (x[2] / len(known[x[3]].text), x[0] - x[1], x[0], x[3]))
    kept: list[tuple[int, int, int, int]] = []
    for x in found:
        if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
            kept.append(x)
    return sorted(kept)


def scan_text(raw: bytes, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> tuple[int, list[tuple]]:
    words = raw.translate(FOLD).split(b" ")
    words = [w for w in words if w]
    text = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    found = []  # label, by, start and end in text, errors, length of what was looked for
    for phrase, label in phrases:
        at = text.find(look := f" {phrase} ")
        while at >= 0:
            found.append((label, "phrase", at + 1, at + len(look) - 1, 0, len(phrase)))
            at = text.find(look, at + 1)
    known = compiled(notices)[0]
    found += [(known[k].label, "notice", a, b, errors, len(known[k].text)) for a, b, errors, k in fuzzy_spans(text, notices)]
    if not found:
        return len(words), []
    places = [m.span() for m in WORD.finditer(raw.decode("utf-8", "replace"))]

    def word_at(at: int) -> int:
        return max(0, min(text.count(" ", 0, at + 1) - 1, len(places) - 1))

    out = []
    for label, by, a, b, errors, chars in found:
        first, last = word_at(a), word_at(b - 1)
        out.append((label, by, first, last, places[first][0], places[last][1], errors, chars))
    return len(words), sorted(out, key=lambda x: (x[2], x[3], x[1], x[0]))


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans.

    A span has its label, whether a phrase or a notice was found, its first and last word (from 0), start and end
    (code points of the original text, end exclusive, whole words), the edits and the length of what was looked for.
    Notices match with one edit per twelve characters: seeds that must stand unchanged locate candidates, and bounded-error
    matching decides. A null or empty text has no words and no spans. Repeated rows and null ids are kept. No shuffle.
    """
    p, n = tuple(phrases.items()), tuple(notices.items())
    names = ("label", "by", "first_word", "last_word", "start", "end", "errors", "chars")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [scan_text(t, p, n) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        kind = pa.list_(pa.struct([(x, pa.string() if x in ("label", "by") else pa.int32() if x in ("errors", "chars") else pa.int64()) for x in names]))
        spans = pa.array([[dict(zip(names, x, strict=True)) for x in spans] for _, spans in got], kind)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in got], pa.int64()), spans], names=["doc_id", "n_words", "spans"])

    return per_batch(id_text(docs), step, f"doc_id long, n_words long, spans array<{SPAN}>")


def license_digest(spans: DataFrame) -> DataFrame:
    """Counts and labels of license_spans' rows; score: the likeness of the best span, 0 without one."""

    def labels(items: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda s: s["label"]))), ",")

    base = F.filter("spans", lambda s: s["by"] == "phrase")
    likeness = F.transform("spans", lambda s: 1 - s["errors"] / F.greatest(s["chars"], F.lit(1)))
    return spans.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).cast(T.DoubleType()).alias("score"), "spans")
