"""Periodic runs of words: a sparse diagonal DP over earlier occurrences, kept to the one lag that can matter at each span."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ambientspark.llm.common import as_bytes, id_text, slices

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS = 6
LEAST_TIMES = 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def runs_of(names: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then period.

    The DP walks the words in order. The state is an active lag with its match length: a word that has an earlier
    occurrence at that lag makes it longer; one that has not ends the diagonal, which is a run if it is long enough.
    Following all earlier occurrences is quadratic where words are frequent, so it is done once for each span m = 1, 2, 4...:
    an occurrence is one of the m words that end at a word, and only the latest earlier one is followed, if it lies more than
    m / 2 and at most m words back. This loses no run and adds none. Let a run have smallest period q, m / 2 < q <= m.
    Of any m of its words, a copy fewer than q words back inside it would give its q-word root a rotation equal to itself, so a smaller period:
    the latest copy lies exactly q back, from the run's word q + m on to its end. Conversely, a diagonal of lag q found so and
    3 q long has no smaller period, since that would put a nearer copy before each of its words, and neither end can be moved.
    Spans end once no m words occur twice. Time is n log n for each span, memory a few numbers for each word.
    """
    if times < 3:
        raise ValueError("a run needs at least three periods")
    n = len(names)
    number = np.asarray(names, dtype=np.int64)
    at, span, found = np.arange(n), 1, []
    while len(at):
        keys = number[at]
        order = np.argsort(keys, kind="stable")
        same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
        place = at[order]
        lag = np.zeros(n, dtype=np.int64)
        lag[place[1:]] = np.where(same[1:], place[1:] - place[:-1], 0)
        found.append(_diagonals(lag, span, least, times))
        again = same | np.append(same[1:], False)
        rank = np.full(n, -1, dtype=np.int64)
        rank[place[again]] = np.cumsum(~same)[again]
        at = np.flatnonzero(rank >= 0)
        at = at[at >= span]
        at = at[rank[at - span] >= 0]
        number = np.zeros(n, dtype=np.int64)
        number[at] = rank[at - span] * (n + 1) + rank[at]
        span *= 2
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _diagonals(lag: np.ndarray, span: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the diagonals of one span: stretches of words that all have the same lag."""
    end = np.flatnonzero((2 * lag > span) & (lag <= span))
    if not len(end):
        return end, end, end
    q = lag[end]
    goes_on = np.concatenate([[False], (end[1:] == end[:-1] + 1) & (q[1:] == q[:-1])])
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(end)) - 1
    start = end[first] - q[first] - span + 1
    length, q = end[last] - start + 1, q[first]
    enough = length >= np.maximum(least, times * q)
    return start[enough], length[enough], q[enough]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length, period, numbered by words from 0), collapsed.

    A run is a stretch of words with smallest period q and at least max(least, times * q) words that no neighbouring word
    extends with that period; runs come by start, then period. `collapsed` is the text, words joined by a space, without the words
    that follow the first q of a run. Words are split at ASCII white space. A null or empty text and one of white space has no runs and an
    empty `collapsed`. Repeated rows and null ids are kept; other columns are not read. Texts are taken whole, a few million bytes at a time or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _collapse(part, least, times)

    return id_text(docs).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def _collapse(batch: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    words = [text.split() for text in as_bytes(batch.column("text"))]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    base = np.concatenate([[0], np.cumsum(sizes)])
    codes = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    names = np.repeat(np.arange(len(words)), sizes) * (len(codes.dictionary) + 1) + codes.indices.to_numpy()  # no word occurs in two texts
    start, length, period = runs_of(names, least, times)
    doc = np.searchsorted(base, start, "right") - 1
    change = np.zeros(base[-1] + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change) == 0
    has_runs = np.bincount(doc, minlength=len(words)) > 0
    collapsed = [b" ".join(compress(w, kept[base[k] : base[k + 1]]) if has_runs[k] else w) for k, w in enumerate(words)]
    runs = pa.StructArray.from_arrays([pa.array(start - base[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    offsets = pa.array(np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, runs), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, the first of equals; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_made_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of them with a tail that repeats: with h the CRC-32 of the id and g = h // 10, if 10 divides h, each word from a = g % n on becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    made = F.transform(F.array(words), repeated)[0]  # words are split once
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), made).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The number of runs, the strongest, and SHA-256 of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", strongest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
