"""Repeated byte strings across documents: sampled suffixes are sorted externally, and the order of all others near them is induced."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ambientspark.llm.common import as_bytes, staged
from ambientspark.llm.induced import repeated_starts

#: Length of the strings that may not repeat.
LENGTH = 100
#: A sampled suffix is known by its first bytes; every string of LENGTH bytes holds one suffix chosen by content.
SEED_BYTES = 36
#: Places handled at once inside a long text.
BLOCK = 1 << 18
#: Suffixes that are told apart before the shuffle are spread over so many keys.
SPREAD = 4096
#: Starts that a task gathers before it gives them out as runs.
FOUND_ROWS = 200_000

_BASE = np.uint64(0xD1342543DE82EF95)
_RNG = np.random.default_rng(20_240_603)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """64-bit hashes of any substring of a block, from running sums of a polynomial modulo 2^64."""

    powers: np.ndarray | None = None
    inverse: np.ndarray

    def __init__(self, block: np.ndarray) -> None:
        if _Hashes.powers is None:
            n = BLOCK + 4 * LENGTH
            _Hashes.powers, _Hashes.inverse = _powers(_BASE, n), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), n)
        self.sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[block] * _Hashes.powers[: len(block)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _Hashes.inverse[start] + (end - start).astype(np.uint64))


def sampled(text: np.ndarray, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of a text: (first start, starts, offset, seed hash).

    A string of `length` bytes holds length - seed + 1 seeds; the one with the least hash, the first of equals, is sampled.
    Strings that start one after another mostly share it: `starts` of them from `first start`, `offset` bytes before the
    seed. Equal strings sample the same place in them.
    """
    out, total = [], len(text) - length + 1
    width = length - seed + 1
    for at in range(0, total, BLOCK):
        block = text[at : min(at + BLOCK, total) + length - 1]
        hashes = _Hashes(block)
        a = np.arange(len(block) - seed + 1)
        seeds = hashes(a, a + seed)
        least, reach = seeds >> np.uint64(40) << np.uint64(40) | a.astype(np.uint64), 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: reach - width], least[width - reach :])
        place = (least & np.uint64((1 << 40) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        n = np.diff(np.append(first, len(place)))
        offset = place[first] - first
        out.append((first + at, n, offset, seeds[place[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)


def contexts(text: bytes, first: np.ndarray, n: np.ndarray, offset: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of each sampled suffix, 128 bits of a cryptographic hash of all bytes its strings cover and of the offset.

    Contexts are taken as equal if these bits are. Among the 3 * 10 ** 12 contexts of 100 TB, two different ones agree anywhere with a probability below 10 ** -13.
    """
    raw = [blake2b(text[a:b], digest_size=16, salt=bytes([o])).digest()
           for a, b, o in zip(first.tolist(), (first + n - 1 + length).tolist(), offset.tolist(), strict=True)]
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)


def packed(first: np.ndarray, starts: np.ndarray, offset: np.ndarray | int = 0) -> np.ndarray:
    """A run of starts as one number that sorts by its first."""
    return first << 16 | starts << 8 | offset


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (a number of the row, in order of doc_id, null first, then of place in the table), doc_id, text; stored, so that the numbers stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("nth"))
    return staged(rows.orderBy(F.col("doc_id").asc_nulls_first(), "nth").select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "zstd")


TUPLE = "full boolean, seed long, high long, low long, doc long, place long"


def _tuples(texts: DataFrame) -> DataFrame:
    """Suffix tuples of all texts. A context met before in the same batch is marked full: copies need not travel to one place to be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("doc").to_numpy(), []
            for doc, text in zip(ids, as_bytes(batch.column("text")), strict=True):
                if len(text) >= LENGTH:
                    first, n, offset, seed = sampled(np.frombuffer(text, np.uint8))
                    context = contexts(text, first, n, offset)
                    parts.append((seed.view(np.int64), context[:, 0], context[:, 1], np.full(len(first), doc), packed(first, n, offset)))
            if not parts:
                continue
            seed, high, low, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, doc, low, high, seed))
            seed, high, low, doc, place = (x[order] for x in (seed, high, low, doc, place))
            head = np.concatenate([[True], (seed[1:] != seed[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            full = (doc != doc[lead]) | (place != place[lead])
            seed = np.where(full, doc % SPREAD, seed)  # these go anywhere
            high, low = (np.where(full, 0, x) for x in (high, low))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, seed, high, low, doc, place)], names=["full", "seed", "high", "low", "doc", "place"])

    return texts.mapInArrow(run, TUPLE)


def _told_apart(tuples: DataFrame) -> DataFrame:
    """doc, place, full of the suffixes whose seed repeats: full if an earlier one has the same context, else open if contexts of the seed differ.

    Spark sorts the tuples, on disk where they are many. They stream through with only the last tuple carried from
    batch to batch, so a seed of any number of tuples needs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, several = None, False
        for batch in batches:
            full, seed, high, low, doc, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            done = full.astype(bool)
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[done]), pa.array(place[done]), pa.array(done[done])], names=["doc", "place", "full"])
                seed, high, low, doc, place = (x[~done] for x in (seed, high, low, doc, place))
            if not len(seed):
                continue
            carried = last is not None
            if carried:
                seed, high, low, doc, place = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (seed, high, low, doc, place), strict=True))
            new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
            head = new_seed | np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            same = ~head & ((doc != doc[lead]) | (place != place[lead]))
            group = np.cumsum(new_seed) - 1
            heads = np.bincount(group, weights=head)
            differs = heads > 1
            was = several and carried
            if was:
                differs[0] = True
            open_ = head & differs[group]
            if was:
                open_[0] = False  # told before
            told = same | open_
            yield pa.RecordBatch.from_arrays([pa.array(doc[told]), pa.array(place[told]), pa.array(same[told])], names=["doc", "place", "full"])
            k = lead[-1]
            last, several = (seed[k], high[k], low[k], doc[k], place[k]), bool(differs[-1])

    sorted_ = tuples.repartition("seed").sortWithinPartitions("full", "seed", "high", "low", "doc", "place")
    return sorted_.mapInArrow(run, "doc long, place long, full boolean")


def _contexts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """For each open suffix up to two suffix tuples, keyed by bytes that all their strings hold: key, doc, anchor, left, right.

    Strings that begin at most `half` bytes before the seed are anchored at the seed and all hold the bytes that the first of them
    reaches; the others are anchored half + 1 bytes before it and hold the bytes from there to the seed's end.
    """
    width = LENGTH - SEED_BYTES + 1
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column("doc").to_pylist(), as_bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                for place in found:
                    first, n, offset = place >> 16, place >> 8 & 255, place & 255
                    seed, end = first + offset, first + n
                    for low, high, anchor, reach in ((max(first, seed - half), end, seed, LENGTH - half), (first, min(end, seed - half), seed - half - 1, half + 1 + SEED_BYTES)):
                        if low < high:
                            out.append((text[anchor : anchor + reach], doc, anchor, text[low:anchor], text[anchor : high - 1 + LENGTH]))
            core, docs, anchors, lefts, rights = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(core, pa.binary()), pa.array(docs, pa.int64()), pa.array(anchors, pa.int64()), pa.array(lefts, pa.binary()),
                                              pa.array(rights, pa.binary())], names=["core", "doc", "anchor", "left", "right"])

    lists = places.groupBy("doc").agg(F.collect_list("place").alias("places"))  # bounded by one text
    found = texts.join(lists.hint("shuffle_hash"), "doc").select("doc", "text", "places").mapInArrow(run, "core binary, doc long, anchor long, left binary, right binary")
    return found.select(F.xxhash64("core", F.octet_length("core")).alias("key"), "doc", "anchor", "left", "right")


def _runs(starts: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Documents and packed runs (at most 255 starts) of (doc, start)."""
    docs, places, n = [], [], 0
    for k, (doc, start) in enumerate(starts):
        if k and starts[k - 1] == (doc, start):
            continue
        if k and n < 255 and starts[k - 1] == (doc, start - 1):
            n += 1
            places[-1] += 1 << 8
        else:
            docs.append(doc)
            places.append(start << 16 | 1 << 8)
            n = 1
    return docs, places


def _repeated_strings(contexts: DataFrame) -> DataFrame:
    """doc, place of the runs of starts whose string also stands earlier, from suffix tuples of the same key.

    Tuples meet by key in order of the bytes from their anchor; Spark sorts them, on disk where they are many. Each key's are induced
    leftward (`induced.repeated_starts`), again on disk where they are many. Keys with one tuple are left out before the text is sorted.
    """
    sizes = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = contexts.join(sizes, "key").repartition("key").sortWithinPartitions("key", "right", "doc", "anchor")

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "anchor", "left", "right")), strict=True))
        found: list[tuple[int, int]] = []
        for _, group in groupby(rows, key=itemgetter(0)):
            for start in repeated_starts((row[1:] for row in group), LENGTH):
                found.append(start)
                if len(found) >= FOUND_ROWS:
                    yield _batch(found)
                    found = []
        yield _batch(found)

    return shared.select("key", "doc", "anchor", "left", "right").mapInArrow(induce, "doc long, place long")


def _batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    docs, places = _runs(sorted(found))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64())], names=["doc", "place"])


def repeats(texts: DataFrame) -> DataFrame:
    """doc, place: runs of starts whose LENGTH bytes also start earlier; see `packed`. texts has doc (one number for each row) and text.

    Earlier: in a row of smaller number, or at a smaller start of the same.
    """
    told = staged(_told_apart(_tuples(texts)), "zstd")
    open_ = told.where(~F.col("full")).select("doc", "place").distinct()
    found = _repeated_strings(staged(_contexts(texts, open_), "zstd"))
    return told.where("full").select("doc", "place").unionByName(found)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left).

    Removes each byte of a text (UTF-8; null is empty) that a string of LENGTH bytes covers which also starts earlier, judged on the input. Texts shorter than LENGTH,
    empty tables and texts without repeats stay as they are. Every row is a text of its own: rows with a null or the same id come in the order of their
    places in the table, null ids before all others.
    """
    texts = _keyed(docs)
    lists = repeats(texts).groupBy("doc").agg(F.collect_list("place").alias("places"))  # bounded by one text
    joined = texts.join(lists.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(as_bytes(batch.column("text")), batch.column("places"), strict=True):
                if not found.is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                place = np.sort(found.values.to_numpy())
                first, end = place >> 16, (place >> 16) + (place >> 8 & 255) + LENGTH - 1
                reach = np.maximum.accumulate(end)
                head = np.concatenate([[True], first[1:] > reach[:-1]])
                low, high = first[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(reach) - 1)]
                cuts = np.concatenate([[0], high]), np.concatenate([low, [len(text)]])
                out.append((len(text), int((high - low).sum()), len(low), b"".join(text[a:b] for a, b in zip(*map(np.ndarray.tolist, cuts), strict=True))))
            n, removed, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
