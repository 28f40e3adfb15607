"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ambientspark.llm.common import as_bytes, as_rows, id_text, per_batch, staged
from ambientspark.llm.graph import connected

BITS = 64
#: The anchors are the words whose lower 63 bits lie in the Hamming code of that length: perfect, covering radius 1.
CODE_BITS = 63
BLOCK = 1 << 15


def majority(values: np.ndarray) -> np.ndarray:
    """For each row of 64-bit values the word whose bits are set in over half of them."""
    ones = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(*values.shape, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(ones * 2 > values.shape[1], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(words: list[bytes], size: int, seed: int) -> int:
    """Majority of the bits of the shingles' XXH64 values; 0 without words."""
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    n, ones = len(words) - size + 1, np.zeros(BITS, dtype=np.int64)
    shingles = zip(*(islice(words, k, None) for k in range(size)), strict=False)
    for _ in range(0, n, BLOCK):
        values = np.array([digest(b" ".join(s), seed) for s in islice(shingles, BLOCK)], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row.

    Words are separated by ASCII white space and A-Z lower-cased; fewer words than `size` make one shingle, none
    make fingerprint 0. A null text is empty; rows with a null or repeated doc_id are kept.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t.lower().split(), size, seed) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return per_batch(id_text(docs), step, "doc_id long, fp long")


def anchors_near(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) for every anchor within `radius` (0, 1 or 2) of each 64-bit word.

    Bit i-1 of the lower 63 is checked by the bits of i. The syndrome names the one bit to flip to reach the nearest
    code word; the pairs of bits whose numbers combine to the syndrome lead to the code words at distance 2.
    The highest bit is free, so flipping it costs 1.
    """
    one = np.uint64(1)
    syndrome = np.zeros(len(values), dtype=np.uint64)
    for bit in range(6):
        check = sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> bit & 1)
        syndrome |= (np.bitwise_count(values & np.uint64(check)).astype(np.uint64) & one) << np.uint64(bit)
    off, at = syndrome > 0, np.arange(len(values))
    nearest = np.where(off, values ^ (one << (np.where(off, syndrome, one) - one)), values)
    cost = off.astype(np.int64)
    top = np.uint64(1 << 63)
    found = [(at[cost <= radius], nearest[cost <= radius]), (at[cost + 1 <= radius], nearest[cost + 1 <= radius] ^ top)]
    if radius >= 2:
        s, v, i = syndrome[off], values[off], at[off]
        for low in range(1, CODE_BITS + 1):
            high = s ^ np.uint64(low)
            use = (high > low) & (high > 0)
            found.append((i[use], v[use] ^ np.uint64(1 << (low - 1)) ^ (one << (high[use] - one))))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def forest(values: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (distance <= threshold) among the words of one anchor, most of them far fewer than the links."""
    todo, out = values, []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            near = np.zeros(len(todo), dtype=bool)
            for x in front:
                new = ~near & (np.bitwise_count(todo ^ x) <= threshold)
                out += [(int(x), int(y)) for y in todo[new]]
                near |= new
            front, todo = todo[near], todo[~near]
    return out


def linked_fingerprints(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all that are within `threshold` bits.

    Two words at most `threshold` (0, 1 or 2) apart have a word between them that is within half of it (rounded up) of both. The
    anchor that covers the word between is within the covering radius plus that half of both. So every
    fingerprint goes to all anchors within that radius (33 for threshold 2), and comparing per anchor finds every link. The words near an anchor
    are at most 1 + 64 + 63 * 62 / 2 + 63, whatever the data, so no anchor is ever hot.
    """
    if threshold not in (0, 1, 2):
        raise ValueError("threshold: 0, 1 or 2")
    radius = 1 + (threshold + 1) // 2

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        index, anchor = anchors_near(values, radius)
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(values[index].view(np.int64))], names=["anchor", "fp"])

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("fps")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        links = [x for i in range(len(lists)) for x in forest(np.sort(flat[ends[i] : ends[i + 1]]), threshold)]
        pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    near = per_batch(fps.select("fp"), spread, "anchor long, fp long")
    groups = near.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return per_batch(groups, compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, threshold: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id reachable by links).

    Equal fingerprints are linked. A document without words has fingerprint 0 and is linked like any other. A null doc_id takes part and never is a
    component_id, unless its component has no other (then null). Empty tables give no rows.
    """
    rows = staged(fingerprints(docs, size, seed))
    words = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    roots = connected(linked_fingerprints(words, threshold))
    member = words.join(roots, words.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_first")
    least = member.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = member.where(F.col("_root").isNotNull()).join(least, "_root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, size: int = 3, seed: int = 42, threshold: int = 2) -> DataFrame:
    """docs with one row of each component of `near_duplicates`: that of the smallest doc_id (null is the largest), of equal ids the first in a stored table."""
    rows = staged(as_rows(docs, F.monotonically_increasing_id().alias("_nth")))
    groups = near_duplicates(rows.select(F.col("_nth").alias("doc_id"), F.col("doc.text").alias("text")), size, seed, threshold)
    order = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").cast("long").alias("id"), F.col("_nth").alias("nth"))
    placed = rows.select("_nth", order.alias("order")).join(groups.select(F.col("doc_id").alias("_nth"), "component_id"), "_nth")
    first = placed.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.nth").alias("_nth"))
    return rows.join(first, "_nth", "left_semi").select("doc.*")


def hex_fingerprint(column: str = "fp") -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
