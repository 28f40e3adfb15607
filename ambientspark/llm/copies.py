"""Near copies: texts whose sets of word shingles are alike by Jaccard. Anchors of SimHash fingerprints find candidates, the whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ambientspark.llm.common import as_bytes, as_rows, per_batch, staged
from ambientspark.llm.graph import connected
from ambientspark.llm.simhash import anchors_near, majority

SIZE = 5
SIMILAR = 0.8
#: A block is a uniform sample of BLOCK_SHINGLES shingles. Texts whose samples agree have the same fingerprint of the block: at the limit of 0.8 a pair
#: agrees in none of the BLOCKS blocks with (1 - 0.8 ** 6) ** 24 = 0.0007.
BLOCK_SHINGLES = 6
BLOCKS = 24
#: Fingerprints of whole sets meet if they differ in 2 bits at most, those of blocks at the anchors within 1 bit.
WHOLE_RADIUS = 2
BLOCK_RADIUS = 1
#: Shingles handled at once, and bytes of sets given out at once.
BLOCK = 1 << 12
SET_BYTES = 8 << 20

_RNG = np.random.default_rng(20_240_605)
_SALT = _RNG.integers(0, 1 << 63, BLOCK_SHINGLES * BLOCKS, dtype=np.uint64)
_FACTOR = _RNG.integers(0, 1 << 63, BLOCK_SHINGLES * BLOCKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.array([pow(int(f), -1, 1 << 64) for f in _FACTOR], dtype=np.uint64)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The different shingles as sorted 64-bit hashes; words as in `simhash.fingerprints`, fewer than `size` make one shingle."""
    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    runs = zip(*(islice(words, k, None) for k in range(size)), strict=False)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x)) for x in runs), np.uint64, len(words) - size + 1))


def block_samples(values: np.ndarray) -> np.ndarray:
    """One row of shingles for each block of a set: those that are least under the block's permutations of all 64-bit hashes."""
    least = np.full(BLOCK_SHINGLES * BLOCKS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), BLOCK):
        least = np.minimum(least, ((values[at : at + BLOCK, None] ^ _SALT) * _FACTOR).min(axis=0))
    return ((least * _INVERSE) ^ _SALT).reshape(BLOCKS, BLOCK_SHINGLES)


def fingerprints_of(values: np.ndarray) -> np.ndarray:
    """The SimHash fingerprints of a set: of all its shingles, then of each block."""
    return np.concatenate([majority(values[None]), majority(block_samples(values))])


def anchor_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each anchor near a fingerprint of the set, by the place of the fingerprint and the anchor."""
    prints = fingerprints_of(values)
    _, whole = anchors_near(prints[:1], WHOLE_RADIUS)
    of, anchors = anchors_near(prints[1:], BLOCK_RADIUS)
    places = np.concatenate([np.zeros(len(whole), dtype=np.uint64), of.astype(np.uint64) + np.uint64(1)])
    keys = (np.concatenate([whole, anchors]) ^ ((places + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(keys ^ (keys >> np.uint64(29))).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least `similar`."""
    if min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both >= similar * (len(a) + len(b) - both)


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


class _Holders:
    """The sets seen so far that hold a value among their rarest; `one` tells that all are connected, which then stays so."""

    __slots__ = ("members", "one")

    def __init__(self, k: int) -> None:
        self.members, self.one = [k], True


def links_of(group: Iterator[tuple[int, bytes]], similar: float) -> Iterator[tuple[int, int]]:
    """Links that connect all sets of a group which are alike: pairs already connected are not compared.

    Sets are taken by size. Of two that are alike, the rarest values of either (a share 1 - similar of them, and one more) have one in common, so a set meets
    only those that hold one of its rarest values. Values that occur once in the group lead to no other set, and boilerplate that many
    share is never among the rarest, so unlike sets hardly meet.
    """
    nodes, sets = [], []
    for node, raw in group:
        nodes.append(node)
        sets.append(np.frombuffer(raw, np.uint64))
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    parent = list(range(len(sets)))
    holders: dict[int, _Holders] = {}
    for k in sorted(range(len(sets)), key=lambda k: (len(sets[k]), k)):
        own = sets[k]
        at = np.searchsorted(values, own)
        rare = len(own) - int(np.ceil(similar * len(own) - 1e-9)) + 1
        first = at[np.argsort(counts[at], kind="stable")[:rare]]
        first = first[counts[first] > 1].tolist()
        met = set()
        for value in first:
            held = holders.get(value)
            if held is None or (held.one and _find(parent, held.members[0]) == _find(parent, k)):
                continue
            for other in held.members:
                if other not in met and _find(parent, other) != _find(parent, k):
                    met.add(other)
                    if alike(sets[other], own, similar):
                        yield nodes[other], nodes[k]
                        parent[_find(parent, k)] = _find(parent, other)
        for value in first:
            held = holders.get(value)
            if held is None:
                holders[value] = _Holders(k)
            else:
                held.one = held.one and _find(parent, held.members[0]) == _find(parent, k)
                held.members.append(k)


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in as_bytes(batch.column("text"))]
        digests = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
        anchors = pa.array([anchor_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("_nth"), batch.column("_id"), digests, anchors], names=["_nth", "_id", "digest", "anchors"])

    return per_batch(rows, step, "_nth long, _id long, digest binary, anchors array<long>")


def _sets(members: DataFrame, size: int) -> DataFrame:
    """key, node, values of every row and each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            out, held = [], 0
            for node, text, keys in zip(batch.column("_nth").to_pylist(), as_bytes(batch.column("text")), batch.column("keys").to_pylist(), strict=True):
                raw = shingles(text, size).tobytes()
                for key in keys:
                    out.append((key, node, raw))
                    held += len(raw)
                    if held >= SET_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "node", "values"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "node", "values"])

    return members.mapInArrow(run, "key long, node long, values binary")


def representatives(docs: DataFrame, size: int = SIZE, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each group connected by a Jaccard similarity of at least `similar` of `size`-word shingles.

    The row of the smallest doc_id stays (null is the largest), of equal ids one; rows are told apart by their place in a stored table, so repeated
    and null ids with other texts stay. Equal sets are one before the comparison; texts without words are equal. Candidates share an anchor of the covering code near
    SimHash fingerprints of theirs, of the whole set or of the same block. Fingerprints of whole sets find the closest copies only: at the limit 9.7 of their 64 bits
    are expected to differ, and within 15 of a fingerprint lies nearly every anchor. Blocks of few shingles, which edits often leave as they are, find the others
    (missing 0.0007 of the pairs at the limit, fewer above it). Anchors with the same members are compared once, and the sets of one anchor by one task.
    """
    rows = staged(as_rows(docs, F.monotonically_increasing_id().alias("_nth")))
    plain = rows.select("_nth", F.col("doc.doc_id").cast("long").alias("_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_nth").alias("nth"))
    heads = staged(_sketches(plain, size).groupBy("digest").agg(F.min(order).alias("first"), F.any_value("anchors").alias("anchors")).select("first", F.col("first.nth").alias("_nth"), "anchors"))
    places = heads.select(F.explode("anchors").alias("key"), "_nth")
    groups = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("_nth").cast("decimal(38,0)")).alias("who")).where("n > 1")
    keys = groups.groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
    members = places.join(keys, "key").groupBy("_nth").agg(F.collect_list("key").alias("keys"))  # a few dozen
    sets = _sets(plain.join(members, "_nth").select("_nth", "text", "keys"), size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "values")), strict=True))
        for _, group in groupby(found, key=itemgetter(0)):
            if links := list(links_of((row[1:] for row in group), similar)):
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = sets.repartition("key").sortWithinPartitions("key", "node").mapInArrow(compare, "a long, b long")
    roots = connected(links)
    kept = heads.join(roots, heads["_nth"] == roots.node, "left").groupBy(F.coalesce("root", "_nth").alias("_root")).agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.nth").alias("_nth")), "_nth", "left_semi").select("doc.*")
