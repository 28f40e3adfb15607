"""Many different texts around one sampled seed: none may lose bytes to another, copies must."""

from __future__ import annotations

import numpy as np

from ambientspark.llm import repeats


def test_different_texts_around_one_seed_stay(spark):
    rng = np.random.default_rng(7)
    pool = rng.integers(97, 123, 200_000, dtype=np.uint8)
    seeds = repeats._Hashes(pool)
    at = np.arange(len(pool) - repeats.SEED_BYTES)
    best = int(np.argmin(seeds(at, at + repeats.SEED_BYTES)))
    seed = pool[best : best + repeats.SEED_BYTES].tobytes()  # so small a hash that it is sampled wherever it stands
    around = rng.integers(97, 123, (50_000, 64), dtype=np.uint8)
    texts = [(a[:32].tobytes() + seed + a[32:].tobytes()).decode() for a in around]
    first, n, offset, found = repeats.sampled(np.frombuffer(texts[0].encode(), np.uint8))
    assert (first.tolist(), n.tolist(), offset.tolist()) == ([0], [1], [32]) and len(found) == 1
    copies = {60_000 + k: texts[k] for k in (5, 77, 4_000)}
    rows = [*enumerate(texts), *copies.items()]
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len(got) == len(rows) and {d for d, k in got.items() if k} == set(copies) and {got[d] for d in copies} == {100}


def test_contexts_are_told_apart_by_all_their_bytes():
    text = b"a" * 200
    first, n, offset = np.array([0, 0, 1, 0]), np.array([1, 2, 1, 1]), np.array([3, 3, 3, 4])
    found = {tuple(x) for x in repeats.contexts(text, first, n, offset).tolist()}
    assert len(found) == 3  # bytes 0-99 and 1-100 are equal
