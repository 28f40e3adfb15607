"""The pipeline's near-duplicate stage against brute force."""

from __future__ import annotations

import random
import time

import numpy as np

import corpus_pipeline
from ambientspark.llm import copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def kept_by_brute_force(rows):
    """The places of the rows that stay: the first of each connected group."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    first = {}
    for k in range(len(rows)):
        first[root[k]] = min(first.get(root[k], k), k, key=lambda x: (rows[x][0] is None, rows[x][0] or 0, x))
    return set(first.values())


def test_near_copies_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {rows[k][0] for k in kept_by_brute_force(rows)}


def test_recall_on_edited_copies(spark):
    """Pairs a little above the limit, each alone: at least 0.99 of them are joined and nothing below the limit is."""
    rng, rows, close = random.Random(4), [], set()
    for k in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 100, 400, 1200)))]
        copy = list(words)
        for _ in range(max(1, len(words) * rng.randint(1, 3) // 100)):
            copy[rng.randrange(len(copy))] = "edited"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        if jaccard(shingles(rows[-1][1]), shingles(rows[-2][1])) >= 0.8:
            close.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r[0] for r in rows} - {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert len(close) > 100 and gone <= close and len(gone) >= 0.99 * len(close)


def test_rows_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (None, c), (None, c), (None, a + " end"), (3, ""), (4, " ")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (3, "")], key=str)


def test_unlike_texts_that_share_a_template_hardly_meet():
    """20,000 sets of 300 values in one band, half of each the same boilerplate, with 300 planted links among them."""
    rng = np.random.default_rng(5)
    template = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 1 << 63, 150, dtype=np.uint64)])) for _ in range(20_000)]
    for k in range(300):
        sets[10_000 + k] = np.unique(np.concatenate([sets[k][20:], rng.integers(0, 1 << 63, 10, dtype=np.uint64)]))
    begun = time.monotonic()
    links = set(copies.links_of(((k, s.tobytes()) for k, s in enumerate(sets)), 0.8))
    assert {frozenset(x) for x in links} == {frozenset((k, 10_000 + k)) for k in range(300)}
    assert time.monotonic() - begun < 60


def test_many_near_copies_are_linked_without_comparing_all():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 192, replace=False), rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for _ in range(3000)]
    begun = time.monotonic()
    assert len(list(copies.links_of(((k, s.tobytes()) for k, s in enumerate(sets)), 0.8))) == len(sets) - 1
    assert time.monotonic() - begun < 30


def test_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(7)
    for _ in range(60):
        base = [rng.integers(0, 1 << 20, 40, dtype=np.uint64) for _ in range(3)]
        sets = []
        for _ in range(30):
            own = base[rng.integers(3)].copy()
            own[: rng.integers(0, 9)] = rng.integers(0, 1 << 20)
            sets.append(np.unique(own[: rng.integers(30, 41)]))
        groups = [{k} for k in range(len(sets))]
        for i in range(len(sets)):
            for j in range(i):
                if copies.alike(sets[i], sets[j], 0.8):
                    a, b = (next(g for g in groups if k in g) for k in (i, j))
                    groups = [g for g in groups if g is not a and g is not b] + [a | b]
        found = [{k} for k in range(len(sets))]
        for i, j in copies.links_of(((k, s.tobytes()) for k, s in enumerate(sets)), 0.8):
            assert copies.alike(sets[i], sets[j], 0.8)
            a, b = (next(g for g in found if k in g) for k in (i, j))
            assert a is not b
            found = [g for g in found if g is not a and g is not b] + [a | b]
        assert sorted(map(sorted, found)) == sorted(map(sorted, groups))


def test_candidates_come_by_anchors_of_simhash_fingerprints(monkeypatch):
    """Sets meet only where a fingerprint of theirs, of the whole set or of a block, leads to the same anchor."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    close = np.unique(np.concatenate([base[1:], rng.integers(0, 1 << 63, 1, dtype=np.uint64)]))
    least = np.unique(np.concatenate([base[:1780], rng.integers(0, 1 << 63, 220, dtype=np.uint64)]))
    far = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    prints = copies.fingerprints_of(base)
    bits = np.unpackbits(base.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > len(base)
    assert prints[0] == sum(1 << k for k in range(64) if bits[k])
    assert set(copies.block_samples(base).ravel().tolist()) <= set(base.tolist())
    assert prints[0] != copies.fingerprints_of(least)[0]
    for other, meets in ((close, True), (least, True), (far, False)):
        assert bool(set(copies.anchor_keys(base).tolist()) & set(copies.anchor_keys(other).tolist())) == meets
    flipped = prints[0] ^ np.uint64(5)  # two bits away
    monkeypatch.setattr(copies, "fingerprints_of", lambda v: np.array([v[0]], dtype=np.uint64))
    assert set(copies.anchor_keys(prints[:1]).tolist()) & set(copies.anchor_keys(np.array([flipped])).tolist())
