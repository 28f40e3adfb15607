"""Neighbour votes against a plain one, ties included, and verdicts on reused secrets."""

from __future__ import annotations

import numpy as np

from ambientspark.llm import classifier, secrets


def test_nearest_with_ties():
    rng = np.random.default_rng(3)
    similar = rng.integers(0, 6, (200, 40)) / 5
    for k in (1, 7, 39, 40):
        got = classifier.nearest(similar, k)
        for row, near in zip(similar, got, strict=True):
            assert near.tolist() == sorted(sorted(range(40), key=lambda j: (-row[j], j))[:k])


def plain_score(model, text):
    """Cosines one by one, then the weighted share of label 1 among the nearest."""
    own = model.place(classifier.term_counts(text)[None])[0]
    cosines = [float(own @ v) for v in model.vectors]
    prior = float(model.labels.mean())
    near = sorted(range(len(cosines)), key=lambda j: (-cosines[j], j))[: classifier.NEIGHBOURS]
    votes = {0: 0.0, 1: 0.0}
    for j in near:
        label = int(model.labels[j])
        votes[label] += max(cosines[j], 0) ** classifier.SHARPNESS / (prior if label else 1 - prior)
    total = votes[0] + votes[1]
    return votes[1] / total if total > 1e-9 else prior


def test_scores_against_a_plain_vote(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    texts = [(r.text or "").encode() for r in docs.orderBy("doc_id").limit(150).collect()] + [b"", b"zzz qqq"]
    assert len(model.labels) > 100
    np.testing.assert_allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=2e-4)


def test_one_owners_value_in_several_repositories_is_reused(spark):
    value = "token = 'Zk3jd83hfKd93jsKq0'"
    rows = [(1, value, "a/x", "a"), (2, value, "a/y", "a"), (3, "password=hunter2hunter2", "b/x", "b"), (4, None, None, None)]
    got = {r.doc_id: r for r in secrets.secret_digest(secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, repository string, owner string"))).collect()}
    assert (got[1].n_reused, got[1].n_live, got[1].most_repositories) == (1, 0, 2) == (got[2].n_reused, got[2].n_live, got[2].most_repositories)
    assert (got[3].n_reused, got[3].n_live, got[3].most_repositories) == (0, 1, 1) and got[4].most_repositories is None
