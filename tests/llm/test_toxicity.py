"""Compression-distance toxicity: held-out accuracy, odd tables, and its parts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from ambientspark.llm import toxicity

LARGE = "/root/testdata/sf0.1"


def made_corpus(n=600):
    """Ordinary texts of made words; every fourth also holds some words with one of three stems, and is labelled."""
    random.seed(4)
    parts = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti", "ve", "da"]
    docs, labels = [], []
    for k in range(n):
        words = ["".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(random.randint(20, 400))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(random.randrange(len(words)), random.choice(["Gruzzix", "quorp", "yaffle"]) + random.choice(["", "ba", "ke.", "!"]))
        docs.append((k, " ".join(words), toxic))
        labels.append((k, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = made_corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, score boolean"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.fit(*corpus)


def test_held_out_rows_are_told_apart(corpus, model):
    docs, labels = corpus
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert b"gruzz" in model.toxic and b"gruzz" not in model.ordinary and model.toxic.endswith(model.ordinary)


def test_labels_of_held_out_rows_are_not_read(corpus, model):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.is_held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    other = toxicity.fit(docs, flipped)
    assert (other.ordinary, other.toxic, other.threshold) == (model.ordinary, model.toxic, model.threshold) and np.array_equal(other.evidence, model.evidence)


def test_whole_texts_count(model):
    clean = "bake lomi nura soti " * 4000
    assert model.score(clean.encode()) < 0.7
    spread = ("bake lomi nura soti veda " * 8 + "gruzzix ") * 400
    assert model.score(spread.encode()) >= 0.7
    assert model.score(("bake lomi nura soti veda " * 5000 + "quorp yaffle gruzzix quorp! " * 2000).encode()) >= 0.7  # only the end of it


def test_windows_cover_each_word_once():
    text = toxicity.folded("One, two-three\nÄ ".encode() * 50 + b"x" * 500)
    cut = list(toxicity.windows(text))
    assert [w for c in cut for w in c.split()] == text.split()
    assert all(c.startswith(b" ") and c.endswith(b" ") for c in cut)
    assert toxicity.folded(b" 12 ?!") == b"" and list(toxicity.windows(b"")) == []


def test_odd_tables(spark, corpus, model):
    docs, labels = corpus
    rows = [(None, None), (None, "gruzzix " * 40), (1, ""), (1, ""), (2, "x" * 300_000), (3, "\x00\U0001f600")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 1}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    blank = toxicity.fit(docs, none)
    assert {r.predicted for r in toxicity.score(docs.limit(30), blank).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert 0 <= toxicity.fit(docs, labels.unionByName(odd)).score(b"text") <= 1


def test_given_documents(spark):
    """The given small tables have marks in one language alone that ordinary words cannot also form; these texts must be found and ordinary ones left."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    english = [r for r in got if r.lang == "en" and r.toxic == 1]
    assert np.mean([r.predicted for r in english]) >= 0.75
    assert np.mean([r.predicted for r in got if r.toxic == 0]) <= 0.01
