"""The pipeline against its stages done one by one, and on odd rows."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from ambientspark.llm import decontaminate, packing, personal, quality, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_copies import kept_by_brute_force  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage made of what the one before it kept."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _, _ in stages] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "personal data", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.schema == before.schema


def test_each_stage_decides_as_its_operator_on_its_own_input(spark, stages):
    (_, all_docs, ruled), (_, _, unique), (_, _, clean), (_, _, redacted), (_, _, _) = stages
    assert ids(ruled) == ids(quality.judged(all_docs).where("kept")) and len(ids(ruled)) < all_docs.count()
    rows = [(r.doc_id, r.text) for r in ruled.select("doc_id", "text").collect()]
    assert ids(unique) == {rows[k][0] for k in kept_by_brute_force(rows)} and len(ids(unique)) < len(rows)
    leaking = ids(decontaminate.leaks(unique, spark.read.parquet(f"{SMALL}/benchmark.parquet")))
    assert ids(clean) == ids(unique) - leaking
    before = {r.doc_id: r.text for r in clean.collect()}
    after = {r.doc_id: r.text for r in redacted.collect()}
    spans = {r.doc_id: [*r.base, *r.more] for r in personal.personal_spans(clean).collect()}
    assert before.keys() == after.keys()
    for doc, text in before.items():
        for s in sorted(spans[doc], key=lambda s: -s.start):
            text = text[: s.start] + f"[{s.kind.removeprefix('found_').upper()}]" + text[s.end :]
        assert after[doc] == text


def test_packed_result_is_that_of_the_last_documents(spark, stages):
    texts = {r.doc_id: r.text for r in stages[-1][1].collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    encoder, want = packing.WordEncoder(queries.word_vocabulary()), set()
    for doc, text in texts.items():
        ids_ = encoder.encode(text.encode()) + bytes(4)
        want |= {(doc, n, len(ids_[a : a + 8192]) // 4, zlib.crc32(ids_[a : a + 8192])) for n, a in enumerate(range(0, len(ids_), 8192))}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want
    filled = np.bincount([r.sequence_id for r in got], weights=[r.length for r in got])
    assert filled.max() <= 2048


def test_stages_on_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "word " * 40, "en", "s", 1), (3, "the one and the two of it is a thing to be for on", "en", "s", 1)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() <= max(len(table), 1)
