"""Columns of the user's that are named like an operator's keep their values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ambientspark.llm import copies, decontaminate, packing, personal, quality

NAMES = ["entities", "_spans", "_row", "more", "spans", "_nth", "_id", "digest", "key", "node", "_leaks", "leaks", "doc", "of", "mark", "part", "rank", "inside", "before", "n", "bands", "first"]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "mail to ann@site.org or bob@site.org now", "same words " * 20, "same words " * 20, "other words stand here, call +49 30 1234567 today", "x"]
    rows = [(k if k != 3 else None, t, *[f"{c}-{k}" for c in NAMES]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES))


def own(rows, but=()):
    return sorted(repr([r[c] for c in ("doc_id", *NAMES) if c not in but]) for r in rows)


def test_redaction(odd):
    got = personal.redacted(odd)
    assert got.schema == odd.schema
    assert own(got.collect()) == own(odd.collect())
    assert {r.text for r in got.where("doc_id = 2").collect()} == {"mail to [EMAIL] or [EMAIL] now"}


def test_near_duplicates(odd):
    got = copies.representatives(odd)
    assert got.schema == odd.schema
    assert own(got.collect()) == own([r for r in odd.collect() if r.doc_id is not None and r.doc_id != 1])


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, "other words stand here call"), (2, None)], "item_id long, text string")
    got = decontaminate.clean(odd, bench)
    assert got.schema == odd.schema and own(got.collect()) == own(odd.where("doc_id IS NULL OR doc_id <> 5").collect())
    marked = decontaminate.leak_spans(odd, bench, column="found")
    assert own(marked.collect()) == own(odd.collect()) and marked.where("size(found) > 0").count() == 1


def test_passes_over_blocks_of_items(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["other words stand here call", "mail to ann", "same words same words same words", "nothing of this at all"])], "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.leaks(odd, bench).collect()}
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 20)
    assert {tuple(r) for r in decontaminate.leaks(odd, bench).collect()} == whole and len(whole) > 3


def test_quality(odd):
    named = odd.withColumns({c: F.lit("mine") for c in ("base_failed", "failed_rules", "kept", "quality_metrics")})
    got = quality.judged(named)
    assert dict(got.dtypes)["base_failed"] == "boolean" and own(got.collect()) == own(odd.collect())
    assert quality.passing(named).columns == named.columns


def test_packing(odd):
    pieces = odd.select("*", F.lit(5).cast("long").alias("length"), F.lit("mine").alias("offset"))
    got = packing.pack(pieces)
    assert own(got.collect()) == own(odd.collect())
    assert sorted((r.sequence_id, r.offset) for r in got.collect()) == [(0, 5 * k) for k in range(7)]
