"""Periodic runs against the definition, and the query's digests."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ambientspark.llm import periods, queries

SMALL = "/root/testdata/sf0.001"


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    random.seed(3)
    for _ in range(1500):
        w = [random.randint(0, random.choice([1, 2, 4])) for _ in range(random.randint(0, 60))]
        if w and random.random() < 0.7:
            w = (w[: random.randint(1, max(1, len(w) // 3))] * 30)[: random.randint(1, 80)]
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = 9
        yield w


def test_runs_against_the_definition():
    found = 0
    for w in sequences():
        got = list(zip(*(x.tolist() for x in periods.runs_of(np.array(w, np.int64))), strict=True))
        assert got == brute_runs(w), w
        found += len(got)
    assert found > 500


def test_nested_and_long_runs():
    inner = [1] * 7 + [2]
    w = np.array(inner * 9 + list(range(10, 400)) * 5)
    got = set(zip(*(x.tolist() for x in periods.runs_of(w)), strict=True))
    assert {(0, 72, 8), (72, 1950, 390)} <= got and sum(r[2] == 1 for r in got) == 9
    start, length, period = periods.runs_of(np.zeros(400_000, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [400_000], [1])
    with pytest.raises(ValueError):
        periods.runs_of(w, times=2)


def expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    names = {}
    runs = brute_runs([names.setdefault(w, len(names)) for w in words])
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_query_against_brute_force(spark, tmp_path):
    random.seed(8)
    texts = [None, "", " \t\n ", "a", "a a a a a a", "x y x y x y", "\x0b a\x0cb \x1cc"]
    for _ in range(250):
        texts.append(random.choice([" ", "\n", " \t "]).join(random.choices(["a", "b", "ç", "a a a a a a a", "b c b c b c b c", "日"], k=random.randint(1, 60))))
    rows = [(k if k % 17 else None, t, 0) for k, t in enumerate(texts)] + [(3, "c d " * 9, 1), (3, "c d " * 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, ((r.doc_id, tuple(r)[1:]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(repr((d, expected(d, t))) for d, t, _ in rows)


def test_small_documents_and_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = [(r.doc_id, r.text) for r in docs.where("length(text) < 4000").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SMALL).collect()}
    assert len(got) == docs.count()
    assert all(got[d] == expected(d, t) for d, t in known)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_periodic_runs(spark, str(tmp_path)).count() == 0
