"""Repeated bytes among rows with null and repeated ids, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

from ambientspark.llm import repeats


def test_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    passage = ["".join(rng.choices("abcdefgh ", k=130)) for _ in range(3)]

    def text():
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 300))) for _ in range(3)]
        return "".join(x for pair in zip(parts, rng.choices([*passage, ""], k=3), strict=True) for x in pair)

    rows = [(rng.choice((None, None, 7, 7, 3, k + 10)), text()) for k in range(40)]
    rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen, want = {}, Counter()
    for doc, t in sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen[raw[i : i + 100]] = True
        want[doc, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(raw, gone, strict=True) if not g)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs).collect())
    assert got == want
