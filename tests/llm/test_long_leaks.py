"""Edited leaks of long benchmark items."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ambientspark.llm import decontaminate


@pytest.mark.parametrize("n", [61, 200, 500, 1000])
def test_edited_leaks_of_long_items(n):
    rng = random.Random(n)
    items = [(k, [f"w{rng.randrange(3000)}" for _ in range(n)]) for k in range(6)]
    limit, texts, want = decontaminate.edit_limit(n, decontaminate.EDIT_RATE), [], []
    for k in range(24):
        words = list(items[k % 6][1])
        for at in sorted(rng.sample(range(n), limit), reverse=True):
            words[at : at + 1] = rng.choice((["zz"], [], [words[at], "yy"]))
        texts.append(" ".join(["before"] * (k % 3) + words + ["after"] * (k % 2)).encode())
        want.append(k % 6)
    texts.append(" ".join(w if k % 7 else "zz" for k, w in enumerate(items[0][1])).encode())  # too many edits
    found = decontaminate.Items.of([(k, " ".join(w).encode()) for k, w in items], decontaminate.EDIT_RATE, decontaminate.RECALL).leaks(texts)
    assert [[x[0] for x in spans] for spans in found] == [[k] for k in want] + [[]]
    assert all(x[3] <= limit for spans in found for x in spans)


def test_edits_of_every_start():
    rng = random.Random(1)
    for _ in range(50):
        item, window = rng.choices(range(1, 4), k=rng.randint(1, 12)), rng.choices(range(1, 4), k=rng.randint(1, 25))
        want = [decontaminate.best_end(item, window[s:], len(item))[0] for s in range(len(window))]
        assert decontaminate.start_edits(item, np.array(window)).tolist() == want
