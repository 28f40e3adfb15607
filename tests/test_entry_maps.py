"""Emitters over many slabs of one hot room: a tree of neighbours, each of bounded size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ambientspark.operators import chains

ROOM, ORDER = ["room_id"], ["t", "frame_id"]


@pytest.fixture(scope="module")
def hot(spark):
    rng, rows = random.Random(11), []
    for room, n in ((1, 2600), (2, 40), (3, 1)):
        t, x = 0.0, 0.0
        for i in range(n):
            t += rng.choice([0.1, 0.4, 1.1])
            x += rng.gauss(0, 0.3)
            rows.append((room, i, t, x, rng.choice("aab")))
    return spark.createDataFrame(rows, "room_id long, frame_id long, t double, x double, sig string"), rows


def kept(rows, accept):
    out, last = set(), {}
    for r in rows:
        if r[0] not in last or accept(last[r[0]], r):
            out.add((r[0], r[1]))
            last[r[0]] = r
    return out


@pytest.mark.parametrize("name", ["throttle", "deadband", "emit_on_change"])
def test_hot_room_in_a_logarithmic_tree(hot, monkeypatch, name):
    df, rows = hot
    slab = max(r[2] for r in rows) / 63.5
    staged = []

    def spy(df):
        out = spied(df)
        staged.append(out)
        return out

    spied = chains.stage
    monkeypatch.setattr(chains, "stage", spy)
    if name == "throttle":
        got, want = chains.throttle(df, ROOM, ORDER, slab, 3.0), kept(rows, lambda a, r: r[2] - a[2] >= 3.0)
    elif name == "deadband":
        got, want = chains.deadband(df, ROOM, ORDER, slab, F.col("x"), 2.5), kept(rows, lambda a, r: abs(r[3] - a[3]) >= 2.5)
    else:
        got, want = chains.emit_on_change(df, ROOM, ORDER, slab, F.col("sig"), 50.0), kept(rows, lambda a, r: r[2] - a[2] >= 50.0 and r[4] != a[4])
    assert {(r.room_id, r.frame_id) for r in got.collect()} == want and len(want) > 5
    slabs = math.ceil(math.log2(64))
    assert len(staged) == 2 + 2 * slabs  # entries, slabs, and a table for each level up and down
    levels = [s for s in staged if "exit_t" in s.columns and "_node" in s.columns]
    assert len(levels) == slabs
    entries = staged[0].where("room_id = 1").count()
    for level in levels[:-1]:
        largest = level.groupBy("room_id", F.shiftright("_node", 1)).count().agg(F.max("count")).first()[0]
        assert largest <= 0.35 * entries
