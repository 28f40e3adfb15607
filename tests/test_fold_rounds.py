"""Folds that never forget settle in a number of rounds logarithmic in the slabs."""

import pytest
from pyspark.sql import functions as F

from ambientspark.operators import fold

ROOM, ORDER = ["room_id"], ["t", "frame_id"]


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that a fold stages: one for the rows, one for the slabs, one for the first states, one for each round."""
    staged, spied = [], fold.stage

    def spy(df):
        staged.append(1)
        return spied(df)

    monkeypatch.setattr(fold, "stage", spy)
    return lambda: len(staged) - 3


def rows(spark, n, ids):
    data = [(room, room * 10_000 + i, 1.0 * i, ids(room, i)) for room, length in ((1, n), (2, 7)) for i in range(length)]
    return spark.createDataFrame(data, "room_id long, frame_id long, t double, track_id string"), data


def live_after(data, k):
    out, live = {}, {}
    for room, frame, _, track in data:
        mine = live.setdefault(room, [])
        if track not in mine:
            live[room] = mine = [*mine, track][-k:]
        out[frame] = list(mine)
    return out


def test_rotating_ids_over_64_slabs(spark, rounds):
    """Each slab holds one id of a set that the map keeps for good, so the slots depend on the first slab for ever."""
    df, data = rows(spark, 640, lambda room, i: f"t{i // 10 % 4}")
    got = {r.frame_id: r.live for r in fold.recent_k(df, ROOM, ORDER, 10.0, "track_id", 4).collect()}
    assert got == live_after(data, 4) and df.select(F.floor(F.col("t") / 10)).distinct().count() == 64
    assert rounds() <= 7


def test_counter_over_64_slabs(spark, rounds):
    df, data = rows(spark, 640, lambda room, i: "x")
    made = fold.scan(df, ROOM, ORDER, 10.0, 0, lambda s, r: (s + 1, {"frame_id": r["frame_id"], "n": s + 1}), "frame_id long, n long")
    assert {r.frame_id: r.n for r in made.collect()} == {room * 10_000 + i: i + 1 for room, n in ((1, 640), (2, 7)) for i in range(n)}
    assert rounds() <= 7


def test_a_fold_that_forgets_needs_one_round(spark, rounds):
    df, data = rows(spark, 640, lambda room, i: f"t{i}")
    got = {r.frame_id: r.live for r in fold.recent_k(df, ROOM, ORDER, 10.0, "track_id", 4).collect()}
    assert got == live_after(data, 4)
    assert rounds() <= 2
