"""Trends against plain least squares; their cost does not follow the rows in the horizon."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambientspark.operators import smoothing as sm


def _plain(rows, horizon):
    """frame_id -> trend; rows: room, frame_id, t, x."""
    out = {}
    for room in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == room and r[2] is not None), key=lambda r: r[2])
        for _, i, t, x in mine:
            seen = [(a, b) for _, _, a, b in mine if t - horizon <= a <= t and b is not None]
            out[i] = "stable"
            if x is not None and len(seen) >= 5 and t - seen[0][0] >= 15.0:
                a, b = (np.array(v) for v in zip(*seen))
                slope = ((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum() * 60.0
                out[i] = "rising" if slope > 0.1 else "falling" if slope < -0.1 else "stable"
    return out


@pytest.mark.parametrize("horizon", [60.0, 37.3])
@pytest.mark.parametrize("slab", [70.0, 10_000.0])
def test_trends_are_those_of_least_squares(spark, slab, horizon):
    rng = random.Random(3)
    rows = []
    for room, gap in ((None, 2.0), (1, 2.0), (2, 0.3), (3, 40.0), (2**60 + 1, 5.0), (2**60 + 2, 5.0)):
        t = -100.0
        for _ in range(220):
            t += rng.choice([0.0, 0.5, 1.0, 3.0]) * gap  # some rows share their time
            rows.append((room, len(rows), round(t, 3), None if rng.random() < 0.2 else 1e6 + rng.uniform(-0.2, 0.2) + 0.1 * np.sin(t / 40)))
        rows.append((room, len(rows), None, 1.0))  # belongs to no horizon
    df = spark.createDataFrame([(a, b, c, d if d is None else float(d)) for a, b, c, d in rows], "room_id long, frame_id long, t double, x double")
    made = sm.trend(df, ["room_id"], "t", slab, horizon_s=horizon, trend=F.col("x"))
    assert made.columns == [*df.columns, "trend"]
    got, want = [(r.frame_id, r.trend) for r in made.collect()], _plain(rows, horizon)
    assert dict(got) == want and len(got) == len(want) == 6 * 220
    assert set(want.values()) == {"rising", "falling", "stable"}


def test_a_crowded_horizon_costs_no_more_a_row(spark):
    """Row by row over what each looks back on, the 60,000 rows of one horizon make 1.8 billion visits for each value."""
    n = 60_000
    df = spark.range(n).selectExpr("1L AS room_id", f"id * 59.0D / {n} AS t", f"sin(id * 6.0D / {n}) AS valence", f"IF(id % 7 > 0, cos(id * 6.0D / {n}), NULL) AS arousal")
    began = time.monotonic()
    made = {(r.valence_trend, r.arousal_trend) for r in sm.va_trend(df, ["room_id"], "t", 1000.0).collect()}
    assert time.monotonic() - began < 25.0
    assert {v for v, _ in made} == {"rising", "falling", "stable"} and {a for _, a in made} >= {"falling", "stable"}


def test_no_frame_slides_over_the_rows(spark):
    df = spark.range(9).selectExpr("1L AS room_id", "id * 1.0D AS t", "id * 1.0D AS x")
    plan = sm.trend(df, ["room_id"], "t", 1000.0, trend=F.col("x"))._jdf.queryExecution().toString()
    assert "RangeFrame" not in plan and "regr_slope" not in plan
