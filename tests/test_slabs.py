"""Slab-wise operators against sequential models, with one room holding a third of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ambientspark.operators import chains, fold, joins, signal, smoothing as sm
from ambientspark.operators import slabs as S

ROOM, ORDER = ["room_id"], ["t", "frame_id"]
SLABS = [7.0, 1000.0]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(11), []
    for room in range(9):
        t = rng.uniform(0, 3)
        for i in range(240 if room == 0 else 60):
            t += rng.choice([0.0, 0.1, 0.5, 2.0, 9.0])
            out.append((room, room * 1000 + i, round(t, 3), rng.choice([None, rng.uniform(-60, -10)]), rng.random(), rng.choice("abc")))
    return out


@pytest.fixture(scope="module")
def ticks(spark, rows):
    return spark.createDataFrame(rows, "room_id long, frame_id long, t double, x double, u double, sig string").cache()


def by_room(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out.values()


def got(df, *cols):
    return {r["frame_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def close(a, b, tol=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= tol)


@pytest.mark.parametrize("slab", SLABS)
def test_running(ticks, rows, slab):
    df = S.running(ticks, ROOM, ORDER, slab, n=S.row_rank(), p=S.previous(F.col("x")), l=S.last_known(F.col("x")),
                   b=S.last_before(F.col("x")), tl=S.tail(F.col("x"), 3), s=S.running_sum(F.col("u")), g=S.lagged(F.col("sig"), 5))
    out = got(df, "n", "p", "l", "b", "tl", "s", "g")
    for room in by_room(rows):
        last, total, xs = None, 0.0, []
        for i, (_, fid, t, x, u, sig) in enumerate(room):
            before, last = last, x if x is not None else last
            total += u
            xs.append(x)
            n, p, l, b, tl, s, g = out[fid]
            assert (n, p, l, b) == (i + 1, xs[i - 1] if i else None, last, before)
            assert tl == xs[-3:] and close(s, total) and g == (room[i - 5][5] if i >= 5 else None)


@pytest.mark.parametrize("slab", SLABS)
def test_averages(ticks, rows, slab):
    df = sm.averages(ticks, ROOM, ORDER, slab, sm.Average(6.0, {"a": F.col("x")}),
                     sm.Average(0.05, {"fast": F.col("u")}, F.col("sig") == "a", "fed"))
    out = got(df, "a", "fast", "fed")
    for room in by_room(rows):
        a = fast = ta = tf = None
        for _, fid, t, x, u, sig in room:
            if x is not None:
                a = x if a is None else a + (1 - math.exp(-max(1e-6, t - ta) / 6.0)) * (x - a)
                ta = t
            if sig == "a":
                fast = u if fast is None else fast + (1 - math.exp(-max(1e-6, t - tf) / 0.05)) * (u - fast)
                tf = t
            assert close(out[fid][0], a) and close(out[fid][1], fast) and out[fid][2] == tf


@pytest.mark.parametrize("slab", SLABS)
def test_signature_scan_hysteresis_streak(ticks, rows, slab):
    sig = got(sm.running_signature(ticks, ROOM, ORDER, slab, "n", F.col("u") < 0.6, m=F.col("u")), "n", "m")
    hyst = got(sm.hysteresis(ticks, ROOM, ORDER, slab, F.col("sig"), 2), "published")
    runs = got(sm.streak(ticks, ROOM, ORDER, slab, F.col("u") > 0.3), "streak")
    ratio = got(signal.rolling_ratio(ticks, ROOM, ORDER, slab, 7, "u", r=0.5), "r")
    for room in by_room(rows):
        n, m, pub, pend, cnt, run = 0, 0.0, None, None, 0, 0
        for i, (_, fid, t, x, u, c) in enumerate(room):
            if u < 0.6:
                n, m = n + 1, m + (u - m) / min(n + 1, 20)
            assert sig[fid][0] == n and close(sig[fid][1], m)
            if pub is None or c == pub:
                pub, pend, cnt = c, None, 0
            else:
                pend, cnt = c, cnt + 1 if c == pend else 1
                if cnt >= 2:
                    pub, pend, cnt = c, None, 0
            assert hyst[fid] == (pub,)
            run = run + 1 if u > 0.3 else 0
            assert runs[fid] == (run,)
            last = [r[4] >= 0.5 for r in room[max(0, i - 6):i + 1]]
            assert close(ratio[fid][0], sum(last) / len(last))


def keep(rows, accept):
    out = set()
    for room in by_room(rows):
        last = None
        for r in room:
            if last is None or accept(last, r):
                out.add(r[1])
                last = r
    return out


@pytest.mark.parametrize("slab", SLABS)
def test_chains(ticks, rows, slab):
    assert set(got(chains.throttle(ticks, ROOM, ORDER, slab, 2.0))) == keep(rows, lambda a, r: r[2] - a[2] >= 2.0)
    assert set(got(chains.deadband(ticks, ROOM, ORDER, slab, F.col("u"), 0.4))) == keep(rows, lambda a, r: abs(r[4] - a[4]) >= 0.4)
    assert set(got(chains.emit_on_change(ticks, ROOM, ORDER, slab, F.col("sig"), 11.0))) == \
        keep(rows, lambda a, r: r[2] - a[2] >= 11.0 and r[5] != a[5])


def test_quiet_signature_passes_through_many_slabs(spark):
    """A signature that hardly changes: most slabs keep nothing and hand the last emission on."""
    data = [(0, i, 2.0 * i, "z" if 150 <= i < 152 else "a") for i in range(300)]
    df = spark.createDataFrame(data, "room_id long, frame_id long, t double, sig string")
    assert sorted(got(chains.emit_on_change(df, ROOM, ORDER, 9.0, F.col("sig"), 30.0))) == [0, 150, 165]


@pytest.mark.parametrize("slab", SLABS)
def test_recent_and_scan(ticks, rows, slab):
    out = got(fold.recent_k(ticks, ROOM, ORDER, slab, "sig", 2), "live")
    total = fold.scan(ticks, ROOM, ORDER, max(slab, 150.0), 0,  # never forgets: one round per slab
                      lambda s, r: (s + 1, {"frame_id": r["frame_id"], "n": s + 1}), "frame_id long, n long")
    counts = got(total, "n")
    for room in by_room(rows):
        live = []
        for i, r in enumerate(room):
            if r[5] not in live:
                live = (live + [r[5]])[-2:]
            assert out[r[1]] == (live,) and counts[r[1]] == (i + 1,)


@pytest.mark.parametrize("slab", SLABS)
def test_asof_and_evidence(spark, ticks, rows, slab):
    right = ticks.filter("x IS NOT NULL").select("room_id", F.col("t").alias("at"), F.col("frame_id").alias("evidence_id"), "x")
    probes = ticks.filter("u < 0.5").select("room_id", "frame_id", (F.col("t") + 0.05).alias("t"))
    held = got(joins.asof_reading(probes, right, ROOM, slab, ["x"], reading_id="evidence_id"), "x", "staleness_s")
    window = joins.evidence_window(probes, right, ROOM, slab, ["x"], "frame_id", 12.0, 4).collect()
    pairs = {(r["frame_id"], r["evidence_id"]) for r in window}
    want = set()
    for room in by_room(rows):
        known = [r for r in room if r[3] is not None]
        for r in room:
            if r[4] >= 0.5:
                continue
            t = r[2] + 0.05
            past = [k for k in known if k[2] <= t]
            x, stale = held[r[1]]
            assert (x is None) == (not past) and (not past or (x == past[-1][3] and close(stale, t - past[-1][2])))
            want |= {(r[1], k[1]) for k in [k for k in past if k[2] >= t - 12.0][-4:]}
    assert pairs == want


def test_trend_and_trail_across_slabs(ticks, rows):
    near, far = (got(sm.trend(ticks, ROOM, "t", s, tr=F.col("u")), "tr") for s in (61.0, 10_000.0))
    assert near == far and len(near) == len(rows) and len(set(near.values())) > 1
    assert got(sm.trail(ticks, ROOM, "t", 15.0, 12.0, "u").withColumn("n", F.size("trail")), "n") == \
        got(sm.trail(ticks, ROOM, "t", 9999.0, 12.0, "u").withColumn("n", F.size("trail")), "n")


def test_hot_room_is_split(ticks):
    """No task of the windowed stage sees the whole hot room."""
    slab = S.fit_slab(ticks, ROOM, "t", rows=40)
    assert S.add_slab(ticks, "t", slab).groupBy("room_id", S.SLAB).count().agg(F.max("count")).first()[0] <= 80
