"""Reorder buffer, timers, late rows and typed state: streams equal the rows in order, over several micro-batches."""

import os
import random

import pytest

from ambientspark.plans import queries_rooms as R, queries_streams as S
from ambientspark.streaming import processors as P, streams
from ambientspark.streaming import ordered
from ambientspark.streaming.ordered import fold_in_order

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def in_order(fold, rows):
    state, out = None, []
    for row in sorted(rows, key=lambda r: (r["t"], r["frame_id"])):
        while fold.due and state is not None and fold.due(state) is not None and fold.due(state) < row["t"]:
            state, made = fold.lapse(state, {"room_id": row["room_id"]}, fold.due(state))
            out += made
        state, made = fold.step(state, row)
        out += made
    return out


@pytest.fixture(scope="module")
def evidence(spark):
    rng, rows = random.Random(3), []
    for room in range(3):
        centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
        t = 0.0
        for i in range(40):
            t += rng.choice([1.0, 4.0, 12.0, 120.0])
            x = [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]
            norm = sum(v * v for v in x) ** 0.5
            rows.append({"room_id": room, "frame_id": room * 100 + i, "t": t, "duration_s": rng.uniform(0.5, 2), "embedding": [v / norm for v in x]})
    return rows


SCHEMA = "room_id long, frame_id long, t double, duration_s double, embedding array<double>"


def run(spark, tmp_path, rows, fold, delay, grace=0.0, late=False, files=5):
    """Rows in the given order as files of a stream, one run from the checkpoint for each, then a row that closes the rest."""
    src, sink = str(tmp_path / "src"), str(tmp_path / "out")
    end = max(r["t"] for r in rows) + 10_000
    parts = [rows[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    for part in [*parts, [{"room_id": -1, "frame_id": -1, "t": end, "duration_s": None, "embedding": None}]]:
        spark.createDataFrame([tuple(r.values()) for r in part], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        live = fold_in_order(spark.readStream.schema(SCHEMA).parquet(src), fold, delay, grace, late=late)
        query = (live.writeStream.foreachBatch(streams.append_once(sink)).option("checkpointLocation", str(tmp_path / "cp"))
                 .outputMode("append").trigger(availableNow=True).start())
        assert query.awaitTermination(120)
    read = spark.read.parquet(sink)
    assert read.select("batch").distinct().count() >= 4
    return [r.asDict() for r in read.drop("batch").collect()]


def rounded(rows):
    return sorted(repr({k: round(v, 9) if isinstance(v, float) else v for k, v in sorted(r.items())}) for r in rows)


def test_shuffled_arrival_within_the_delay_equals_rows_in_order(spark, tmp_path, evidence):
    rng = random.Random(1)
    arrived = sorted(evidence, key=lambda r: r["t"] + rng.uniform(0, 140))
    assert arrived != sorted(evidence, key=lambda r: r["t"])
    got = run(spark, tmp_path, arrived, P.EVIDENCE_FOLD, 150.0)
    want = []
    for room in range(3):
        mine = in_order(P.EVIDENCE_FOLD, [r for r in evidence if r["room_id"] == room])
        last = [r for r in evidence if r["room_id"] == room]
        state = None
        for row in sorted(last, key=lambda r: r["t"]):
            state, _ = P.evidence_step(state, row)
        while P.evidence_due(state) is not None:  # all of it times out once the stream has passed
            state, made = P.evidence_lapse(state, {"room_id": room}, P.evidence_due(state))
            mine += made
        want += mine
    assert rounded(got) == rounded(want)
    assert any(r["timed_out"] and r["segments"] == 0 for r in got) and any(r["timed_out"] and r["segments"] for r in got)


def test_late_rows_come_out_marked_and_change_nothing(spark, tmp_path, evidence):
    def counted(state, row):
        """Counts the rows of a room; the state is the number as text and the time of the last."""
        n = int(state[0]) + 1 if state else 1
        assert not state or row["t"] >= state[1]
        return [str(n), row["t"]], [{"room_id": row["room_id"], "frame_id": row["frame_id"], "t": row["t"], "bucket": str(n), "headcount_staleness_s": 0.0}]

    on_time = sorted((r for r in evidence if r["frame_id"] % 10), key=lambda r: r["t"])
    late = [r for r in evidence if r["frame_id"] % 10 == 0]
    split = len(on_time) * 4 // 5
    ordered = on_time[:split] + late + on_time[split:]
    got = run(spark, tmp_path, ordered, P.HELD_BUCKET_FOLD.with_step(counted), 1.0, 100_000.0, late=True)
    marked = [r for r in got if r["late"]]
    assert {r["frame_id"] for r in marked} <= {r["frame_id"] for r in late} and len(marked) >= 6
    assert all(sorted(r["late_rows"] for r in marked if r["room_id"] == room) == list(range(1, 1 + sum(r["room_id"] == room for r in marked))) for room in range(3))
    kept = {r["frame_id"] for r in got if not r["late"]}
    assert kept | {r["frame_id"] for r in marked} == {r["frame_id"] for r in evidence} and not kept & {r["frame_id"] for r in marked}
    for room in range(3):
        steps = [r for r in got if not r["late"] and r["room_id"] == room]
        assert [int(r["bucket"]) for r in sorted(steps, key=lambda r: r["t"])] == list(range(1, len(steps) + 1))


def test_every_fold_restores_its_state():
    rows = [{"room_id": 1, "frame_id": k, "t": 5.0 * k, "loudness_raw": -30.0 - k, "activity_raw": 1.0, "speech_raw": 0.05 * (k % 5), "v_raw": 0.1 * k if k % 2 else None,
             "a_raw": 0.2 if k % 2 else None, "pull_v": 0.3 if k > 3 else None, "pull_a": None, "scale": 1.0, "candidate": k // 3, "sig": "ab"[k // 4 % 2], "floor": -50.0 if k else None,
             "loud": -30.0, "speech": 0.0, "playback_active": k % 4 > 0, "duration_s": 1.0, "embedding": None, "bucket": "4" if k % 3 == 1 else None, "obs_id": k, "rec_id": k,
             "kind": ("pick", "poll", "veto", "take", "speech", "reference", "tap", "record")[k % 8], "track_id": "xyz"[k % 3], "progress_s": 9.0, "duration": 10.0} for k in range(40)]
    for fold in P.FOLDS:
        plain, stored, once, again = None, None, [], []
        for row in rows:
            plain, out = fold.step(plain, row)
            once += out
            held = None if stored is None else fold.unpack(fold.pack(stored))
            stored, out = fold.step(held, row)
            again += out
        assert once == again and once, fold.step


def test_streamed_headcount_equals_the_batch(spark):
    got = {r.frame_id: r for r in S.stream_headcount(spark, SF).collect()}
    want = {r.frame_id: r for r in R.headcount_estimate(spark, SF).collect()}
    assert got.keys() == want.keys() and got
    for k, r in want.items():
        assert got[k].raw_clusters == r.raw_clusters
        assert abs(got[k].dispersion - r.dispersion) < 2e-6 and abs(got[k].fragmentation - r.fragmentation) < 2e-6


def test_rooms_that_share_a_group_keep_their_own_state(spark, tmp_path, monkeypatch, evidence):
    """30 rooms in 2 groups: a processor is called per group, each room still has its own order, late count and timers."""
    monkeypatch.setattr(ordered, "GROUPS", 2)
    rows = [r | {"room_id": r["room_id"] + 3 * k, "frame_id": r["frame_id"] + 1000 * k, "t": r["t"] + k} for k in range(10) for r in evidence]
    rng = random.Random(9)
    arrived = sorted(rows, key=lambda r: r["t"] + rng.uniform(0, 140))
    got = run(spark, tmp_path, arrived, P.EVIDENCE_FOLD, 150.0)
    for room in {r["room_id"] for r in rows}:
        mine = [r for r in rows if r["room_id"] == room]
        want, state = in_order(P.EVIDENCE_FOLD, mine), None
        for row in sorted(mine, key=lambda r: r["t"]):
            state, _ = P.evidence_step(state, row)
        while P.evidence_due(state) is not None:
            state, made = P.evidence_lapse(state, {"room_id": room}, P.evidence_due(state))
            want += made
        assert rounded([r for r in got if r["room_id"] == room]) == rounded(want)
