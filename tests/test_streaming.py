"""Batch equals streaming on the same rows, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from ambientspark.operators import chains, smoothing as sm
from ambientspark.streaming import processors as P, streams

ROOM, ORDER = ["room_id"], ["t", "frame_id"]


@pytest.fixture(scope="module")
def ticks(spark):
    rng, rows = random.Random(5), []
    for room in range(3):
        t = 0.0
        for i in range(60):
            t += rng.choice([0.5, 2.0, 7.0])
            rows.append((room, room * 1000 + i, t, rng.uniform(-60, -10), rng.uniform(0, 4), rng.random(),
                         rng.randrange(3), rng.choice("ab"), rng.random() < 0.5))
    return spark.createDataFrame(rows, "room_id long, frame_id long, t double, loudness_raw double, activity_raw double, "
                                 "speech_raw double, candidate long, sig string, playback_active boolean")


def stream(spark, df, tmp_path, build, files=3):
    """Write df as consecutive files and run build(stream) one file per micro-batch."""
    src = str(tmp_path / "src")
    bounds = [df.agg(F.max("t")).first()[0] * i / files for i in range(files + 1)]
    for lo, hi in zip(bounds, bounds[1:]):
        df.filter((F.col("t") > lo) & (F.col("t") <= hi)).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = str(tmp_path / "out")
    q = (build(live).writeStream.foreachBatch(streams.append_once(sink)).option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    return spark.read.parquet(sink).drop("batch")


def keyed(df, *cols):
    return sorted((r["frame_id"], *[round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols]) for r in df.collect())


def test_smoothing_stream_equals_batch(spark, ticks, tmp_path):
    got = stream(spark, ticks, tmp_path, lambda d: P.fold_stream(d, P.smoothing_step, P.SMOOTHING))
    want = sm.averages(ticks, ROOM, ORDER, 30.0,
                       sm.Average(6.0, {"loudness": F.col("loudness_raw"), "activity": F.col("activity_raw"), "speech": F.col("speech_raw")}),
                       sm.Average(60.0, {"floor": F.col("loudness_raw")}, F.col("speech_raw") < 0.1))
    assert keyed(got, "loudness", "activity", "speech", "floor") == keyed(want, "loudness", "activity", "speech", "floor")


def test_emitters_stream_equals_batch(spark, ticks, tmp_path):
    got = stream(spark, ticks, tmp_path / "h", lambda d: P.fold_stream(d, P.hysteresis_step, P.HYSTERESIS))
    assert keyed(got, "published") == keyed(sm.hysteresis(ticks, ROOM, ORDER, 30.0, F.col("candidate")), "published")
    got = stream(spark, ticks, tmp_path / "d", lambda d: P.fold_stream(d, P.dwell_step, P.DWELL))
    assert keyed(got, "sig") == keyed(chains.emit_on_change(ticks, ROOM, ORDER, 30.0, F.col("sig"), 30.0), "sig")


def test_late_rows_come_out_marked(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "room_id long, frame_id long, t double, candidate long"
    (tmp_path / "src").mkdir()
    live = spark.readStream.schema(schema).parquet(src)
    query = (P.fold_stream(live, P.hysteresis_step, P.HYSTERESIS, late=True).writeStream.foreachBatch(streams.append_once(str(tmp_path / "out")))
             .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start())
    try:
        for rows in ([(1, 1, 10.0, 5), (1, 2, 20.0, 5)], [(1, 3, 15.0, 6), (1, 4, 25.0, 5)]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["frame_id"], r["published"], r["late"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 5, False), (2, 5, False), (3, None, True), (4, 5, False)}


def test_steps_on_golden_sequences():
    state, flags = None, []
    for floor in (-44.0, None):
        state, _ = P.advisory_step(state, dict(room_id=1, frame_id=0, t=0.0, floor=floor, loud=-50.0, speech=0.0, playback_active=False), hops=2)
    for floor in (-40.0, -34.0, -28.0, -24.0, -23.0):
        state, out = P.advisory_step(state, dict(room_id=1, frame_id=0, t=0.0, floor=floor, loud=-22.0, speech=0.0, playback_active=True), hops=2)
        flags.append(out[0]["envelope_advisory"])
    assert flags == [False, True, True, True, True]
    state = None
    for t in (0.0, 50.0, 95.0):
        state, out = P.evidence_step(state, dict(room_id=1, frame_id=0, t=t, duration_s=1.0))
    assert out[0]["segments"] == 2
    state, out = P.held_bucket_step(None, dict(room_id=1, frame_id=0, t=1.0, bucket="4"))
    state, out = P.held_bucket_step(state, dict(room_id=1, frame_id=1, t=9.0, bucket=None))
    assert (out[0]["bucket"], out[0]["headcount_staleness_s"]) == ("4", 8.0)


def test_completion_step():
    def poll(t, track, progress, obs):
        return dict(room_id=1, obs_id=obs, t=t, kind="poll", track_id=track, progress_s=progress, duration_s=100.0)
    state, seen = None, []
    for row in (dict(room_id=1, obs_id=0, t=0.0, kind="pick", track_id="a", progress_s=None, duration_s=None),
                poll(1.0, "a", 10.0, 1), poll(2.0, "a", 95.0, 2), poll(3.0, "b", 1.0, 3), poll(4.0, None, None, 4)):
        state, out = P.completion_step(state, row)
        seen += [o["track_id"] for o in out]
    assert seen == ["a"]


def test_fan_out_isolates_failures(spark):
    got = []
    def broken(batch, batch_id):
        raise RuntimeError("consumer down")
    streams.fan_out(broken, lambda b, i: got.append((i, b.count())))(spark.range(3), 7)
    assert got == [(7, 3)]


def test_sliding_windows_and_repeats(spark, tmp_path):
    rows = [(1, i, 0.5 * i, 0.9 if i % 2 else 0.1, 0.01) for i in range(20)]
    df = spark.createDataFrame(rows + rows[:3], "room_id long, frame_id long, t double, prob double, power double")
    batch = streams.sliding_features(df.dropDuplicates().withColumn("ts", F.timestamp_seconds("t")))
    one = batch.filter("window_end = timestamp '1970-01-01 00:00:07'").first()
    assert (one["chunks"], one["speech_ratio"]) == (10, 0.5) and abs(one["rms_dbfs"] + 20.0) < 1e-9
    live = stream(spark, df, tmp_path, lambda d: streams.drop_repeats(streams.with_event_time(d), ["room_id", "frame_id"]).select("frame_id", "t"))
    assert live.count() == 19  # t = 0 falls outside the first file's (0, t] range


def test_label_join(spark):
    c = spark.createDataFrame([(1, 10.0, 0.0), (1, 50.0, 40.0)], "room_id long, t double, s double") \
        .select("room_id", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("s").alias("started_at"))
    t = spark.createDataFrame([(1, 5.0)], "room_id long, t double").select("room_id", F.timestamp_seconds("t").alias("tap_ts"))
    out = streams.completions_with_taps(c, t).orderBy("ts").collect()
    assert [r["tap_ts"] is not None for r in out] == [True, False]
