"""Joins on time: as-of, bounded-age as-of, tap windows, rolling buffers, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import AtomicType

from ambientspark.operators.slabs import last_known, running, running_sum


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, slab_s: float,
         values: list[str], left_id: str | None = None, right_id: str | None = None,
         by_id: bool = False) -> DataFrame:
    """Latest right row at or before each left row, as columns `values`, plus `at`.

    Both sides travel in one union and the right value is carried forward, so there is no
    range join to explode. At equal times every right row counts as earlier, or with
    by_id only those whose id is not above the left row's.
    """
    payload = F.struct(*[F.col(c) for c in left.columns]).alias("_left")
    l = left.select(*keys, F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_side"),
                    (F.col(left_id) if left_id else F.lit(0)).cast("bigint").alias("_id"), payload)
    r = right.select(*keys, F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_side"),
                     (F.col(right_id) if right_id else F.lit(0)).cast("bigint").alias("_id"),
                     F.struct(F.col(right_t).cast("double").alias("at"), *values).alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = ["_t", "_id", "_side"] if by_id else ["_t", "_side", "_id"]
    held = running(both, keys, order, slab_s, _held=last_known(F.col("_right")))
    return held.filter("_side = 1").select("_left.*", "_held.at", *[f"_held.{v}" for v in values])


def asof_reading(ticks: DataFrame, readings: DataFrame, keys: list[str], slab_s: float, values: list[str],
                 tick_t: str = "t", reading_t: str = "at", reading_id: str | None = None) -> DataFrame:
    """Held reading and its age; both null before the first reading."""
    out = asof(ticks, readings, keys, tick_t, reading_t, slab_s, values, right_id=reading_id)
    return out.withColumn("staleness_s", F.when(F.col("at").isNotNull(),
                                                F.greatest(F.lit(0.0), F.col(tick_t) - F.col("at"))))


def asof_playback(ticks: DataFrame, obs: DataFrame, keys: list[str], slab_s: float) -> DataFrame:
    """(playback_active, playback_track_id) of the last observation; inactive when paused or unseen."""
    out = asof(ticks, obs, keys, "t", "t", slab_s, ["obs_track", "obs_playing"], right_id="obs_id")
    active = F.coalesce(F.col("obs_playing") & F.col("obs_track").isNotNull(), F.lit(False))
    return (out.withColumn("playback_active", active)
            .withColumn("playback_track_id", F.when(active, F.col("obs_track")))
            .drop("obs_track", "obs_playing", "at"))


def asof_max_age(left: DataFrame, right: DataFrame, keys: list[str], slab_s: float, values: list[str],
                 max_age_s: float, left_t: str = "t", right_t: str = "at", **ids) -> DataFrame:
    """As-of values, null once older than max_age_s."""
    out = asof(left, right, keys, left_t, right_t, slab_s, values, **ids)
    fresh = F.col(left_t) - F.col("at") <= max_age_s
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in ["at", *values]})


def tap_ages(records: DataFrame, taps: DataFrame, keys: list[str], slab_s: float, ts: str = "ts") -> DataFrame:
    """Seconds since the last human tap at or before each record (`tap_age_s`)."""
    out = asof(records, taps, keys, ts, "tap_ts", slab_s, [])
    return out.withColumn("tap_age_s", F.col(ts) - F.col("at")).drop("at")


def tap_in_window(duration: Column, tap_age: Column) -> Column:
    """A tap inside [ts - duration, ts] exists exactly when the last tap is that young."""
    return F.coalesce((duration > 0) & (tap_age <= duration), F.lit(False))


def evidence_window(ticks: DataFrame, evidence: DataFrame, keys: list[str], slab_s: float, values: list[str],
                    tick_id: str, horizon_s: float, cap: int) -> DataFrame:
    """(tick, evidence) rows: evidence with t - horizon <= at <= t, the newest `cap` of it.

    Evidence is numbered per key; a tick's buffer is then a run of at most `cap`
    consecutive numbers, matched by equality.
    """
    numbered = running(evidence, keys, ["at", "evidence_id"], slab_s, _n=running_sum(F.lit(1).cast("bigint")))
    marks = numbered.select(*keys, "at", "evidence_id", "_n")
    first_out = F.col("t") - horizon_s
    probe = ticks.select(*keys, tick_id, "t", first_out.alias("_from"))
    newest = asof(probe, marks, keys, "t", "at", slab_s, ["_n"], right_id="evidence_id").withColumnRenamed("_n", "_hi")
    # Rows strictly older than the horizon: number of the last one, by an as-of just before it.
    aged = marks.select(*keys, "evidence_id", F.col("_n").alias("_lo"), F.col("at").alias("gone_at"))
    spans = asof_before(newest.drop("at"), aged, keys, "_from", "gone_at", slab_s, ["_lo"])
    lo = F.greatest(F.coalesce(F.col("_lo"), F.lit(0)) + 1, F.col("_hi") - cap + 1)
    slots = (spans.filter(F.col("_hi").isNotNull() & (lo <= F.col("_hi")))
             .withColumn("_n", F.explode(F.sequence(lo, F.col("_hi"))))
             .select(*keys, tick_id, F.col("t"), "_n"))
    return slots.join(numbered.select(*keys, "_n", "evidence_id", "at", *values), [*keys, "_n"]).drop("_n")


def asof_before(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, slab_s: float,
                values: list[str]) -> DataFrame:
    """Latest right row strictly before each left row."""
    payload = F.struct(*[F.col(c) for c in left.columns]).alias("_left")
    l = left.select(*keys, F.col(left_t).alias("_t"), F.lit(0).alias("_side"), payload)
    r = right.select(*keys, F.col(right_t).alias("_t"), F.lit(1).alias("_side"), F.struct(*values).alias("_right"),
                     F.col("evidence_id").alias("_id"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_id", F.coalesce("_id", F.lit(0)))
    held = running(both, keys, ["_t", "_side", "_id"], slab_s, _held=last_known(F.col("_right")))
    return held.filter("_side = 0").select("_left.*", *[f"_held.{v}" for v in values])


def frames_in_phase(frames: DataFrame, phases: DataFrame, slab_s: float, keys: list[str] = (), t: str = "t") -> DataFrame:
    """Label frames with the protocol phases [start_s, end_s) they fall in: one row per frame and phase.

    Overlapping phases each label a frame; a phase that does not end before it starts is required to state its end. Both sides are
    matched by time slab, so a phase costs a row per slab and part it touches, whatever the number of phases. Without keys a slab holds the frames of
    all rooms, so they are dealt to as many parts as a shuffle has partitions: no task holds a slab's frames.
    """
    keys = list(keys)
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.greatest(F.floor(F.col("start_s") / slab_s), F.ceil(F.col("end_s") / slab_s) - 1)
    slabs = phases.withColumn("_slab", F.explode(F.sequence(F.floor(F.col("start_s") / slab_s), last)))
    slabs = slabs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    plain = [f.name for f in frames.schema.fields if isinstance(f.dataType, AtomicType)]
    placed = frames.withColumns({"_slab": F.floor(F.col(t) / slab_s), "_part": F.pmod(F.xxhash64(*plain), F.lit(parts).cast("bigint"))})
    both = placed.join(slabs, [*keys, "_slab", "_part"]).filter((F.col(t) >= F.col("start_s")) & (F.col(t) < F.col("end_s")))
    return both.select(*frames.columns, *[c for c in phases.columns if c not in (*keys, "start_s", "end_s")])
