"""Registered queries: labels, gates and the tuning report."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ambientspark.functions import columns as col
from ambientspark.operators import joins, labels, slabs, tuning
from ambientspark.plans import views as V
from ambientspark.plans.report import tuning_report
from ambientspark.sources import logs, snapshots
from ambientspark.streaming import streams


def _slab(spark, sf):
    return V.slab(spark, sf, "labels")


def _gated(spark, sf):
    a, o = V.annotations(spark, sf), V.overrides(spark, sf)
    return labels.gate_overrides(o, labels.tap_times(a, o), _slab(spark, sf))


def _usable(spark, sf):
    return labels.usable(_gated(spark, sf))


def _labelled(df):
    return df.withColumn("cell", col.cell_label("cell"))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def verdicts_by_cell(spark, sf):
    return _labelled(tuning.verdict_counts_by_cell(V.annotations(spark, sf)))


def verdict_totals(spark, sf):
    return tuning.verdict_totals(V.annotations(spark, sf))


def boundary_proximity(spark, sf):
    return tuning.boundary_proximity(V.annotations(spark, sf))


def boundary_shift_scores(spark, sf):
    return tuning.boundary_shift_scores(V.annotations(spark, sf)).drop("ord")


def boundary_shifts(spark, sf):
    return tuning.suggest_boundary_shifts(V.annotations(spark, sf))


def override_counts_by_cell(spark, sf):
    return _round(_labelled(tuning.override_counts_by_cell(_usable(spark, sf))), "rate")


def override_rate(spark, sf):
    """Veto rate per room over the gated corpus."""
    counts = _usable(spark, sf).groupBy("room_id").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("skip", "wrong_vibe", "manual", "played_through")])
    return counts.select("room_id", F.round(tuning.override_rate(), 6).alias("rate"))


def veto_proximity(spark, sf):
    return tuning.veto_boundary_proximity(_usable(spark, sf))


def strong_label_shifts(spark, sf):
    return tuning.strong_label_shifts(_usable(spark, sf))


def tier_disagreement(spark, sf):
    return tuning.tier_disagreement(_usable(spark, sf))


def tier_cutoffs(spark, sf):
    return tuning.suggest_tier_cutoffs(_usable(spark, sf))


def pool_weighting(spark, sf):
    return _round(_labelled(tuning.pool_weighting(_usable(spark, sf))), "rate")


def gate_overrides(spark, sf):
    return _gated(spark, sf).select("rec_id", "action", "gate", "basis", "stamped")


def gate_summary(spark, sf):
    return tuning.gate_summary(_gated(spark, sf))


def presence_retro(spark, sf):
    return _gated(spark, sf).filter("action = 'played_through'").select("rec_id", "occupied", "basis", "stamped")


def blind_vetoes(spark, sf):
    o = V.overrides(spark, sf)
    hit = col.is_blind_veto("action", "playback_active", "speech_ratio", "emotion_staleness_s")
    return o.filter(hit).select("rec_id", "action", "speech_ratio", "emotion_staleness_s")


def _aged(spark, sf):
    a, o = V.annotations(spark, sf), V.overrides(spark, sf)
    return joins.tap_ages(o, labels.tap_times(a, o), ["room_id"], _slab(spark, sf))


def tap_in_window(spark, sf):
    return _aged(spark, sf).select("rec_id", joins.tap_in_window(F.col("duration_s"), F.col("tap_age_s")).alias("tapped"))


def last_tap_age(spark, sf):
    return _aged(spark, sf).select("rec_id", "tap_age_s")


def presence_block(spark, sf):
    block = col.presence_block("headcount_staleness_s", "emotion_staleness_s", "duration_s", "tap_age_s")
    return (_aged(spark, sf).filter("action = 'played_through'").select("rec_id", block.alias("p"))
            .select("rec_id", "p.occupied", "p.basis", "p.staleness_s", "p.track_duration_s", "p.last_tap_age_s"))


def tap_times(spark, sf):
    taps = labels.tap_times(V.annotations(spark, sf), V.overrides(spark, sf))
    return taps.groupBy("room_id").agg(F.count("*").alias("taps"), F.min("tap_ts").alias("first_tap"),
                                       F.max("tap_ts").alias("last_tap"))


def validate_overrides(spark, sf):
    """Records with missing parts or parts without any field, by the first rule they break."""
    raw = V.overrides(spark, sf).selectExpr(
        "rec_id", "CASE WHEN rec_id % 97 = 0 THEN 'rewind' WHEN rec_id % 89 = 0 THEN NULL ELSE action END AS action",
        "IF(rec_id % 71 = 0, NULL, struct(CASE WHEN rec_id % 83 <> 0 THEN valence END AS valence)) AS state", "struct(cell AS matched_cell) AS recommendation",
        "CASE WHEN rec_id % 79 <> 0 THEN struct(struct(duration_s) AS track, 1.0D AS progress_s) "
        "ELSE from_json('{}', 'track STRUCT<duration_s: DOUBLE>, progress_s DOUBLE') END AS now_playing",
        "struct(chosen_tier AS tier) AS chosen")
    _, rejected = labels.validate_overrides(raw)
    return rejected.select("rec_id", "reject_reason")


def validate_annotations(spark, sf):
    raw = V.annotations(spark, sf).selectExpr(
        "rec_id", "CASE WHEN rec_id % 97 = 0 THEN 'meh' WHEN rec_id % 89 = 0 THEN NULL ELSE verdict END AS verdict",
        "struct(valence AS valence) AS state", "struct(CASE WHEN rec_id % 83 <> 0 THEN cell END AS matched_cell) AS recommendation")
    _, rejected = labels.validate_annotations(raw)
    return rejected.select("rec_id", "reject_reason")


def session_counts(spark, sf):
    return tuning.session_counts(V.overrides(spark, sf), "action")


def signal_records(spark, sf):
    """Usable boundary records per room, guard rows and records without signals left out."""
    return tuning.signal_records(V.annotations(spark, sf)).groupBy("room_id").agg(F.count("*").alias("records"))


def strong_labels(spark, sf):
    return tuning.strong_labels_as_verdicts(_usable(spark, sf)).groupBy("action", "verdict").agg(F.count("*").alias("n"))


def attribution_cells(spark, sf):
    o = V.overrides(spark, sf)
    return o.select("rec_id", col.cell_label(col.attribution_cell("cell", "source")).alias("cell"),
                    col.is_guard("cell").alias("guard"))


#: Section of the tuning report -> what its query shows of it.
SECTIONS = {
    "verdict_totals": lambda df: df, "1_verdicts_by_cell": _labelled, "2_boundary_proximity": lambda df: df, "3_boundary_shifts": lambda df: df,
    "gate_summary": lambda df: df, "4_overrides_by_cell": lambda df: _round(_labelled(df), "rate"),
    "4a_flagged": lambda df: df.select("rec_id", "action", "gate", "basis", "stamped"), "5_veto_proximity": lambda df: df, "6_tier_disagreement": lambda df: df,
    "7_strong_label_shifts": lambda df: df, "8_tier_cutoffs": lambda df: df, "9_pool_weighting": lambda df: _round(_labelled(df), "rate")}


def _section(name):
    def query(spark, sf):
        report = tuning_report(V.annotations(spark, sf), V.overrides(spark, sf), _slab(spark, sf))
        return SECTIONS[name](report[name])

    query.__name__ = f"report_{name}"
    query.__doc__ = f"Section {name} of the tuning report."
    return query


def jsonl_round_trip(spark, sf):
    """Verdict records written as daily JSON lines, read back and flattened."""
    path = f"{slabs.shared_dir(spark)}/log-{uuid4().hex}"
    cuts = F.struct(*[F.col(c) for c in ("valence_low", "valence_high", "arousal_low", "arousal_high")])
    nested = V.annotations(spark, sf).select("room_id", F.lit(1).alias("schema_version"), "ts", "verdict", F.struct("valence", "arousal").alias("state"),
                                             F.struct(F.col("cell").alias("matched_cell"), cuts.alias("boundaries_snapshot")).alias("recommendation"))
    logs.write_daily(nested, path)
    records, _ = logs.read_annotations(spark, f"{path}/*")
    return _labelled(logs.flatten_annotations(records))


def state_feed(spark, sf):
    """States written as JSON lines and read as a live feed."""
    path = f"{slabs.shared_dir(spark)}/feed-{uuid4().hex}"
    logs.write_states(V.frames(spark, sf).select("room_id", F.col("t").alias("timestamp"), F.col("speech_raw").alias("speech_ratio"), "playback_active"), f"{path}/source")
    feed = logs.stream_states(spark, f"{path}/source")
    (feed.writeStream.foreachBatch(streams.append_once(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(feed.schema).parquet(f"{path}/out/*").select("room_id", "timestamp", "speech_ratio", "playback_active")


def signature_store(spark, sf):
    """Two versions of a signature snapshot, of which the second is in force."""
    path = f"{slabs.shared_dir(spark)}/signatures-{uuid4().hex}"
    seen = V.frames(spark, sf).filter("track_id IS NOT NULL").groupBy("track_id").agg(
        F.max("v_raw").alias("valence"), F.min("a_raw").alias("arousal"), F.count("*").cast("int").alias("refs"))
    seen = seen.selectExpr("*", "0.0D AS pull_valence", "0.0D AS pull_arousal", "0 AS pull_refs")
    snapshots.write_signatures(seen.withColumn("refs", F.lit(0)), path)
    snapshots.write_signatures(snapshots.read_signatures(spark, path).drop("refs").join(seen.select("track_id", "refs"), "track_id"), path)
    return snapshots.read_signatures(spark, path).select("track_id", "valence", "arousal", F.col("refs").cast("bigint").alias("refs"))


QUERIES = {f.__name__: f for f in (
    verdicts_by_cell, verdict_totals, boundary_proximity, boundary_shift_scores, boundary_shifts,
    override_counts_by_cell, override_rate, veto_proximity, strong_label_shifts, tier_disagreement, tier_cutoffs,
    pool_weighting, gate_overrides, gate_summary, presence_retro, blind_vetoes, tap_in_window, last_tap_age,
    presence_block, tap_times, validate_overrides, validate_annotations, session_counts, signal_records,
    strong_labels, attribution_cells, jsonl_round_trip, state_feed, signature_store, *map(_section, SECTIONS))}
