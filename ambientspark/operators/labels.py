"""Human labels: validation, presence gate, blind-veto gate over flat label records.

Flat records are what `sources.logs.flatten_*` projects out of the nested logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators.joins import tap_ages, tap_in_window


def split_rejects(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with reject_reason)."""
    checked = df.withColumn("reject_reason", reason)
    return checked.filter("reject_reason IS NULL").drop("reject_reason"), checked.filter("reject_reason IS NOT NULL")


def _present(df: DataFrame, name: str):
    """The column, null where it is an object without any field."""
    if isinstance(df.schema[name].dataType, T.StructType):
        return F.when(F.to_json(name) != "{}", F.col(name))
    return F.col(name)


def validate_annotations(df: DataFrame, state="state", recommendation="recommendation") -> tuple[DataFrame, DataFrame]:
    return split_rejects(df, col.annotation_reject_reason("verdict", _present(df, state), _present(df, recommendation)))


def validate_overrides(df: DataFrame, state="state", recommendation="recommendation", now_playing="now_playing",
                       chosen="chosen") -> tuple[DataFrame, DataFrame]:
    parts = [_present(df, c) for c in (state, recommendation, now_playing, chosen)]
    return split_rejects(df, col.override_reject_reason("action", *parts))


def tap_times(annotations: DataFrame, overrides: DataFrame, keys: list[str] = ("room_id",)) -> DataFrame:
    """Every human tap: all annotations, and overrides other than automatic completions."""
    human = overrides.filter(~F.col("action").eqNullSafe(F.lit("played_through")))
    taps = annotations.select(*keys, "ts").unionByName(human.select(*keys, "ts"))
    return taps.filter("ts IS NOT NULL").withColumnRenamed("ts", "tap_ts")


def assess_presence(overrides: DataFrame, taps: DataFrame, slab_s: float, keys: list[str] = ("room_id",),
                    fresh: float = C.FRESH_S, handoff: float = C.HANDOFF_S) -> DataFrame:
    """Adds occupied, basis, stamped: a stamped block is honoured as it is, everything else is
    judged by staleness, warm handoff and taps inside the play window."""
    aged = tap_ages(overrides, taps, list(keys), slab_s)
    tapped = tap_in_window(F.col("duration_s"), F.col("tap_age_s"))
    staleness = F.coalesce("headcount_staleness_s", "emotion_staleness_s")
    retro = col.presence_basis(staleness, "duration_s", tapped, fresh, handoff)
    stamped = F.col("stamped_occupied").isNotNull()
    return aged.withColumns({
        "stamped": stamped,
        "basis": F.when(stamped, F.col("stamped_basis")).otherwise(retro),
        "occupied": F.when(stamped, F.col("stamped_occupied")).otherwise(retro.isin(*C.OCCUPIED))})


def gate_overrides(overrides: DataFrame, taps: DataFrame, slab_s: float, keys: list[str] = ("room_id",)) -> DataFrame:
    """Adds `gate` (usable / suspect / blind); a label, so nothing is lost."""
    df = assess_presence(overrides, taps, slab_s, keys)
    thru = F.col("action").eqNullSafe(F.lit("played_through"))
    blind = col.is_blind_veto("action", "playback_active", "speech_ratio", "emotion_staleness_s")
    return df.withColumn("gate", F.when(thru & F.col("occupied"), "usable").when(thru, "suspect")
                         .when(blind, "blind").otherwise("usable"))


def usable(gated: DataFrame) -> DataFrame:
    return gated.filter("gate = 'usable'")
