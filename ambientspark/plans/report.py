"""The offline tuning report as named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ambientspark.operators import labels, tuning
from ambientspark.operators.slabs import stage


def tuning_report(annotations: DataFrame, overrides: DataFrame, slab_s: float,
                  keys: list[str] = ("room_id",)) -> dict[str, DataFrame]:
    """Sections of the report over flat label records; each is lazy.

    The gated corpus feeds every override section, so it is written once to the shared folder."""
    taps = labels.tap_times(annotations, overrides, list(keys))
    gated = stage(labels.gate_overrides(overrides, taps, slab_s, list(keys)))
    usable = labels.usable(gated)
    return {
        "verdict_totals": tuning.verdict_totals(annotations),
        "1_verdicts_by_cell": tuning.sorted_report(tuning.verdict_counts_by_cell(annotations)),
        "2_boundary_proximity": tuning.boundary_proximity(annotations),
        "3_boundary_shifts": tuning.suggest_boundary_shifts(annotations),
        "gate_summary": tuning.gate_summary(gated),
        "4_overrides_by_cell": tuning.sorted_report(tuning.override_counts_by_cell(usable)),
        "4a_flagged": gated.filter("gate <> 'usable'"),
        "5_veto_proximity": tuning.veto_boundary_proximity(usable),
        "6_tier_disagreement": tuning.tier_disagreement(usable),
        "7_strong_label_shifts": tuning.strong_label_shifts(usable),
        "8_tier_cutoffs": tuning.suggest_tier_cutoffs(usable),
        "9_pool_weighting": tuning.pool_weighting(usable).orderBy("cell", "genre"),
    }
