"""The offline tuning report: rates, proximity, shift and cut-off proposals, pool weights.

Candidate moves are evaluated as conditional sums of one aggregate, so the records are read
once and never multiplied by the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ambientspark.functions import constants as C, columns as col


def verdict_counts_by_cell(annotations: DataFrame) -> DataFrame:
    cell = F.when(F.size("cell") > 0, F.col("cell")).otherwise(F.array(F.lit("?")))
    return (annotations.groupBy(cell.alias("cell"))
            .agg(F.count_if(F.col("verdict") == "good").alias("good"),
                 F.count_if(F.col("verdict") == "wrong").alias("wrong")))


def verdict_totals(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.count("*").alias("records"), F.count_if(F.col("verdict") == "good").alias("good"),
                           F.count_if(F.col("verdict") == "wrong").alias("wrong"))


def override_counts_by_cell(usable: DataFrame) -> DataFrame:
    """Actions per attributed cell with the veto rate."""
    counts = usable.groupBy(col.attribution_cell("cell", "source").alias("cell")).agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in C.ACTIONS])
    return counts.withColumn("rate", override_rate())


def override_rate() -> Column:
    """vetoes / (vetoes + completions); null when there are neither."""
    vetoes = F.col("skip") + F.col("wrong_vibe") + F.col("manual")
    return F.try_divide(vetoes, vetoes + F.col("played_through"))


def signal_records(df: DataFrame) -> DataFrame:
    """Records a rulebook cell fired for, with both signals and all four cuts."""
    return df.filter(~col.is_guard("cell")).dropna(subset=["valence", "arousal", *C.BAND_CUTS])


def _signal(cut: str) -> str:
    return cut.rsplit("_", 1)[0]


def _proximity(records: DataFrame, hit: Column, tol: float) -> DataFrame:
    near = {cut: F.count_if(hit & (F.abs(F.col(_signal(cut)) - F.col(cut)) <= tol)) for cut in C.BAND_CUTS}
    counts = signal_records(records).agg(*[e.alias(c) for c, e in near.items()])
    return counts.unpivot([], list(C.BAND_CUTS), "boundary", "near")


def boundary_proximity(annotations: DataFrame, tol: float = C.PROXIMITY) -> DataFrame:
    """Wrong calls within tol of each cut, against the record's own cuts."""
    return _proximity(annotations, F.col("verdict") == "wrong", tol)


def veto_boundary_proximity(usable: DataFrame, tol: float = C.PROXIMITY) -> DataFrame:
    return _proximity(usable, F.col("action").isin("skip", "wrong_vibe"), tol)


def _best(stats: DataFrame, by: str, gain: str, loss: str, names: list[str]) -> DataFrame:
    """Per name the first shift with the strictly best positive score; nulls and zeros when none."""
    score = F.col(gain) - F.col(loss)
    pick = F.max_by(F.struct("shift", gain, loss), F.when(score > 0, F.struct(score, -F.col("ord"))))
    best = stats.groupBy(by).agg(pick.alias("_p"))
    zero = F.lit(0).cast("bigint")
    return best.select(by, F.col("_p.shift").alias("shift"), F.coalesce(f"_p.{gain}", zero).alias(gain),
                       F.coalesce(f"_p.{loss}", zero).alias(loss))


def _stack(counts: DataFrame, rows: list[tuple[str, float, int, str, str]], by: str, gain: str, loss: str) -> DataFrame:
    """One wide row of sums -> one row per (name, shift)."""
    items = F.array(*[F.struct(F.lit(n).alias(by), F.lit(s).alias("shift"), F.lit(o).alias("ord"),
                               F.col(g).alias(gain), F.col(x).alias(loss)) for n, s, o, g, x in rows])
    return counts.select(F.explode(items).alias("_i")).select("_i.*")


def boundary_shift_scores(records: DataFrame, shifts: tuple[float, ...] = C.SHIFTS) -> DataFrame:
    """Per cut and shift: wrong and good calls whose band would change. A record the shift would
    leave without a middle band is skipped; any verdict but wrong counts as good."""
    sums, rows = [], []
    for cut in C.BAND_CUTS:
        x, low, high = F.col(_signal(cut)), F.col(f"{_signal(cut)}_low"), F.col(f"{_signal(cut)}_high")
        for o, shift in enumerate(shifts):
            moved_low = low + shift if cut.endswith("_low") else low
            moved_high = high + shift if cut.endswith("_high") else high
            flips = (moved_low < moved_high) & (col.band(x, low, high) != col.band(x, moved_low, moved_high))
            wrong = F.col("verdict") == "wrong"
            sums += [F.count_if(flips & wrong).alias(f"w_{cut}_{o}"),
                     F.count_if(flips & ~F.coalesce(wrong, F.lit(False))).alias(f"g_{cut}_{o}")]
            rows.append((cut, shift, o, f"w_{cut}_{o}", f"g_{cut}_{o}"))
    return _stack(signal_records(records).agg(*sums), rows, "boundary", "wrong_flipped", "good_flipped")


def suggest_boundary_shifts(records: DataFrame) -> DataFrame:
    return _best(boundary_shift_scores(records), "boundary", "wrong_flipped", "good_flipped", list(C.BAND_CUTS))


def strong_labels_as_verdicts(usable: DataFrame) -> DataFrame:
    """Vetoes read as wrong, occupied completions as good; manual picks judge the replacement and drop out."""
    return usable.withColumn("verdict", col.strong_label_verdict("action")).filter("verdict IS NOT NULL")


def strong_label_shifts(usable: DataFrame) -> DataFrame:
    return suggest_boundary_shifts(strong_labels_as_verdicts(usable))


def manual_picks(usable: DataFrame) -> DataFrame:
    return usable.filter((F.col("action") == "manual") & F.col("chosen_tier").isin(*C.TIERS)
                         & F.col("target_arousal").isNotNull())


def tier_disagreement(usable: DataFrame, low: float = C.TIER_LOW_MAX, high: float = C.TIER_HIGH_MIN) -> DataFrame:
    """Chosen tier of manual picks against the derived one: higher / lower / same counts."""
    derived = col.derive_tier("target_arousal", F.coalesce("energy_action", F.lit("hold")), F.lit(low), F.lit(high))
    diff = col.tier_rank("chosen_tier") - col.tier_rank(derived)
    return manual_picks(usable).agg(F.count_if(diff > 0).alias("higher"), F.count_if(diff < 0).alias("lower"),
                                    F.count_if(diff == 0).alias("same"))


def suggest_tier_cutoffs(usable: DataFrame, low: float = C.TIER_LOW_MAX, high: float = C.TIER_HIGH_MIN,
                         shifts: tuple[float, ...] = C.SHIFTS) -> DataFrame:
    """Per cut-off the shift that gains the most manual-pick agreement; shifts that close the
    middle tier are not candidates."""
    action, chosen = F.coalesce("energy_action", F.lit("hold")), F.col("chosen_tier")
    before = col.derive_tier("target_arousal", action, F.lit(low), F.lit(high)) == chosen
    sums, rows = [], []
    for name in ("tier_low_max", "tier_high_min"):
        for o, shift in enumerate(shifts):
            moved = (low + shift, high) if name == "tier_low_max" else (low, high + shift)
            if moved[0] >= moved[1]:
                continue
            after = col.derive_tier("target_arousal", action, F.lit(moved[0]), F.lit(moved[1])) == chosen
            sums += [F.count_if(~before & after).alias(f"g_{name}_{o}"), F.count_if(before & ~after).alias(f"l_{name}_{o}")]
            rows.append((name, shift, o, f"g_{name}_{o}", f"l_{name}_{o}"))
    counts = manual_picks(usable).agg(*sums)
    return _best(_stack(counts, rows, "cutoff", "agree_gained", "agree_lost"), "cutoff", "agree_gained", "agree_lost",
                 ["tier_low_max", "tier_high_min"])


def pool_weighting(usable: DataFrame) -> DataFrame:
    """Veto and completion counts per cell and selection genre; manual picks and unstamped records excluded."""
    cell = F.when(F.size("cell") > 0, F.col("cell")).otherwise(F.array(F.lit("?")))
    stamped = usable.filter(F.col("action").isin("skip", "wrong_vibe", "played_through") & (F.col("genre") != ""))
    counts = stamped.groupBy(cell.alias("cell"), "genre").agg(
        F.count_if(F.col("action") != "played_through").alias("veto"),
        F.count_if(F.col("action") == "played_through").alias("thru"))
    return counts.withColumn("rate", F.try_divide(F.col("veto"), F.col("veto") + F.col("thru")))


def gate_summary(gated: DataFrame) -> DataFrame:
    suspect = F.col("gate") == "suspect"
    return gated.agg(
        F.count("*").alias("records"), *[F.count_if(F.col("action") == a).alias(a) for a in C.ACTIONS],
        F.count_if(suspect & (F.col("basis") != "unknown")).alias("empty_room"),
        F.count_if(suspect & (F.col("basis") == "unknown")).alias("unknown_presence"),
        F.count_if(F.col("gate") == "blind").alias("blind"), F.count_if(F.col("gate") == "usable").alias("usable"))


def session_counts(records: DataFrame, label: str) -> DataFrame:
    """Records per UTC day and action / verdict, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86_400).cast("int")).cast("string")
    return records.groupBy(day.alias("day"), label) \
        .agg(F.count("*").alias("records"))


def sorted_report(by_cell: DataFrame) -> DataFrame:
    """Cells in report order: element by element, shorter first."""
    return by_cell.orderBy("cell")
