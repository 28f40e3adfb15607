"""State to recommendation: bands, guard, lookup grid, trends, dwell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators.chains import emit_on_change
from ambientspark.operators.smoothing import va_trend

CELL = ["bucket", "vband", "aband"]


def rulebook(spark: SparkSession, overrides: dict[tuple[str, str, str], list[str]] | None = None) -> DataFrame:
    """The 108-row lookup grid; `overrides` replaces single cells."""
    rows = [(b, v, a, (overrides or {}).get((b, v, a), pool)) for b, v, a, pool in C.rulebook_rows()]
    return spark.createDataFrame(rows, "bucket string, vband string, aband string, pool array<string>")


def mapped_cells(items: DataFrame) -> DataFrame:
    """The (genre, tier) pairs that have a playlist, by genre, tiers from low to high."""
    tier = F.array_position(F.array(*[F.lit(t) for t in ("low", "mid", "high")]), F.col("tier"))
    return items.select("genre", "tier").distinct().orderBy("genre", tier)


def rulebook_lookup(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds the cell's pool. The seed grid is small enough that Spark broadcasts it by itself; a larger one it joins otherwise."""
    return df.join(grid, CELL, "left")


def _decided(states: DataFrame, slab_s: float, cuts: dict[str, float]) -> DataFrame:
    """States with the trends, guard reason, bands and energy action that a recommendation follows from."""
    df = va_trend(states, ["room_id"], "t", slab_s, horizon_s=cuts["trend_horizon_s"],
                  slope_per_min=cuts["trend_slope_threshold"])
    df = df.withColumns({
        "reason": col.guard_reason("speech_ratio", "mood", "valence", "arousal", "bucket", "headcount_confidence",
                                   cuts["min_speech_ratio"], cuts["min_headcount_confidence"]),
        "vband": col.band("valence", F.lit(cuts["valence_low"]), F.lit(cuts["valence_high"])),
        "aband": col.band("arousal", F.lit(cuts["arousal_low"]), F.lit(cuts["arousal_high"]))})
    direction = F.when(F.col("arousal_trend") != "stable", F.col("arousal_trend")).otherwise(F.col("trend"))
    return df.withColumn("energy_action", F.when(F.col("reason").isNotNull(), "hold").when(direction == "rising", "raise")
                         .when(direction == "falling", "lower").otherwise("hold"))


def _described(df: DataFrame, grid: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """What `_decided` rows recommend."""
    lead = cuts["target_lead"]
    df = rulebook_lookup(df, grid)
    guard, action = F.col("reason").isNotNull(), F.col("energy_action")
    v_lead = (F.when(guard | (F.col("valence_trend") == "stable"), 0.0)
              .when(F.col("valence_trend") == "rising", lead).otherwise(-lead))
    a_lead = F.when(action == "raise", lead).when(action == "lower", -lead).otherwise(0.0)
    zero = F.lit(0.0)
    v, a = F.coalesce("valence", zero), F.coalesce("arousal", zero)
    confidence = col.clamp01(0.5 * F.coalesce("emotion_confidence", zero) + 0.5 * F.coalesce("headcount_confidence", zero))
    pool = F.when(guard, F.array().cast("array<string>")).otherwise(F.col("pool"))
    summary = F.when(guard, F.concat(F.lit("insufficient signal ("), "reason", F.lit(") — hold current energy"))).otherwise(
        F.concat("mood", F.lit(" room, ~"), "bucket", F.lit(" people → "), F.array_join("pool", " / "), F.lit("; "),
                 action, F.lit(" energy")))
    return df.withColumns({
        "target_valence": col.round_even(F.when(guard, v).otherwise(col.clamp(v + v_lead)), 3),
        "target_arousal": col.round_even(F.when(guard, a).otherwise(col.clamp(a + a_lead)), 3),
        "genre_pool": pool,
        "confidence": F.when(guard, cuts["guard_confidence"]).otherwise(col.round_even(confidence, 2)),
        "summary": summary,
        "matched_cell": F.when(guard, F.array(F.lit("guard"), "reason")).otherwise(F.array("bucket", "vband", "aband")),
        "boundaries_snapshot": col.boundaries_snapshot(cuts),
    }).drop("vband", "aband", "pool", "reason", "valence_trend", "arousal_trend")


def candidates(states: DataFrame, grid: DataFrame, slab_s: float, cuts: dict[str, float] | None = None) -> DataFrame:
    """What each published state would recommend, before dwell: one row per state."""
    cuts = {**C.BOUNDARIES, **(cuts or {})}
    return _described(_decided(states, slab_s, cuts), grid, cuts)


def recommend(states: DataFrame, grid: DataFrame, slab_s: float, cuts: dict[str, float] | None = None) -> DataFrame:
    """Emitted recommendations: the first state, then only after the dwell and on a material change.

    Pools, texts and the boundaries' snapshot are added to what is emitted, so they do not travel with every state."""
    cuts = {**C.BOUNDARIES, **(cuts or {})}
    df = _decided(states, slab_s, cuts)
    signature = F.concat_ws("|", F.coalesce("mood", F.lit("-")), F.coalesce("bucket", F.lit("-")), "energy_action",
                            F.col("reason").isNotNull().cast("string"))
    return _described(emit_on_change(df, ["room_id"], ["t", "frame_id"], slab_s, signature, cuts["min_dwell_s"]), grid, cuts)


def adjacency(grid: DataFrame) -> DataFrame:
    """Per cell, the genres one band step away (arousal up, down, then valence up, down), first seen first.

    Neighbours that the grid does not have add nothing."""
    def up(band):
        return F.when(F.col(band) == "low", "mid").when(F.col(band) == "mid", "high")

    def down(band):
        return F.when(F.col(band) == "high", "mid").when(F.col(band) == "mid", "low")

    steps = [(F.col("vband"), up("aband")), (F.col("vband"), down("aband")), (up("vband"), F.col("aband")), (down("vband"), F.col("aband"))]
    near = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v"), a.alias("a")) for i, (v, a) in enumerate(steps)])
    asked = grid.select(*CELL, F.explode(near).alias("s")).select(*CELL, "s.*")
    other = grid.select(F.col("bucket").alias("_b"), F.col("vband").alias("_v"), F.col("aband").alias("_a"), F.col("pool").alias("_p"))
    found = asked.join(other, (F.col("bucket") == F.col("_b")) & (F.col("v") == F.col("_v")) & (F.col("a") == F.col("_a")), "left")
    pools = F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("i", F.col("_p").alias("p")))))  # at most four
    return found.groupBy(*CELL).agg(F.array_distinct(F.flatten(F.transform(pools, lambda x: x["p"]))).alias("near"))


def adjacent_pool(recs: DataFrame, near: DataFrame, out: str = "adjacent_pool") -> DataFrame:
    """Genres to resample from after a vetoed selection; empty for guard and unknown cells."""
    cell = F.col("matched_cell")
    keyed = recs.withColumns({c: F.when(F.size(cell) == 3, F.get(cell, F.lit(i))) for i, c in enumerate(["_b", "_v", "_a"])})
    n = near.select(F.col("bucket").alias("_b"), F.col("vband").alias("_v"), F.col("aband").alias("_a"), "near")
    joined = keyed.join(n, ["_b", "_v", "_a"], "left")
    pool = F.array_except(F.coalesce("near", F.array().cast("array<string>")),
                          F.coalesce("genre_pool", F.array().cast("array<string>")))
    return joined.withColumn(out, pool).drop("_b", "_v", "_a", "near")
