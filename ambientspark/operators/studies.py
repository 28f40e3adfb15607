"""Protocol studies over frames: phase summaries, phase deltas, latency ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ambientspark.functions import columns as col


def phase_summary(labelled: DataFrame, by: list[str] = ("phase",)) -> DataFrame:
    """Per phase: frames, mean valence / arousal, ranges of bucket rung, speech, level and staleness."""
    return labelled.groupBy(*by).agg(
        F.count("*").alias("frames"), F.avg("valence").alias("mean_valence"), F.avg("arousal").alias("mean_arousal"),
        F.min("rung").alias("min_rung"), F.max("rung").alias("max_rung"),
        F.min("speech_ratio").alias("min_speech"), F.max("speech_ratio").alias("max_speech"),
        F.min("loudness_dbfs").alias("min_dbfs"), F.max("loudness_dbfs").alias("max_dbfs"),
        F.min("staleness_s").alias("min_staleness"), F.max("staleness_s").alias("max_staleness"))


MOODS = ("excited", "tense", "chill", "flat")


def phase_delta(labelled: DataFrame, control: str, treatment: str, positive: str, limit: float = 0.2) -> DataFrame:
    """Shift of mean valence / arousal from control to treatment, share of treatment frames in
    another mood quadrant than the control mean, whether both shifts stay under the limit, and
    how far the positive control still separates from the treatment."""
    def mean(signal, phase):
        return F.avg(F.when(F.col("phase") == phase, F.col(signal)))
    treated = F.col("phase") == treatment
    mood = col.mood_quadrant("valence", "arousal")
    means = labelled.agg(*[mean(s, p).alias(f"{s[0]}_{i}") for s in ("valence", "arousal")
                           for i, p in enumerate((control, treatment, positive))],
                         F.count_if(treated & mood.isNotNull()).alias("total"),
                         *[F.count_if(treated & (mood == m)).alias(m) for m in MOODS])
    dv, da = F.col("v_1") - F.col("v_0"), F.col("a_1") - F.col("a_0")
    usual = col.mood_quadrant("v_0", "a_0")
    same = F.coalesce(*[F.when(usual == m, F.col(m)) for m in MOODS], F.lit(0))
    return means.select(
        dv.alias("delta_valence"), da.alias("delta_arousal"),
        (1.0 - F.try_divide(same, F.col("total"))).alias("mood_flip_share"),
        ((F.abs(dv) < limit) & (F.abs(da) < limit)).alias("passed"),
        (F.col("a_2") - F.col("a_1")).alias("positive_separation"))


def latency_report(timings: DataFrame, by: list[str], value: str, budget: float, buckets: int = 4096) -> DataFrame:
    """Mean, the p95 element of the sorted timings (0-based rank max(0, int(0.95 n) - 1)), and the verdict.

    A histogram of partial counts finds the bucket holding that rank; only this bucket's rows
    are ordered, so a group with most of the rows is never sorted or gathered as a whole."""
    stats = timings.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    stats = stats.withColumn("target", F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(0.95)).cast("bigint") - 1))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (buckets - 1))).otherwise(0)
    placed = timings.select(*by, value).filter(F.col(value).isNotNull()).join(stats.select(*by, "lo", "hi"), by) \
        .select(*by, value, place.cast("bigint").alias("_b"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("_b"))
    hist = placed.groupBy(*by, "_b").agg(F.count("*").alias("c")).withColumn("upto", upto).join(stats, by)
    hit = hist.filter((F.col("upto") > F.col("target")) & (F.col("upto") - F.col("c") <= F.col("target"))) \
        .withColumn("skip", F.col("target") - F.col("upto") + F.col("c"))
    inside = placed.join(hit.select(*by, "_b", "skip"), [*by, "_b"]).groupBy(*by, "skip", value).agg(F.count("*").alias("c"))
    ranked = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(value)))
    p95 = ranked.filter(F.col("upto") > F.col("skip")).groupBy(*by).agg(F.min(value).alias("p95"))
    return stats.join(p95, by).select(*by, "n", "mean", "p95", (F.col("p95") < budget).alias("within_budget"))
