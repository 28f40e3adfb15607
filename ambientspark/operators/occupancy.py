"""Occupancy: rolling speaker evidence, clustering, count / crowd blend.

A buffer (one tick's evidence) holds at most BUFFER_CAP embeddings, so per-buffer work is
bounded; parallelism comes from the buffers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators.joins import asof_reading
from ambientspark.operators.slabs import SLAB, hashed, with_halo
from ambientspark.operators.smoothing import bucket_smoother, recent_values


def threshold_cluster(evidence: DataFrame, buffer: list[str], threshold: float = C.CLUSTER_THRESHOLD,
                      order: tuple[str, ...] = ("at", "evidence_id"), cap: int = C.BUFFER_CAP) -> DataFrame:
    """Average-linkage clusters per buffer over cosine distance, cut at the threshold; adds `label`.

    A buffer is its newest `cap` rows, as in a room: older ones have left it. (Each task keeps only these before the shuffle.)"""
    newest = Window.partitionBy(*buffer).orderBy(*[F.col(o).desc() for o in order])
    evidence = evidence.drop("label").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= cap).drop("_r")
    schema = StructType([*evidence.schema.fields, StructField("label", LongType())])

    def label(pdf):
        import numpy as np
        pdf = pdf.sort_values(list(order), kind="stable")
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        return pdf.assign(label=average_linkage(1.0 - np.clip(x @ x.T, -1.0, 1.0), threshold))

    return evidence.groupBy(*buffer).applyInPandas(label, schema)


def average_linkage(dist, threshold: float):
    """Merge the closest pair (first in row order on ties) until none is below the threshold.

    Labels number the clusters by their first member. Each row keeps its nearest neighbour, so a merge looks at one number per row and searches again
    only where the nearest was one of the two."""
    import numpy as np
    n = len(dist)
    gap = np.array(dist, dtype=float)
    np.fill_diagonal(gap, np.inf)
    size, owner = np.ones(n), np.arange(n)
    near = gap.argmin(axis=1) if n else np.zeros(0, dtype=int)
    least = gap[np.arange(n), near]
    while n:
        a = int(least.argmin())
        if not least[a] < threshold:
            break
        b = int(near[a])  # a is the first row with this gap, so b is later
        joined = (size[a] * gap[a] + size[b] * gap[b]) / (size[a] + size[b])
        gap[a], gap[:, a] = joined, joined
        gap[a, a] = np.inf
        gap[b], gap[:, b] = np.inf, np.inf
        size[a] += size[b]
        owner[owner == b] = a
        least[b] = np.inf
        again = np.flatnonzero(((near == a) | (near == b)) & np.isfinite(least))
        near[again] = gap[again].argmin(axis=1)
        least[again] = gap[again, near[again]]
        near[a] = int(gap[a].argmin())
        least[a] = gap[a, near[a]]
        closer = (gap[:, a] < least) | ((gap[:, a] == least) & (a < near))
        closer[[a, b]] = False
        near[closer], least[closer] = a, gap[closer, a]
    return np.unique(owner, return_inverse=True)[1].astype("int64")


def cluster_mass(labelled: DataFrame, buffer: list[str], min_segments: int = C.MIN_CLUSTER_SEGMENTS,
                 min_s: float = C.MIN_CLUSTER_S, min_frac: float = C.MIN_CLUSTER_FRAC) -> DataFrame:
    """Per buffer: clusters heavy enough to count, stray share, evidence seconds."""
    per = labelled.groupBy(*buffer, "label").agg(F.count("*").alias("n"), F.sum("duration_s").alias("s"))
    total = per.groupBy(*buffer).agg(F.collect_list(F.struct("n", "s")).alias("cl"), F.sum("s").alias("evidence_s"),
                                     F.sum("n").alias("segments"))
    heavy = F.filter("cl", lambda c: ((c["n"] >= min_segments) | (c["s"] >= min_s))
                     & (c["s"] >= min_frac * F.col("evidence_s")))
    counted = F.aggregate(heavy, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    return total.select(
        *buffer, "segments", "evidence_s", F.size("cl").cast("bigint").alias("clusters"),
        F.greatest(F.size(heavy), F.lit(1)).cast("bigint").alias("raw_clusters"),
        (F.col("segments") - counted).alias("stray_segments"),
        ((F.col("segments") - counted) / F.col("segments")).alias("fragmentation"))


def _cluster_sums(labelled: DataFrame, buffer: list[str]) -> DataFrame:
    """One row per cluster with its vector sum; the mean cosine distance to it is then a dot product.

    Components are summed one by one, which every task does for its own rows first: no cluster's vectors come together."""
    part = [*buffer, "label"]
    one = labelled.select(*part, F.posexplode("embedding").alias("_i", "_x")).groupBy(*part, "_i").agg(
        F.sum(F.col("_x").cast("double")).alias("_s"), F.sum(F.col("_x").cast("double") * F.col("_x")).alias("_q"), F.count("*").alias("n"))
    parts = one.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.sum("_q").alias("self"), F.max("n").alias("n"))
    return parts.select(*part, "n", "self", F.transform("_v", lambda x: x["_s"]).alias("vsum"))


def separation_score(labelled: DataFrame, buffer: list[str]) -> DataFrame:
    """Mean silhouette per buffer from cluster vector sums: rows x clusters, never rows x rows."""
    sums = _cluster_sums(labelled, buffer)
    listed = sums.groupBy(*buffer).agg(F.collect_list(F.struct("label", "n", "vsum")).alias("cl"))
    rows = labelled.join(listed, buffer)
    own = F.get(F.filter("cl", lambda c: c["label"] == F.col("label")), F.lit(0))
    inside = 1.0 - (col.dot("embedding", own["vsum"]) - col.dot("embedding", "embedding")) / (own["n"] - 1)
    others = F.transform(F.filter("cl", lambda c: c["label"] != F.col("label")),
                         lambda c: 1.0 - col.dot(F.col("embedding"), c["vsum"]) / c["n"])
    rows = rows.select(*buffer, F.when(own["n"] > 1, inside).alias("a"), F.array_min(others).alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (top > 0), (F.col("b") - F.col("a")) / top)
    return (rows.withColumn("s", score).groupBy(*buffer)
            .agg(F.when(F.count("*") >= 3, F.coalesce(F.avg("s"), F.lit(0.0))).otherwise(0.0).alias("separation")))


def dispersion(labelled: DataFrame, buffer: list[str]) -> DataFrame:
    """Size-weighted mean within-cluster distance, in closed form from |vsum|^2."""
    sums = _cluster_sums(labelled, buffer)
    n = F.col("n")
    spread = (n * (n - 1) - (col.dot("vsum", "vsum") - F.col("self"))) / (n - 1)
    parts = sums.select(*buffer, F.when(n >= 2, spread).alias("total"), F.when(n >= 2, n).alias("weight"))
    return parts.groupBy(*buffer).agg(
        F.coalesce(F.try_divide(F.sum("total"), F.sum("weight")), F.lit(0.0)).alias("dispersion"))


def pairwise_cosine(evidence: DataFrame, buffer: list[str]) -> DataFrame:
    """Number of pairs and mean pairwise cosine distance per buffer, in O(n) from the vector sum."""
    sums = _cluster_sums(evidence.withColumn("label", F.lit(0)), buffer)
    n = F.col("n")
    mean = 1.0 - F.try_divide(col.dot("vsum", "vsum") - F.col("self"), n * (n - 1))
    return sums.select(*buffer, (n * (n - 1) / 2).cast("bigint").alias("pairs"), mean.alias("mean_distance"))


def loudness_term(loudness, floor, playing) -> Column:
    """Loudness over the floor while playback runs and a floor is known, else absolute."""
    relative = col.ramp(F.col(loudness) - F.col(floor), 3.0, 12.0)
    return F.when(F.col(playing) & F.col(floor).isNotNull(), relative).otherwise(col.ramp(loudness, -45.0, -20.0))


def crowd_estimate(df: DataFrame, threshold: float = C.CLUSTER_THRESHOLD) -> DataFrame:
    """From (raw_clusters, fragmentation, separation, dispersion, evidence_s) and the window's
    (speech_ratio, loudness_dbfs, noise_floor_dbfs, playback_active): crowd_weight,
    babble_log2, log2_count, confidence."""
    collapse = 1.0 - col.clamp01(F.col("separation") / 0.25)
    saturation = col.ramp("speech_ratio", 0.6, 0.95) * loudness_term("loudness_dbfs", "noise_floor_dbfs", "playback_active")
    smear = F.greatest(col.ramp("dispersion", 0.5 * threshold, threshold), col.ramp("fragmentation", 0.3, 0.8))
    pressure = col.ramp("raw_clusters", C.COUNT_RELIABLE, C.COUNT_CEILING)
    df = df.withColumns({
        "crowd_weight": col.clamp01(collapse * F.greatest(pressure, saturation * smear)),
        "babble_log2": 3.0 + 7.0 * col.clamp01("speech_ratio") * col.clamp01((F.col("loudness_dbfs") + 45.0) / 25.0)})
    w = F.col("crowd_weight")
    counted = F.least(F.lit(1.0), F.col("evidence_s") / 15.0) * col.clamp(0.4 + F.col("separation"), 0.2, 1.0)
    return df.withColumns({
        "log2_count": (1.0 - w) * F.log2("raw_clusters") + w * F.col("babble_log2"),
        "confidence": col.clamp01((1.0 - w) * counted + w * 0.25)})


def buffer_stats(evidence: DataFrame, buffer: list[str], threshold: float = C.CLUSTER_THRESHOLD, min_segments: int = C.MIN_CLUSTER_SEGMENTS,
                 min_s: float = C.MIN_CLUSTER_S, min_frac: float = C.MIN_CLUSTER_FRAC, order: tuple[str, ...] = ("at", "evidence_id")) -> DataFrame:
    """`threshold_cluster`, `cluster_mass`, `separation_score` and `dispersion` of capped buffers in one pass: one row per buffer."""
    fields = [f for f in evidence.schema.fields if f.name in buffer]
    ddl = ("segments long, evidence_s double, clusters long, raw_clusters long, stray_segments long, fragmentation double, "
           "separation double, dispersion double")
    schema = StructType([*fields, *StructType.fromDDL(ddl).fields])

    def stats(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.sort_values(list(order), kind="stable")
        found = buffer_numbers(np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["duration_s"].to_numpy(float), threshold, min_segments, min_s, min_frac)
        return pd.DataFrame([[*(pdf[f.name].iloc[0] for f in fields), *found]], columns=schema.names)

    return evidence.select(*buffer, *order, "duration_s", "embedding").groupBy(*buffer).applyInPandas(stats, schema)


def buffer_numbers(x, seconds, threshold: float = C.CLUSTER_THRESHOLD, min_segments: int = C.MIN_CLUSTER_SEGMENTS,
                   min_s: float = C.MIN_CLUSTER_S, min_frac: float = C.MIN_CLUSTER_FRAC) -> tuple:
    """(segments, evidence_s, clusters, raw_clusters, stray_segments, fragmentation, separation, dispersion) of one buffer: unit vectors in order and their seconds."""
    return product_numbers(x @ x.T, seconds, threshold, min_segments, min_s, min_frac)


def product_numbers(products, seconds, threshold: float = C.CLUSTER_THRESHOLD, min_segments: int = C.MIN_CLUSTER_SEGMENTS,
                    min_s: float = C.MIN_CLUSTER_S, min_frac: float = C.MIN_CLUSTER_FRAC) -> tuple:
    """`buffer_numbers` from the dot products of the vectors."""
    import numpy as np
    label = average_linkage(1.0 - np.clip(products, -1.0, 1.0), threshold)
    n, size, total = len(label), np.bincount(label), seconds.sum()
    mass = np.bincount(label, weights=seconds)
    heavy = ((size >= min_segments) | (mass >= min_s)) & (mass >= min_frac * total)
    own, dots = np.diagonal(products), products @ np.eye(len(size))[label]
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = 1.0 - (dots[np.arange(n), label] - own) / (size[label] - 1)
    away = 1.0 - dots / size
    away[np.arange(n), label] = np.inf
    near = away.min(axis=1)
    top = np.maximum(inside, near)
    told = (size[label] > 1) & np.isfinite(near) & (top > 0)
    separation = float(((near - inside)[told] / top[told]).mean()) if n >= 3 and told.any() else 0.0
    many = size >= 2
    spread = size * (size - 1.0) - np.bincount(label, weights=dots[np.arange(n), label] - own)
    dispersion_ = float((spread[many] / (size[many] - 1)).sum() / size[many].sum()) if many.any() else 0.0
    stray = int(n - size[heavy].sum())
    return n, float(total), len(size), max(int(heavy.sum()), 1), stray, stray / n, separation, dispersion_


class _Ring:
    """The newest evidence of one room: times, seconds, vectors and their dot products, in room for twice as many rows so that shifting is rare."""

    def __init__(self, cap: int, dim: int) -> None:
        import numpy as np
        self.cap, self.low, self.high = cap, 0, 0
        self.at, self.seconds = np.zeros(2 * cap), np.zeros(2 * cap)
        self.x, self.products = np.zeros((2 * cap, dim)), np.zeros((2 * cap, 2 * cap))

    def add(self, at: float, seconds: float, x) -> None:
        if self.high == 2 * self.cap:
            kept = slice(self.low, self.high)
            n = self.high - self.low
            self.at[:n], self.seconds[:n], self.x[:n] = self.at[kept].copy(), self.seconds[kept].copy(), self.x[kept].copy()
            self.products[:n, :n] = self.products[kept, kept].copy()
            self.low, self.high = 0, n
        k = self.high
        self.at[k], self.seconds[k], self.x[k] = at, seconds, x
        self.high = k + 1
        self.low = max(self.low, self.high - self.cap)
        row = self.x[self.low : self.high] @ x
        self.products[k, self.low : self.high] = row
        self.products[self.low : self.high, k] = row

    def since(self, at: float):
        """Products and seconds of what is left once all before `at` is gone."""
        while self.low < self.high and self.at[self.low] < at:
            self.low += 1
        kept = slice(self.low, self.high)
        return self.products[kept, kept], self.seconds[kept]


def rolling_stats(ticks: DataFrame, evidence: DataFrame, slab_s: float, horizon_s: float = C.BUFFER_S, cap: int = C.BUFFER_CAP,
                  threshold: float = C.CLUSTER_THRESHOLD) -> DataFrame:
    """room_id, frame_id and `buffer_stats` of each tick's rolling evidence: at most `cap` pieces no older than the horizon; no row without any.

    Each piece of evidence is shuffled once, and once more where the next slab looks back on it. A slab's rows stream through a ring of the newest
    pieces, which takes one row of dot products for each new one; a tick clusters what the ring holds."""
    import numpy as np
    import pyarrow as pa
    width = max(float(slab_s), horizon_s + 1e-3)  # as with_halo
    types = dict(ticks.dtypes)
    e = with_halo(evidence.select("room_id", F.col("at").cast("double").alias("t"), "evidence_id", F.col("duration_s").cast("double").alias("duration_s"), "embedding"), "t", slab_s, horizon_s)
    e = e.drop("_halo").withColumn("_tick", F.lit(0))
    k = ticks.select("room_id", "frame_id", F.col("t").cast("double").alias("t"), F.floor(F.col("t") / width).cast("bigint").alias(SLAB), F.lit(1).alias("_tick"))
    rows = hashed(e.unionByName(k, allowMissingColumns=True), ["room_id", SLAB], ["t", "_tick", "evidence_id", "frame_id"])
    numbers = "segments long, evidence_s double, clusters long, raw_clusters long, stray_segments long, fragmentation double, separation double, dispersion double"
    ddl = f"room_id {types['room_id']}, frame_id {types['frame_id']}, {numbers}"
    names = [f.strip().split()[0] for f in ddl.split(",")]

    def walk(batches):
        part = ring = None
        for batch in batches:
            room, slab, t, tick, seconds = (batch.column(c).to_pylist() for c in ("room_id", SLAB, "t", "_tick", "duration_s"))
            vectors, frames = batch.column("embedding"), batch.column("frame_id").to_pylist()
            out = []
            for i in range(batch.num_rows):
                if (room[i], slab[i]) != part:
                    part, ring = (room[i], slab[i]), None
                if not tick[i]:
                    x = np.asarray(vectors[i].values, dtype=float)
                    ring = ring or _Ring(cap, len(x))
                    ring.add(t[i], seconds[i], x)
                elif ring is not None:
                    products, held = ring.since(t[i] - horizon_s)
                    if len(held):
                        out.append((room[i], frames[i], *product_numbers(products, held, threshold)))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return rows.mapInArrow(walk, ddl)


def headcount_estimate(ticks: DataFrame, evidence: DataFrame, slab_s: float, horizon_s: float = C.BUFFER_S,
                       cap: int = C.BUFFER_CAP) -> DataFrame:
    """Occupancy estimate per certified tick from its rolling evidence; ticks without evidence yield no row."""
    return crowd_estimate(ticks.join(rolling_stats(ticks, evidence, slab_s, horizon_s, cap), ["room_id", "frame_id"]))


def headcount_series(ticks: DataFrame, estimates: DataFrame, slab_s: float) -> DataFrame:
    """Bucket held on every tick: estimates smoothed and debounced, then carried forward with their age."""
    e = bucket_smoother(estimates, ["room_id"], ["t", "frame_id"], slab_s, F.col("log2_count"))
    e = recent_values(e, ["room_id"], ["t", "frame_id"], slab_s, F.col("log2_count"), out="recent_raw_log2")
    e = e.withColumnRenamed("t", "at").withColumnRenamed("confidence", "headcount_confidence")
    cols = ["bucket", "headcount_confidence", "smoothed_log2", "crowd_weight", "raw_clusters", "dispersion",
            "fragmentation", "recent_raw_log2"]
    held = asof_reading(ticks, e, ["room_id"], slab_s, cols, reading_id="frame_id")
    return held.withColumnRenamed("staleness_s", "headcount_staleness_s").drop("at")
