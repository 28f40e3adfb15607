"""Running computations that split a key's history into time slabs.

A window over a whole key puts that key into one task, however long its
history. Here rows are hashed by (key, slab), where a slab is a stretch of event
time holding a bounded number of rows; each slab is computed on its own and only
one summary row per slab travels between them. Window and range frames that look
back a fixed horizon take copies of the previous slab's tail instead.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

SLAB = "_slab"
ROWS_PER_SLAB = 500_000


def fit_slab(df: DataFrame, keys: list[str], t: str, rows: int = ROWS_PER_SLAB) -> float:
    """Slab width (seconds) that keeps the densest stretch of any key near `rows` rows.

    One column-pruned counting job: the densest 1/4096th of the time span decides.
    """
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    if lo is None or hi <= lo:
        return 1.0
    probe = (hi - lo) / 4096
    densest = (df.groupBy(*keys, F.floor(F.col(t) / probe).alias("_p")).count()
               .agg(F.max("count")).first()[0])
    return min(hi - lo, probe * rows / densest)


def add_slab(df: DataFrame, t: str, slab_s: float) -> DataFrame:
    return df.withColumn(SLAB, F.floor(F.col(t) / F.lit(float(slab_s))).cast("bigint"))


def with_halo(df: DataFrame, t: str, slab_s: float, horizon_s: float) -> DataFrame:
    """Rows plus, for each later slab whose rows look back onto them, a copy with `_halo` set.

    Slabs are at least as wide as the horizon, so a row is copied at most twice.
    """
    width = max(float(slab_s), horizon_s + 1e-3)
    home = F.floor(F.col(t) / width).cast("bigint")
    last = F.floor((F.col(t) + horizon_s + 1e-3) / width).cast("bigint")
    return (df.withColumn("_home", home).withColumn(SLAB, F.explode(F.sequence("_home", last)))
            .withColumn("_halo", F.col(SLAB) != F.col("_home")).drop("_home"))


def lookback(keys: list[str], t: str, horizon_s: float):
    """Window over a key's slab (with halo) reaching horizon_s back from each row."""
    part = Window.partitionBy(*keys, SLAB)
    if float(horizon_s).is_integer():
        return part.orderBy(t).rangeBetween(-int(horizon_s), 0)
    return part.orderBy(F.col(t) / horizon_s).rangeBetween(-1, 0)  # frames take whole numbers only


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column
    n: int = 1


def last_known(value: Column) -> Running:
    """Newest non-null value at or before the row."""
    return Running("last", value)


def last_before(value: Column) -> Running:
    """Newest non-null value strictly before the row."""
    return Running("last_before", value)


def lagged(value: Column, n: int = 1) -> Running:
    """The value n rows back (null where there are fewer)."""
    return Running("lag", value, n)


def previous(value: Column) -> Running:
    return lagged(value, 1)


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def row_rank() -> Running:
    return Running("sum", F.lit(1).cast("bigint"))


def tail(value: Column, n: int) -> Running:
    """The last n values up to this row, newest last."""
    return Running("tail", value, n)


def running(df: DataFrame, keys: list[str], order: list[str], slab_s: float,
            **specs: Running) -> DataFrame:
    """Add running columns per key in `order` (event time first, ties broken by the rest)."""
    v = {name: f"_v_{name}" for name in specs}
    base = add_slab(df.select("*", *[s.value.alias(v[n]) for n, s in specs.items()]), order[0], slab_s)
    part = [*keys, SLAB]
    w = Window.partitionBy(*part).orderBy(*order)
    first = Window.unboundedPreceding
    over_slabs = Window.partitionBy(*keys).orderBy(SLAB)
    before = over_slabs.rowsBetween(first, -1)
    at = F.struct(*order)
    backward = {n: s for n, s in specs.items() if s.kind in ("lag", "tail")}

    local, partial, carry, merged = {}, {}, {}, {}
    if backward:
        local["_rn"] = F.row_number().over(w)
    for name, s in specs.items():
        x, lo, pa, ca = F.col(v[name]), f"_l_{name}", f"_p_{name}", f"_c_{name}"
        if s.kind in ("last", "last_before"):
            local[lo] = F.last(x, ignorenulls=True).over(w.rowsBetween(first, 0 if s.kind == "last" else -1))
            partial[pa] = F.max_by(x, F.when(x.isNotNull(), at))
            carry[ca] = F.last(pa, ignorenulls=True).over(before)
            merged[name] = F.coalesce(F.col(lo), F.col(ca))
        elif s.kind == "sum":
            local[lo] = F.sum(x).over(w.rowsBetween(first, 0))
            partial[pa] = F.sum(x)
            carry[ca] = F.sum(pa).over(before)
            both = F.coalesce(F.col(lo), F.lit(0)) + F.coalesce(F.col(ca), F.lit(0))
            merged[name] = F.when(F.col(lo).isNotNull() | F.col(ca).isNotNull(), both)
        else:
            # What came before the slab: the ends of up to n earlier slabs, newest last.
            carry[ca] = F.flatten(F.collect_list(pa).over(over_slabs.rowsBetween(-s.n, -1)))
            if s.kind == "lag":
                local[lo] = F.lag(F.struct(x.alias("v")), s.n).over(w)
                back = F.try_element_at(F.col(ca), (F.col("_rn") - s.n - 1).cast("int"))
                merged[name] = F.coalesce(F.col(lo), F.when(F.col("_rn") <= s.n, back))["v"]
            else:
                local[lo] = F.collect_list(F.struct(x.alias("v"))).over(w.rowsBetween(1 - s.n, 0))
                both = F.concat(F.coalesce(F.col(ca), F.slice(lo, 1, 0)), F.col(lo))
                kept = F.slice(both, F.greatest(F.size(both) - s.n + 1, F.lit(1)), F.lit(s.n))
                merged[name] = F.transform(kept, lambda e: e["v"])
    summary = None
    if partial:
        summary = base.groupBy(*part).agg(*[e.alias(n) for n, e in partial.items()])
    if backward:
        newest = Window.partitionBy(*part).orderBy(*[F.col(o).desc() for o in order])
        ends = (base.select(*part, *[v[n] for n in backward], F.row_number().over(newest).alias("_r"))
                .filter(F.col("_r") <= max(s.n for s in backward.values())))
        ends = ends.groupBy(*part).agg(*[
            F.array_sort(F.collect_list(F.when(F.col("_r") <= s.n, F.struct(
                (-F.col("_r")).alias("r"), F.struct(F.col(v[n]).alias("v")).alias("e"))))).alias(f"_p_{n}")
            for n, s in backward.items()])
        ends = ends.withColumns({f"_p_{n}": F.transform(f"_p_{n}", lambda e: e["e"]) for n in backward})
        summary = ends if summary is None else summary.join(ends, part)
    summary = summary.withColumns(carry).select(*part, *carry)
    return (base.withColumns(local).join(summary, part, "left")
            .withColumns(merged).drop(SLAB, *v.values(), *local, *carry))


_SPAN = 300.0  # exponent range of one block; two of them still fit a double


def decayed_sum(df: DataFrame, part: list[str], order: list[str], step: str, inputs: dict[str, str],
                clock: str = "_L") -> DataFrame:
    """y = exp(-step) * y_before + input in row order, by running sums alone.

    The summed steps are a clock (kept as `clock`). Inputs are summed relative to the start
    of their block of `_SPAN` clock units plus what the preceding block left; anything older
    has decayed by at least exp(-_SPAN) and cannot change a double.
    """
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = (df.withColumn(clock, F.sum(step).over(upto))
          .withColumn("_blk", F.floor(F.col(clock) / _SPAN).cast("bigint")))
    inside = (Window.partitionBy(*part, "_blk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    block_before = Window.partitionBy(*part).orderBy("_blk").rangeBetween(-1, -1)
    rel = F.col(clock) - _SPAN * F.col("_blk")
    near = {f"_n_{y}": F.sum(F.col(x) * F.exp(rel)).over(inside) for y, x in inputs.items()}
    far = {f"_f_{y}": F.sum(F.col(x) * F.exp(rel - _SPAN)).over(block_before) for y, x in inputs.items()}
    out = {y: F.exp(-rel) * (F.col(f"_n_{y}") + F.coalesce(F.col(f"_f_{y}"), F.lit(0.0))) for y in inputs}
    return df.withColumns(near).withColumns(far).withColumns(out).drop("_blk", *near, *far)


def linear_scan(df: DataFrame, keys: list[str], order: list[str], slab_s: float, step: Column,
                **inputs: Column) -> DataFrame:
    """y = exp(-step) * y_before + input per key, for one or more inputs sharing the step.

    step >= 0; a step of RESET forgets everything before the row.
    """
    ys = {y: f"_b_{y}" for y in inputs}
    base = add_slab(df.select("*", step.alias("_step"), *[b.alias(ys[y]) for y, b in inputs.items()]),
                    order[0], slab_s)
    part = [*keys, SLAB]
    local = decayed_sum(base, part, order, "_step", {f"_y_{y}": b for y, b in ys.items()})
    at = F.struct(*order)
    summary = local.groupBy(*part).agg(F.max_by("_L", at).alias("_LS"),
                                       *[F.max_by(f"_y_{y}", at).alias(f"_e_{y}") for y in inputs])
    ends = decayed_sum(summary.withColumnRenamed("_LS", "_step"), keys, [SLAB], "_step",
                        {f"_z_{y}": f"_e_{y}" for y in inputs})
    before = Window.partitionBy(*keys).orderBy(SLAB)
    ends = ends.select(*part, *[F.lag(f"_z_{y}").over(before).alias(f"_in_{y}") for y in inputs])
    merged = {y: F.col(f"_y_{y}") + F.exp(-F.col("_L")) * F.coalesce(F.col(f"_in_{y}"), F.lit(0.0))
              for y in inputs}
    return (local.join(ends, part, "left").withColumns(merged)
            .drop(SLAB, "_step", "_L", *ys.values(), *[f"_y_{y}" for y in inputs],
                  *[f"_in_{y}" for y in inputs]))


RESET = 3 * _SPAN  # whole blocks, so a value that was only reset and held stays bit-exact


def hashed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Hash by keys and sort within partitions, for a Python step.

    The session's number of shuffle partitions is stated outright: rows are few next to the work a Python step
    does for each, so merging small partitions would only idle cores."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def stage(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it back: the plan above
    starts afresh and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local master, where all are one process, gets a folder of its own if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{tempfile.mkdtemp(prefix='ambientspark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named
