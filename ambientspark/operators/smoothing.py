"""Smoothing, trends, hysteresis and streaks over ticks of many rooms."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators.slabs import (RESET, SLAB, add_slab, decayed_sum, hashed, last_known, linear_scan, lookback, row_rank,
                                          running, running_sum, tail, with_halo)


@dataclass(frozen=True)
class Average:
    """Averages sharing a time constant and a gate. `fed_at` names a column for the time last fed."""
    tau_s: float
    values: dict[str, Column]
    where: Column | None = None
    fed_at: str | None = None


def averages(df: DataFrame, keys: list[str], order: list[str], slab_s: float, *groups: Average) -> DataFrame:
    """Time-aware exponential averages: the first fed value passes through, then
    alpha = 1 - exp(-max(1e-6, dt) / tau). Only rows with every value of the group present (and
    its gate open) feed it; the others carry the held value.

    Within a slab everything is relative to the slab's first fed row; that row's own value
    needs what the earlier slabs left, which one summary row per slab brings.
    """
    t = order[0]
    part = [*keys, SLAB]
    df = add_slab(df, t, slab_s)
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    made, aggs, summary_cols = [], [], {}
    for i, g in enumerate(groups):
        fed = F.lit(True) if g.where is None else F.coalesce(g.where, F.lit(False))
        for x in g.values.values():
            fed = fed & x.isNotNull()
        f, lt, st, clock = f"_fed{i}", f"_lt{i}", f"_st{i}", f"_L{i}"
        df = df.withColumn(f, fed)
        fed_t = F.when(F.col(f), F.col(t))
        df = df.withColumns({lt: F.last(fed_t, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                             f"_t1{i}": F.first(fed_t, True).over(upto)})
        later = F.col(f) & F.col(lt).isNotNull()
        df = df.withColumn(st, F.when(later, F.greatest(F.lit(1e-6), F.col(t) - F.col(lt)) / g.tau_s).otherwise(0.0))
        gain = 1.0 - F.exp(-F.col(st))
        df = df.withColumns({f"_b_{n}": F.when(later, x * gain).otherwise(0.0) for n, x in g.values.items()})
        df = decayed_sum(df, part, order, st, {f"_y_{n}": f"_b_{n}" for n in g.values}, clock)
        df = df.withColumns({f"_x_{n}": F.first(F.when(F.col(f), x), True).over(upto) for n, x in g.values.items()})
        made += [f, lt, st, clock, f"_t1{i}", *[p + n for n in g.values for p in ("_b_", "_y_", "_x_")]]
        # Slab ends: first and last fed time, clock, and per value the local sum and first value.
        at = F.struct(*order)
        aggs += [F.min(fed_t).alias(f"_s1{i}"), F.max(fed_t).alias(f"_s2{i}"), F.max(clock).alias(f"_sL{i}")]
        aggs += [F.max_by(p + n, at).alias("_s" + p + n) for n in g.values for p in ("_y_", "_x_")]
    ends = df.groupBy(*part).agg(*aggs)
    over = Window.partitionBy(*keys).orderBy(SLAB)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for i, g in enumerate(groups):
        t_in, step = f"_tin{i}", f"_step{i}"
        ends = ends.withColumn(t_in, F.last(f"_s2{i}", True).over(before))
        any_fed, first = F.col(f"_s1{i}").isNotNull(), F.col(t_in).isNull()
        gap = F.greatest(F.lit(1e-6), F.col(f"_s1{i}") - F.col(t_in)) / g.tau_s
        ends = ends.withColumn(step, F.when(~any_fed, 0.0).when(first, RESET).otherwise(gap + F.col(f"_sL{i}")))
        share = F.exp(-F.col(f"_sL{i}")) * F.when(first, 1.0).otherwise(1.0 - F.exp(-gap))
        ends = ends.withColumns({f"_e_{n}": F.when(any_fed, share * F.col(f"_s_x_{n}") + F.col(f"_s_y_{n}")).otherwise(0.0)
                                 for n in g.values})
        ends = decayed_sum(ends, keys, [SLAB], step, {f"_z_{n}": f"_e_{n}" for n in g.values}, f"_cl{i}")
        summary_cols[t_in] = F.col(t_in)
        keep = F.exp(-F.greatest(F.lit(1e-6), F.col(f"_t1{i}") - F.col(t_in)) / g.tau_s)
        for n in g.values:
            y_in, x1 = f"_in_{n}", F.col(f"_x_{n}")
            summary_cols[y_in] = F.when(F.col(t_in).isNotNull(), F.lag(f"_z_{n}").over(over))
            y1 = F.when(F.col(t_in).isNull(), x1).otherwise(keep * F.col(y_in) + (1.0 - keep) * x1)
            out[n] = F.when(x1.isNull(), F.col(y_in)).otherwise(F.exp(-F.col(f"_L{i}")) * y1 + F.col(f"_y_{n}"))
        if g.fed_at:
            now = F.when(F.col(f"_fed{i}"), F.col(t))
            out[g.fed_at] = F.coalesce(now, F.col(f"_lt{i}"), F.col(t_in))
    ends = ends.select(*part, *[e.alias(c) for c, e in summary_cols.items()])
    return df.join(ends, part, "left").withColumns(out).drop(SLAB, *made, *summary_cols)


def ema(df: DataFrame, keys: list[str], order: list[str], slab_s: float, tau_s: float,
        where: Column | None = None, fed_at: str | None = None, **values: Column) -> DataFrame:
    """One group of `averages`."""
    return averages(df, keys, order, slab_s, Average(tau_s, values, where, fed_at))


def running_signature(df: DataFrame, keys: list[str], order: list[str], slab_s: float, refs: str,
                      where: Column, horizon: int = C.SIGNATURE_HORIZON, **values: Column) -> DataFrame:
    """Adaptive mean with alpha = 1 / min(n, horizon) over qualifying rows, held elsewhere.

    Adds `refs` (samples so far) and one mean per value; means are 0 before any sample."""
    df = df.withColumn("_fed", F.coalesce(where, F.lit(False)))
    df = running(df, keys, order, slab_s, **{refs: running_sum(F.col("_fed").cast("bigint"))})
    n = F.least(F.col(refs), F.lit(horizon)).cast("double")
    step = (F.when(~F.col("_fed"), 0.0).when(F.col(refs) == 1, RESET).otherwise(-F.log(1.0 - 1.0 / n)))
    out = linear_scan(df, keys, order, slab_s, step,
                      **{v: F.when(F.col("_fed"), x / n).otherwise(0.0) for v, x in values.items()})
    return out.drop("_fed")


def trend(df: DataFrame, keys: list[str], t: str, slab_s: float, horizon_s: float = C.TREND_HORIZON_S,
          slope_per_min: float = C.TREND_SLOPE_PER_MIN, **values: Column) -> DataFrame:
    """rising / falling / stable per value: least-squares slope over the horizon, stable with
    fewer than 5 points or less than 15 s of them, and on rows without the value.

    A row costs the same however many rows its horizon holds (`window_slopes`)."""
    import pyarrow as pa
    given = {name: f"_v_{name}" for name in values}
    part = [*keys, SLAB]
    halo = with_halo(df.select("*", *[x.cast("double").alias(given[n]) for n, x in values.items()]), t, slab_s, horizon_s)
    schema = df.withColumns({n: F.lit("") for n in values}).schema
    # as a frame of Spark's: whole horizons are taken off the time itself, others off the time in horizons
    unit, reach = (1.0, float(horizon_s)) if float(horizon_s).is_integer() else (horizon_s, 1.0)

    def found(batches):
        for table, edges in _whole_slabs(batches, part):
            at = table.column(t).to_numpy().astype(float)
            u = at / unit
            start = np.concatenate([lo + np.searchsorted(u[lo:hi], u[lo:hi] - reach) for lo, hi in zip(edges, edges[1:])])
            new = np.append(u[1:] != u[:-1], True)
            new[edges[1:] - 1] = True
            last = np.flatnonzero(new)  # rows of one time see each other
            end = last[np.searchsorted(last, np.arange(len(u)))]
            made = {}
            for name, column in given.items():
                x = table.column(column)
                known = x.is_valid().to_numpy()
                n, since, slope = window_slopes(at, x.fill_null(0.0).to_numpy(), known, start, end)
                enough, slope = known & (n >= 5) & (at - since >= 15.0), slope * 60.0
                up, down = (slope > slope_per_min) | np.isnan(slope), slope < -slope_per_min
                made[name] = pa.array(np.where(enough & up, "rising", np.where(enough & down, "falling", "stable")).astype(object), pa.string())
            home = pa.array(~table.column("_halo").to_numpy())
            columns = [made[c] if c in made else table.column(c) for c in schema.names]
            yield from pa.table(columns, names=schema.names).filter(home).to_batches()

    return hashed(halo, part, [t]).mapInArrow(found, schema)


def _whole_slabs(batches, part):
    """(table, edges) pairs out of record batches sorted by slab: whole slabs only, slab i being rows edges[i]:edges[i + 1].
    Null keys are equal."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def cut(table):
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in part:
            column = table.column(c).combine_chunks()
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            new[1:] |= pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
            new[1:] |= here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    held: list = []  # batches of one slab, but for the last, which may hold the next ones' first rows
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held:
            pair = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
            starts = cut(pair)[1:] - 1
        else:
            starts = cut(pa.Table.from_batches([batch]))[1:]
        if not len(starts):
            held.append(batch)
            continue
        before = sum(b.num_rows for b in held)
        whole = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
        yield whole, np.unique(np.concatenate([[0], before + starts]))
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held), np.array([0, sum(b.num_rows for b in held)])


def window_slopes(t, x, known, start, end):
    """For rows start..end (both included) of each row, as far as x is known: how many, the first one's t, and the slope of x over t.

    start and end rise with the rows and hold the row itself. Rows are cut into blocks whose rows all look back to the block's first
    row and none beyond the block before, so a window is the end of one block and the beginning of the next. Both are running sums from that
    border, relative to what stands there: nothing is subtracted, and a row costs the same whatever its window holds."""
    rows = np.arange(len(t))
    firsts, at, looks = [], 0, start.tolist()
    while at < len(looks):
        firsts.append(at)
        at = bisect_right(looks, at, at)
    sizes = np.diff([*firsts, len(t)])
    own = np.repeat(firsts, sizes)
    border = np.repeat([*firsts[1:], firsts[-1]], sizes)  # of the last block's end no row asks
    next_known = np.minimum.accumulate(np.where(known, rows, len(t))[::-1])[::-1]
    level = np.append(x, 0.0)[next_known]  # any value near will do

    def sums(origin):
        dt, dx = np.where(known, t - t[origin], 0.0), np.where(known, x - level[origin], 0.0)
        return np.stack([known.astype(float), dt, dx, dt * dt, dt * dx])

    with np.errstate(all="ignore"):
        upto = _running(sums(own), rows - own)
        onward = _running(sums(border)[:, ::-1], (own + np.repeat(sizes, sizes) - 1 - rows)[::-1])[:, ::-1]
        n, st, sx, stt, stx = upto[:, end] + np.where(start < own, onward[:, start], 0.0)
        slope = (stx - st * sx / n) / (stt - st * st / n)
    return n, np.append(t, np.nan)[next_known[start]], slope


def _running(sums, nth):
    """Running sums of each row of `sums`, begun anew where nth is 0."""
    reach, longest = 1, int(nth.max())
    while reach <= longest:  # each sum reaches back over so many columns
        sums[:, reach:] += np.where(nth[reach:] >= reach, sums[:, :-reach], 0.0)
        reach *= 2
    return sums


def va_trend(df: DataFrame, keys: list[str], t: str, slab_s: float, v: str = "valence", a: str = "arousal",
             **kw) -> DataFrame:
    """Trends of valence and arousal over rows where both are present."""
    both = F.col(v).isNotNull() & F.col(a).isNotNull()
    return trend(df, keys, t, slab_s, valence_trend=F.when(both, F.col(v)),
                 arousal_trend=F.when(both, F.col(a)), **kw)


def hysteresis(df: DataFrame, keys: list[str], order: list[str], slab_s: float, candidate: Column,
               k: int = C.HOLD_K, out: str = "published") -> DataFrame:
    """The published value follows a candidate only once it was seen k times in a row."""
    df = running(df, keys, order, slab_s, _recent=tail(candidate, k), _n=row_rank())
    same = F.forall("_recent", lambda x: x.eqNullSafe(F.element_at("_recent", -1))) & (F.size("_recent") == k)
    df = df.withColumn("_settled", F.when((F.col("_n") == 1) | same, F.element_at("_recent", -1)))
    df = running(df, keys, order, slab_s, **{out: last_known(F.col("_settled"))})
    return df.drop("_recent", "_n", "_settled")


def bucket_smoother(df: DataFrame, keys: list[str], order: list[str], slab_s: float, log2: Column,
                    tau_s: float = C.TAU_BUCKET_S, k: int = C.HOLD_K) -> DataFrame:
    """Average in log2 space, nearest rung, hysteresis: smoothed_log2, rung, bucket."""
    df = ema(df, keys, order, slab_s, tau_s, smoothed_log2=log2)
    df = hysteresis(df, keys, order, slab_s, col.rung("smoothed_log2"), k, "rung")
    return df.withColumn("bucket", col.rung_label("rung"))


def streak(df: DataFrame, keys: list[str], order: list[str], slab_s: float, cond: Column,
           out: str = "streak") -> DataFrame:
    """Length of the run of true rows ending here (0 on a false row)."""
    df = running(df.withColumn("_hit", F.coalesce(cond, F.lit(False))), keys, order, slab_s, _n=row_rank())
    df = running(df, keys, order, slab_s, _broken=last_known(F.when(~F.col("_hit"), F.col("_n"))))
    return df.withColumn(out, F.col("_n") - F.coalesce("_broken", F.lit(0))).drop("_hit", "_n", "_broken")


def envelope_advisory(df: DataFrame, keys: list[str], order: list[str], slab_s: float, playing: str, floor: str,
                      loudness: str, speech: str, db: float = C.ADVISORY_DB, eps: float = C.ADVISORY_SPEECH,
                      hops: int = C.ADVISORY_HOPS, seed: Column | None = None) -> DataFrame:
    """Music out-reads the room: `hops` rows in a row that are loud over the quiet anchor and speechless.

    The anchor is the last floor seen while not playing; `seed` is one restored from an
    earlier session, and without either the live floor serves."""
    quiet = ~F.coalesce(F.col(playing), F.lit(False))
    df = running(df, keys, order, slab_s, anchor=last_known(F.when(quiet, F.col(floor))))
    start = F.lit(None).cast("double") if seed is None else seed
    ref = F.coalesce(F.col("anchor"), start, F.col(floor))
    blind = (~quiet & ref.isNotNull() & (F.coalesce(F.col(loudness), ref) - ref >= db)
             & (F.coalesce(F.col(speech), F.lit(1.0)) <= eps))
    return (streak(df, keys, order, slab_s, blind, "blind_streak")
            .withColumn("envelope_advisory", F.col("blind_streak") >= hops))


def recent_values(df: DataFrame, keys: list[str], order: list[str], slab_s: float, x: Column,
                  n: int = C.RECENT_RAW, out: str = "recent") -> DataFrame:
    return running(df, keys, order, slab_s, **{out: tail(x, n)})


def trail(df: DataFrame, keys: list[str], t: str, slab_s: float, horizon_s: float, *values: str,
          out: str = "trail") -> DataFrame:
    """Per row, the list of rows at most horizon_s old, oldest first."""
    halo = with_halo(df, t, slab_s, horizon_s)
    w = lookback(keys, t, horizon_s)
    listed = F.collect_list(F.struct(t, *values)).over(w)
    return halo.withColumn(out, listed).filter(~F.col("_halo")).drop("_halo", SLAB)


def history(df: DataFrame, keys: list[str], order: list[str], n: int = 300) -> DataFrame:
    """The newest n rows per key (ranking keeps only n per task before the shuffle)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def current_recommendation(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_last")).select(*keys, "_last.*")
