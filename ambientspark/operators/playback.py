"""Playback analytics: track boundaries, completions, candidate pools, picks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators.fold import recent_k, scan
from ambientspark.operators.joins import asof
from ambientspark.operators.slabs import lagged, running, stage

ROOM, OBS = ["room_id"], ["t", "obs_id"]


def track_boundaries(obs: DataFrame, slab_s: float) -> DataFrame:
    """Observations at which the previous track ended: another id, or playback vanished.

    A row with a null track_id is an observation of nothing playing. Adds prev_* columns."""
    before = F.struct("track_id", "progress_s", "duration_s", "t", "obs_id")
    df = running(obs, ROOM, OBS, slab_s, _p=lagged(before))
    df = df.filter(F.col("_p.track_id").isNotNull() & ~F.col("_p.track_id").eqNullSafe(F.col("track_id")))
    return df.select(*obs.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}")
                                     for c in ("track_id", "progress_s", "duration_s", "t", "obs_id")])


def completed(lead_s: float = C.QUEUE_LEAD_S) -> Column:
    return col.near_end("prev_progress_s", "prev_duration_s", lead_s)


def vanished_tracks(obs: DataFrame, slab_s: float, lead_s: float = C.QUEUE_LEAD_S) -> DataFrame:
    """Boundaries far from the previous track's end: it never completed."""
    return track_boundaries(obs, slab_s).filter(~completed(lead_s))


def unvetoed_completions(ended: DataFrame, selections: DataFrame, vetoes: DataFrame, slab_s: float,
                         keep_selected: int = C.ATTRIBUTION_KEEP, keep_vetoed: int = C.OVERRIDDEN_KEEP) -> DataFrame:
    """Ended tracks still attributed to a selection and not overridden, by the capped memories of both."""
    chosen = stage(recent_k(selections, ROOM, ["t", "pick_id"], slab_s, "track_id", keep_selected))
    vetoed = stage(recent_k(vetoes, ROOM, ["t", "veto_id"], slab_s, "track_id", keep_vetoed))
    df = asof(stage(ended), chosen.withColumnRenamed("live", "chosen_ids"), ROOM, "t", "t", slab_s, ["chosen_ids"],
              right_id="pick_id").drop("at")
    df = asof(df, vetoed.withColumnRenamed("live", "vetoed_ids"), ROOM, "t", "t", slab_s, ["vetoed_ids"],
              right_id="veto_id").drop("at")
    def holds(ids):
        return F.coalesce(F.array_contains(ids, F.col("prev_track_id")), F.lit(False))
    return df.filter(holds("chosen_ids") & ~holds("vetoed_ids")).drop("chosen_ids", "vetoed_ids")


def played_through(obs: DataFrame, selections: DataFrame, vetoes: DataFrame, slab_s: float,
                   lead_s: float = C.QUEUE_LEAD_S) -> DataFrame:
    """Boundary, near the previous track's end, attributed and not overridden: an implicit positive."""
    ended = track_boundaries(obs, slab_s).filter(completed(lead_s))
    return unvetoed_completions(ended, selections, vetoes, slab_s)


def playlist_items(tracks: DataFrame) -> DataFrame:
    """Every track with its number, from 0, among the tracks of its (genre, tier): genre, tier, number, track_id.

    Numbers follow the id's MD5, then the id, so the track of any one number is a uniform pick. A pair with very many tracks is
    numbered in 256 parts, each from the sizes of the parts before it."""
    digest = F.md5(F.col("track_id").cast("string"))
    keyed = tracks.select("genre", "tier", "track_id", digest.alias("_h"), F.substring(digest, 1, 2).alias("_part"))
    part = ["genre", "tier", "_part"]
    before = F.sum("_n").over(Window.partitionBy("genre", "tier").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = keyed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).select(*part, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("_h", "track_id")) - 1
    return (keyed.withColumn("_inside", inside).join(sizes, part)
            .select("genre", "tier", (F.col("_inside") + F.col("_before")).alias("number"), "track_id"))


def pool_candidates(requests: DataFrame, items: DataFrame, pool: str = "genre_pool", tier: str = "tier",
                    request: str = "request_id") -> DataFrame:
    """First genre of the pool, in priority order, that has tracks for the tier: adds picked_genre and n, how many.

    Requests without any mapped genre are dropped. Only the count per (genre, tier) meets the requests, never
    a list of tracks; a popular pair is an ordinary skewed join key, which adaptive execution splits."""
    sizes = items.groupBy("genre", "tier").agg(F.count(F.lit(1)).alias("n"))
    asked = requests.select(request, F.col(tier).alias("tier"), F.posexplode(pool).alias("pos", "genre"))
    first = asked.join(sizes, ["genre", "tier"]).groupBy(request).agg(F.min_by(F.struct("genre", "n"), "pos").alias("_g"))
    return requests.join(first.select(request, F.col("_g.genre").alias("picked_genre"), F.col("_g.n").alias("n")), request)


def suppress_recent(candidates: DataFrame, picks: DataFrame, items: DataFrame, n: int = C.RECENT_PICKS,
                    request: str = "request_id") -> DataFrame:
    """Bars each room's last n picks: adds `barred`, the numbers of its candidates that are recent, and takes them off n.

    Where all candidates are recent none is barred."""
    w = Window.partitionBy("room_id").orderBy(F.col("t").desc(), F.col("pick_id").desc())
    recent = picks.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select("room_id", "track_id").distinct()
    asked = candidates.select(request, "room_id", F.col("picked_genre").alias("genre"), "tier")
    barred = (asked.join(recent, "room_id").join(items, ["genre", "tier", "track_id"])
              .groupBy(request).agg(F.sort_array(F.collect_set("number")).alias("_b")))  # at most n numbers
    some = F.when(F.size("_b") < F.col("n"), F.col("_b")).otherwise(F.array().cast("array<bigint>"))
    df = candidates.join(barred, request, "left").withColumn("barred", F.coalesce(some, F.array().cast("array<bigint>"))).drop("_b")
    return df.withColumn("n", F.col("n") - F.size("barred"))


def drawn(request: str, n: str, seed: int = 0, draw: Column | int = 0) -> Column:
    """A number below n, by a hash of (request, seed, draw): uniform and repeatable."""
    text = F.concat_ws(":", F.col(request).cast("string"), F.lit(seed).cast("string"), F.lit(draw).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.col(n))


def random_pick(candidates: DataFrame, items: DataFrame, request: str = "request_id", seed: int = 0) -> DataFrame:
    """candidates with track_id: one of the n that are not barred."""
    number = drawn(request, "n", seed)
    if "barred" in candidates.columns:
        number = F.aggregate(F.sort_array("barred"), number, lambda at, b: F.when(b <= at, at + 1).otherwise(at))
    asked = candidates.withColumns({"genre": F.col("picked_genre"), "number": number})
    return asked.join(items, ["genre", "tier", "number"]).drop("genre", "number")


def preferred(request: str, n: int, k: int, seed: int = 0) -> Iterator[int]:
    """The first k different numbers below n that a request draws, or all if there are fewer: one by one, as a caller mostly takes the first.

    The draws are those of `drawn`. They repeat now and then, so four times k are made; should they not suffice, the lowest numbers follow."""
    draws = (int(md5(f"{request}:{seed}:{j}".encode()).hexdigest()[:8], 16) % n for j in range(4 * k))
    seen: set[int] = set()
    for number in chain(draws, range(min(n, k))):
        if number not in seen:
            seen.add(number)
            yield number
        if len(seen) == k:
            return


def twins(items: DataFrame) -> DataFrame:
    """Numbers whose track has several, with the first of that track's, and those below a playlist's first, which have no track and a null:
    genre, tier, number, same (a genre, tier and number)."""
    same = F.min(F.struct("genre", "tier", "number")).alias("same")
    several = items.groupBy(F.col("track_id").alias("_id")).agg(same, F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = items.join(several, F.col("track_id").eqNullSafe(F.col("_id"))).select("genre", "tier", "number", "same")
    unused = items.groupBy("genre", "tier").agg(F.min("number").alias("_first")).filter("_first > 0")
    below = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_first") - 1)).alias("number")
    return shared.unionByName(unused.select("genre", "tier", below), allowMissingColumns=True)


def with_twins(candidates: DataFrame, found: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """candidates with `twins`: those of the k numbers a request prefers that `found` tells of."""
    liked = F.udf(lambda request, n: list(preferred(request, n, k, seed)), "array<bigint>")
    asked = ["request_id", "picked_genre", "tier"]
    drawn_ones = candidates.select(*asked, F.explode(liked(F.col("request_id").cast("string"), "n")).alias("number"))
    known = (drawn_ones.join(found.withColumnRenamed("genre", "picked_genre"), ["picked_genre", "tier", "number"])
             .groupBy(*asked).agg(F.collect_set(F.struct("number", "same")).alias("twins")))  # at most k
    return candidates.join(known, asked, "left")


def select_tracks(requests: DataFrame, items: DataFrame, slab_s: float, recent: int = C.RECENT_PICKS,
                  seed: int = 0) -> DataFrame:
    """One pick per request, in order per room, never one of the room's last `recent` own picks
    unless the whole playlist is recent. Requests: request_id, room_id, t, genre_pool, tier.

    A request only needs its `recent` + 1 preferred tracks, since at most `recent` are barred. The fold picks numbers, whose
    tracks are looked up afterwards, one for each request; only tracks with several numbers are told beforehand."""
    df, k = pool_candidates(requests, items), recent + 1
    slim = df.select("request_id", "room_id", "t", "tier", "picked_genre", "n", F.col("request_id").cast("string").alias("name"))
    found = stage(twins(items))
    if not found.isEmpty():
        slim = with_twins(slim, found, k, seed)

    def pick(last, row):
        genre, tier, first = row["picked_genre"], row["tier"], None
        same = {x["number"]: x["same"] and [x["same"][c] for c in ("genre", "tier", "number")] for x in row.get("twins") or ()}
        for number in preferred(row["name"], row["n"], k, seed):
            track = same.get(number, [genre, tier, number])
            if track is None:
                continue
            first = first or (number, track)
            if track not in last:
                break
        else:
            if first is None:
                return last, None
            number, track = first
        return (last + [track])[-recent:], {
            **{c: row[c] for c in ("request_id", "room_id", "t", "tier")}, "genre": genre, "number": number}

    types = dict(df.dtypes)
    ddl = (f"request_id {types['request_id']}, room_id {types['room_id']}, t double, tier string, "
           "genre string, number bigint")
    picks = scan(slim, ROOM, ["t", "request_id"], slab_s, [], pick, ddl)
    return picks.join(items, ["genre", "tier", "number"]).select("request_id", "room_id", "t", "tier", "genre", "track_id")
