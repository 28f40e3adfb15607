"""Picks are folded by number and named afterwards; what stands before the fold is found once."""

from __future__ import annotations

import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from ambientspark.operators import fold, playback
from ambientspark.plans import room

ROOM, ORDER = ["room_id"], ["t", "frame_id"]


def _requests(spark, n=60):
    rng = random.Random(5)
    rows = [(1000 * r + i, r, float(i), rng.choice([["a", "b"], ["none", "b"], ["none"], ["c"]]), rng.choice(["low", "mid", None])) for r in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, room_id long, t double, genre_pool array<string>, tier string"), rows


def _picked(rows, items, recent):
    """The picks in plain Python: request_id -> (genre, track_id)."""
    slots, out, last = {}, {}, {}
    for i in items:
        slots.setdefault((i.genre, i.tier), {})[i.number] = i.track_id
    for request, r, _, pool, tier in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        genre = next((g for g in pool if (g, tier) in slots), None)
        if genre is None:
            continue
        tracks, k = slots[genre, tier], recent + 1
        n = len(tracks)
        draws = [int(md5(f"{request}:0:{j}".encode()).hexdigest()[:8], 16) % n for j in range(4 * k)] + list(range(min(n, k)))
        liked = [tracks[x] for x in list(dict.fromkeys(draws))[:k] if x in tracks]  # numbers start late where tracks have no id
        if not liked:
            continue
        mine = last.setdefault(r, [])
        track = next((x for x in liked if x not in mine), liked[0])
        last[r] = (mine + [track])[-recent:]
        out[request] = (genre, track)
    return out


@pytest.mark.parametrize("tracks", [[(i, "abc"[i % 3], ("low", "mid")[i % 2]) for i in range(90)],
                                    [(i % 40, "abc"[i % 3], ("low", "mid")[i // 3 % 2]) for i in range(90)],
                                    [(i // 2 or None, "a", "low") for i in range(6)] + [(i, "b", "mid") for i in range(4)] + [(2, "c", "low")]],
                         ids=["one number each", "shared by playlists", "few, repeated and null"])
@pytest.mark.parametrize("slab", [20.0, 1000.0])
def test_picks_are_those_of_the_plain_fold(spark, monkeypatch, tracks, slab):
    seen = []

    def scanned(df, *rest, base=playback.scan):
        seen.append(df.columns)
        return base(df, *rest)

    monkeypatch.setattr(playback, "scan", scanned)
    requests, rows = _requests(spark)
    items = playback.playlist_items(spark.createDataFrame(tracks, "track_id long, genre string, tier string")).cache()
    made = playback.select_tracks(requests, items, slab, recent=4).collect()
    want = _picked(rows, items.collect(), 4)
    assert {r.request_id: (r.genre, r.track_id) for r in made} == want and len(made) == len(want) > 30
    assert all("liked" not in c for c in seen)  # no list of tracks travels with a request


def test_equal_requests_are_picked_for_each(spark):
    requests, rows = _requests(spark, 20)
    items = playback.playlist_items(spark.createDataFrame([(i, "abc"[i % 3], ("low", "mid")[i % 2]) for i in range(90)], "track_id long, genre string, tier string")).cache()
    made = playback.select_tracks(requests.union(requests), items, 1000.0, recent=4)
    assert made.count() == 2 * len(_picked(rows, items.collect(), 4))


def test_numbers_preferred_are_those_drawn(spark):
    df = spark.range(50).select(F.col("id").alias("request_id"), (F.col("id") % 7 + 1).alias("n"))
    first = df.select("*", playback.drawn("request_id", "n", 3, 0).alias("number")).collect()
    assert all(next(playback.preferred(str(r.request_id), r.n, 11, 3)) == r.number for r in first)
    assert all(sorted(playback.preferred(str(r.request_id), r.n, 11, 3)) == list(range(r.n)) for r in first)


def test_recommendations_are_staged_before_they_are_read_twice(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(room.playback, "select_tracks", lambda asked, *rest, **more: seen.append(asked))
    recs = spark.range(10).select(F.col("id").alias("frame_id"), F.lit(1).alias("room_id"), F.col("id").cast("double").alias("t"), F.array(F.lit("a")).alias("genre_pool"),
                                  (F.col("id") / 10).alias("target_arousal"), F.lit("hold").alias("energy_action"))
    room.pick_for_recommendations(recs, None, 7.0)
    assert seen[0].count() == 10 and len(seen[0].inputFiles()) > 0


def test_a_key_of_one_slab_is_folded_once(spark, monkeypatch):
    staged = []

    def spy(df, base=fold.stage):
        staged.append(df.columns)
        return base(df)

    monkeypatch.setattr(fold, "stage", spy)
    df = spark.range(40).selectExpr("id % 4 AS room_id", "id AS frame_id", "id * 1.0D AS t")
    made = fold.scan(df, ROOM, ORDER, 100.0, 0, lambda s, r: (s + 1, {"frame_id": r["frame_id"], "n": s + 1}), "frame_id long, n long")
    assert {r.frame_id: r.n for r in made.collect()} == {i: i // 4 + 1 for i in range(40)}
    assert not any("state_out" in c for c in staged)


@pytest.mark.parametrize("slab", [12.0, 1000.0])
def test_null_keys_and_times_are_folded(spark, slab):
    data = [(r, i, t) for r in (None, 1, 2) for i, t in enumerate([None, *map(float, range(30))])]
    df = spark.createDataFrame(data, "room_id long, frame_id long, t double")
    made = fold.scan(df, ROOM, ORDER, slab, 0, lambda s, r: (s + 1, {**{c: r[c] for c in ("room_id", "frame_id")}, "n": s + 1}), "room_id long, frame_id long, n long")
    assert {(r.room_id, r.frame_id): r.n for r in made.collect()} == {(r, i): i + 1 for r in (None, 1, 2) for i in range(31)}


def test_alternatives_are_staged_and_exclude_the_vetoed_pool(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(room.playback, "select_tracks", lambda asked, *rest, **more: seen.append(asked))
    near = spark.createDataFrame([("2", "low", "mid", ["a", "b"])], "bucket string, vband string, aband string, near array<string>")
    recs = spark.range(10).select(F.col("id").alias("frame_id"), F.lit(1).alias("room_id"), F.col("id").cast("double").alias("t"), F.array(F.lit("a")).alias("genre_pool"),
                                  F.expr("IF(id < 6, array('2', 'low', 'mid'), array('guard', 'no-speech'))").alias("matched_cell"),
                                  (F.col("id") / 10).alias("target_arousal"), F.lit("hold").alias("energy_action"))
    room.wrong_vibe_alternatives(recs, near, None, 7.0)
    assert {(r.request_id, tuple(r.genre_pool)) for r in seen[0].collect()} == {(i, ("b",)) for i in range(6)} and len(seen[0].inputFiles()) > 0
