"""Registered queries: occupancy, playback, studies and whole-room compositions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators import fold, joins, mapping, occupancy, playback, slabs, studies
from ambientspark.plans import queries_ticks as T, room, views as V
from ambientspark.sources import payloads, playlists

ROOM = ["room_id"]


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- occupancy -----------------------------------------------------------------

def cluster_mass(spark, sf):
    return _r(occupancy.cluster_mass(V.evidence(spark, sf), ROOM), "fragmentation")


def separation_score(spark, sf):
    return _r(occupancy.separation_score(V.evidence(spark, sf), ROOM), "separation")


def dispersion(spark, sf):
    return _r(occupancy.dispersion(V.evidence(spark, sf), ROOM), "dispersion")


def pairwise_cosine(spark, sf):
    return _r(occupancy.pairwise_cosine(V.evidence(spark, sf), ROOM), "mean_distance")


def threshold_cluster(spark, sf):
    df = occupancy.threshold_cluster(V.evidence(spark, sf).drop("label"), ROOM)
    return df.select("evidence_id", "room_id", "label")


def crowd_estimate(spark, sf):
    f = V.frames(spark, sf).selectExpr(
        "frame_id", "frame_id % 9 + 1 AS raw_clusters", "high_share * 2 AS fragmentation", "v_raw * sqrt(0.2D) AS separation",
        "speech_raw AS dispersion", "activity_raw * sqrt(23.0D) AS evidence_s", "least(1.0D, speech_raw + 0.3D) AS speech_ratio",
        "loudness_raw * sqrt(0.97D) AS loudness_dbfs", "CASE WHEN frame_id % 4 <> 0 THEN -55.0D END AS noise_floor_dbfs", "playback_active")
    df = occupancy.crowd_estimate(f).select("frame_id", "crowd_weight", "log2_count", "confidence")
    return _r(df, "crowd_weight", "log2_count", "confidence")


def _evidence_ticks(spark, sf):
    return V.evidence(spark, sf).selectExpr(
        "room_id", "evidence_id AS frame_id", "at AS t", "0.9D AS speech_ratio", "-30.0D + evidence_id % 7 AS loudness_dbfs",
        "evidence_id % 2 = 0 AS playback_active", "-45.0D AS noise_floor_dbfs")


def evidence_window(spark, sf):
    """Rolling buffer of 20 s, at most 6 embeddings, at every evidence time."""
    df = joins.evidence_window(_evidence_ticks(spark, sf), V.evidence(spark, sf), ROOM, V.slab(spark, sf, "evidence"),
                               ["duration_s"], "frame_id", 20.0, 6)
    return df.select("frame_id", "evidence_id")


def evidence_seconds(spark, sf):
    df = joins.evidence_window(_evidence_ticks(spark, sf), V.evidence(spark, sf), ROOM, V.slab(spark, sf, "evidence"),
                               ["duration_s"], "frame_id", C.BUFFER_S, C.BUFFER_CAP)
    return df.groupBy("frame_id").agg(F.sum("duration_s").alias("evidence_s"))


def headcount_estimate(spark, sf):
    df = occupancy.headcount_estimate(_evidence_ticks(spark, sf), V.evidence(spark, sf).drop("label"), V.slab(spark, sf, "evidence"))
    numbers = ("crowd_weight", "dispersion", "fragmentation", "log2_count", "confidence")
    return _r(df.select("room_id", "frame_id", "t", "raw_clusters", *numbers), *numbers)


def headcount_series(spark, sf):
    s = V.slab(spark, sf, "evidence")
    est = slabs.stage(occupancy.headcount_estimate(_evidence_ticks(spark, sf), V.evidence(spark, sf).drop("label"), s))
    ticks = V.evidence(spark, sf).selectExpr("room_id", "evidence_id AS frame_id", "at AS t")
    df = occupancy.headcount_series(ticks, est, s)
    return _r(df.select("room_id", "frame_id", "bucket", "headcount_confidence", "headcount_staleness_s", "smoothed_log2"), "headcount_confidence", "smoothed_log2")


# --- playback ------------------------------------------------------------------

LEAD_S = 3.0


def _obs(spark, sf):
    """Poll log; every tenth poll finds nothing playing."""
    return V.now_playing_obs(spark, sf).withColumn("track_id", F.expr("CASE WHEN is_playing THEN track_id END"))


def track_boundaries(spark, sf):
    df = playback.track_boundaries(_obs(spark, sf), V.slab(spark, sf))
    return df.select("obs_id", "track_id", "prev_track_id", col.near_end("prev_progress_s", "prev_duration_s", LEAD_S).alias("completed"))


def vanished_tracks(spark, sf):
    return playback.vanished_tracks(_obs(spark, sf), V.slab(spark, sf), LEAD_S).select("obs_id", "prev_track_id")


def recent_ids(spark, sf):
    df = fold.recent_k(V.selections(spark, sf), ROOM, ["t", "pick_id"], V.slab(spark, sf), "track_id", 4)
    return df.select("pick_id", F.array_join("live", ",").alias("live"))


def played_through(spark, sf):
    df = playback.played_through(_obs(spark, sf), V.selections(spark, sf), V.track_vetoes(spark, sf), V.slab(spark, sf), LEAD_S)
    return df.select("obs_id", "room_id", "prev_track_id")


def _requests(spark, sf):
    return V.selections(spark, sf).selectExpr(
        "pick_id AS request_id", "room_id", "t",
        """CASE pick_id % 4 WHEN 0 THEN array('NONE', 'ECONOMY') WHEN 1 THEN array('SMALL', 'LARGE')
             WHEN 2 THEN array('NONE') ELSE array('PROMO', 'SMALL') END AS genre_pool""",
        "CASE pick_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS tier")


def playlist_items(spark, sf):
    df = playback.playlist_items(V.tracks(spark, sf))
    return df.groupBy("genre", "tier").agg(F.count("*").alias("n"), F.max("track_id").alias("last_id"), F.max_by("track_id", "number").alias("last_numbered"))


def pool_candidates(spark, sf):
    df = playback.pool_candidates(_requests(spark, sf), playback.playlist_items(V.tracks(spark, sf)))
    return df.select("request_id", "picked_genre", "tier", "n")


def suppress_recent(spark, sf):
    """How many candidates every request has left, which numbers are barred, and one pick of the rest."""
    items = slabs.stage(playback.playlist_items(V.tracks(spark, sf)))
    picks = V.selections(spark, sf).selectExpr("room_id", "t", "pick_id", "pick_id % 300 AS track_id")
    df = playback.suppress_recent(playback.pool_candidates(_requests(spark, sf), items), picks, items)
    df = playback.random_pick(df, items, seed=3)
    return df.select("room_id", "request_id", "n", F.array_join("barred", ",").alias("barred"), "track_id")


def random_pick(spark, sf):
    items = slabs.stage(playback.playlist_items(V.tracks(spark, sf)))
    return playback.random_pick(playback.pool_candidates(_requests(spark, sf), items), items).select("request_id", "track_id")


def select_tracks(spark, sf):
    return playback.select_tracks(_requests(spark, sf), slabs.stage(playback.playlist_items(V.tracks(spark, sf))), V.slab(spark, sf))


def _recs(spark, sf):
    return mapping.candidates(T._states(spark, sf), mapping.rulebook(spark), V.slab(spark, sf))


def _genre_items(spark, sf):
    """Playlists under the grid's genre names, two of them per part type."""
    names = F.array(*[F.lit(g) for g in ("Pop", "Hip-Hop", "Jazz", "Rock", "Dance", "Soul", "R&B", "Country", "Classical")])
    tracks = V.tracks(spark, sf).withColumn("genre", F.get(names, (F.col("track_id") % 9).cast("int")))
    return slabs.stage(playback.playlist_items(tracks))


def picks_for_recommendations(spark, sf):
    return room.pick_for_recommendations(_recs(spark, sf), _genre_items(spark, sf), V.slab(spark, sf))


def wrong_vibe_alternatives(spark, sf):
    return room.wrong_vibe_alternatives(_recs(spark, sf), mapping.adjacency(mapping.rulebook(spark)), _genre_items(spark, sf), V.slab(spark, sf))


def mapped_cells(spark, sf):
    return mapping.mapped_cells(V.tracks(spark, sf))


def completions(spark, sf):
    """Completions with presence stamped from the latest state and the last tap of the room."""
    states = V.frames(spark, sf).selectExpr(
        "room_id", "t AS state_t", "CASE WHEN frame_id % 6 <> 0 THEN (frame_id * 13 % 900) / 10.0D END AS headcount_staleness_s",
        "CASE WHEN frame_id % 4 <> 0 THEN (frame_id * 7 % 800) / 10.0D END AS emotion_staleness_s")
    taps = V.track_vetoes(spark, sf).select("room_id", F.col("t").alias("tap_ts"))
    df = room.completions(_obs(spark, sf), V.selections(spark, sf), V.track_vetoes(spark, sf), taps, states, V.slab(spark, sf), LEAD_S)
    return df.select("obs_id", "prev_track_id", "presence.occupied", "presence.basis", "presence.staleness_s")


# --- payload and dimension sources over derived documents -------------------------

def playlist_map(spark, sf):
    """Playlist mapping documents, one per brand, exploded to (genre, tier, playlist_id)."""
    t = V.tracks(spark, sf).groupBy("playlist_id", "genre", "tier").agg(F.min("track_id").alias("id"))
    tiers = t.groupBy("playlist_id", "genre").agg(F.map_from_entries(F.collect_list(F.struct("tier", F.concat(F.lit("P"), "id")))).alias("tiers"))
    docs = tiers.groupBy("playlist_id").agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.map_from_entries(
        F.collect_list(F.struct("genre", "tiers"))).alias("playlists"))).alias("doc"))
    df = playlists.explode_playlists(docs, "doc")
    return df.withColumnRenamed("playlist_id", "brand").withColumnRenamed("mapped_id", "playlist_id")


def now_playing_rows(spark, sf):
    """Player payloads, flattened: no item or no uri reads as nothing playing."""
    docs = V.now_playing_obs(spark, sf).select("obs_id", F.to_json(F.struct(
        "is_playing", (F.col("progress_s") * 1000).cast("bigint").alias("progress_ms"),
        F.when(F.col("obs_id") % 9 != 0, F.struct(
            F.when(F.col("obs_id") % 7 != 0, F.col("track_id")).alias("uri"), F.col("track_id").alias("name"),
            F.array(F.struct(F.lit("A").alias("name")), F.struct(F.col("track_id").alias("name"))).alias("artists"),
            F.lit(20000).alias("duration_ms"))).alias("item"),
        F.struct(F.expr("IF(obs_id % 2 = 0, 'playlist', 'album')").alias("type"), F.lit("ctx").alias("uri")).alias("context"),
        F.struct(F.lit("d1").alias("id")).alias("device"))).alias("payload"))
    return payloads.flatten_now_playing(docs, "payload").drop("payload")


def playlist_item_rows(spark, sf):
    """Playlist payloads, one per brand, flattened to playable tracks."""
    t = V.tracks(spark, sf)
    entry = F.struct(F.struct(F.when(F.col("track_id") % 11 != 0, F.concat(F.lit("uri"), "track_id")).alias("uri"), F.col("title").alias("name"),
                              F.array(F.struct(F.col("genre").alias("name"))).alias("artists"),
                              (F.col("duration_s") * 1000).cast("bigint").alias("duration_ms")).alias("item"))
    w = Window.partitionBy("playlist_id").orderBy("track_id")
    docs = t.withColumn("_r", F.row_number().over(w)).groupBy("playlist_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(
        F.struct("_r", entry.alias("e")))), lambda x: x["e"]).alias("items"))).alias("payload"))
    return payloads.flatten_playlist_items(docs, "payload").select("playlist_id", "pos", "track_id", "title", "artist", "duration_s")


# --- studies -------------------------------------------------------------------

def _study_frames(spark, sf):
    f = V.frames(spark, sf).selectExpr("room_id", "frame_id", "t", "v_raw + IF(t > 60, 0.3D, 0.0D) AS valence", "a_raw AS arousal",
                                       "speech_raw AS speech_ratio", "loudness_raw AS loudness_dbfs", "activity_raw AS staleness_s", "log2_est")
    return f.withColumn("rung", col.rung("log2_est").cast("bigint"))


def frames_in_phase(spark, sf):
    return joins.frames_in_phase(_study_frames(spark, sf), V.phases(spark), V.slab(spark, sf)).select("frame_id", "phase")


def phase_summary(spark, sf):
    df = studies.phase_summary(joins.frames_in_phase(_study_frames(spark, sf), V.phases(spark), V.slab(spark, sf)))
    return _r(df, "mean_valence", "mean_arousal", "min_dbfs", "max_dbfs")


def phase_delta(spark, sf):
    labelled = joins.frames_in_phase(_study_frames(spark, sf), V.phases(spark), V.slab(spark, sf))
    df = studies.phase_delta(labelled, "baseline", "music", "animated")
    return _r(df, "delta_valence", "delta_arousal", "mood_flip_share", "positive_separation")


def latency_report(spark, sf):
    df = studies.latency_report(V.table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", 100.0)
    return _r(df, "mean")


# --- whole rooms ---------------------------------------------------------------

def _estimates(spark, sf):
    return V.frames(spark, sf).filter(F.col("speech_raw") >= C.MIN_SPEECH_RATIO).selectExpr(
        "room_id", "t", "frame_id", "log2_est AS log2_count", "high_share AS confidence")


def _room_state(spark, sf):
    ticks = T._ticks(spark, sf, "loudness_raw", "activity_raw", "speech_raw", "high_share", "playback_active", "track_id", "v_raw", "a_raw")
    return room.room_state(ticks, T._readings(spark, sf), _estimates(spark, sf), V.slab(spark, sf), V.slab(spark, sf, "tracks"))


def room_state(spark, sf):
    return _room_state(spark, sf).select(
        "frame_id", "loudness_dbfs", "activity_density", "speech_ratio", "valence", "arousal", "emotion_confidence",
        "emotion_staleness_s", "bucket", "headcount_confidence", "headcount_staleness_s", "energy", "mood", "trend",
        "playback_active", "playback_track_id", "noise_floor_dbfs", "emotion_music_dominance",
        F.col("emotion_correction.basis").alias("correction_basis"), F.col("emotion_correction.valence").alias("correction_valence"))


def room_recommendations(spark, sf):
    """States and recommendations in one go."""
    states = slabs.stage(_room_state(spark, sf))
    return T._flat_recs(mapping.recommend(states, mapping.rulebook(spark), V.slab(spark, sf)))


QUERIES = {f.__name__: f for f in (
    cluster_mass, separation_score, dispersion, pairwise_cosine, threshold_cluster, crowd_estimate, evidence_window,
    evidence_seconds, headcount_estimate, headcount_series, track_boundaries, vanished_tracks, recent_ids, played_through,
    playlist_items, pool_candidates, suppress_recent, random_pick, select_tracks, picks_for_recommendations,
    wrong_vibe_alternatives, mapped_cells, completions, playlist_map, now_playing_rows, playlist_item_rows,
    frames_in_phase, phase_summary, phase_delta, latency_report, room_state, room_recommendations)}
