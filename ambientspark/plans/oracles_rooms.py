"""DuckDB statements for the occupancy, playback, study and room queries."""

from __future__ import annotations

from ambientspark.plans.oracle_views import ema_cte, with_views
from ambientspark.plans.oracles_ticks import (_CANDS, _LADDER, _NEAR, _REC_OUT, _STATES, CORRECTED, clamp, energy, held_ema, keep_cte,
                                              mood, pyround, ramp, rung, trend)

_PAIRS = """pairs AS MATERIALIZED (SELECT a.room_id, a.evidence_id AS i, b.evidence_id AS j, a.label AS li, b.label AS lj,
    1 - least(1, greatest(-1, list_inner_product(a.embedding, b.embedding))) AS d
  FROM evidence a JOIN evidence b ON a.room_id = b.room_id AND a.evidence_id <> b.evidence_id)"""
_SMEAR = f"greatest({ramp('dispersion', '0.35e0', '0.7e0')}, {ramp('fragmentation', '0.3e0', '0.8e0')})"
_LOUD = f"""CASE WHEN playback_active AND noise_floor_dbfs IS NOT NULL THEN {ramp('(loudness_dbfs - noise_floor_dbfs)', '3', '12')}
    ELSE {ramp('loudness_dbfs', '(-45.0e0)', '(-20.0e0)')} END"""
_TICKS = """ticks AS (SELECT room_id, evidence_id AS frame_id, "at" AS t FROM evidence)"""
_OBS = """obs AS MATERIALIZED (SELECT *, lag(track_id) OVER w AS p_track, lag(progress_s) OVER w AS p_progress, lag(duration_s) OVER w AS p_duration
  FROM (SELECT * REPLACE (CASE WHEN is_playing THEN track_id END AS track_id) FROM now_playing_obs) WINDOW w AS (PARTITION BY room_id ORDER BY t, obs_id))"""
_ENDS = """ends AS MATERIALIZED (SELECT *, p_progress >= p_duration - 3 AS completed FROM obs WHERE p_track IS NOT NULL AND p_track IS DISTINCT FROM track_id)"""


def _recent(name, src, id_col, k):
    """Insertion-ordered ids capped at k after each row of src."""
    return (f"{name}_src AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY t, {id_col}) AS rn FROM {src})",
            f"""{name} AS (SELECT room_id, rn, t, {id_col}, [track_id] AS live FROM {name}_src WHERE rn = 1
      UNION ALL SELECT s.room_id, s.rn, s.t, s.{id_col}, CASE WHEN list_contains(e.live, s.track_id) THEN e.live
        WHEN len(e.live) < {k} THEN list_append(e.live, s.track_id) ELSE list_append(e.live[2:], s.track_id) END
      FROM {name} e JOIN {name}_src s ON s.room_id = e.room_id AND s.rn = e.rn + 1)""")


_DONE = (_OBS, _ENDS, *_recent("chosen", "selections", "pick_id", 8), *_recent("vetoed", "track_vetoes", "veto_id", 16),
         """done AS MATERIALIZED (SELECT e.* FROM ends e ASOF LEFT JOIN chosen c ON e.room_id = c.room_id AND e.t >= c.t
              ASOF LEFT JOIN vetoed v ON e.room_id = v.room_id AND e.t >= v.t
            WHERE e.completed AND list_contains(c.live, e.p_track) AND NOT coalesce(list_contains(v.live, e.p_track), false))""")
_ITEMS = """numbered AS MATERIALIZED (SELECT genre, tier, track_id, row_number() OVER (PARTITION BY genre, tier ORDER BY md5(CAST(track_id AS VARCHAR)), track_id) - 1 AS number FROM tracks),
items AS MATERIALIZED (SELECT genre, tier, count(*) AS n, max(track_id) AS last_id, max_by(track_id, number) AS last_numbered FROM numbered GROUP BY 1, 2)"""
_REQ = """req AS MATERIALIZED (SELECT pick_id AS request_id, room_id, t, CASE pick_id % 4 WHEN 0 THEN ['NONE', 'ECONOMY'] WHEN 1 THEN ['SMALL', 'LARGE']
    WHEN 2 THEN ['NONE'] ELSE ['PROMO', 'SMALL'] END AS pool, CASE pick_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS tier FROM selections)"""
_FIRST = """firsts AS MATERIALIZED (SELECT q.*, i.genre, i.n FROM req q JOIN range(1, 3) r(k) ON true
    JOIN items i ON i.genre = q.pool[k] AND i.tier = q.tier QUALIFY row_number() OVER (PARTITION BY q.request_id ORDER BY k) = 1)"""


def _drawn(request: str, seed: int, draw: str | int, n: str) -> str:
    return f"CAST('0x' || substr(md5({request} || ':{seed}:' || {draw}), 1, 8) AS BIGINT) % {n}"


_PICKED = (f"""draws AS MATERIALIZED (SELECT request_id, number, min(pos) AS pos FROM (
      SELECT request_id, {_drawn('request_id', 0, 'j', 'n')} AS number, j AS pos FROM firsts, range(0, 44) r(j)
      UNION ALL SELECT request_id, j, 44 + j FROM firsts, range(0, 11) r(j) WHERE j < n) GROUP BY 1, 2)""",
    """liked AS MATERIALIZED (SELECT f.request_id, list(i.track_id ORDER BY d.pos) AS ids FROM firsts f JOIN (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS r FROM draws) d ON d.request_id = f.request_id AND d.r <= 11
      JOIN numbered i ON i.genre = f.genre AND i.tier = f.tier AND i.number = d.number GROUP BY 1)""",
    """asks AS MATERIALIZED (SELECT f.*, l.ids, row_number() OVER (PARTITION BY room_id ORDER BY t, request_id) AS rn FROM firsts f JOIN liked l USING (request_id))""",
    """sel AS (SELECT room_id, rn, request_id, t, tier, genre, [ids[1]] AS last, ids[1] AS track_id FROM asks WHERE rn = 1
      UNION ALL SELECT room_id, rn, request_id, t, tier, genre, list_append(last, c)[-10:], c FROM (
        SELECT s.room_id, s.rn, s.request_id, s.t, s.tier, s.genre, e.last, coalesce(list_filter(s.ids, lambda x: NOT list_contains(e.last, x))[1], s.ids[1]) AS c
        FROM sel e JOIN asks s ON s.room_id = e.room_id AND s.rn = e.rn + 1))""")
_GENRES = "['Pop', 'Hip-Hop', 'Jazz', 'Rock', 'Dance', 'Soul', 'R&B', 'Country', 'Classical'][1 + track_id % 9]"
_GENRE_ITEMS = _ITEMS.replace("FROM tracks)", f"FROM (SELECT * REPLACE ({_GENRES} AS genre) FROM tracks))", 1)
_REC_TIER = """['low', 'mid', 'high'][1 + greatest(0, least(2, CASE WHEN target_arousal > 0.25 THEN 2 WHEN target_arousal > -0.25 THEN 1 ELSE 0 END
    + CASE energy_action WHEN 'raise' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END))]"""
_REC_REQ = f"req AS MATERIALIZED (SELECT frame_id AS request_id, room_id, t, pool, {_REC_TIER} AS tier FROM cands WHERE reason IS NULL)"
_NEAR_REQ = f"""req AS MATERIALIZED (SELECT frame_id AS request_id, room_id, t, a.pool, {_REC_TIER} AS tier FROM cands JOIN (
    SELECT frame_id, list_transform(list_sort(list({{'o': o, 'i': i, 'g': g}})), lambda x: x.g) AS pool
    FROM (SELECT frame_id, g, min(o) AS o, min_by(i, o) AS i FROM near GROUP BY ALL) GROUP BY 1) a USING (frame_id) WHERE reason IS NULL)"""
_ANY_FIRST = _FIRST.replace("range(1, 3)", "range(1, 20)")
_PICK_OUT = "SELECT request_id, room_id, t, tier, genre, track_id FROM sel"
_STUDY = """study AS MATERIALIZED (SELECT f.*, p.phase FROM (SELECT frame_id, t, v_raw + CASE WHEN t > 60 THEN 0.3e0 ELSE 0.0e0 END AS valence, a_raw AS arousal,
    speech_raw, loudness_raw, activity_raw, RUNG AS rung FROM frames) f JOIN phases p ON f.t >= p.start_s AND f.t < p.end_s)""".replace("RUNG", rung("log2_est"))

_EST = (ema_cte("est_s", "est", "room_id", 20.0, x="log2_est"),
        f"est_c AS MATERIALIZED (SELECT room_id, rn, t, {rung('x')} AS candidate FROM est_s)",
        """est_h AS (SELECT room_id, rn, t, candidate AS b, CAST(NULL AS BIGINT) AS pend, 0 AS cnt FROM est_c WHERE rn = 1 UNION ALL
           SELECT room_id, rn, t, CASE WHEN c >= 3 THEN candidate ELSE b END, CASE WHEN c >= 3 THEN NULL ELSE pend END, CASE WHEN c >= 3 THEN 0 ELSE c END FROM (
             SELECT s.room_id, s.rn, s.t, s.candidate, h.b, CASE WHEN s.candidate = h.b THEN NULL ELSE s.candidate END AS pend,
               CASE WHEN s.candidate = h.b THEN 0 WHEN s.candidate = h.pend THEN h.cnt + 1 ELSE 1 END AS c
             FROM est_h h JOIN est_c s ON s.room_id = h.room_id AND s.rn = h.rn + 1))""")
_STATE = (*CORRECTED, *held_ema("hold", "corrected", 10.0, "v_inst", "a_inst"),
    ema_cte("dsp", "frames", "room_id", 6.0, l="loudness_raw", a="activity_raw", s="speech_raw"),
    "quiet AS MATERIALIZED (SELECT room_id, t, loudness_raw AS x, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM frames WHERE speech_raw < 0.1)",
    ema_cte("nf", "quiet", "room_id", 60.0, x="x"),
    "est AS MATERIALIZED (SELECT room_id, t, frame_id, log2_est, high_share, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM frames WHERE speech_raw >= 0.2)",
    *_EST,
    f"""full_state AS MATERIALIZED (SELECT *, {energy('l', 'a', 's', 'ha')} AS energy_raw FROM (
      SELECT c.*, d.l, d.a, d.s, n.x AS nf, h.v AS hv, h.a AS ha, eh.b AS hc, ee.high_share AS hc_conf, c.t - eh.t AS hc_stale
      FROM corrected c JOIN dsp d ON d.room_id = c.room_id AND d.rn = c.rn
        ASOF LEFT JOIN nf n ON c.room_id = n.room_id AND c.t >= n.t ASOF LEFT JOIN hold h ON c.room_id = h.room_id AND c.t >= h.t
        ASOF LEFT JOIN est_h eh ON c.room_id = eh.room_id AND c.t >= eh.t
        LEFT JOIN est ee ON ee.room_id = eh.room_id AND ee.rn = eh.rn))""",
    f"""pub AS MATERIALIZED (SELECT frame_id, room_id, rn, t, {pyround('l', 1)} AS loudness_dbfs, {pyround('a', 2)} AS activity_density, {pyround('s', 3)} AS speech_ratio,
      {pyround('hv', 3)} AS valence, {pyround('ha', 3)} AS arousal, {pyround('emotion_confidence', 2)} AS emotion_confidence, {pyround('staleness_s', 1)} AS emotion_staleness_s,
      {_LADDER}[hc + 1] AS bucket, {pyround('hc_conf', 2)} AS headcount_confidence, {pyround('hc_stale', 1)} AS headcount_staleness_s,
      {pyround('energy_raw', 3)} AS energy, CASE WHEN staleness_s <= 20 THEN {mood('hv', 'ha')} END AS mood, {trend('energy_raw')} AS trend,
      playback_active, track_id AS playback_track_id, {pyround('nf', 1)} AS noise_floor_dbfs, {pyround('m', 3)} AS emotion_music_dominance,
      basis AS correction_basis, {pyround('dv', 3)} AS correction_valence FROM full_state)""")
_PUB_STATES = f"""states AS MATERIALIZED (SELECT * , {trend('valence')} AS valence_trend, {trend('arousal')} AS arousal_trend FROM (
    SELECT room_id, rn, t, frame_id, speech_ratio, mood, bucket, headcount_confidence, emotion_confidence, trend,
      CASE WHEN arousal IS NOT NULL THEN valence END AS valence, CASE WHEN valence IS NOT NULL THEN arousal END AS arousal FROM pub))"""



def _clustered(buffers: str) -> tuple[str, ...]:
    """Average linkage by recursion over buffers (buffer, room_id, evidence_id, at, duration_s): each step merges the nearest two clusters of every buffer."""
    return (
        f'bufs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY buffer ORDER BY "at", evidence_id) AS pos FROM ({buffers}))',
        """gaps AS MATERIALIZED (SELECT a.room_id, a.evidence_id AS i, b.evidence_id AS j, 1 - least(1, greatest(-1, list_inner_product(a.embedding, b.embedding))) AS d
          FROM evidence a JOIN evidence b ON a.room_id = b.room_id)""",
        """near_pairs AS MATERIALIZED (SELECT x.buffer, x.pos AS p, y.pos AS q, g.d FROM bufs x JOIN bufs y ON x.buffer = y.buffer AND x.pos < y.pos
          JOIN gaps g ON g.i = x.evidence_id AND g.j = y.evidence_id)""",
        """merged AS (SELECT buffer, 0 AS step, list(pos ORDER BY pos) AS roots FROM bufs GROUP BY buffer
          UNION ALL SELECT buffer, step + 1, list_transform(roots, lambda x: CASE WHEN x = m.b THEN m.a ELSE x END)
          FROM (SELECT buffer, step, roots, min_by({'a': a, 'b': b}, {'d': d, 'a': a, 'b': b}) AS m, min(d) AS d
            FROM (SELECT r.buffer, r.step, r.roots, least(r.roots[n.p], r.roots[n.q]) AS a, greatest(r.roots[n.p], r.roots[n.q]) AS b, avg(n.d) AS d
              FROM merged r JOIN near_pairs n ON n.buffer = r.buffer AND r.roots[n.p] <> r.roots[n.q] GROUP BY ALL) GROUP BY ALL) WHERE d < 0.7)""",
        """told AS MATERIALIZED (SELECT b.*, l.roots[b.pos] AS root FROM bufs b JOIN (SELECT buffer, max_by(roots, step) AS roots FROM merged GROUP BY 1) l USING (buffer))""",
        """told_pairs AS MATERIALIZED (SELECT x.buffer, x.pos AS p, x.root AS rp, y.root AS rq, g.d FROM told x JOIN told y ON x.buffer = y.buffer AND x.pos <> y.pos
          JOIN gaps g ON g.i = x.evidence_id AND g.j = y.evidence_id)""")


_TICK_BUFFERS = """SELECT k.evidence_id AS buffer, e.room_id, e.evidence_id, e."at", e.duration_s FROM evidence k JOIN evidence e ON e.room_id = k.room_id AND e."at" BETWEEN k."at" - 90 AND k."at" """
_ESTIMATES = (*_clustered(_TICK_BUFFERS), f"""numbers AS MATERIALIZED (SELECT c.buffer, c.evidence_s, greatest(1, c.heavy) AS raw_clusters, c.stray / c.n AS fragmentation,
      CASE WHEN c.n >= 3 THEN coalesce(s.separation, 0) ELSE 0.0e0 END AS separation, coalesce(w.dispersion, 0) AS dispersion
    FROM (SELECT buffer, sum(n) AS n, sum(s) AS evidence_s, count(*) FILTER (WHERE ok) AS heavy, coalesce(sum(n) FILTER (WHERE NOT ok), 0) AS stray
      FROM (SELECT *, (n >= 2 OR s >= 2.5) AND s >= 0.1e0 * sum(s) OVER (PARTITION BY buffer) AS ok FROM (
        SELECT buffer, root, count(*) AS n, sum(duration_s) AS s FROM told GROUP BY 1, 2)) GROUP BY 1) c
    LEFT JOIN (SELECT buffer, avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END) AS separation
      FROM (SELECT buffer, p, avg(d) AS a FROM told_pairs WHERE rp = rq GROUP BY 1, 2)
      JOIN (SELECT buffer, p, min(d) AS b FROM (SELECT buffer, p, rq, avg(d) AS d FROM told_pairs WHERE rp <> rq GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (buffer, p) GROUP BY 1) s USING (buffer)
    LEFT JOIN (SELECT buffer, sum(d * n) / sum(n) AS dispersion FROM (SELECT buffer, rp, avg(d) AS d, count(DISTINCT p) AS n FROM told_pairs WHERE rp = rq GROUP BY 1, 2) GROUP BY 1) w USING (buffer))""",
    f"""estimates AS MATERIALIZED (SELECT *, (1 - crowd_weight) * log2(raw_clusters) + crowd_weight * babble_log2 AS log2_count,
      least(1, greatest(0, (1 - crowd_weight) * least(1, evidence_s / 15.0e0) * least(1, greatest(0.2e0, 0.4e0 + separation)) + crowd_weight * 0.25e0)) AS confidence
    FROM (SELECT *, least(1, greatest(0, (1 - least(1, greatest(0, separation / 0.25e0))) * greatest({ramp('raw_clusters', '4.0e0', '8.0e0')},
          {ramp('speech_ratio', '0.6e0', '0.95e0')} * {_LOUD} * {_SMEAR}))) AS crowd_weight,
        3.0e0 + 7.0e0 * speech_ratio * least(1, greatest(0, (loudness_dbfs + 45.0e0) / 25.0e0)) AS babble_log2
      FROM (SELECT n.*, e.room_id, e.evidence_id AS frame_id, e."at" AS t, 0.9e0 AS speech_ratio, -30.0e0 + e.evidence_id % 7 AS loudness_dbfs, e.evidence_id % 2 = 0 AS playback_active,
          -45.0e0 AS noise_floor_dbfs FROM numbers n JOIN evidence e ON e.evidence_id = n.buffer)))""")

ORACLES = {
    "threshold_cluster": with_views("evidence", "SELECT evidence_id, room_id, dense_rank() OVER (PARTITION BY room_id ORDER BY root) - 1 AS label FROM told",
                                    *_clustered('SELECT room_id AS buffer, room_id, evidence_id, "at", duration_s FROM evidence')),
    "headcount_estimate": with_views("evidence", """SELECT room_id, frame_id, t, raw_clusters, round(crowd_weight, 6) AS crowd_weight, round(dispersion, 6) AS dispersion,
        round(fragmentation, 6) AS fragmentation, round(log2_count, 6) AS log2_count, round(confidence, 6) AS confidence FROM estimates""", *_ESTIMATES),
    "headcount_series": with_views("evidence", f"""SELECT e.room_id, e.frame_id, {_LADDER}[h.b + 1] AS bucket, round(e.confidence, 6) AS headcount_confidence, 0.0e0 AS headcount_staleness_s, round(s.x, 6) AS smoothed_log2
        FROM est_h h JOIN est_s s USING (room_id, rn) JOIN est_src e USING (room_id, rn)""", *_ESTIMATES,
        "est_src AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY t, frame_id) AS rn FROM estimates)",
        ema_cte("est_s", "est_src", "room_id", 20.0, x="log2_count"), *_EST[1:]),
    "cluster_mass": with_views("evidence", """
        SELECT room_id, CAST(sum(n) AS BIGINT) AS segments, sum(s) AS evidence_s, count(*) AS clusters, greatest(1, count(*) FILTER (WHERE ok)) AS raw_clusters,
          CAST(coalesce(sum(n) FILTER (WHERE NOT ok), 0) AS BIGINT) AS stray_segments, round(coalesce(sum(n) FILTER (WHERE NOT ok), 0) / sum(n), 6) AS fragmentation
        FROM (SELECT *, (n >= 2 OR s >= 2.5) AND s >= 0.1e0 * sum(s) OVER (PARTITION BY room_id) AS ok
              FROM (SELECT room_id, label, count(*) AS n, sum(duration_s) AS s FROM evidence GROUP BY 1, 2)) GROUP BY 1"""),
    "separation_score": with_views("evidence", """
        SELECT r.room_id, CASE WHEN any_value(k) >= 3 THEN round(coalesce(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END), 0), 6) ELSE 0.0e0 END AS separation
        FROM (SELECT room_id, evidence_id AS i, count(*) OVER (PARTITION BY room_id) AS k FROM evidence) r
        LEFT JOIN (SELECT i, avg(d) AS a FROM pairs WHERE li = lj GROUP BY 1) USING (i)
        LEFT JOIN (SELECT i, min(d) AS b FROM (SELECT i, lj, avg(d) AS d FROM pairs WHERE li <> lj GROUP BY 1, 2) GROUP BY 1) USING (i) GROUP BY 1""", _PAIRS),
    "dispersion": with_views("evidence", """
        SELECT room_id, round(coalesce(sum(total) / sum(n), 0), 6) AS dispersion FROM (SELECT DISTINCT room_id FROM evidence) LEFT JOIN (
          SELECT room_id, li, sum(d) / (count(DISTINCT i) - 1) AS total, count(DISTINCT i) AS n FROM pairs WHERE li = lj GROUP BY 1, 2) USING (room_id) GROUP BY 1""", _PAIRS),
    "pairwise_cosine": with_views("evidence", "SELECT room_id, count(*) // 2 AS pairs, round(avg(d), 6) AS mean_distance FROM pairs GROUP BY 1", _PAIRS),
    "crowd_estimate": with_views("frames", f"""
        SELECT frame_id, round(w, 6) AS crowd_weight, round((1 - w) * log2(raw_clusters) + w * babble, 6) AS log2_count,
          round(least(1, greatest(0, (1 - w) * least(1, evidence_s / 15) * least(1, greatest(0.2e0, 0.4e0 + separation)) + w * 0.25e0)), 6) AS confidence
        FROM (SELECT *, least(1, greatest(0, (1 - least(1, greatest(0, separation / 0.25e0))) * greatest({ramp('raw_clusters', '4.0e0', '8.0e0')}, {ramp('speech_ratio', '0.6e0', '0.95e0')} * {_LOUD} * {_SMEAR}))) AS w,
            3 + 7 * least(1, greatest(0, speech_ratio)) * least(1, greatest(0, (loudness_dbfs + 45) / 25)) AS babble
          FROM (SELECT frame_id, frame_id % 9 + 1 AS raw_clusters, high_share * 2 AS fragmentation, v_raw * sqrt(0.2e0) AS separation, speech_raw AS dispersion,
            activity_raw * sqrt(23.0e0) AS evidence_s, least(1, speech_raw + 0.3e0) AS speech_ratio, loudness_raw * sqrt(0.97e0) AS loudness_dbfs,
            CASE WHEN frame_id % 4 <> 0 THEN -55.0e0 END AS noise_floor_dbfs, playback_active FROM frames))"""),
    "evidence_window": with_views("evidence", """
        SELECT frame_id, evidence_id FROM (SELECT k.frame_id, e.evidence_id, row_number() OVER (PARTITION BY k.frame_id ORDER BY e.at DESC, e.evidence_id DESC) AS r
          FROM ticks k JOIN evidence e ON e.room_id = k.room_id AND e.at BETWEEN k.t - 20 AND k.t) WHERE r <= 6""", _TICKS),
    "evidence_seconds": with_views("evidence", "SELECT k.frame_id, sum(e.duration_s) AS evidence_s FROM ticks k JOIN evidence e ON e.room_id = k.room_id AND e.at BETWEEN k.t - 90 AND k.t GROUP BY 1", _TICKS),
    "track_boundaries": with_views("now_playing_obs", "SELECT obs_id, track_id, p_track AS prev_track_id, completed FROM ends", _OBS, _ENDS),
    "vanished_tracks": with_views("now_playing_obs", "SELECT obs_id, p_track AS prev_track_id FROM ends WHERE NOT completed", _OBS, _ENDS),
    "recent_ids": with_views("selections", "SELECT pick_id, array_to_string(live, ',') AS live FROM mem", *_recent("mem", "selections", "pick_id", 4)),
    "played_through": with_views("now_playing_obs selections track_vetoes", "SELECT obs_id, room_id, p_track AS prev_track_id FROM done", *_DONE),
    "playlist_items": with_views("tracks", "SELECT genre, tier, n, last_id, last_numbered FROM items", _ITEMS),
    "pool_candidates": with_views("tracks selections", "SELECT request_id, genre AS picked_genre, tier, n FROM firsts", _ITEMS, _REQ, _FIRST),
    "suppress_recent": with_views("tracks selections", f"""
        SELECT room_id, request_id, m AS n, array_to_string(barred, ',') AS barred, i.track_id
        FROM (SELECT *, list_reduce(list_prepend({_drawn('request_id', 3, 0, 'm')}, barred), lambda k, b: CASE WHEN b <= k THEN k + 1 ELSE k END) AS number
          FROM (SELECT *, n - len(barred) AS m FROM (SELECT f.*, CASE WHEN len(b.numbers) < f.n THEN b.numbers ELSE CAST([] AS BIGINT[]) END AS barred
            FROM firsts f LEFT JOIN (SELECT f.request_id, list_sort(list(DISTINCT i.number)) AS numbers FROM firsts f JOIN last_picks p USING (room_id)
              JOIN numbered i ON i.genre = f.genre AND i.tier = f.tier AND i.track_id = p.track_id GROUP BY 1) b USING (request_id)))) q
        JOIN numbered i ON i.genre = q.genre AND i.tier = q.tier AND i.number = q.number""", _ITEMS, _REQ, _FIRST,
        """last_picks AS MATERIALIZED (SELECT DISTINCT room_id, pick_id % 300 AS track_id FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY t DESC, pick_id DESC) AS r
             FROM selections) WHERE r <= 10)"""),
    "random_pick": with_views("tracks selections", f"""SELECT request_id, i.track_id FROM firsts f
        JOIN numbered i ON i.genre = f.genre AND i.tier = f.tier AND i.number = {_drawn('f.request_id', 0, 0, 'f.n')}""", _ITEMS, _REQ, _FIRST),
    "select_tracks": with_views("tracks selections", _PICK_OUT, _ITEMS, _REQ, _FIRST, *_PICKED),
    "picks_for_recommendations": with_views("tracks frames rulebook", _PICK_OUT, _STATES, _CANDS, _GENRE_ITEMS, _REC_REQ, _ANY_FIRST, *_PICKED),
    "wrong_vibe_alternatives": with_views("tracks frames rulebook", _PICK_OUT, _STATES, _CANDS, _NEAR, _GENRE_ITEMS, _NEAR_REQ, _ANY_FIRST, *_PICKED),
    "mapped_cells": with_views("tracks", "SELECT DISTINCT genre, tier FROM tracks"),
    "completions": with_views("now_playing_obs selections track_vetoes frames", """
        SELECT obs_id, p_track AS prev_track_id, basis IN ('fresh', 'handoff', 'tap') AS occupied, basis, stale AS staleness_s FROM (
          SELECT *, CASE WHEN stale IS NULL THEN CASE WHEN coalesce(tap_age <= p_duration, false) THEN 'tap' ELSE 'unknown' END WHEN stale <= 60 THEN 'fresh'
            WHEN stale BETWEEN p_duration AND p_duration + 30 THEN 'handoff' WHEN tap_age <= p_duration THEN 'tap' ELSE 'absent' END AS basis
          FROM (SELECT d.*, d.t - v.t AS tap_age, coalesce(CASE WHEN f.frame_id % 6 <> 0 THEN (f.frame_id * 13 % 900) / 10.0e0 END,
                  CASE WHEN f.frame_id % 4 <> 0 THEN (f.frame_id * 7 % 800) / 10.0e0 END) AS stale
                FROM done d ASOF LEFT JOIN frames f ON d.room_id = f.room_id AND d.t >= f.t ASOF LEFT JOIN track_vetoes v ON d.room_id = v.room_id AND d.t >= v.t))""", *_DONE),
    "playlist_map": with_views("tracks", "SELECT playlist_id AS brand, genre, tier, 'P' || min(track_id) AS playlist_id FROM tracks GROUP BY ALL"),
    "now_playing_rows": with_views("now_playing_obs", """
        SELECT obs_id, CASE WHEN ok THEN track_id END AS track_id, CASE WHEN ok THEN track_id END AS title, CASE WHEN ok THEN 'A, ' || track_id END AS artist,
          CASE WHEN ok THEN 20.0e0 END AS duration_s, CASE WHEN ok AND obs_id % 2 = 0 THEN 'ctx' END AS playlist_id,
          CASE WHEN ok THEN trunc(progress_s * 1000) / 1000.0e0 END AS progress_s, CASE WHEN ok THEN is_playing END AS is_playing, CASE WHEN ok THEN 'd1' END AS device_id
        FROM (SELECT *, obs_id % 9 <> 0 AND obs_id % 7 <> 0 AS ok FROM now_playing_obs)"""),
    "playlist_item_rows": with_views("tracks", """
        SELECT playlist_id, r - 1 AS pos, 'uri' || track_id AS track_id, title, genre AS artist, duration_s
        FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY track_id) AS r FROM tracks) WHERE track_id % 11 <> 0"""),
    "frames_in_phase": with_views("frames phases", "SELECT frame_id, phase FROM study", _STUDY),
    "phase_summary": with_views("frames phases", """
        SELECT phase, count(*) AS frames, round(avg(valence), 6) AS mean_valence, round(avg(arousal), 6) AS mean_arousal, min(rung) AS min_rung, max(rung) AS max_rung,
          min(speech_raw) AS min_speech, max(speech_raw) AS max_speech, round(min(loudness_raw), 6) AS min_dbfs, round(max(loudness_raw), 6) AS max_dbfs,
          min(activity_raw) AS min_staleness, max(activity_raw) AS max_staleness FROM study GROUP BY 1""", _STUDY),
    "phase_delta": with_views("frames phases", f"""
        SELECT round(v1 - v0, 6) AS delta_valence, round(a1 - a0, 6) AS delta_arousal,
          round(1 - (SELECT count(*) FROM study WHERE phase = 'music' AND {mood('valence', 'arousal')} = {mood('v0', 'a0')}) / (SELECT count(*) FROM study WHERE phase = 'music'), 6) AS mood_flip_share,
          abs(v1 - v0) < 0.2 AND abs(a1 - a0) < 0.2 AS passed, round(a2 - a1, 6) AS positive_separation
        FROM (SELECT avg(valence) FILTER (WHERE phase = 'baseline') AS v0, avg(arousal) FILTER (WHERE phase = 'baseline') AS a0,
          avg(valence) FILTER (WHERE phase = 'music') AS v1, avg(arousal) FILTER (WHERE phase = 'music') AS a1,
          avg(arousal) FILTER (WHERE phase = 'animated') AS a2 FROM study)""", _STUDY),
    "latency_report": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[1 + greatest(0, CAST(floor(count(*) * 0.95e0) AS BIGINT) - 1)] AS p95,
        list_sort(list(value))[1 + greatest(0, CAST(floor(count(*) * 0.95e0) AS BIGINT) - 1)] < 100 AS within_budget FROM events GROUP BY 1""",
    "room_state": with_views("frames", "SELECT * EXCLUDE (room_id, rn, t) FROM pub", *_STATE),
    "room_recommendations": with_views("frames rulebook", f"SELECT {_REC_OUT} FROM cands WHERE frame_id IN (SELECT frame_id FROM k WHERE kept)", *_STATE, _PUB_STATES, _CANDS,
        "src AS MATERIALIZED (SELECT room_id, rn, frame_id, t, concat_ws('|', coalesce(mood, '-'), coalesce(bucket, '-'), energy_action, reason IS NOT NULL) AS sig FROM cands)",
        keep_cte("k", "src", "(s.t - e.k_t >= 30 AND s.sig <> e.k_sig)", ["t", "sig"])),
}
