"""The telemetry views of `views.py` as DuckDB common table expressions, for the oracle queries."""

from __future__ import annotations

from ambientspark.functions import constants as C

_US = "(epoch_us(ts) - 1704067200000000)"
_DAY = "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"
_RUNG = "CASE o_custkey % 12 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(C.LADDER)) + " END"
_CELL = """[bucket,
    CASE WHEN valence > valence_high THEN 'high' WHEN valence > valence_low THEN 'mid' ELSE 'low' END,
    CASE WHEN arousal > arousal_high THEN 'high' WHEN arousal > arousal_low THEN 'mid' ELSE 'low' END]"""

VIEWS = {
    "frames": f"""
        SELECT frame_id, room_id, t,
          -60.0e0 + 50.0e0 * least(value, 100.0e0) / 100.0e0 AS loudness_raw,
          (k % 41) / 10.0e0 AS activity_raw, (frame_id * 7 % 50) / 100.0e0 AS high_share,
          (k % 20) / 20.0e0 AS speech_raw, (frame_id * 37 % 201) / 100.0e0 - 1.0e0 AS v_raw,
          (frame_id * 53 % 201) / 100.0e0 - 1.0e0 AS a_raw, (frame_id * 11 % 120) / 10.0e0 AS log2_est,
          CAST(floor(t / 40) AS BIGINT) % 2 = 1 AS playback_active,
          CASE WHEN CAST(floor(t / 40) AS BIGINT) % 2 = 1
               THEN concat('trk', CAST(CAST(floor(t / 20) AS BIGINT) % 8 AS VARCHAR)) END AS track_id,
          row_number() OVER (PARTITION BY room_id ORDER BY t, frame_id) AS rn
        FROM (SELECT event_id AS frame_id, user_id AS room_id, {_US} / 1e10 AS t, value,
                CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "annotations": f"""
        SELECT rec_id, room_id, ts, verdict, valence, arousal, valence_low, valence_high, arousal_low, arousal_high,
          CASE WHEN guard THEN ['guard', 'no-speech'] ELSE {_CELL} END AS cell
        FROM (SELECT o_orderkey AS rec_id, o_custkey % 50 AS room_id,
          CAST({_DAY} * 600 + o_orderkey * 6151 % 600 AS DOUBLE) AS ts,
          CASE WHEN o_orderkey % 12 = 0 OR o_orderkey * 37 % 201 BETWEEN 126 AND 129 THEN 'wrong' ELSE 'good' END AS verdict,
          o_orderkey % 17 = 0 AS guard,
          CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 37 % 201) / 100.0e0 - 1.0e0 END AS valence,
          CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 53 % 201) / 100.0e0 - 1.0e0 END AS arousal,
          -0.25e0 AS valence_low, CASE WHEN o_orderkey % 3 = 0 THEN 0.30e0 ELSE 0.25e0 END AS valence_high,
          -0.25e0 AS arousal_low, 0.25e0 AS arousal_high, {_RUNG} AS bucket FROM orders)""",
    "overrides": f"""
        SELECT * EXCLUDE (no_cell, guard, bucket),
          CASE WHEN no_cell THEN NULL WHEN guard THEN ['guard', 'no-speech'] ELSE {_CELL} END AS cell
        FROM (SELECT o_orderkey AS rec_id, o_custkey % 50 AS room_id,
          CAST({_DAY} * 600 + o_orderkey * 7919 % 600 AS DOUBLE) AS ts,
          CASE o_orderkey % 10 WHEN 0 THEN 'skip' WHEN 1 THEN 'wrong_vibe' WHEN 2 THEN 'manual' ELSE 'played_through' END AS action,
          CAST(120 + o_orderkey % 240 AS DOUBLE) AS duration_s,
          CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey * 131 % 5000) / 10.0e0 END AS headcount_staleness_s,
          CASE WHEN o_orderkey % 29 <> 0 THEN (o_orderkey * 17 % 1300) / 10.0e0 END AS emotion_staleness_s,
          CASE WHEN o_orderkey % 31 <> 0 THEN (o_orderkey * 13 % 101) / 100.0e0 END AS speech_ratio,
          o_orderkey % 4 <> 0 AS playback_active,
          CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 37 % 201) / 100.0e0 - 1.0e0 END AS valence,
          CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 53 % 201) / 100.0e0 - 1.0e0 END AS arousal,
          -0.25e0 AS valence_low, CASE WHEN o_orderkey % 3 = 0 THEN 0.30e0 ELSE 0.25e0 END AS valence_high,
          -0.25e0 AS arousal_low, 0.25e0 AS arousal_high,
          o_orderkey % 19 = 0 AS no_cell, o_orderkey % 17 = 0 AS guard, {_RUNG} AS bucket,
          CASE WHEN o_orderkey % 38 = 0 THEN 'manual' END AS source,
          CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 71 % 201) / 100.0e0 - 1.0e0 END AS target_arousal,
          CASE o_orderkey % 4 WHEN 0 THEN 'raise' WHEN 1 THEN 'lower' WHEN 2 THEN 'hold' END AS energy_action,
          CASE WHEN o_orderkey % 10 = 2 AND o_orderkey % 7 <> 0 THEN CASE o_orderkey * 3 % 11 % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END END AS chosen_tier,
          CASE WHEN o_orderkey % 5 <> 4 THEN CASE o_orderkey * 7 % 3 WHEN 0 THEN 'Jazz' WHEN 1 THEN 'Rock' ELSE 'Pop' END END AS genre,
          CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey % 2 = 0 END AS stamped_occupied,
          CASE WHEN o_orderkey % 41 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'fresh' ELSE 'absent' END END AS stamped_basis
          FROM orders)""",
    "evidence": """
        SELECT vec_id AS evidence_id, CAST(floor(vec_id / 25) AS BIGINT) AS room_id, 2.0e0 * (vec_id % 25) AS at,
          0.75e0 + 0.125e0 * (vec_id % 5) AS duration_s, CAST(label AS BIGINT) AS label,
          CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "now_playing_obs": f"""
        SELECT obs_id, room_id, t, concat('trk', CAST(CAST(floor(t / 20) AS BIGINT) % 8 AS VARCHAR)) AS track_id,
          t - 20.0e0 * floor(t / 20) AS progress_s, 20.0e0 AS duration_s, obs_id % 10 <> 0 AS is_playing
        FROM (SELECT event_id AS obs_id, user_id AS room_id, {_US} / 1e10 AS t FROM events)""",
    "selections": f"""
        SELECT event_id AS pick_id, user_id AS room_id, {_US} / 1e10 AS t,
          concat('trk', CAST(event_id * 5 % 12 AS VARCHAR)) AS track_id FROM events WHERE event_type = 'click'""",
    "track_vetoes": f"""
        SELECT event_id AS veto_id, user_id AS room_id, {_US} / 1e10 AS t,
          concat('trk', CAST(event_id * 7 % 30 AS VARCHAR)) AS track_id FROM events WHERE event_type = 'error'""",
    "tracks": """
        SELECT p_partkey AS track_id, p_name AS title, p_type AS genre,
          CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS tier,
          CAST(120 + p_partkey % 240 AS DOUBLE) AS duration_s, p_brand AS playlist_id FROM part""",
    "phases": """
        SELECT * FROM (VALUES ('baseline', 0.0e0, 60.0e0), ('music', 60.0e0, 130.0e0), ('pull', 130.0e0, 190.0e0),
          ('animated', 190.0e0, 260.0e0)) p(phase, start_s, end_s)""",
    "rulebook": "SELECT * FROM (VALUES " + ", ".join(
        f"('{b}', '{v}', '{a}', {pool!r})" for b, v, a, pool in C.rulebook_rows()) + ") r(bucket, vband, aband, pool)",
    # The retro gate: last tap by an as-of join, then the presence criterion, then the blind gate.
    "taps": """
        SELECT room_id, ts AS tap_ts FROM annotations
        UNION ALL SELECT room_id, ts FROM overrides WHERE action IS DISTINCT FROM 'played_through'""",
    "gated": """
        SELECT *, CASE WHEN action = 'played_through' THEN CASE WHEN occupied THEN 'usable' ELSE 'suspect' END
             WHEN action IN ('skip', 'wrong_vibe', 'manual') AND playback_active AND coalesce(speech_ratio, 1.0) <= 0.05
                  AND coalesce(emotion_staleness_s, 0) > 60 THEN 'blind' ELSE 'usable' END AS gate
        FROM (SELECT *, coalesce(stamped_occupied, retro IN ('fresh', 'handoff', 'tap')) AS occupied,
                coalesce(stamped_basis, retro) AS basis, stamped_occupied IS NOT NULL AS stamped
          FROM (SELECT *, CASE WHEN stale IS NULL THEN CASE WHEN tapped THEN 'tap' ELSE 'unknown' END
                  WHEN stale <= 60 THEN 'fresh' WHEN stale BETWEEN duration_s AND duration_s + 30 THEN 'handoff'
                  WHEN tapped THEN 'tap' ELSE 'absent' END AS retro
            FROM (SELECT o.*, coalesce(headcount_staleness_s, emotion_staleness_s) AS stale,
                    EXISTS (SELECT 1 FROM taps p WHERE p.room_id = o.room_id
                            AND p.tap_ts BETWEEN o.ts - o.duration_s AND o.ts) AS tapped
                  FROM overrides o)))""",
    "usable": "SELECT * FROM gated WHERE gate = 'usable'",
}

_NEEDS = {"taps": ("annotations", "overrides"), "gated": ("annotations", "overrides", "taps"),
          "usable": ("annotations", "overrides", "taps", "gated")}


def with_views(names: str, body: str, *more: str) -> str:
    """WITH RECURSIVE clause over the named views and further CTEs, then the body."""
    wanted = []
    for name in names.split():
        for n in (*_NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in wanted] + list(more)
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def ema_cte(name: str, src: str, key: str, tau: float, **values: str) -> str:
    """Sequential average over src(key, rn, t, ...): one recursion step per row of a key."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in values.items())
    step = ", ".join(f"e.{n} + (1 - exp(-greatest(1e-6, s.t - e.t) / {tau})) * (s.{x} - e.{n})" for n, x in values.items())
    return f"""{name} AS (SELECT {key}, rn, t, {first} FROM {src} WHERE rn = 1
      UNION ALL SELECT s.{key}, s.rn, s.t, {step} FROM {name} e JOIN {src} s ON s.{key} = e.{key} AND s.rn = e.rn + 1)"""
