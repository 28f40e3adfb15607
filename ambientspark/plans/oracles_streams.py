"""DuckDB statements of the streamed queries: what the batch form of each operator gives."""

from __future__ import annotations

from ambientspark.functions import constants as C
from ambientspark.plans import oracles_labels, oracles_rooms, oracles_ticks
from ambientspark.plans.oracle_views import ema_cte, with_views
from ambientspark.plans.oracles_ticks import clamp, energy, trend

_LABELS, _TICKS, _ROOMS = oracles_labels.ORACLES, oracles_ticks.ORACLES, oracles_rooms.ORACLES

ORACLES = {
    "stream_smoothing": _TICKS["ema_loudness"],
    "stream_noise_floor": _TICKS["noise_floor"],
    "stream_hysteresis": _TICKS["hysteresis_bucket"].replace("SELECT frame_id, candidate, b AS published", "SELECT frame_id, b AS published"),
    "stream_dwell": _TICKS["emit_on_change"],
    "stream_throttle": _TICKS["throttle"],
    "stream_evidence": with_views("evidence", """SELECT k.evidence_id AS frame_id, sum(e.duration_s) AS evidence_s, count(*) AS segments
        FROM evidence k JOIN evidence e ON e.room_id = k.room_id AND e.at BETWEEN k.at - 90 AND k.at GROUP BY 1"""),
    "stream_headcount": with_views("evidence", """SELECT buffer AS frame_id, raw_clusters, round(fragmentation, 6) AS fragmentation, round(separation, 6) AS separation,
        round(dispersion, 6) AS dispersion FROM numbers""", *oracles_rooms._ESTIMATES[:-1]),
    "stream_evidence_timeouts": with_views("evidence", """SELECT k.room_id, k."at" + 90 AS t, count(e."at") AS segments, coalesce(sum(e.duration_s), 0) AS evidence_s
        FROM (SELECT DISTINCT room_id, "at" FROM evidence) k LEFT JOIN evidence e ON e.room_id = k.room_id AND e."at" > k."at" AND e."at" <= k."at" + 90 GROUP BY 1, 2"""),
    "stream_room": with_views("frames", f"""SELECT frame_id, round(l, 6) AS loudness, round(a, 6) AS activity, round(s, 6) AS speech, round(fl, 6) AS floor, round(ev, 6) AS valence,
          round(ea, 6) AS arousal, round(energy, 6) AS energy, {trend('energy')} AS trend
        FROM (SELECT f.*, d.l, d.a, d.s, q.x AS fl, e.v AS ev, e.a AS ea, {energy('d.l', 'd.a', 'd.s', 'e.a')} AS energy
          FROM frames f JOIN dsp d USING (room_id, rn) LEFT JOIN emo e ON e.room_id = f.room_id AND e.rn = f.rn - f.rn_first + 1
          ASOF LEFT JOIN q ON f.room_id = q.room_id AND f.t >= q.t)""".replace("FROM frames f JOIN", "FROM numbered f JOIN"),
        """numbered AS MATERIALIZED (SELECT f.*, s.rn_first FROM frames f LEFT JOIN (
          SELECT room_id, min(rn) AS rn_first FROM frames WHERE frame_id % 3 <> 0 GROUP BY 1) s USING (room_id))""",
        f"""emo_src AS MATERIALIZED (SELECT room_id, t, rn - rn_first + 1 AS rn, CASE WHEN pv IS NULL THEN hv ELSE {clamp('hv - pv')} END AS hv, CASE WHEN pa IS NULL THEN ha ELSE {clamp('ha - pa')} END AS ha
          FROM (SELECT *, {clamp('0.5e0 * pull_v', '-0.6e0', '0.6e0')} AS pv, {clamp('0.5e0 * pull_a', '-0.6e0', '0.6e0')} AS pa FROM (
            SELECT room_id, t, rn, rn_first, last_value(CASE WHEN frame_id % 3 <> 0 THEN v_raw END IGNORE NULLS) OVER w AS hv,
              last_value(CASE WHEN frame_id % 3 <> 0 THEN a_raw END IGNORE NULLS) OVER w AS ha,
              CASE WHEN playback_active THEN (frame_id % 7 - 3) / 7.0e0 END AS pull_v, CASE WHEN playback_active THEN (frame_id % 5 - 2) / 5.0e0 END AS pull_a
            FROM numbered WINDOW w AS (PARTITION BY room_id ORDER BY rn))) WHERE rn >= rn_first)""",
        ema_cte("emo", "emo_src", "room_id", 10.0, v="hv", a="ha"),
        "quiet AS MATERIALIZED (SELECT room_id, t, loudness_raw AS x, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM frames WHERE speech_raw < 0.1)",
        ema_cte("q", "quiet", "room_id", 60.0, x="x"), ema_cte("dsp", "frames", "room_id", 6.0, l="loudness_raw", a="activity_raw", s="speech_raw")),
    "stream_late": with_views("frames", """SELECT room_id, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE late) AS counted, count(*) FILTER (WHERE NOT late) AS in_order
        FROM (SELECT room_id, frame_id % 100 = 0 AND coalesce(t < max(CASE WHEN frame_id % 100 <> 0 THEN t END) OVER (PARTITION BY room_id), false) AS late FROM frames) GROUP BY 1"""),
    "stream_held_bucket": with_views("frames", """SELECT f.frame_id, b.bucket, CASE WHEN b.t IS NOT NULL THEN round(f.t - b.t, 6) END AS headcount_staleness_s
        FROM frames f ASOF LEFT JOIN (SELECT room_id, t, rn, CAST(CAST(floor(log2_est) AS BIGINT) AS VARCHAR) AS bucket FROM frames WHERE speech_raw >= 0.5) b
          ON f.room_id = b.room_id AND f.rn >= b.rn"""),
    "stream_latest_wins": with_views("frames", """SELECT frame_id, o_frame AS window_id, o_kind AS window_kind, round(o_age, 6) AS age_s FROM walk WHERE o_frame IS NOT NULL""",
        """src AS MATERIALIZED (SELECT *, CASE WHEN frame_id % 3 = 0 THEN 'take' WHEN speech_raw >= 0.3e0 THEN 'speech' ELSE 'reference' END AS kind FROM frames)""",
        """walk AS (SELECT room_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS BIGINT) AS p_frame, CAST(NULL AS VARCHAR) AS p_kind,
            CAST(NULL AS DOUBLE) AS p_t, CAST(NULL AS BIGINT) AS o_frame, CAST(NULL AS VARCHAR) AS o_kind, CAST(NULL AS DOUBLE) AS o_age FROM (SELECT DISTINCT room_id FROM src)
          UNION ALL SELECT room_id, rn, frame_id, CASE WHEN taken AND p_frame IS NOT NULL THEN t ELSE last END,
            CASE WHEN taken THEN NULL WHEN offered THEN frame_id ELSE p_frame END, CASE WHEN taken THEN NULL WHEN offered THEN kind ELSE p_kind END, CASE WHEN taken THEN NULL WHEN offered THEN t ELSE p_t END,
            CASE WHEN taken THEN p_frame END, CASE WHEN taken THEN p_kind END, CASE WHEN taken AND p_frame IS NOT NULL THEN t - p_t END
          FROM (SELECT s.room_id, s.rn, s.frame_id, s.t, s.kind, w.last, w.p_frame, w.p_kind, w.p_t, s.kind = 'take' AS taken,
              (w.last IS NULL OR s.t - w.last >= 4) AND NOT (s.kind = 'reference' AND coalesce(w.p_kind = 'speech', false)) AS offered
            FROM walk w JOIN src s ON s.room_id = w.room_id AND s.rn = w.rn + 1))"""),
    "stream_tap_age": _LABELS["last_tap_age"],
    "stream_completions": _ROOMS["played_through"],
    "stream_sliding": with_views("frames", f"""
        SELECT room_id, CAST((k * 2 + 5) * 1000000 AS BIGINT) AS window_end_us, count(*) AS chunks,
          round(avg(CASE WHEN speech_raw >= {C.CERT_THRESHOLD} THEN 1.0e0 ELSE 0.0e0 END), 6) AS speech_ratio
        FROM frames JOIN range(-3, 200) r(k) ON t >= k * 2 AND t < k * 2 + 5 GROUP BY room_id, k"""),
}
