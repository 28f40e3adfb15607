"""DuckDB statements for the tick queries: plain sequential formulations (recursive CTEs, ASOF joins)."""

from __future__ import annotations

from ambientspark.functions import constants as C
from ambientspark.plans.oracle_views import ema_cte, with_views

_LADDER = "[" + ", ".join(f"'{b}'" for b in C.LADDER) + "]"


def clamp(x, lo="-1.0e0", hi="1.0e0"):
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


def ramp(x, lo, hi):
    return f"least(1.0e0, greatest(0.0e0, ({x} - {lo}) / ({hi} - {lo})))"


def mood(v, a):
    return f"""CASE WHEN {v} IS NULL OR {a} IS NULL THEN NULL WHEN {a} >= 0 THEN CASE WHEN {v} >= 0 THEN 'excited' ELSE 'tense' END
        ELSE CASE WHEN {v} >= 0 THEN 'chill' ELSE 'flat' END END"""


def band(x):
    return f"CASE WHEN {x} > 0.25e0 THEN 'high' WHEN {x} > -0.25e0 THEN 'mid' WHEN {x} IS NOT NULL THEN 'low' END"


def energy(loud, act, speech, arousal):
    base = (f"(0.3e0 * least(1, greatest(0, ({loud} + 60.0e0) / 50.0e0)) + 0.2e0 * least(1, greatest(0, {act} / 4.0e0))"
            f" + 0.25e0 * least(1, greatest(0, {speech})))")
    return (f"CASE WHEN {arousal} IS NULL THEN {base} / 0.75e0 ELSE {base} + 0.25e0 * "
            f"least(1, greatest(0, ({arousal} + 1.0e0) / 2.0e0)) END")


def rung(x):
    return f"CAST(least(11, round_even(greatest({x}, 0), 0)) AS BIGINT)"


def bucket(x):
    return f"{_LADDER}[{rung(x)} + 1]"


def pyround(x, digits):
    """The correctly rounded decimal of the double (printf works on its exact value)."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def trend(x):
    """Slope label over the 60 s window; x may be null."""
    w = f"(PARTITION BY room_id ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)"
    ok = (f"{x} IS NOT NULL AND count({x}) OVER {w} >= 5 AND t - min(CASE WHEN {x} IS NOT NULL THEN t END) OVER {w} >= 15")
    slope = f"regr_slope({x}, t) OVER {w} * 60"
    return f"CASE WHEN {ok} AND {slope} > 0.1e0 THEN 'rising' WHEN {ok} AND {slope} < -0.1e0 THEN 'falling' ELSE 'stable' END"


_READINGS = """readings AS MATERIALIZED (SELECT room_id, t AS at, frame_id AS reading_id, v_raw AS valence, a_raw AS arousal,
    speech_raw AS confidence FROM frames WHERE speech_raw >= 0.2)"""
_HELD = """held AS MATERIALIZED (SELECT f.*, r.at, r.reading_id, r.valence, r.arousal, r.confidence,
    CASE WHEN r.at IS NOT NULL THEN greatest(0, f.t - r.at) END AS staleness_s
    FROM frames f ASOF LEFT JOIN readings r ON f.room_id = r.room_id AND f.t >= r.at)"""
_M = f"CASE WHEN playback_active THEN {ramp('high_share', '0.05e0', '0.3e0')} END"

# Banking: the first tick that holds a reading, while fresh; then the clean / pull split.
_BANK = f"""bank AS MATERIALIZED (SELECT *, banked AND (NOT playback_active OR coalesce(m <= 0.1e0, false)) AS clean
    FROM (SELECT *, {_M} AS m, "at" IS NOT NULL AND "at" IS DISTINCT FROM lag("at") OVER (PARTITION BY room_id ORDER BY rn)
          AND staleness_s <= 4 AS banked FROM held))"""
_CLEAN = "clean_rows AS MATERIALIZED (SELECT room_id, t, valence, arousal, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM bank WHERE clean)"
_BASE = ema_cte("base", "clean_rows", "room_id", 20.0, valence="valence", arousal="arousal")
_MEASURED = """measured AS MATERIALIZED (SELECT *,
    CASE WHEN usable THEN (valence - base_valence) / m END AS pull_v, CASE WHEN usable THEN (arousal - base_arousal) / m END AS pull_a
    FROM (SELECT *, banked AND NOT clean AND track_id IS NOT NULL AND coalesce(m >= 0.25e0, false) AND base_valence IS NOT NULL AS usable
      FROM (SELECT k.*, CASE WHEN k.t - b.t <= 300 THEN b.valence END AS base_valence,
              CASE WHEN k.t - b.t <= 300 THEN b.arousal END AS base_arousal
            FROM bank k ASOF LEFT JOIN base b ON k.room_id = b.room_id AND k.t >= b.t)))"""
MEASURED = (_READINGS, _HELD, _BANK, _CLEAN, _BASE, _MEASURED)


def signature_cte(name, src, v, a):
    """Adaptive mean alpha = 1 / min(n, 20) per track over src(track_id, rn, t, frame_id, v, a)."""
    return f"""{name} AS (SELECT track_id, rn, t, frame_id, CAST({v} AS DOUBLE) AS sv, CAST({a} AS DOUBLE) AS sa FROM {src} WHERE rn = 1
      UNION ALL SELECT s.track_id, s.rn, s.t, s.frame_id, e.sv + (s.{v} - e.sv) / least(s.rn, 20), e.sa + (s.{a} - e.sa) / least(s.rn, 20)
      FROM {name} e JOIN {src} s ON s.track_id = e.track_id AND s.rn = e.rn + 1)"""


_TAP_SRC = """tap_src AS MATERIALIZED (SELECT track_id, t, frame_id, v_raw, a_raw, row_number() OVER (PARTITION BY track_id ORDER BY t, frame_id) AS rn
    FROM frames WHERE playback_active AND track_id IS NOT NULL AND speech_raw <= 0.1)"""
_SIG = signature_cte("sig", "tap_src", "v_raw", "a_raw")
_PULL_SRC = """pull_src AS MATERIALIZED (SELECT track_id, t, frame_id, pull_v, pull_a, row_number() OVER (PARTITION BY track_id ORDER BY t, frame_id) AS rn
    FROM measured WHERE pull_v IS NOT NULL)"""
_PULL = signature_cte("pull", "pull_src", "pull_v", "pull_a")
# Per tick the newest signature row of its track at or before (t, frame_id).
_LOOKED = """looked AS MATERIALIZED (SELECT m.*, coalesce(s.rn, 0) AS refs, s.sv, s.sa, coalesce(p.rn, 0) AS pull_refs, p.sv AS pv, p.sa AS pa
    FROM measured m ASOF LEFT JOIN sig s ON m.track_id = s.track_id AND m.t >= s.t
      ASOF LEFT JOIN pull p ON m.track_id = p.track_id AND m.t >= p.t)"""
SIGNED = (*MEASURED, _TAP_SRC, _SIG, _PULL_SRC, _PULL, _LOOKED)
_CORR = f"""corr AS MATERIALIZED (SELECT *, {clamp('scale_v * m * bv', '-0.6e0', '0.6e0')} AS dv, {clamp('scale_a * m * ba', '-0.6e0', '0.6e0')} AS da FROM (
    SELECT *, CASE basis WHEN 'pull' THEN pv WHEN 'standalone' THEN sv END AS bv, CASE basis WHEN 'pull' THEN pa WHEN 'standalone' THEN sa END AS ba,
      CASE basis WHEN 'pull' THEN 1.0e0 WHEN 'standalone' THEN 2.2e0 END AS scale_v, CASE basis WHEN 'pull' THEN 1.0e0 WHEN 'standalone' THEN 1.5e0 END AS scale_a,
      CASE basis WHEN 'pull' THEN pull_refs WHEN 'standalone' THEN refs END AS basis_refs
    FROM (SELECT *, CASE WHEN "at" IS NULL OR NOT coalesce(m > 0, false) THEN NULL WHEN pull_refs >= 3 THEN 'pull' WHEN refs >= 3 THEN 'standalone' END AS basis FROM looked)))"""
_CORRECTED = f"""corrected AS MATERIALIZED (SELECT *, CASE WHEN basis IS NULL THEN valence ELSE {clamp('valence - dv')} END AS v_inst,
    CASE WHEN basis IS NULL THEN arousal ELSE {clamp('arousal - da')} END AS a_inst,
    CASE WHEN basis IS NULL AND m > 0 THEN confidence * greatest(0, 1 - 0.5e0 * m) ELSE confidence END AS emotion_confidence FROM corr)"""
CORRECTED = (*SIGNED, _CORR, _CORRECTED)


def held_ema(name, src, tau, v, a):
    """Averages over rows with a reading, renumbered; the reading never goes away once there."""
    return (f"""{name}_src AS MATERIALIZED (SELECT room_id, frame_id, t, {v} AS v, {a} AS a, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM {src} WHERE "at" IS NOT NULL)""",
            ema_cte(name, f"{name}_src", "room_id", tau, v="v", a="a"))


_STATES = f"""states AS MATERIALIZED (SELECT *, {trend('energy')} AS trend, {trend('valence')} AS valence_trend, {trend('arousal')} AS arousal_trend,
      CASE WHEN frame_id % 17 <> 0 THEN {mood('valence', 'arousal')} END AS mood FROM (
    SELECT room_id, t, frame_id, rn, CASE WHEN frame_id % 11 <> 0 THEN v_raw END AS valence, CASE WHEN frame_id % 11 <> 0 THEN a_raw END AS arousal,
      speech_raw AS speech_ratio, high_share AS emotion_confidence, (frame_id * 29 % 101) / 100.0e0 AS headcount_confidence,
      CASE WHEN frame_id % 13 <> 0 THEN {bucket('log2_est')} END AS bucket,
      {energy('loudness_raw', 'activity_raw', 'speech_raw', 'a_raw')} AS energy FROM frames))"""
_REASON = """CASE WHEN speech_ratio < 0.1e0 THEN 'no-speech' WHEN mood IS NULL OR valence IS NULL OR arousal IS NULL THEN 'no-emotion'
    WHEN bucket IS NULL THEN 'no-headcount' WHEN headcount_confidence < 0.35e0 THEN 'uncertain-regime' END"""
_CANDS = f"""cands AS MATERIALIZED (SELECT *,
    {pyround("t_v", 3)} AS target_valence, {pyround("t_a", 3)} AS target_arousal,
    CASE WHEN reason IS NOT NULL THEN 0.15e0 ELSE {pyround("least(1, greatest(0, 0.5e0 * coalesce(emotion_confidence, 0) + 0.5e0 * coalesce(headcount_confidence, 0)))", 2)} END AS confidence,
    CASE WHEN reason IS NOT NULL THEN 'insufficient signal (' || reason || ') — hold current energy'
      ELSE mood || ' room, ~' || bucket || ' people → ' || array_to_string(pool, ' / ') || '; ' || energy_action || ' energy' END AS summary,
    CASE WHEN reason IS NOT NULL THEN 'guard / ' || reason ELSE bucket || ' / ' || vband || ' / ' || aband END AS cell
  FROM (SELECT *,
      CASE WHEN reason IS NOT NULL THEN coalesce(valence, 0) ELSE {clamp("(valence + CASE valence_trend WHEN 'rising' THEN 0.15e0 WHEN 'falling' THEN -0.15e0 ELSE 0 END)")} END AS t_v,
      CASE WHEN reason IS NOT NULL THEN coalesce(arousal, 0) ELSE {clamp("(arousal + CASE energy_action WHEN 'raise' THEN 0.15e0 WHEN 'lower' THEN -0.15e0 ELSE 0 END)")} END AS t_a
  FROM (SELECT s.*, r.pool, CASE WHEN reason IS NOT NULL THEN 'hold'
          WHEN (CASE WHEN arousal_trend <> 'stable' THEN arousal_trend ELSE trend END) = 'rising' THEN 'raise'
          WHEN (CASE WHEN arousal_trend <> 'stable' THEN arousal_trend ELSE trend END) = 'falling' THEN 'lower' ELSE 'hold' END AS energy_action
        FROM (SELECT *, {_REASON} AS reason, {band('valence')} AS vband, {band('arousal')} AS aband FROM states) s
        LEFT JOIN rulebook r USING (bucket, vband, aband))))"""
_NEAR = """near AS MATERIALIZED (SELECT c.frame_id, o, i, n.pool[i] AS g FROM cands c
            JOIN (VALUES (0, 0, 1), (1, 0, -1), (2, 1, 0), (3, -1, 0)) d(o, dv, da) ON c.reason IS NULL
            JOIN rulebook n ON n.bucket = c.bucket
              AND list_position(['low', 'mid', 'high'], n.vband) = list_position(['low', 'mid', 'high'], c.vband) + dv
              AND list_position(['low', 'mid', 'high'], n.aband) = list_position(['low', 'mid', 'high'], c.aband) + da
            JOIN range(1, 3) r(i) ON i <= len(n.pool) WHERE NOT list_contains(c.pool, n.pool[i]))"""
_REC_OUT = """frame_id, energy_action, round(target_valence, 6) AS target_valence, round(target_arousal, 6) AS target_arousal,
    CASE WHEN reason IS NULL THEN array_to_string(pool, ' / ') ELSE '' END AS pool, round(confidence, 6) AS confidence, summary, cell, 0.25e0 AS valence_high"""


def keep_cte(name, src, cond, cols):
    """Greedy filter: walks every row of a room and carries the last kept one (k_*)."""
    first = ", ".join(f"{c} AS k_{c}" for c in cols)
    step = ", ".join(f"CASE WHEN {cond} THEN s.{c} ELSE e.k_{c} END" for c in cols)
    return f"""{name} AS (SELECT room_id, rn, frame_id, true AS kept, {first} FROM {src} WHERE rn = 1
      UNION ALL SELECT s.room_id, s.rn, s.frame_id, {cond}, {step} FROM {name} e JOIN {src} s ON s.room_id = e.room_id AND s.rn = e.rn + 1)"""


_F = "frames"
_MASKED = """masked AS MATERIALIZED (SELECT frame_id, i, (frame_id * 7 + floor(i / (9 + frame_id % 50))) % 3 <> 0 AS on_, n
    FROM (SELECT frame_id, 96 + frame_id % 61 AS n FROM frames) b, LATERAL (SELECT unnest(range(b.n)) AS i) u)"""
_RUNS = """runs AS MATERIALIZED (SELECT frame_id, min(i) AS start_chunk, max(i) + 1 AS end_chunk, max(n) AS n FROM (
    SELECT frame_id, i, n, i - row_number() OVER (PARTITION BY frame_id ORDER BY i) AS g FROM masked WHERE on_) GROUP BY frame_id, g)"""

ORACLES = {
    "energy_mood": with_views(_F, f"""
        SELECT frame_id, round({energy('loudness_raw', 'activity_raw', 'speech_raw', 'a')}, 6) AS energy, {mood('v_raw', 'a')} AS mood,
          {band('v_raw')} AS vband, {band('a')} AS aband FROM (SELECT *, CASE WHEN frame_id % 9 <> 0 THEN a_raw END AS a FROM frames)"""),
    "unit_scalars": with_views(_F, f"""
        SELECT frame_id, round({clamp('(v_raw * 1.5e0)')}, 6) AS clamped, round({ramp('speech_raw', '0.6e0', '0.95e0')}, 6) AS ramped,
          CASE WHEN speech_raw >= 0.5 THEN 1.0e0 ELSE 0.0e0 END AS stepped, round({clamp('(2 * speech_raw - 1)')}, 6) AS rescaled,
          round({_M}, 6) AS dominance, CASE WHEN playback_active THEN 0.75e0 ELSE 0.5e0 END AS threshold FROM frames"""),
    "occupancy_rungs": with_views(_F, f"SELECT frame_id, {rung('log2_est')} AS rung, {bucket('log2_est')} AS bucket FROM frames"),
    "display_labels": with_views(_F, """
        SELECT frame_id, CASE WHEN speech_raw < 0.25 THEN 'counting' WHEN speech_raw < 0.75 THEN 'blend' ELSE 'crowd' END AS regime,
          CASE WHEN high_share >= 0.7 THEN '±0 rungs' WHEN high_share >= 0.4 THEN '±1 rung' ELSE '±2+ rungs' END AS doubt,
          CASE WHEN speech_raw >= 0.2 THEN 'speech' ELSE 'quiet' END AS voice, activity_raw * 10 > 30 AS stale,
          CASE WHEN frame_id % 3 = 0 AND track_id IS NOT NULL THEN 'live' WHEN frame_id % 3 = 1 THEN 'degraded' ELSE 'shadow' END AS mode,
          strftime(to_timestamp(frame_id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS stamp FROM frames"""),
    "published_state": with_views(_F, f"""
        SELECT frame_id, {pyround('loudness_raw / 3', 1)} AS loudness_dbfs, {pyround('activity_raw / 7', 2)} AS activity_density,
          {pyround('speech_raw / 3', 3)} AS speech_ratio,
          round(v_raw + CASE WHEN playback_active THEN high_share ELSE 0 END, 6) AS raw_valence FROM frames"""),
    "tier_labels": with_views(_F, """
        SELECT frame_id, ['low', 'mid', 'high'][1 + greatest(0, least(2, CASE WHEN a_raw > 0.25 THEN 2 WHEN a_raw > -0.25 THEN 1 ELSE 0 END
          + CASE frame_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END))] AS tier FROM frames"""),
    "playlist_ids": with_views("tracks", "SELECT track_id, 'P' || track_id AS playlist FROM tracks"),
    "ema_loudness": with_views(_F, "SELECT frame_id, round(l, 6) AS loudness, round(a, 6) AS activity, round(s, 6) AS speech FROM e JOIN frames USING (room_id, rn)",
                               ema_cte("e", "frames", "room_id", 6.0, l="loudness_raw", a="activity_raw", s="speech_raw")),
    "noise_floor": with_views(_F, "SELECT f.frame_id, round(e.x, 6) AS floor FROM frames f ASOF LEFT JOIN e ON f.room_id = e.room_id AND f.t >= e.t",
        "q AS MATERIALIZED (SELECT room_id, t, loudness_raw AS x, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM frames WHERE speech_raw < 0.1)",
        ema_cte("e", "q", "room_id", 60.0, x="x")),
    "linear_scan": with_views(_F, "SELECT frame_id, round(y, 6) AS y FROM e JOIN frames USING (room_id, rn)",
        """e AS (SELECT room_id, rn, speech_raw AS y FROM frames WHERE rn = 1 UNION ALL
           SELECT s.room_id, s.rn, CASE WHEN s.playback_active THEN exp(-0.1e0) * e.y ELSE 0 END + s.speech_raw FROM e JOIN frames s ON s.room_id = e.room_id AND s.rn = e.rn + 1)"""),
    "trend_energy": with_views(_F, f"SELECT frame_id, {trend('energy')} AS trend FROM (SELECT *, {energy('loudness_raw', 'activity_raw', 'speech_raw', 'a_raw')} AS energy FROM frames)"),
    "va_trend": with_views(_F, f"SELECT frame_id, {trend('v')} AS valence_trend, {trend('a')} AS arousal_trend FROM (SELECT *, CASE WHEN frame_id % 7 <> 0 THEN v_raw END AS v, CASE WHEN frame_id % 7 <> 0 THEN a_raw END AS a FROM frames)"),
    "hysteresis_bucket": with_views(_F, "SELECT frame_id, candidate, b AS published FROM h JOIN src USING (room_id, rn)",
        "src AS MATERIALIZED (SELECT room_id, rn, frame_id, CAST(floor(log2_est / 6) AS BIGINT) AS candidate FROM frames)",
        """h AS (SELECT room_id, rn, candidate AS b, CAST(NULL AS BIGINT) AS pend, 0 AS cnt FROM src WHERE rn = 1 UNION ALL
           SELECT room_id, rn, CASE WHEN c >= 3 THEN candidate ELSE b END, CASE WHEN c >= 3 THEN NULL ELSE pend END, CASE WHEN c >= 3 THEN 0 ELSE c END FROM (
             SELECT s.room_id, s.rn, s.candidate, h.b, CASE WHEN s.candidate = h.b THEN NULL ELSE s.candidate END AS pend,
               CASE WHEN s.candidate = h.b THEN 0 WHEN s.candidate = h.pend THEN h.cnt + 1 ELSE 1 END AS c
             FROM h JOIN src s ON s.room_id = h.room_id AND s.rn = h.rn + 1))"""),
    "bucket_smoother": with_views(_F, f"SELECT frame_id, round(x, 6) AS smoothed_log2, {_LADDER}[b + 1] AS bucket FROM h JOIN src USING (room_id, rn)",
        ema_cte("e", "frames", "room_id", 20.0, x="log2_est"),
        f"src AS MATERIALIZED (SELECT room_id, rn, frame_id, x, {rung('x')} AS candidate FROM e JOIN frames USING (room_id, rn))",
        """h AS (SELECT room_id, rn, candidate AS b, CAST(NULL AS BIGINT) AS pend, 0 AS cnt FROM src WHERE rn = 1 UNION ALL
           SELECT room_id, rn, CASE WHEN c >= 3 THEN candidate ELSE b END, CASE WHEN c >= 3 THEN NULL ELSE pend END, CASE WHEN c >= 3 THEN 0 ELSE c END FROM (
             SELECT s.room_id, s.rn, s.candidate, h.b, CASE WHEN s.candidate = h.b THEN NULL ELSE s.candidate END AS pend,
               CASE WHEN s.candidate = h.b THEN 0 WHEN s.candidate = h.pend THEN h.cnt + 1 ELSE 1 END AS c
             FROM h JOIN src s ON s.room_id = h.room_id AND s.rn = h.rn + 1))"""),
    "envelope_advisory": with_views(_F, "SELECT frame_id, anchor, k AS blind_streak, k >= 4 AS envelope_advisory FROM h JOIN src USING (room_id, rn)",
        """src AS MATERIALIZED (SELECT room_id, rn, frame_id, playback_active, CASE WHEN frame_id % 5 <> 0 THEN -50.0e0 + frame_id % 7 END AS floor,
             CASE WHEN frame_id % 11 <> 0 THEN -38.0e0 + frame_id % 3 END AS loud, CASE WHEN frame_id % 13 <> 0 THEN CAST(frame_id % 17 = 0 AS INT) * 0.5e0 END AS speech FROM frames)""",
        """h AS (SELECT room_id, 0::BIGINT AS rn, CAST(NULL AS DOUBLE) AS anchor, 0::BIGINT AS k FROM src WHERE rn = 1 UNION ALL
           SELECT room_id, rn, anchor, CASE WHEN NOT playback_active THEN 0 WHEN coalesce(coalesce(loud, ref) - ref >= 10 AND coalesce(speech, 1) <= 0.05, false) THEN k + 1 ELSE 0 END FROM (
             SELECT s.room_id, s.rn, s.playback_active, s.loud, s.speech, h.k, CASE WHEN NOT s.playback_active AND s.floor IS NOT NULL THEN s.floor ELSE h.anchor END AS anchor,
               coalesce(h.anchor, s.floor) AS ref FROM h JOIN src s ON s.room_id = h.room_id AND s.rn = h.rn + 1))"""),
    "anchor_writes": with_views(_F, "SELECT frame_id, round(k_x, 6) AS anchor FROM k WHERE kept",
        "src AS MATERIALIZED (SELECT room_id, frame_id, loudness_raw AS x, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM frames WHERE NOT playback_active)",
        keep_cte("k", "src", "abs(s.x - e.k_x) >= 4", ["x"])),
    "anchor_seed": with_views(_F, """SELECT room_id, round(arg_max(loudness_raw, rn), 6) AS anchor FROM frames WHERE NOT playback_active
        GROUP BY 1 HAVING 260.0e0 - max(t) BETWEEN 0 AND 150"""),
    "recent_values": with_views(_F, """SELECT frame_id, array_to_string(list_transform(list(log2_est) OVER (PARTITION BY room_id ORDER BY rn ROWS 4 PRECEDING),
        lambda x: printf('%.1f', x)), ',') AS recent FROM frames"""),
    "trail": with_views(_F, """SELECT frame_id, count(*) OVER w AS points, round(sum(v_raw) OVER w, 6) AS sum_valence FROM frames
        WINDOW w AS (PARTITION BY room_id ORDER BY t RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)"""),
    "history_tail": with_views(_F, "SELECT room_id, frame_id FROM frames QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY rn DESC) <= 20"),
    "current_recommendation": with_views(_F, "SELECT room_id, arg_max(frame_id, rn) AS frame_id, arg_max(v_raw, rn) AS v_raw FROM frames GROUP BY 1"),
    "throttle": with_views(_F, "SELECT room_id, frame_id FROM k WHERE kept",
        "src AS MATERIALIZED (SELECT room_id, frame_id, t, row_number() OVER (PARTITION BY room_id ORDER BY rn) AS rn FROM frames WHERE speech_raw >= 0.2)",
        keep_cte("k", "src", "s.t - e.k_t >= 8", ["t"])),
    "deadband": with_views(_F, "SELECT room_id, frame_id FROM k WHERE kept", keep_cte("k", "frames", "abs(s.loudness_raw - e.k_loudness_raw) >= 4", ["loudness_raw"])),
    "emit_on_change": with_views(_F, "SELECT room_id, frame_id, k_sig AS sig FROM k WHERE kept",
        "src AS MATERIALIZED (SELECT room_id, rn, frame_id, t, CASE WHEN v_raw > 0.9 THEN 'high' ELSE 'low' END AS sig FROM frames)",
        keep_cte("k", "src", "(s.t - e.k_t >= 9 AND s.sig <> e.k_sig)", ["t", "sig"])),
    "asof_reading": with_views(_F, f"""SELECT frame_id, reading_id, valence, round(staleness_s, 6) AS staleness_s,
        CASE WHEN staleness_s <= 20 THEN {mood('valence', 'arousal')} END AS mood FROM held""", _READINGS, _HELD),
    "asof_playback": with_views("frames now_playing_obs", """
        SELECT frame_id, coalesce(o.is_playing AND o.tr IS NOT NULL, false) AS playback_active, CASE WHEN o.is_playing THEN o.tr END AS playback_track_id
        FROM frames f ASOF LEFT JOIN (SELECT room_id, t, is_playing, CASE WHEN obs_id % 24 <> 0 THEN track_id END AS tr FROM now_playing_obs) o
          ON f.room_id = o.room_id AND f.t >= o.t"""),
    "asof_max_age": with_views(_F, "SELECT frame_id, CASE WHEN staleness_s <= 5 THEN valence END AS valence FROM held", _READINGS, _HELD),
    "clean_baseline": with_views(_F, "SELECT frame_id, banked, clean, round(base_valence, 6) AS base_valence, round(base_arousal, 6) AS base_arousal FROM measured", *MEASURED),
    "pull_samples": with_views(_F, "SELECT frame_id, track_id, round(pull_v, 6) AS pull_v, round(pull_a, 6) AS pull_a FROM measured WHERE pull_v IS NOT NULL", *MEASURED),
    "reference_taps": with_views(_F, "SELECT frame_id, track_id, v_raw, a_raw FROM frames WHERE playback_active AND track_id IS NOT NULL AND speech_raw <= 0.1"),
    "running_signature": with_views(_F, "SELECT frame_id, track_id, rn AS refs, round(sv * sqrt(0.5), 6) AS valence, round(sa * sqrt(0.5), 6) AS arousal FROM sig", _TAP_SRC, _SIG),
    "corrected_emotion": with_views(_F, """SELECT frame_id, round(v_inst, 6) AS v_inst, round(a_inst, 6) AS a_inst, round(dv, 6) AS dv, round(da, 6) AS da,
        basis, basis_refs, round(emotion_confidence, 6) AS emotion_confidence FROM corrected""", *CORRECTED),
    "va_hold_ema": with_views(_F, "SELECT frame_id, round(e.v, 6) AS valence_ema, round(e.a, 6) AS arousal_ema FROM frames f ASOF LEFT JOIN e ON f.room_id = e.room_id AND f.t >= e.t",
                              _READINGS, _HELD, *held_ema("e", "held", 10.0, "valence", "arousal")),
    "signature_lookup": with_views(_F, """SELECT frame_id, refs, pull_refs, CASE WHEN refs >= 3 THEN round(sv, 6) END AS sig_valence,
        round(coalesce(pv, 0), 6) AS pull_valence, round(coalesce(pa, 0), 6) AS pull_arousal FROM looked WHERE track_id IS NOT NULL""", *SIGNED),
    "signature_stats": with_views(_F, """SELECT count(*) AS tracks, count(*) FILTER (WHERE refs > 0) AS with_refs, count(*) FILTER (WHERE refs >= 3) AS trusted,
          count(*) FILTER (WHERE pull_refs > 0) AS with_pull, count(*) FILTER (WHERE pull_refs >= 3) AS pull_trusted,
          CAST(sum(refs) AS BIGINT) AS refs, CAST(sum(pull_refs) AS BIGINT) AS pull_refs
        FROM (SELECT track_id, max(refs) AS refs, max(pull_refs) AS pull_refs FROM looked WHERE track_id IS NOT NULL GROUP BY 1)""", *SIGNED),
    "speech_ratio": with_views(_F, """SELECT frame_id AS chunk_id, round(avg(CASE WHEN speech_raw >= 0.5 THEN 1.0e0 ELSE 0 END) OVER w * CAST(NOT playback_active AS INT)
          + avg(CASE WHEN speech_raw >= 0.75 THEN 1.0e0 ELSE 0 END) OVER w * CAST(playback_active AS INT), 6) AS speech_ratio FROM frames
        WINDOW w AS (PARTITION BY room_id ORDER BY rn ROWS 155 PRECEDING)"""),
    "spectral_short": with_views("evidence", """SELECT evidence_id, round(low / total, 4) AS low, round(mid / total, 4) AS mid, round(high / total, 4) AS high,
          coalesce(onsets, 0) * 250.0e0 AS onset_density
        FROM (SELECT evidence_id, sum(m * m) AS total, sum(m * m) FILTER (WHERE b = 0) AS low, sum(m * m) FILTER (WHERE b = 1) AS mid, sum(m * m) FILTER (WHERE b >= 2) AS high FROM mags GROUP BY 1)
        LEFT JOIN (SELECT evidence_id, count(*) AS onsets FROM (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after,
            avg(x) OVER (PARTITION BY evidence_id) + 1.5e0 * stddev_pop(x) OVER (PARTITION BY evidence_id) AS bar FROM rises WINDOW w AS (PARTITION BY evidence_id ORDER BY f))
          WHERE x > bar AND x >= before AND x >= after GROUP BY 1) USING (evidence_id)""",
        """mags AS MATERIALIZED (SELECT evidence_id, f, b, sqrt(power(sum(v * cos(2 * pi() * b * j / 16)), 2) + power(sum(v * sin(2 * pi() * b * j / 16)), 2)) AS m
          FROM (SELECT evidence_id, f, b, j, embedding[f * 8 + j + 1] * (0.5e0 - 0.5e0 * cos(2 * pi() * j / 15)) AS v FROM evidence, range(0, 7) r(f), range(0, 9) s(b), range(0, 16) u(j)) GROUP BY 1, 2, 3)""",
        "rises AS MATERIALIZED (SELECT evidence_id, f, sum(greatest(m - p, 0)) AS x FROM (SELECT *, lag(m) OVER (PARTITION BY evidence_id, b ORDER BY f) AS p FROM mags) WHERE p IS NOT NULL GROUP BY 1, 2)"),
    "speech_runs": with_views(_F, "SELECT frame_id, start_chunk, end_chunk FROM runs", _MASKED, _RUNS),
    "speech_segments": with_views(_F, """SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY start_sample) - 1 AS pos, start_sample, end_sample
        FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY start_sample) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS k FROM segs) s
        WHERE k <= 6 OR i IN (SELECT round_even(j * ((s.k - 1) / 5.0e0), 0) FROM range(6) r(j))""", _MASKED, _RUNS,
        """spans AS (SELECT frame_id, start_chunk * 512 AS a, least(end_chunk * 512, least(80000, n * 512)) AS b FROM runs)""",
        """segs AS MATERIALIZED (SELECT frame_id, a AS start_sample, b AS end_sample FROM spans WHERE b - a >= 12000 AND b - a <= 20000
           UNION ALL SELECT frame_id, a + i * 10000, a + i * 10000 + 20000 FROM spans, range(20) r(i) WHERE b - a > 20000 AND a + i * 10000 + 20000 <= b)"""),
    "rms_dbfs": with_views("evidence", """SELECT evidence_id, round(greatest(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda x: x * x)) / len(embedding)), 1e-10)), -120), 6) AS dbfs FROM evidence"""),
    "guard_reason": with_views(_F, f"SELECT frame_id, {_REASON} AS reason FROM states", _STATES),
    "rulebook_lookup": with_views("frames rulebook", f"""SELECT frame_id, array_to_string(pool, ' / ') AS pool FROM
        (SELECT frame_id, {bucket('log2_est')} AS bucket, {band('v_raw')} AS vband, {band('a_raw')} AS aband FROM frames) LEFT JOIN rulebook USING (bucket, vband, aband)"""),
    "recommendation_candidates": with_views("frames rulebook", f"SELECT {_REC_OUT} FROM cands", _STATES, _CANDS),
    "recommendations": with_views("frames rulebook", f"SELECT {_REC_OUT} FROM cands WHERE frame_id IN (SELECT frame_id FROM k WHERE kept)", _STATES, _CANDS,
        "src AS MATERIALIZED (SELECT room_id, rn, frame_id, t, concat_ws('|', coalesce(mood, '-'), coalesce(bucket, '-'), energy_action, reason IS NOT NULL) AS sig FROM cands)",
        keep_cte("k", "src", "(s.t - e.k_t >= 30 AND s.sig <> e.k_sig)", ["t", "sig"])),
    "adjacent_pool": with_views("frames rulebook", """SELECT c.frame_id, coalesce(array_to_string(list_transform(list_sort(list({'o': o, 'i': i, 'g': g})), lambda x: x.g), ' / '), '') AS pool
        FROM cands c LEFT JOIN (SELECT frame_id, g, min(o) AS o, min_by(i, o) AS i FROM near GROUP BY ALL) USING (frame_id) GROUP BY c.frame_id""", _STATES, _CANDS,
        _NEAR),
}
