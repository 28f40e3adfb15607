"""DuckDB statements for the label and report queries."""

from __future__ import annotations

from ambientspark.functions import constants as C
from ambientspark.plans.oracle_views import with_views

_CUTS = [(c, c.rsplit("_", 1)[0]) for c in C.BAND_CUTS]
_VALUES = "(VALUES " + ", ".join(f"('{c}', {s}e0, {i})" for c in C.BAND_CUTS for i, s in enumerate(C.SHIFTS)) + ") c(boundary, shift, ord)"


def _band(x, lo, hi):
    return f"CASE WHEN {x} > {hi} THEN 'high' WHEN {x} > {lo} THEN 'mid' ELSE 'low' END"


_SIGNALS = """SELECT * FROM {src} WHERE coalesce(cell[1], '') <> 'guard' AND valence IS NOT NULL AND arousal IS NOT NULL
    AND valence_low IS NOT NULL AND valence_high IS NOT NULL AND arousal_low IS NOT NULL AND arousal_high IS NOT NULL"""


def _scores(src):
    moved = f"""SELECT c.boundary, c.shift, c.ord, r.verdict,
        CASE WHEN c.boundary LIKE 'valence%' THEN r.valence ELSE r.arousal END AS x,
        CASE WHEN c.boundary LIKE 'valence%' THEN r.valence_low ELSE r.arousal_low END AS lo,
        CASE WHEN c.boundary LIKE 'valence%' THEN r.valence_high ELSE r.arousal_high END AS hi
      FROM ({_SIGNALS.format(src=src)}) r, {_VALUES}"""
    shifted = f"""SELECT *, CASE WHEN boundary LIKE '%low' THEN lo + shift ELSE lo END AS mlo,
        CASE WHEN boundary LIKE '%high' THEN hi + shift ELSE hi END AS mhi FROM ({moved})"""
    flip = f"mlo < mhi AND {_band('x', 'lo', 'hi')} <> {_band('x', 'mlo', 'mhi')}"
    return f"""SELECT boundary, shift, ord, count(*) FILTER (WHERE {flip} AND verdict = 'wrong') AS wrong_flipped,
        count(*) FILTER (WHERE {flip} AND verdict IS DISTINCT FROM 'wrong') AS good_flipped
      FROM ({shifted}) GROUP BY ALL"""


def _best(scores, by, gain, loss):
    return f"""SELECT n.{by}, b.shift, coalesce(b.{gain}, 0) AS {gain}, coalesce(b.{loss}, 0) AS {loss}
      FROM (SELECT DISTINCT {by} FROM sc) n LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {gain} - {loss} DESC, ord) AS r FROM sc
        WHERE {gain} > {loss}) b ON b.{by} = n.{by} AND b.r = 1"""


def _near(src, hit):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS boundary, count(*) FILTER (WHERE {hit} AND abs({s} - {c}) <= 0.1e0) AS near FROM sig" for c, s in _CUTS)


_TIER = """CASE WHEN {x} > {hi} THEN 2 WHEN {x} > {lo} THEN 1 ELSE 0 END"""


def _derived(lo, hi):
    return (f"greatest(0, least(2, {_TIER.format(x='target_arousal', lo=lo, hi=hi)} + CASE coalesce(energy_action, 'hold') "
            "WHEN 'raise' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END))")


_RANK = "CASE chosen_tier WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END"
_PICKS = "picks AS (SELECT * FROM usable WHERE action = 'manual' AND chosen_tier IS NOT NULL AND target_arousal IS NOT NULL)"
_ATTR = "CASE WHEN len(cell) > 0 THEN cell WHEN source = 'manual' THEN ['manual'] ELSE ['?'] END"
_OR_UNKNOWN = "CASE WHEN len(cell) > 0 THEN cell ELSE ['?'] END"


def _cutoffs():
    parts = []
    for name in ("tier_low_max", "tier_high_min"):
        for i, s in enumerate(C.SHIFTS):
            lo = f"(-0.25e0 + {s}e0)" if name == "tier_low_max" else "-0.25e0"
            hi = f"(0.25e0 + {s}e0)" if name == "tier_high_min" else "0.25e0"
            before, after = f"({_derived('-0.25e0', '0.25e0')} = {_RANK})", f"({_derived(lo, hi)} = {_RANK})"
            parts.append(f"""SELECT '{name}' AS cutoff, {s}e0 AS shift, {i} AS ord,
              count(*) FILTER (WHERE NOT {before} AND {after}) AS agree_gained,
              count(*) FILTER (WHERE {before} AND NOT {after}) AS agree_lost FROM picks""")
    return " UNION ALL ".join(parts)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in C.ACTIONS)
_RATE = "CASE WHEN skip + wrong_vibe + manual + played_through > 0 THEN round((skip + wrong_vibe + manual) / (skip + wrong_vibe + manual + played_through), 6) END AS rate"
_TAPPED = """EXISTS (SELECT 1 FROM taps p WHERE p.room_id = o.room_id AND p.tap_ts BETWEEN o.ts - o.duration_s AND o.ts)"""
_AGED = """aged AS (SELECT o.*, o.ts - (SELECT max(p.tap_ts) FROM taps p WHERE p.room_id = o.room_id AND p.tap_ts <= o.ts) AS tap_age_s
    FROM overrides o)"""

ORACLES = {
    "verdicts_by_cell": with_views("annotations", f"""
        SELECT array_to_string({_OR_UNKNOWN}, ' / ') AS cell, count(*) FILTER (WHERE verdict = 'good') AS good,
          count(*) FILTER (WHERE verdict = 'wrong') AS wrong FROM annotations GROUP BY 1"""),
    "verdict_totals": with_views("annotations", """
        SELECT count(*) AS records, count(*) FILTER (WHERE verdict = 'good') AS good,
          count(*) FILTER (WHERE verdict = 'wrong') AS wrong FROM annotations"""),
    "boundary_proximity": with_views("annotations", _near("sig", "verdict = 'wrong'"),
                                     f"sig AS ({_SIGNALS.format(src='annotations')})"),
    "boundary_shift_scores": with_views("annotations", f"SELECT * EXCLUDE (ord) FROM ({_scores('annotations')})"),
    "boundary_shifts": with_views("annotations", _best("sc", "boundary", "wrong_flipped", "good_flipped"),
                                  f"sc AS ({_scores('annotations')})"),
    "override_counts_by_cell": with_views("usable", f"""
        SELECT *, {_RATE} FROM (SELECT array_to_string({_ATTR}, ' / ') AS cell, {_COUNTS} FROM usable GROUP BY 1)"""),
    "override_rate": with_views("usable", f"""
        SELECT room_id, {_RATE} FROM (SELECT room_id, {_COUNTS} FROM usable GROUP BY 1)"""),
    "veto_proximity": with_views("usable", _near("sig", "action IN ('skip', 'wrong_vibe')"),
                                 f"sig AS ({_SIGNALS.format(src='usable')})"),
    "strong_label_shifts": with_views("usable", _best("sc", "boundary", "wrong_flipped", "good_flipped"),
        "lab AS (SELECT *, CASE WHEN action = 'played_through' THEN 'good' ELSE 'wrong' END AS verdict FROM usable WHERE action <> 'manual')",
        f"sc AS ({_scores('lab')})"),
    "tier_disagreement": with_views("usable", f"""
        SELECT count(*) FILTER (WHERE d > 0) AS higher, count(*) FILTER (WHERE d < 0) AS lower,
          count(*) FILTER (WHERE d = 0) AS same
        FROM (SELECT {_RANK} - {_derived('-0.25e0', '0.25e0')} AS d FROM picks)""", _PICKS),
    "tier_cutoffs": with_views("usable", _best("sc", "cutoff", "agree_gained", "agree_lost"), _PICKS, f"sc AS ({_cutoffs()})"),
    "pool_weighting": with_views("usable", f"""
        SELECT *, round(veto / (veto + thru), 6) AS rate FROM (
          SELECT array_to_string({_OR_UNKNOWN}, ' / ') AS cell, genre,
            count(*) FILTER (WHERE action <> 'played_through') AS veto,
            count(*) FILTER (WHERE action = 'played_through') AS thru
          FROM usable WHERE action <> 'manual' AND genre <> '' GROUP BY 1, 2)"""),
    "gate_overrides": with_views("gated", "SELECT rec_id, action, gate, basis, stamped FROM gated"),
    "gate_summary": with_views("gated", f"""
        SELECT count(*) AS records, {_COUNTS},
          count(*) FILTER (WHERE gate = 'suspect' AND basis <> 'unknown') AS empty_room,
          count(*) FILTER (WHERE gate = 'suspect' AND basis = 'unknown') AS unknown_presence,
          count(*) FILTER (WHERE gate = 'blind') AS blind, count(*) FILTER (WHERE gate = 'usable') AS usable FROM gated"""),
    "presence_retro": with_views("gated", "SELECT rec_id, occupied, basis, stamped FROM gated WHERE action = 'played_through'"),
    "blind_vetoes": with_views("overrides", """
        SELECT rec_id, action, speech_ratio, emotion_staleness_s FROM overrides
        WHERE action <> 'played_through' AND playback_active AND coalesce(speech_ratio, 1) <= 0.05 AND emotion_staleness_s > 60"""),
    "tap_in_window": with_views("taps overrides", f"SELECT rec_id, {_TAPPED} AS tapped FROM overrides o"),
    "last_tap_age": with_views("taps overrides", "SELECT rec_id, tap_age_s FROM aged", _AGED),
    "presence_block": with_views("taps overrides", """
        SELECT rec_id, basis IN ('fresh', 'handoff', 'tap') AS occupied, basis, stale AS staleness_s,
          duration_s AS track_duration_s, tap_age_s AS last_tap_age_s
        FROM (SELECT *, CASE WHEN stale IS NULL THEN CASE WHEN coalesce(tap_age_s <= duration_s, false) THEN 'tap' ELSE 'unknown' END
            WHEN stale <= 60 THEN 'fresh' WHEN stale BETWEEN duration_s AND duration_s + 30 THEN 'handoff'
            WHEN tap_age_s <= duration_s THEN 'tap' ELSE 'absent' END AS basis
          FROM (SELECT *, coalesce(headcount_staleness_s, emotion_staleness_s) AS stale FROM aged))
        WHERE action = 'played_through'""", _AGED),
    "tap_times": with_views("taps", "SELECT room_id, count(*) AS taps, min(tap_ts) AS first_tap, max(tap_ts) AS last_tap FROM taps GROUP BY 1"),
    "validate_overrides": with_views("overrides", """
        SELECT rec_id, reject_reason FROM (
          SELECT rec_id, CASE WHEN rec_id % 97 = 0 OR rec_id % 89 = 0 THEN 'action'
            WHEN rec_id % 83 = 0 OR rec_id % 71 = 0 OR valence IS NULL THEN 'state' WHEN cell IS NULL THEN 'recommendation'
            WHEN rec_id % 79 = 0 THEN 'now_playing'
            WHEN action = 'manual' AND chosen_tier IS NULL THEN 'chosen' END AS reject_reason FROM overrides)
        WHERE reject_reason IS NOT NULL"""),
    "validate_annotations": with_views("annotations", """
        SELECT rec_id, reject_reason FROM (
          SELECT rec_id, CASE WHEN rec_id % 97 = 0 OR rec_id % 89 = 0 THEN 'verdict'
            WHEN rec_id % 83 = 0 THEN 'recommendation' WHEN valence IS NULL THEN 'state' END AS reject_reason FROM annotations)
        WHERE reject_reason IS NOT NULL"""),
    "session_counts": with_views("overrides", """
        SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, action, count(*) AS records FROM overrides GROUP BY ALL"""),
    "signal_records": with_views("annotations", "SELECT room_id, count(*) AS records FROM sig GROUP BY 1",
                                 f"sig AS ({_SIGNALS.format(src='annotations')})"),
    "strong_labels": with_views("usable", """
        SELECT action, CASE WHEN action = 'played_through' THEN 'good' ELSE 'wrong' END AS verdict, count(*) AS n
        FROM usable WHERE action <> 'manual' GROUP BY ALL"""),
    "attribution_cells": with_views("overrides", f"""
        SELECT rec_id, array_to_string({_ATTR}, ' / ') AS cell, coalesce(cell[1] = 'guard', false) AS guard FROM overrides"""),
}

ORACLES |= {f"report_{section}": ORACLES[name] for section, name in {
    "verdict_totals": "verdict_totals", "1_verdicts_by_cell": "verdicts_by_cell", "2_boundary_proximity": "boundary_proximity", "3_boundary_shifts": "boundary_shifts",
    "gate_summary": "gate_summary", "4_overrides_by_cell": "override_counts_by_cell", "5_veto_proximity": "veto_proximity", "6_tier_disagreement": "tier_disagreement",
    "7_strong_label_shifts": "strong_label_shifts", "8_tier_cutoffs": "tier_cutoffs", "9_pool_weighting": "pool_weighting"}.items()}
ORACLES |= {
    "report_4a_flagged": with_views("gated", "SELECT rec_id, action, gate, basis, stamped FROM gated WHERE gate <> 'usable'"),
    "jsonl_round_trip": with_views("annotations", "SELECT room_id, ts, verdict, valence, arousal, valence_low, valence_high, arousal_low, arousal_high, array_to_string(cell, ' / ') AS cell FROM annotations"),
    "state_feed": with_views("frames", "SELECT room_id, t AS timestamp, speech_raw AS speech_ratio, playback_active FROM frames"),
    "signature_store": with_views("frames", """SELECT track_id, CAST(printf('%.4f', max(v_raw)) AS DOUBLE) AS valence, CAST(printf('%.4f', min(a_raw)) AS DOUBLE) AS arousal, count(*) AS refs
        FROM frames WHERE track_id IS NOT NULL GROUP BY 1"""),
}
