"""Stateful stream operators: small step functions per room, and the folds that run them with typed state.

Every step is step(state, row) -> (state, [output rows]); the same functions serve the batch `scan` and, as the folds below, Structured Streaming
(`ordered.fold_stream` for rows in order, `ordered.fold_in_order` with a reorder buffer and timers).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ambientspark.functions import constants as C
from ambientspark.operators import occupancy
from ambientspark.streaming import ordered
from ambientspark.streaming.ordered import Fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_stream(df: DataFrame, step, schema: str, keys: tuple[str, ...] = ("room_id",),
                order: tuple[str, ...] = ("t", "frame_id"), late: bool = False) -> DataFrame:
    """`ordered.fold_stream` of one of the steps below (or of a Fold), with its output schema."""
    fold = step if isinstance(step, Fold) else next(f for f in FOLDS if f.step is step)
    return ordered.fold_stream(df, ordered.replace(fold, out=schema), keys, order, late)


# --- steps -----------------------------------------------------------------------

def ema_value(held, x, t, tau):
    """held = [value, t] or None."""
    if x is None:
        return held
    if held is None:
        return [x, t]
    gain = 1.0 - math.exp(-max(1e-6, t - held[1]) / tau)
    return [held[0] + gain * (x - held[0]), t]


def smoothing_step(state, row):
    """Smoothed level, activity and speech, noise floor, energy trend; energy without arousal."""
    s, out = _smoothed(state, row, None)
    return s, [out]


def _smoothed(state, row, arousal):
    s = state or {"points": []}
    t = row["t"]
    for name in ("loudness", "activity", "speech"):
        s[name] = ema_value(s.get(name), row[f"{name}_raw"], t, C.TAU_DSP_S)
    if row["speech_raw"] < C.QUIET_SPEECH:
        s["floor"] = ema_value(s.get("floor"), row["loudness_raw"], t, C.TAU_FLOOR_S)
    unit = lambda v: min(1.0, max(0.0, v))
    energy = 0.30 * unit((s["loudness"][0] + 60.0) / 50.0) + 0.20 * unit(s["activity"][0] / 4.0) + 0.25 * unit(s["speech"][0])
    energy = energy / 0.75 if arousal is None else energy + 0.25 * unit((arousal + 1.0) / 2.0)
    s["points"] = [p for p in s["points"] if p[0] >= t - C.TREND_HORIZON_S] + [[t, energy]]
    floor = s.get("floor")
    return s, {"room_id": row["room_id"], "frame_id": row["frame_id"], "t": t, "loudness": s["loudness"][0],
               "activity": s["activity"][0], "speech": s["speech"][0], "floor": floor[0] if floor else None,
               "energy": energy, "trend": slope_label(s["points"])}


SMOOTHING = ("room_id bigint, frame_id bigint, t double, loudness double, activity double, speech double, "
             "floor double, energy double, trend string")


def room_step(state, row):
    """`smoothing_step` with emotion: the room holds its last reading, which a tick may bring (v_raw, a_raw), corrects it by the pull of
    the playing track (pull_v, pull_a, scale; null without music or signature) and averages it on every tick; energy then counts arousal."""
    s = state or {"points": []}
    if row["v_raw"] is not None:
        s["reading"] = [row["v_raw"], row["a_raw"]]
    if "reading" in s:
        for name, raw, pull in zip(("valence", "arousal"), s["reading"], (row["pull_v"], row["pull_a"]), strict=True):
            if pull is not None:
                raw = max(-1.0, min(1.0, raw - max(-C.MAX_CORRECTION, min(C.MAX_CORRECTION, row["scale"] * pull))))
            s[name] = ema_value(s.get(name), raw, row["t"], C.TAU_EMOTION_S)
    valence, arousal = (s[name][0] if name in s else None for name in ("valence", "arousal"))
    s, out = _smoothed(s, row, arousal)
    return s, [out | {"valence": valence, "arousal": arousal}]


ROOM = SMOOTHING + ", valence double, arousal double"


def slope_label(points):
    if len(points) < 5 or points[-1][0] - points[0][0] < 15.0:
        return "stable"
    mt = sum(p[0] for p in points) / len(points)
    my = sum(p[1] for p in points) / len(points)
    spread = sum((p[0] - mt) ** 2 for p in points)
    slope = 60.0 * sum((p[0] - mt) * (p[1] - my) for p in points) / spread if spread else 0.0
    return "rising" if slope > C.TREND_SLOPE_PER_MIN else "falling" if slope < -C.TREND_SLOPE_PER_MIN else "stable"


def hysteresis_step(state, row, k=C.HOLD_K):
    """Published value follows the candidate once seen k times in a row. state = [published, run value, run length]."""
    c = row["candidate"]
    if state is None:
        state = [c, c, 1]
    else:
        run = state[2] + 1 if c == state[1] else 1
        state = [c if run >= k else state[0], c, run]
    return state, [{"room_id": row["room_id"], "frame_id": row["frame_id"], "t": row["t"], "published": state[0]}]


HYSTERESIS = "room_id bigint, frame_id bigint, t double, published bigint"


def dwell_step(state, row, dwell=C.BOUNDARIES["min_dwell_s"]):
    """state = [t, signature] of the last emission."""
    if state is not None and (row["t"] - state[0] < dwell or row["sig"] == state[1]):
        return state, []
    return [row["t"], row["sig"]], [{k: row[k] for k in ("room_id", "frame_id", "t", "sig")}]


DWELL = "room_id bigint, frame_id bigint, t double, sig string"


def throttle_step(state, row, gap=C.EMOTION_INTERVAL_S):
    if state is not None and row["t"] - state < gap:
        return state, []
    return row["t"], [{k: row[k] for k in ("room_id", "frame_id", "t")}]


THROTTLE = "room_id bigint, frame_id bigint, t double"


def advisory_step(state, row, hops=C.ADVISORY_HOPS):
    """state = [anchor, streak]."""
    anchor, streak = state or [None, 0]
    floor = row["floor"]
    if not row["playback_active"]:
        anchor, streak = (floor if floor is not None else anchor), 0
    else:
        ref = anchor if anchor is not None else floor
        loud = ref if row["loud"] is None else row["loud"]
        speech = 1.0 if row["speech"] is None else row["speech"]
        blind = ref is not None and loud - ref >= C.ADVISORY_DB and speech <= C.ADVISORY_SPEECH
        streak = streak + 1 if blind else 0
    return [anchor, streak], [{"room_id": row["room_id"], "frame_id": row["frame_id"], "t": row["t"],
                               "envelope_advisory": streak >= hops}]


ADVISORY = "room_id bigint, frame_id bigint, t double, envelope_advisory boolean"


def _evidence_numbers(kept):
    import numpy as np
    if not kept:
        return {"segments": 0, "evidence_s": 0.0, "raw_clusters": 0, "fragmentation": None, "separation": None, "dispersion": None}
    seconds = np.array([e[1] for e in kept])
    if kept[0][2] is None:
        return {"segments": len(kept), "evidence_s": float(seconds.sum())}
    segments, total, _, raw, _, fragmentation, separation, dispersion = occupancy.buffer_numbers(np.array([e[2] for e in kept], dtype=float), seconds)
    return {"segments": segments, "evidence_s": total, "raw_clusters": raw, "fragmentation": fragmentation, "separation": separation, "dispersion": dispersion}


def evidence_step(state, row, horizon=C.BUFFER_S, cap=C.BUFFER_CAP):
    """Rolling evidence with time-out and cap; state = [[t, duration, embedding], ...], oldest first. Gives what the buffer holds and, where
    rows carry embeddings, how they cluster."""
    kept = [e for e in (state or []) if e[0] >= row["t"] - horizon] + [[row["t"], row["duration_s"], row.get("embedding")]]
    kept = kept[-cap:]
    return kept, [{"room_id": row["room_id"], "frame_id": row["frame_id"], "t": row["t"], "timed_out": False} | _evidence_numbers(kept)]


def evidence_due(state, horizon=C.BUFFER_S):
    """When the oldest evidence is as old as may be."""
    return state[0][0] + horizon if state else None


def evidence_lapse(state, key, at, horizon=C.BUFFER_S):
    """Evidence that times out while nothing comes in: a row without frame tells what is left."""
    kept = [e for e in state if e[0] + horizon > at]
    return kept, [key | {"frame_id": None, "t": at, "timed_out": True} | _evidence_numbers(kept)]


EVIDENCE = ("room_id bigint, frame_id bigint, t double, timed_out boolean, segments bigint, evidence_s double, raw_clusters bigint, "
            "fragmentation double, separation double, dispersion double")


def held_bucket_step(state, row):
    """Silence holds the bucket while its age grows. state = [bucket, t]."""
    if row["bucket"] is not None:
        state = [row["bucket"], row["t"]]
    bucket, at = state or [None, None]
    return state, [{"room_id": row["room_id"], "frame_id": row["frame_id"], "t": row["t"], "bucket": bucket,
                    "headcount_staleness_s": None if at is None else max(0.0, row["t"] - at)}]


HELD_BUCKET = "room_id bigint, frame_id bigint, t double, bucket string, headcount_staleness_s double"


def completion_step(state, row, lead=C.QUEUE_LEAD_S):
    """Online completion detection over one ordered stream of polls, picks and vetoes (`kind`)."""
    s = state or {"prev": None, "chosen": [], "vetoed": []}
    track, out = row["track_id"], []
    if row["kind"] == "pick":
        s["chosen"] = s["chosen"] if track in s["chosen"] else (s["chosen"] + [track])[-C.ATTRIBUTION_KEEP:]
    elif row["kind"] == "veto":
        s["vetoed"] = s["vetoed"] if track in s["vetoed"] else (s["vetoed"] + [track])[-C.OVERRIDDEN_KEEP:]
    else:
        prev = s["prev"]
        if prev and prev[0] != track:
            ended = prev[2] is not None and prev[2] > 0 and prev[1] >= prev[2] - lead
            if ended and prev[0] in s["chosen"] and prev[0] not in s["vetoed"]:
                out = [{"room_id": row["room_id"], "obs_id": row["obs_id"], "t": row["t"], "track_id": prev[0]}]
        s["prev"] = [track, row["progress_s"], row["duration_s"]] if track is not None else None
    return s, out


COMPLETION = "room_id bigint, obs_id bigint, t double, track_id string"


def slot_step(state, row, gap=C.EMOTION_INTERVAL_S):
    """One pending window per room, for a model that takes it when it can (rows of kind `take`).

    A newer window replaces a pending one, but a reference window never replaces a speech window. Windows offered within `gap` of the last take are
    dropped. state = [time of the last take, pending frame, its kind, its time].
    """
    last, frame, kind, at = state or [None, None, None, None]
    if row["kind"] == "take":
        if frame is None:
            return [last, None, None, None], []
        return [row["t"], None, None, None], [{"room_id": row["room_id"], "frame_id": row["frame_id"], "t": row["t"], "window_id": frame, "window_kind": kind, "age_s": row["t"] - at}]
    if (last is None or row["t"] - last >= gap) and not (row["kind"] == "reference" and kind == "speech"):
        frame, kind, at = row["frame_id"], row["kind"], row["t"]
    return [last, frame, kind, at], []


SLOT = "room_id bigint, frame_id bigint, t double, window_id bigint, window_kind string, age_s double"


def tap_step(state, row):
    """Age of the last human tap at each record; only that tap is kept. Rows of kind `tap` come before records of the same time."""
    if row["kind"] == "tap":
        return row["t"], []
    return state, [{"room_id": row["room_id"], "rec_id": row["rec_id"], "t": row["t"], "tap_age_s": None if state is None else row["t"] - state}]


TAP_AGE = "room_id bigint, rec_id bigint, t double, tap_age_s double"

# --- folds: steps with typed state ------------------------------------------------


def _pack_points(s):
    return [(k, *s[k]) for k in s if k not in ("points", "reading") and s[k]] + [("point", e, t) for t, e in s["points"]] + ([("reading", *s["reading"])] if "reading" in s else [])


def _unpack_points(rows):
    s = {"points": [[t, e] for k, e, t in rows if k == "point"]}
    return s | {k: [x, t] for k, x, t in rows if k != "point"}


def _pack_tracks(s):
    return ([("prev", *s["prev"])] if s["prev"] else []) + [(k, track, None, None) for k in ("chosen", "vetoed") for track in s[k]] + [("known", None, None, None)]


def _unpack_tracks(rows):
    prev = next((list(r[1:]) for r in rows if r[0] == "prev"), None)
    return {"prev": prev} | {k: [r[1] for r in rows if r[0] == k] for k in ("chosen", "vetoed")}


def _one(state):
    return [tuple(state)]


def _first(rows):
    return list(rows[0])


def _rows(state):
    return [tuple(e) for e in state]


def _lists(rows):
    return [list(r) for r in rows]


def _scalar(state):
    return [(state,)]


def _value(rows):
    return rows[0][0]


SMOOTHING_FOLD = Fold(smoothing_step, SMOOTHING, "name string, x double, t double", _pack_points, _unpack_points)
ROOM_FOLD = Fold(room_step, ROOM, SMOOTHING_FOLD.state, _pack_points, _unpack_points)
HYSTERESIS_FOLD = Fold(hysteresis_step, HYSTERESIS, "published bigint, seen bigint, run bigint", _one, _first)
DWELL_FOLD = Fold(dwell_step, DWELL, "t double, sig string", _one, _first)
THROTTLE_FOLD = Fold(throttle_step, THROTTLE, "t double", _scalar, _value)
ADVISORY_FOLD = Fold(advisory_step, ADVISORY, "anchor double, streak bigint", _one, _first)
EVIDENCE_FOLD = Fold(evidence_step, EVIDENCE, "t double, duration_s double, embedding array<double>", _rows, _lists, evidence_due, evidence_lapse)
HELD_BUCKET_FOLD = Fold(held_bucket_step, HELD_BUCKET, "bucket string, t double", lambda s: [tuple(s)] if s else [(None, None)], lambda rows: list(rows[0]) if rows[0][1] is not None else None)
COMPLETION_FOLD = Fold(completion_step, COMPLETION, "kind string, track_id string, progress_s double, duration_s double", _pack_tracks, _unpack_tracks)
SLOT_FOLD = Fold(slot_step, SLOT, "taken double, frame_id bigint, kind string, t double", _one, _first)
TAP_FOLD = Fold(tap_step, TAP_AGE, "t double", _scalar, _value)
FOLDS = (SMOOTHING_FOLD, ROOM_FOLD, HYSTERESIS_FOLD, DWELL_FOLD, THROTTLE_FOLD, ADVISORY_FOLD, EVIDENCE_FOLD, HELD_BUCKET_FOLD, COMPLETION_FOLD, SLOT_FOLD, TAP_FOLD)
