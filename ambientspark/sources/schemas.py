"""Fixed schemas of every log and table. Optional fields are nullable; nothing is inferred."""

from __future__ import annotations

from ambientspark.functions import constants as C

BALANCE = "STRUCT<low: DOUBLE, mid: DOUBLE, high: DOUBLE>"
CORRECTION = "STRUCT<valence: DOUBLE, arousal: DOUBLE, track_id: STRING, basis: STRING, refs: INT>"
_STATE = {
    "timestamp": "DOUBLE", "loudness_dbfs": "DOUBLE", "activity_density": "DOUBLE", "spectral_balance": BALANCE,
    "speech_ratio": "DOUBLE", "valence": "DOUBLE", "arousal": "DOUBLE", "emotion_confidence": "DOUBLE",
    "emotion_staleness_s": "DOUBLE", "headcount_bucket": "STRING", "headcount_confidence": "DOUBLE",
    "headcount_staleness_s": "DOUBLE", "energy": "DOUBLE", "mood": "STRING", "trend": "STRING",
    "playback_active": "BOOLEAN", "playback_track_id": "STRING", "noise_floor_dbfs": "DOUBLE",
    "emotion_music_dominance": "DOUBLE", "emotion_correction": CORRECTION,
}


def struct(fields: dict[str, str]) -> str:
    return "STRUCT<" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + ">"


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


SNAPSHOT = struct(dict.fromkeys(C.BOUNDARIES, "DOUBLE"))
RECOMMENDATION = {
    "energy_action": "STRING", "target_valence": "DOUBLE", "target_arousal": "DOUBLE", "genre_pool": "ARRAY<STRING>",
    "confidence": "DOUBLE", "summary": "STRING", "matched_cell": "ARRAY<STRING>", "boundaries_snapshot": SNAPSHOT,
    "timestamp": "DOUBLE", "schema_version": "INT",
    "source": "STRING", "genre": "STRING", "tier": "STRING",  # manual picks only
}
TRACK = {"id": "STRING", "title": "STRING", "artist": "STRING", "duration_s": "DOUBLE", "playlist_id": "STRING",
         "genre": "STRING", "tier": "STRING"}
NOW_PLAYING = {"track": struct(TRACK), "progress_s": "DOUBLE", "is_playing": "BOOLEAN", "device_id": "STRING"}
PRESENCE = {"occupied": "BOOLEAN", "basis": "STRING", "staleness_s": "DOUBLE", "track_duration_s": "DOUBLE",
            "fresh_s": "DOUBLE", "handoff_s": "DOUBLE", "last_tap_age_s": "DOUBLE"}

ROOM_STATE = ddl({"room_id": "BIGINT", **_STATE})
ANNOTATION = ddl({"room_id": "BIGINT", "schema_version": "INT", "ts": "DOUBLE", "verdict": "STRING",
                  "state": struct(_STATE), "recommendation": struct(RECOMMENDATION)})
OVERRIDE = ddl({"room_id": "BIGINT", "schema_version": "INT", "ts": "DOUBLE", "action": "STRING",
                "state": struct(_STATE), "recommendation": struct(RECOMMENDATION), "now_playing": struct(NOW_PLAYING),
                "chosen": "STRUCT<genre: STRING, tier: STRING>", "presence": struct(PRESENCE)})
SIGNATURE = "track_id STRING, valence DOUBLE, arousal DOUBLE, refs INT, pull_valence DOUBLE, pull_arousal DOUBLE, pull_refs INT"
ANCHOR = "room_id BIGINT, anchor_dbfs DOUBLE, ts DOUBLE"
PLAYER_PAYLOAD = ("item STRUCT<uri: STRING, name: STRING, artists: ARRAY<STRUCT<name: STRING>>, duration_ms: BIGINT>, "
                  "context STRUCT<type: STRING, uri: STRING>, progress_ms BIGINT, is_playing BOOLEAN, device STRUCT<id: STRING>")
PLAYLIST_PAYLOAD = ("items ARRAY<STRUCT<item: STRUCT<uri: STRING, name: STRING, artists: ARRAY<STRUCT<name: STRING>>, "
                    "duration_ms: BIGINT>>>")
PLAYLISTS = "schema_version INT, playlists MAP<STRING, MAP<STRING, STRING>>"
