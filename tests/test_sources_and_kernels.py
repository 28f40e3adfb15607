"""Logs, snapshots and payloads; FFT features and clustering against brute force."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ambientspark.operators import joins, labels, occupancy, playback, signal
from ambientspark.plans.report import tuning_report
from ambientspark.sources import logs, playlists, snapshots


def override(ts, action, **more):
    state = {"headcount_staleness_s": more.pop("stale", 5.0), "valence": 0.3, "arousal": 0.0, "playback_active": True, "speech_ratio": 0.5}
    rec = {"matched_cell": ["4", "high", "mid"], "target_arousal": 0.0, "energy_action": "hold",
           "boundaries_snapshot": {"valence_low": -0.25, "valence_high": 0.25, "arousal_low": -0.25, "arousal_high": 0.25}}
    return {"room_id": 1, "schema_version": 1, "ts": ts, "action": action, "state": state, "recommendation": rec,
            "now_playing": {"track": {"id": "t", "title": "x", "duration_s": 100.0, "genre": "Pop"}}, **more}


def test_logs_and_report(spark, tmp_path):
    path = tmp_path / "o.jsonl"
    records = [override(10.0, "skip"), override(20.0, "played_through"), override(500.0, "played_through", stale=150.0),
               override(30.0, "manual", schema_version=2, chosen={"genre": "Jazz", "tier": "high"}, presence={"occupied": True, "basis": "fresh"})]
    path.write_text("\n".join([json.dumps(r) for r in records[:2]] + ["", "{broken"] + [json.dumps(r) for r in records[2:]]) + "\n")
    good, bad = logs.read_jsonl(spark, [str(path), str(tmp_path / "*.jsonl")], logs.S.OVERRIDE)
    assert good.count() == 4
    assert [(r["value"], r["file"].endswith("o.jsonl"), r["fault"]) for r in bad.collect()] == [("{broken", True, "line")]
    flat = logs.flatten_overrides(logs.read_overrides(spark, str(path))[0])
    notes = spark.createDataFrame([], logs.S.ANNOTATION)
    report = tuning_report(logs.flatten_annotations(notes), flat, 1000.0)
    summary = report["gate_summary"].first()
    assert (summary["records"], summary["empty_room"], summary["usable"]) == (4, 1, 3)
    cell = report["4_overrides_by_cell"].first()
    assert (cell["skip"], cell["manual"], cell["played_through"]) == (1, 1, 1) and cell["rate"] == pytest.approx(2 / 3)
    assert report["6_tier_disagreement"].first()["higher"] == 1
    ok, rejected = labels.validate_overrides(good)
    assert (ok.count(), rejected.count()) == (4, 0)
    logs.write_daily(good, str(tmp_path / "daily"))
    again, none = logs.read_overrides(spark, str(tmp_path / "daily"))
    assert none.count() == 0
    assert again.count() == 4 and [p.name for p in (tmp_path / "daily").glob("day=*")] == ["day=1970-01-01"]


def test_type_slips_and_empty_objects(spark, tmp_path):
    path = tmp_path / "slips.jsonl"
    slip = override(1.0, "skip", refs=3.0)
    slip["state"]["valence"] = "high"
    empty = [override(2.0, "skip") | {part: {}} for part in ("state", "recommendation", "now_playing")] + [override(3.0, "manual", chosen={})]
    path.write_text("\n".join(json.dumps(r) for r in [slip, *empty]) + "\n[1]\n")
    good, bad = logs.read_overrides(spark, str(path))
    assert good.count() == 5 and sorted(r["fault"] for r in bad.collect()) == ["field", "line"]
    kept = good.filter("ts = 1.0").first()
    assert kept["action"] == "skip" and kept["state"]["valence"] is None and kept["state"]["speech_ratio"] == 0.5
    ok, rejected = labels.validate_overrides(good)
    assert ok.count() == 1
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["chosen", "now_playing", "recommendation", "state"]


def test_overlapping_phases_label_alike_at_any_size(spark):
    frames = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 50.0)], "frame_id long, t double")
    few = [("x", 0.0, 6.0), ("y", 0.0, 2.0)]
    many = few + [(f"z{k}", 1000.0 + k, 1001.0 + k) for k in range(2000)]
    for rows in (few, many):
        for slab in (0.7, 100.0):
            got = joins.frames_in_phase(frames, spark.createDataFrame(rows, "phase string, start_s double, end_s double"), slab)
            assert sorted((r["frame_id"], r["phase"]) for r in got.collect()) == [(1, "x"), (1, "y"), (2, "x")]


def test_one_pass_buffer_stats_equal_the_single_operators(spark):
    rng = np.random.default_rng(9)
    rows = []
    for room in range(6):
        centres = rng.normal(size=(room + 1, 8))
        for k in range(3 * room + 1):
            x = centres[k % (room + 1)] + 0.2 * rng.normal(size=8)
            rows.append((room, k, float(k), float(rng.uniform(0.5, 3)), [float(v) for v in x / np.linalg.norm(x)]))
    df = spark.createDataFrame(rows, "room_id long, evidence_id long, at double, duration_s double, embedding array<double>")
    labelled = occupancy.threshold_cluster(df, ["room_id"])
    single = (occupancy.cluster_mass(labelled, ["room_id"]).join(occupancy.separation_score(labelled, ["room_id"]), "room_id")
              .join(occupancy.dispersion(labelled, ["room_id"]), "room_id"))
    want = {r["room_id"]: r.asDict() for r in single.collect()}
    got = {r["room_id"]: r.asDict() for r in occupancy.buffer_stats(df, ["room_id"]).collect()}
    assert got.keys() == want.keys()
    for room, row in want.items():
        assert got[room] == pytest.approx(row, abs=1e-9)


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "sig")
    assert snapshots.read_signatures(spark, path).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text(json.dumps({"track_id": "a", "valence": 0.12345, "arousal": 0.2, "refs": 3}) + "\n")
    old = snapshots.read_signatures(spark, str(tmp_path / "old"))
    assert old.first()["pull_refs"] == 0
    snapshots.write_signatures(old, path)
    assert snapshots.read_signatures(spark, path).first()["valence"] == round(0.12345, 4)
    more = spark.createDataFrame([("b", 0.5, 0.5, 1, 0.0, 0.0, 0)], logs.S.SIGNATURE)
    snapshots.write_signatures(snapshots.read_signatures(spark, path).unionByName(more), path)
    assert {r["track_id"] for r in snapshots.read_signatures(spark, path).collect()} == {"a", "b"}
    snapshots.write_signatures(more.limit(0), path)
    assert snapshots.read_signatures(spark, path).count() == 0
    snapshots.write_signatures(more, str(tmp_path / "old"))
    assert [r["track_id"] for r in snapshots.read_signatures(spark, str(tmp_path / "old")).collect()] == ["b"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text("{not json")
    assert snapshots.read_signatures(spark, str(tmp_path / "bad")).count() == 0
    df = spark.createDataFrame([(-44.0, 0.0)], "a double, ts double")
    got = df.select(*[snapshots.usable_anchor(F.col("a"), F.col("ts"), F.lit(now)).alias(f"n{i}") for i, now in enumerate((100.0, 50_000.0, -1.0))]).first()
    assert tuple(got) == (-44.0, None, None)


def test_a_version_counts_once_its_pointer_is_in_place(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda k: spark.createDataFrame([(f"t{k}", 0.1 * k, 0.0, k, 0.0, 0.0, 0)], logs.S.SIGNATURE)
    for k in range(10):
        snapshots.write_signatures(row(k), path)
    assert [r.track_id for r in snapshots.read_signatures(spark, path).collect()] == ["t9"]
    versions = [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_v")]
    assert 1 <= len(versions) <= 2
    half = tmp_path / "store" / "_vdied"  # a writer that died between its files
    half.mkdir()
    (half / "part-0.json").write_text(json.dumps({"track_id": "x", "valence": 0.0}))
    assert [r.track_id for r in snapshots.read_signatures(spark, path).collect()] == ["t9"]
    snapshots.write_signatures(row(11), path)
    assert [r.track_id for r in snapshots.read_signatures(spark, path).collect()] == ["t11"] and not half.exists()


def test_playlists(spark, tmp_path):
    assert playlists.read_playlists(spark, str(tmp_path / "none.json")).count() == 0
    good = tmp_path / "p.json"
    good.write_text(json.dumps({"schema_version": 1, "playlists": {"Pop": {"high": "A", "mid": "B"}, "Jazz": {"low": "C"}}}, indent=1))
    assert {tuple(r) for r in playlists.read_playlists(spark, str(good)).collect()} == {("Pop", "high", "A"), ("Pop", "mid", "B"), ("Jazz", "low", "C")}
    for doc in ({"schema_version": 2, "playlists": {}}, {"schema_version": 1, "playlists": {"Pop": {"loud": "A"}}}, {"schema_version": 1, "playlists": {"Pop": {"low": ""}}}):
        bad = tmp_path / "bad.json"
        bad.write_text(json.dumps(doc))
        with pytest.raises(PySparkException):
            playlists.read_playlists(spark, str(bad)).collect()


def test_signal_features(spark):
    n, sr = 16_000, 16_000
    tone = [math.sin(2 * math.pi * 100 * i / sr) for i in range(n)]
    clicks = [1.0 if i % 4000 == 2000 else 0.0 for i in range(n)]
    df = spark.createDataFrame([("tone", tone), ("clicks", clicks), ("short", [0.1] * 10), ("silence", [0.0] * 4096)], "id string, samples array<double>")
    level = {r["id"]: r["db"] for r in df.select("id", signal.rms_dbfs("samples").alias("db")).collect()}
    assert level["tone"] == pytest.approx(-3.0, abs=0.1) and level["silence"] == -120.0
    feats = {r["id"]: r for r in signal.spectral_features(df).collect()}
    assert feats["tone"]["low"] > 0.9 and feats["short"]["low"] == 0.0 and feats["silence"]["onset_density"] == 0.0
    assert feats["clicks"]["onset_density"] > 0.5
    # Brute-force transform of one window, frame by frame.
    x, w = np.array(tone), np.hanning(1024)
    power = sum(np.abs(np.array([np.sum(x[s:s + 1024] * w * np.exp(-2j * np.pi * k * np.arange(1024) / 1024)) for k in range(0, 20)])) ** 2
                for s in range(0, n - 1023, 512))
    assert feats["tone"]["low"] == pytest.approx(power.sum() / power.sum(), abs=1e-3)


def brute_linkage(x, threshold):
    clusters = [[i] for i in range(len(x))]
    dist = 1 - x @ x.T
    while len(clusters) > 1:
        gaps = [(np.mean([dist[i, j] for i in a for j in b]), m, n) for m, a in enumerate(clusters) for n, b in enumerate(clusters) if m < n]
        gap, m, n = min(gaps)
        if gap >= threshold:
            break
        clusters[m] += clusters.pop(n)
    return {frozenset(c) for c in clusters}


def test_clustering_and_estimate(spark):
    rng = np.random.default_rng(4)
    voices = rng.normal(size=(3, 16))
    rows, vectors = [], []
    for i in range(24):
        v = voices[i % 3] + 0.25 * rng.normal(size=16)
        v /= np.linalg.norm(v)
        vectors.append(v)
        rows.append((1, i, float(i), 1.25, [float(c) for c in v]))
    evidence = spark.createDataFrame(rows, "room_id long, evidence_id long, at double, duration_s double, embedding array<double>")
    labelled = occupancy.threshold_cluster(evidence, ["room_id"])
    got = {}
    for r in labelled.collect():
        got.setdefault(r["label"], set()).add(r["evidence_id"])
    assert {frozenset(g) for g in got.values()} == brute_linkage(np.array(vectors), 0.70)
    ticks = spark.createDataFrame([(1, 100, 23.0, 0.5, -40.0, False, None), (2, 101, 23.0, 0.5, -40.0, False, None)],
                                  "room_id long, frame_id long, t double, speech_ratio double, loudness_dbfs double, playback_active boolean, noise_floor_dbfs double")
    est = occupancy.headcount_estimate(ticks, evidence, 50.0).collect()
    assert len(est) == 1 and est[0]["raw_clusters"] == 3 and est[0]["crowd_weight"] == 0.0
    assert est[0]["log2_count"] == pytest.approx(math.log2(3)) and est[0]["confidence"] > 0.8


def test_series_of_picks_avoids_recent(spark):
    req = spark.createDataFrame([(i, 1, float(i), ["None", "Pop"], "low") for i in range(40)], "request_id long, room_id long, t double, genre_pool array<string>, tier string")
    tracks = spark.createDataFrame([(i, "Pop", "low") for i in range(14)], "track_id long, genre string, tier string")
    for slab in (5.0, 1000.0):
        picks = playback.select_tracks(req, playback.playlist_items(tracks), slab).orderBy("t").collect()
        ids = [p["track_id"] for p in picks]
        assert len(ids) == 40 and all(ids[i] not in ids[max(0, i - 10):i] for i in range(40))
    few = playback.select_tracks(req, playback.playlist_items(tracks.filter("track_id < 4")), 5.0)
    assert few.count() == 40


def test_model_hooks(spark):
    df = spark.createDataFrame([(1, 0.1, [1.0, 2.0]), (2, 0.9, [3.0, 4.0])], "id long, speech double, samples array<double>")
    scored = signal.score_windows(df, lambda pdf: pdf[["id"]].assign(valence=0.5), "id long, valence double", F.col("speech") >= 0.2)
    assert [tuple(r) for r in scored.collect()] == [(2, 0.5)]
    emb = signal.embed_segments(df.select("id", "samples"), lambda segs: [s[:2] for s in segs]).orderBy("id").collect()
    assert emb[1]["embedding"] == pytest.approx([0.6, 0.8])
