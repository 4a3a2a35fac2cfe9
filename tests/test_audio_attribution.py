import numpy as np
import pytest

from duologue.operators import alignment, attribution, audio
from duologue.settings import AttributionSettings, SyncSettings, load


def test_frames_and_filters():
    t = np.arange(8000) / 8000
    low, high = np.sin(2 * np.pi * 60 * t), np.sin(2 * np.pi * 1000 * t)
    kept = audio.highpass(low + high, 8000, 300)
    assert np.abs(kept[800:-800] - high[800:-800]).max() < 0.05 and np.allclose(audio.highpass(low, 8000, 0), low)
    e = audio.frame_energy(high, 8000, 100.0)
    assert len(e) == 101 and e[20:80].std() < 0.1
    assert audio.frame_energy(high, 8000, 100.0, (900, 1100))[50] - audio.frame_energy(high, 8000, 100.0, (2000, 3000))[50] > 30
    with pytest.raises(ValueError):
        audio.frame_energy(high, 8000, 100.0, (9000, 9500))
    assert abs(audio.energy_envelope(high * (t < 0.5), 8000).mean()) < 1e-9
    moved = audio.placed(np.ones(100), 0.01, 1000, 10, 100.0)
    assert moved[:10].sum() == 0 and moved[10:110].sum() == 100 and len(moved) == 1100
    assert audio.placed(np.arange(100.0), -0.01, 1000, 10, 100.0)[0] == 10
    assert np.isnan(audio.fitted(np.ones(2), 4)).tolist() == [False, False, True, True] and audio.fitted(np.ones(9), 4).sum() == 4


def test_probability_grid(spark):
    chunks = spark.createDataFrame([("s", k, p) for k, p in enumerate([0.2, 0.8, 0.4])], "session_id string, chunk int, p double")
    frames = spark.createDataFrame([(s, i, i / 100) for s in "sx" for i in range(12)], "session_id string, i int, t_s double")
    got = {(r["session_id"], r["i"]): r["speech_prob"] for r in audio.probability_to_grid(chunks, frames, 31.25).collect()}
    centres = (np.arange(3) + 0.5) / 31.25
    for i in range(12):
        assert got["s", i] == pytest.approx(np.interp(i / 100, centres, [0.2, 0.8, 0.4])) and got["x", i] == 0


def test_alignment(spark):
    rng, rate = np.random.default_rng(0), 2000
    n = 60 * rate
    base = rng.normal(size=n) * np.repeat(rng.random(120) + 0.05, n // 120)
    late = np.r_[rng.normal(size=int(1.237 * rate)) * 0.1, base][:n]
    cfg = SyncSettings(max_offset_s=5.0, probe_window_s=8.0)
    tracks = spark.createDataFrame([("s", "wide", rate, base.tolist()), ("s", "a", rate, late.tolist()), ("s", "b", rate, np.zeros(n).tolist())], "session_id string, role string, sample_rate int, samples array<double>")
    got = {r["role"]: r for r in alignment.align_views(tracks, "wide", cfg).collect()}
    assert got["a"]["offset_s"] == pytest.approx(-1.237, abs=1e-3) and got["a"]["n_probes"] == 9 and got["a"]["scatter_s"] < 1e-3 and abs(got["a"]["drift_ppm"]) < 50
    assert got["b"]["method"] == "envelope-only" and got["b"]["n_probes"] == 0 and "low confidence" in got["b"]["warnings"]
    starts = spark.createDataFrame([("s", "wide", 0.5), ("s", "a", 0.1)], "session_id string, role string, start_s double")
    moved = {r["role"]: r["offset_s"] for r in alignment.align_views(tracks, "wide", cfg, starts).collect()}
    assert moved["a"] == pytest.approx(-1.237 + 0.4, abs=1e-3)


def scene(seed=3, seconds=120, hz=100.0, overlap=True):
    """Levels of two microphones, eleven decibels of separation, with known speakers."""
    rng = np.random.default_rng(seed)
    truth, k = [], 0
    while len(truth) < seconds * hz:
        for s, length in ((1, 2.5), (3, 0.6 if overlap else 0), (2, 2.0), (0, 0.7)):
            truth += [s] * int(length * hz * rng.uniform(0.7, 1.3))
        k += 1
    truth = np.array(truth[: int(seconds * hz)])
    a, b = attribution.SPEAKING["A"][truth] * 1e6, attribution.SPEAKING["B"][truth] * 1e6
    leak = 10**-1.1
    energy = 10 * np.log10(np.stack([a + leak * b, b + leak * a], axis=1) + 10) + rng.normal(size=(len(truth), 2)) * 1.5
    return truth, energy, np.clip(np.where(truth > 0, 0.9, 0.1) + rng.normal(size=len(truth)) * 0.05, 0, 1)


def test_attribution_by_two_microphones():
    truth, energy, p = scene()
    found = attribution.attribute(energy, p, 100.0)
    assert found.diagnostics["method"] == "unmixed-source" and not found.diagnostics["shared_audio"]
    assert (found.state == truth).mean() > 0.93 and (found.state == 3)[truth == 3].mean() > 0.7
    single = (truth == 1) | (truth == 2)
    assert (found.state[single] == 3 - truth[single]).mean() < 0.01 and found.confidence.mean() > 0.9
    levels = attribution.learn_levels(energy, truth)
    assert levels.ok and np.allclose(levels.separation, 11, atol=0.5) and np.allclose(levels.leak, 10**-1.1, atol=0.01)
    assert np.allclose(levels.expected()[3], [60.3, 60.3], atol=0.3)
    with pytest.raises(ValueError):
        attribution.attribute(energy[:0], p, 100.0)


def test_attribution_by_faces_and_voices_where_both_tracks_are_one():
    truth, energy, p = scene(overlap=False)
    same = np.repeat(energy.mean(axis=1)[:, None], 2, axis=1)
    rng, t = np.random.default_rng(1), np.arange(len(truth)) / 100
    lips = tuple(0.02 * rng.normal(size=len(truth)) + np.sin(2 * np.pi * 4 * t) * (truth == k) for k in (1, 2))
    seen = attribution.attribute(same, p, 100.0, lips)
    assert seen.diagnostics["method"] == "visual-only" and seen.diagnostics["overlap_identifiable"] == 0
    assert (seen.state == truth).mean() > 0.85
    heard = attribution.attribute(same, p, 100.0, voice=np.where(truth == 1, 3.0, np.where(truth == 2, -3.0, 0.0)))
    assert heard.diagnostics["method"] == "voice-model" and (heard.state == truth).mean() > 0.9
    nothing = attribution.attribute(same, p, 100.0)
    assert any("nothing tells" in w for w in nothing.warnings)


def test_calibration():
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(-8, 2, 700), rng.normal(6, 2, 300)]
    b = attribution.calibrate(x, np.ones(1000, bool))
    assert b.method == "gmm" and b.ok and b.offset_db == pytest.approx(-1, abs=0.4) and b.separation_db == pytest.approx(14, abs=0.6)
    assert attribution.calibrate(x[:50], np.ones(50, bool)).method == "insufficient-data"
    assert attribution.calibrate(np.full(200, 3.0), np.ones(200, bool)) == attribution.Balance(3.0, 0.0, "identical-channels", False)


def test_running_percentile_and_coherence():
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    padded = np.pad(x, (7, 7), mode="edge")
    assert np.allclose(attribution.percentile_filter(x, 15, 70), [np.sort(padded[i : i + 15])[10] for i in range(200)])
    known = np.ones(400, bool)
    y = np.abs(np.cumsum(rng.normal(size=400)))
    assert attribution.coherence(y, known, 3 * y + 2, 25.0)[30:-30].min() > 0.99 and attribution.coherence(y, ~known, y, 25.0).sum() == 0


def test_attribution_by_session(spark):
    truth, energy, p = scene(seconds=30)
    rows = [(s, i, float(e[0]), float(e[1]), float(q)) for s in ("x", "y") for i, (e, q) in enumerate(zip(energy, p))]
    frames = spark.createDataFrame(rows, "session_id string, i int, energy_a double, energy_b double, speech_prob double")
    states = attribution.attribute_speakers(frames, 100.0).cache()
    got = {}
    for r in states.orderBy("session_id", "i").collect():
        got.setdefault(r["session_id"], []).append(r["speaker_state"])
    assert got["x"] == got["y"] and np.mean(np.array(got["x"]) == truth) > 0.9
    spans = attribution.speech_of(states, 100.0)
    total = {(r["session_id"], r["person"]): r["n"] for r in spans.selectExpr("session_id", "person", "(end_s - start_s) AS n").groupBy("session_id", "person").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert total["x", "A"] == pytest.approx(sum(s in (1, 3) for s in got["x"]) / 100)
    report = attribution.attribution_reports(frames, 100.0).filter("session_id = 'x'").first()
    assert report["diagnostics"]["method"] == "unmixed-source" and 0 <= attribution.uncertain_share(states).first()["uncertain"] < 0.2


def test_settings_are_written_and_read():
    changed = load(attribution__min_state_s=0.2, sync__n_probes=5)
    assert load(changed.dump()) == changed and changed.attribution == AttributionSettings(min_state_s=0.2)
    with pytest.raises(ValueError):
        load('{"sync": {"nonsense": 1}}')
