import numpy as np
import pytest
from builders import rows, sessions

from duologue import settings
from duologue.functions import lexicon
from duologue.functions import text as tx
from duologue.operators import grid, semantics, signals, synchrony
from duologue.settings import SemanticSettings, SynchronySettings


def ar1(rng, n, phi):
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.normal()
    return x


def test_synchrony():
    rng = np.random.default_rng(3)
    cfg = SynchronySettings(surrogates=20)
    a, b = ar1(rng, 6000, 0.97), ar1(rng, 6000, 0.97)
    alone = synchrony.windowed_correlation(a, b, 25.0, cfg)
    assert alone.peak_r > 0.15 and not alone.above_chance
    follow = synchrony.windowed_correlation(a, np.roll(a, 25) + 0.3 * rng.normal(size=6000), 25.0, cfg)
    assert follow.above_chance and follow.lag_s == pytest.approx(-1.0, abs=0.15)
    assert np.isnan(synchrony.windowed_correlation(a[:10], b[:10], 25.0, cfg).peak_r)


def test_uptake():
    partner = np.arange(5.0, 300, 20)
    assert synchrony.uptake(partner, partner + 0.8, 300.0) > 0.5
    assert abs(synchrony.uptake(partner, np.arange(0.0, 300, 1), 300.0)) < 0.1
    assert np.isnan(synchrony.uptake(partner[:1], partner, 300.0))


def test_resampling(spark):
    def run(t, y, n, hz, gap):
        s = spark.createDataFrame([("s", "A", float(a), float(b)) for a, b in zip(t, y)], "session_id string, person string, t_s double, value double")
        g = spark.createDataFrame([("s", "A", i, i / hz) for i in range(n)], "session_id string, person string, i int, t_s double")
        return [r["value"] for r in rows(grid.resample(s, g, gap), "i")]

    assert run([0, 1], [0, 10], 3, 2.0, 5) == [0, 5, 10]
    assert run([1, 2], [1, 2], 5, 1.0, 5) == [None, 1, 2, None, None]
    got = run([0, 0.5, 5.5, 6], [1, 1, 9, 9], 13, 2.0, 1)
    assert got[0] == 1 and got[3:11] == [None] * 8 and got[11] == 9


def test_text(spark):
    texts = ["What did you study?", "Did you like it?", "You grew up there, right?", "You grew up there?", "I grew up there.", "don't ' ''"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows(df.select("i", tx.question_type(tx.F.col("t")).alias("q"), tx.tokens(tx.F.col("t")).alias("k")), "i")
    assert [r["q"] for r in got] == ["wh", "yes_no", "tag", "declarative", None, None] and got[-1]["k"] == ["dont"]
    long_ = spark.createDataFrame([([f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)] * k,) for k in (1, 5)], "t array<string>")
    assert len({round(r[0], 9) for r in long_.select(tx.type_token_ratio(tx.F.col("t"))).collect()}) == 1
    phrases = spark.createDataFrame([("i think i think you know",)], "t string").select(tx.count_phrases(tx.tokens(tx.F.col("t")), ["i think", "you know", "think"])).first()[0]
    assert phrases == 5
    assert {"well", "were"} <= set(lexicon.FIRST_PERSON_PLURAL) and len(set(lexicon.stopwords())) == len(lexicon.stopwords())


def test_callbacks_against_a_loop(spark):
    rng = np.random.default_rng(5)
    cfg = SemanticSettings(callback_min_lag=2, min_similarity=-1.0)
    words = [f"topic{chr(97 + i)}{chr(97 + i)}" for i in range(14)]
    texts = [" ".join(rng.choice(words, 4)) for _ in range(30)]
    vectors = rng.normal(size=(30, 5)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    turns = spark.createDataFrame([("s", i, "AB"[i % 2], float(i), i + 0.5, t) for i, t in enumerate(texts)], "session_id string, turn_index int, person string, start_s double, end_s double, text string")
    emb = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(vectors)], "session_id string, turn_index int, v array<float>")
    got = {(r["turn_index"], r["source_index"]): r["anchors"] for r in semantics.find_callbacks(semantics.usable_turns(turns, emb, cfg), cfg).collect()}
    terms = []
    for t in texts:
        w = t.split()
        terms.append(set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])})
    df = {t: sum(t in x for x in terms) for x in terms for t in x}
    expected = {}
    for j in range(30):
        best = None
        for i in range(max(0, j - 40), j - 1):
            shared = sorted(t for t in terms[i] & terms[j] if df[t] <= 7 and not any(t in terms[k] for k in range(i + 1, j)))
            if shared:
                sim = float(np.dot(vectors[i].astype(float), vectors[j].astype(float)))
                if best is None or (sim, j - i) > best[0]:
                    best = ((sim, j - i), i, shared)
        if best:
            expected[j, best[1]] = best[2]
    assert got == expected


def test_topics():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=8), rng.normal(size=8)
    v = np.stack([(a if i < 10 else b) + 0.05 * rng.normal(size=8) for i in range(20)])
    starts = semantics.segment(v)
    assert len(starts) == 2 and 8 <= starts[1] <= 11 and semantics.segment(v[:6]) == [0]


def test_kernels():
    assert signals.hysteresis(np.array([0] * 10 + [0.9] * 30 + [0.4] * 3 + [0.9] * 10 + [0] * 30), 100.0) == [(pytest.approx(0.07), pytest.approx(0.56))]
    states = np.array([1] * 10 + [2] * 2 + [1] * 5 + [0] * 20, np.int8)
    assert signals.absorb_short_runs(states, 3).tolist() == [1] * 17 + [0] * 20
    e = np.log(np.full((60, 4), 0.1))
    e[:30, 1] = e[30:, 2] = 0
    path = signals.viterbi(e, signals.speaker_transitions())
    assert path.tolist() == [1] * 30 + [2] * 30
    assert np.allclose(signals.posteriors(e, signals.speaker_transitions()).sum(axis=1), 1)
    t = np.arange(6000) / 100
    pitch = np.where((t > 10) & (t < 12), 6 * np.sin(2 * np.pi * 2.5 * t), 0)
    found = signals.oscillations(pitch, np.zeros(6000), 100.0)
    assert len(found) == 1 and 9.5 < found[0][0] < 10.5 and signals.oscillations(np.zeros(6000), pitch, 100.0) == []
    noise = np.random.default_rng(1).normal(size=4000)
    lag, sharp = signals.gcc_phat(np.roll(noise, 37), noise, 1000.0, 0.5)  # the first one is later
    assert lag == pytest.approx(0.037, abs=1e-3) and sharp > 5
    assert signals.coarse_lag(noise[:3000], noise[100:3100], 500)[0] == 100 and np.isnan(signals.gcc_phat(noise[:0], noise, 1000.0, 0.5)[0])


def test_hysteresis_at_the_end_of_a_track():
    low = [0.0] * 5
    assert signals.hysteresis(np.array([0.9] * 50 + low), 100.0) == [(0.0, pytest.approx(0.55))]  # too short a dip to close
    assert signals.hysteresis(np.array([0.9] * 50 + [0.0] * 6), 100.0) == [(0.0, pytest.approx(0.53))]
    assert signals.hysteresis(np.array([0.4] * 50), 100.0) == [] and signals.hysteresis(np.zeros(0), 100.0) == []
    # the lower threshold is at least 0.01
    assert signals.hysteresis(np.array([0.2] * 20 + [0.0] * 20), 100.0, on=0.1) == [(0.0, pytest.approx(0.23))]

    def stepwise(p, hz, on=0.5, off=0.35, hold=6):
        mask, start, low = np.zeros(len(p), bool), None, 0
        for i, x in enumerate(p):
            if start is None:
                start, low = (i, 0) if x >= on else (None, 0)
            else:
                low = low + 1 if x < off else 0
                if low >= hold:
                    mask[start : i - low + 1], start = True, None
        if start is not None:
            mask[start:] = True
        return [(a, b) for a, b in signals.runs_of(mask) if b - a >= 10]

    rng = np.random.default_rng(8)
    for _ in range(300):
        p = np.repeat(rng.random(20), rng.integers(1, 14, 20))
        got = signals.hysteresis(p, 100.0, pad_s=0.0)
        assert [(round(a * 100), round(b * 100)) for a, b in got] == stepwise(p, 100.0)


def test_overlap_is_cleaned_first():
    states = np.array([1] * 10 + [3] * 4 + [2] * 2 + [3] * 4 + [1] * 10, np.int8)
    assert signals.clean_states(states, 3, 5).tolist() == [1] * 30
    assert signals.clean_states(states, 3).tolist() == [1] * 10 + [3] * 10 + [1] * 10


def test_filled_pauses():
    rng = np.random.default_rng(2)
    n, hz = 3000, 100.0
    mfcc, pitch = np.cumsum(rng.normal(size=(n, 12)), axis=0), np.log(120 + 30 * np.sin(np.arange(n) / 5) + rng.normal(size=n))
    for a, b in ((500, 560), (1500, 1540), (2000, 2010)):
        mfcc[a:b], pitch[a:b] = mfcc[a], pitch[a]
    got = signals.filled_pauses(mfcc, pitch, np.ones(n, bool), hz)
    assert len(got) == 2 and [round(a, 1) for a, _ in got] == [5.0, 15.0]
    pitch[520:540] = np.nan
    assert len(signals.filled_pauses(mfcc, pitch, np.ones(n, bool), hz)) >= 1
    assert signals.filled_pauses(mfcc, pitch, np.arange(n) < 300, hz) == [] and signals.filled_pauses(mfcc, np.full(n, np.nan), np.ones(n, bool), hz) == []


def test_kernels_by_session(spark):
    t = np.arange(2000) / 100
    pitch = np.where((t > 5) & (t < 8), 6 * np.sin(2 * np.pi * 2.5 * t), 0.0)
    frames = spark.createDataFrame([("s", "A", i, float(p), 0.0) for i, p in enumerate(pitch)], "session_id string, person string, i int, head_pitch double, head_yaw double")
    assert signals.nods(frames, 100.0).count() == 1 and signals.shakes(frames, 100.0).count() == 0
    emissions = spark.createDataFrame([("s", i, [0.0, 5.0, 0.0, 0.0] if i < 50 else [0.0, 0.0, 5.0, 0.0]) for i in range(100)], "session_id string, i int, e array<double>")
    assert [r["speaker_state"] for r in rows(signals.decode_speakers(emissions, 100.0), "i")] == [1] * 50 + [2] * 50


def test_settings():
    assert settings.load('{"turns": {"max_gap_s": 5}}', frame_hz=25.0).turns.max_gap_s == 5
    assert settings.load(turns__max_gap_s=7.0).turns.max_gap_s == 7.0
    with pytest.raises(ValueError):
        settings.load('{"turns": {"nonsense": 1}}')


def test_frame_grid(spark):
    assert grid.frame_grid(sessions(spark, 2.0, hz=10.0)).count() == 42
