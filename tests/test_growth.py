"""What must not grow with a session's frames: plans that send them to the driver, shuffle them or hold them all; kernels that step one session at a time."""

import numpy as np
import pytest

from duologue.operators import attribution, signals
from duologue.operators import intervals as iv
from tests.builders import rows

try:
    import __spark_entry__ as entry
except ImportError:
    entry = None


def above(df, outer: str, inner: str) -> list[str]:
    """Operators of the physical plan that begin with ``outer`` and have one that begins with ``inner`` below them."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-").split(") ", 1)[-1] if x.lstrip(" :+-")[:2] == "*(" else x.lstrip(" :+-")) for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() + df._jdf.queryExecution().executedPlan().toString().splitlines()]
    found = []
    for k, (depth, text) in enumerate(lines):
        if text.startswith(outer):
            for deeper, below in lines[k + 1 :]:
                if deeper <= depth:
                    break
                if below.startswith(inner):
                    found.append(text[:80])
                    break
    return found


@pytest.mark.parametrize("name", ["signal_unmix", "signal_level_model", "signal_short_runs", "signal_speech_spans", "signal_attribution", "signal_nods", "interval_from_mask"])
def test_frames_stay_where_they_are_made(spark, sf, name):
    plan = entry.queries()[name](spark, sf)
    assert above(plan, "Generate", "Exchange") and not above(plan, "Exchange", "Generate") and not above(plan, "BroadcastExchange", "Generate")


def test_levels_are_side_by_side_without_an_aggregate(spark, sf):
    plan = entry.queries()["signal_unmix"](spark, sf)
    assert not above(plan, "HashAggregate", "Generate") and not above(plan, "SortAggregate", "Generate")


def test_chunks_are_not_broadcast(spark, sf):
    assert not above(entry.queries()["signal_probability_grid"](spark, sf), "BroadcastExchange", "Generate")


def test_sessions_are_dealt_to_more_tasks_as_events_grow(spark, sf, monkeypatch):
    from duologue.sources import testdata as td

    e = td.event_rows(spark, sf)
    monkeypatch.setattr(td, "FRAME_BYTES", 512)
    assert td.dealt(td.event_sessions(e), e).rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism


def test_frames_of_spans_come_once_without_a_distinct(spark):
    spans = spark.createDataFrame([("s", "A", 0.0, 10.0), ("s", "A", 2.0, 3.0), ("s", "A", 2.5, 12.0), ("s", "A", 20.2, 20.6), ("s", "A", 20.7, 20.9), ("s", "B", -3.0, 1.0), ("t", "A", 1.0, 1.0)], "session_id string, person string, start_s double, end_s double")
    for outer, last in ((False, []), (True, [20])):
        got = iv.to_frames(spans, 1.0, outer=outer)
        assert [(r["session_id"], r["person"], r["i"]) for r in rows(got, "session_id", "person", "i")] == [*(("s", "A", i) for i in [*range(12), *last]), ("s", "B", 0)]
        assert not above(got, "HashAggregate", "Generate")


def test_steps_of_many_tracks_at_once():
    rng, move = np.random.default_rng(3), signals.speaker_transitions()
    tracks = [rng.normal(size=(n, 4)) * 4 for n in (1, 7, 60, 60, 33)]

    def logs(e):
        forward, backward = [e[0]], [np.zeros(4)]
        for x in e[1:]:
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + move, axis=0) + x)
        for x in e[:0:-1]:
            backward.insert(0, np.logaddexp.reduce(move + x + backward[0], axis=1))
        p = np.array(forward) + np.array(backward)
        return np.exp(p - np.logaddexp.reduce(p, axis=1)[:, None])

    for e, path, p in zip(tracks, signals.viterbi_all(tracks, move), signals.posteriors_all(tracks, move)):
        score = lambda s: e[np.arange(len(e)), s].sum() + move[s[:-1], s[1:]].sum()
        assert np.array_equal(path, signals.viterbi(e, move)) and np.allclose(p, logs(e), rtol=1e-9, atol=1e-12)
        assert all(score(path) >= score(rng.integers(0, 4, len(e))) for _ in range(20))


def test_sessions_attributed_together_are_as_alone():
    rng = np.random.default_rng(5)
    scenes = [(rng.normal(60, 6, (n, 2)), rng.random(n)) for n in (300, 450, 120)] + [(np.full((200, 2), 50.0), rng.random(200))]
    cfg = attribution.AttributionSettings()
    both = attribution.together([attribution._attributed(e, p, 10.0, (None, None), cfg, None) for e, p in scenes], cfg)
    for (e, p), found in zip(scenes, both):
        alone = attribution.attribute(e, p, 10.0)
        assert np.array_equal(found.state, alone.state) and np.allclose(found.confidence, alone.confidence) and found.diagnostics["method"] == alone.diagnostics["method"]


def test_groups_reach_a_kernel_together_and_in_order(spark):
    df = spark.createDataFrame([(f"s{k}", i, float(i * k) if i else None) for k in range(5) for i in reversed(range(3))], "session_id string, i int, x double")
    seen = lambda groups: [{"n": [len(groups)], "xs": [list(g["x"])]} for g in groups]
    got = rows(signals.map_groups(df.repartition(1), ["session_id"], ["x"], seen, "n int, xs array<double>"), "session_id")
    assert [r["n"] for r in got] == [5] * 5 and [np.isnan(r["xs"][0]) for r in got] == [True] * 5 and [r["xs"][1:] for r in got] == [[k, 2 * k] for k in map(float, range(5))]


def test_look_ups_of_frames(spark):
    rng = np.random.default_rng(11)
    frames = spark.createDataFrame([(s, p, i) for s in "st" for p in "AB" for i in range(40)], "session_id string, person string, i int")
    made = [("s", str(p), int(k), int(a), int(a + n)) for p in "AB" for k, (a, n) in enumerate(zip(rng.integers(0, 38, 12), rng.integers(0, 9, 12)))] + [("t", "B", 7, 0, 0)]
    ranges = spark.createDataFrame(made, "session_id string, person string, turn_index int, a int, b int")
    got = sorted(tuple(r) for r in iv.frames_within(frames, ranges, "turn_index").collect())
    assert got == sorted((s, p, i, k) for s, p, k, a, b in made for i in range(a, b + 1) if i < 40)
    apart = [("s", "A", 3, 5), ("s", "A", 6, 6), ("s", "A", 30, 60), ("s", "B", 0, 0), ("u", "A", 1, 2)]
    flagged = iv.flag_frames(frames, {"x": spark.createDataFrame(apart, "session_id string, person string, a int, b int"), "y": spark.createDataFrame([("t", "B", 39, 39)], "session_id string, person string, a int, b int")})
    assert {(r["session_id"], r["person"], r["i"]) for r in flagged.collect() if r["x"]} == {(s, p, i) for s, p, a, b in apart for i in range(a, min(b, 39) + 1) if s != "u"}
    assert [tuple(r) for r in flagged.filter("y").collect()] == [("t", "B", 39, False, True)] and flagged.count() == 160


@pytest.mark.parametrize("name", ["timeline_table", "measures_prosody", "measures_face_gaze_body_affect"])
def test_frames_are_not_joined_by_number(spark, sf, name):
    plan = entry.queries()[name](spark, sf)
    text = plan._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in text.splitlines() if "Join [" in x or "JoinExec" in x]
    keys = [x.split("Join [", 1)[1].split("]", 1)[0] for x in joins if "Join [" in x]
    assert keys and not [k for k in keys if ", i#" in k]


def test_measures_are_joined_while_wide(spark, sf):
    text = entry.queries()["measures_backchannel"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in text.splitlines() if "Join [" in x and "person#" in x.split("Join [", 1)[1].split("]", 1)[0] and "measure#" in x.split("Join [", 1)[1].split("]", 1)[0]]


def test_synchrony_is_one_map_over_frames_where_they_are(spark, sf):
    from duologue.operators import synchrony
    from duologue.sources import testdata as td

    corpus = td.event_corpus(spark, sf)
    plan = synchrony.synchrony(corpus.frames, corpus.sessions, {"smile": ("",)})
    assert not above(plan, "FlatMapGroupsInPandas", "Generate") and not above(plan, "Exchange", "Generate")


def test_surrogates_at_once_are_as_one_by_one():
    from duologue.operators import synchrony as sy

    rng = np.random.default_rng(4)
    a, b = np.sort(rng.uniform(0, 600, 9)), rng.uniform(0, 600, 14)
    shifts = np.random.default_rng(20260730).uniform(4, 596, 200)
    assert sy.uptake(a, b, 600.0) == sy.follow_rate(a, b, 2.0) - float(np.mean([sy.follow_rate((a + s) % 600.0, b, 2.0) for s in shifts]))
    x, y = rng.normal(size=(2, 900))
    x[40:60], y[500:700:3] = np.nan, np.nan
    made = sy.windowed_correlation(x, y, 1.0)
    shift = int(np.random.default_rng(20260730).integers(60, 840))
    one = sy.windowed_correlation(x, np.roll(y, shift), 1.0, sy.SynchronySettings(surrogates=1))
    first = sy.windowed_correlation(x, y, 1.0, sy.SynchronySettings(surrogates=5))
    assert made.n_surrogates == 50 and first.n_surrogates == 5 and one.peak_r != made.peak_r
    # the peak of each window by definition
    starts = [s for s in range(0, 871, 10)]
    sides = [sy.Series(v).windows(np.array(starts), 30) for v in (x, y)]
    peaks = [max(sum(p[t + k] * q[t] for t in range(max(0, -k), min(30, 30 - k))) / (30 - abs(k)) for k in range(-5, 6)) for p, q, u, v in zip(sides[0][0], sides[1][0], sides[0][1], sides[1][1]) if u and v]
    assert made.n_windows == len(peaks) and made.peak_r == pytest.approx(np.mean(peaks), abs=1e-12)
