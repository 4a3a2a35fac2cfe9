import random

import pytest
from builders import rows, spans, talk

from duologue.operators import turns as tn
from duologue.settings import TurnSettings


def sets(spark, a, b, duration=50, words=None):
    return talk(spark, a, b, duration, words).turn_set


def shape(ts):
    return [(r["person"], round(r["start_s"], 3), round(r["end_s"], 3)) for r in rows(ts.turns, "turn_index")]


def test_units(spark):
    assert len(rows(sets(spark, [(0, 1), (1.1, 2)], [(5, 6)]).ipus.filter("person = 'A'"), "start_s")) == 1
    assert len(rows(sets(spark, [(0, 1), (1.5, 2)], [(5, 6)]).ipus.filter("person = 'A'"), "start_s")) == 2
    texts = rows(sets(spark, [(0, 1), (2, 3)], [(5, 6)], words=[("A", 0.1, 0.3, "hello"), ("A", 2.1, 2.4, "world")]).ipus.filter("person = 'A'"), "start_s")
    assert [t["text"] for t in texts] == ["hello", "world"] and [t["n_words"] for t in texts] == [1, 1]
    assert rows(sets(spark, [(1, 2)], [(0, 3)]).ipus.filter("person = 'A'"), "start_s")[0]["containment"] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "a, b, words, expected",
    [
        ([(0, 10)], [(3, 3.4)], None, True),
        ([(0, 10)], [(3, 6)], None, False),
        ([(0, 3.2)], [(3, 3.5)], None, False),
        ([(0, 10)], [(3, 3.8)], [("B", 3.1, 3.3, "absolutely"), ("B", 3.4, 3.7, "not")], False),
        ([(0, 10)], [(3, 3.8)], [("B", 3.1, 3.3, "oh"), ("B", 3.4, 3.7, "yeah")], True),
    ],
)
def test_backchannels(spark, a, b, words, expected):
    assert (sets(spark, a, b, words=words).backchannels.filter("person = 'B'").count() == 1) == expected


def test_offsets(spark):
    ts = sets(spark, [(0, 10)], [(4, 4.4)], 12)
    assert shape(ts) == [("A", 0, 10)] and ts.backchannels.count() == 1
    fto = lambda a, b: [r["fto"] for r in rows(sets(spark, a, b).turns, "turn_index")][-1]
    assert fto([(0, 3)], [(3.5, 6)]) == pytest.approx(0.5)
    assert fto([(0, 3)], [(2.7, 6)]) == pytest.approx(-0.3)
    assert fto([(0, 3)], [(23, 26)]) is None
    ts = sets(spark, [(0, 3), (4, 6)], [(40, 41)], 45)
    assert shape(ts)[0] == ("A", 0, 6) and [round(r["end_s"] - r["start_s"], 3) for r in tn.pauses(ts.turns).collect()] == [1.0]


def test_interruptions(spark):
    def made(a, b, d):
        return [(r["interrupter"], r["kind"], r["successful"]) for r in rows(sets(spark, a, b, d).interruptions, "time_s")]

    assert [(x[0], x[1]) for x in made([(0, 10)], [(4, 12)], 13)] == [("B", "interruption")]
    assert [x[1] for x in made([(0, 10)], [(9.7, 14)], 15)] == ["transition_overlap"]
    assert made([(0, 5.2)], [(4, 12)], 13)[0][2] is True
    assert made([(0, 12)], [(4, 4.6)], 13) == []


def test_floor(spark):
    ts = sets(spark, [(0, 30), (40, 45)], [(12, 14), (31, 39)], 50)
    assert [p for p, *_ in shape(ts)] == ["A", "B", "A"] and shape(ts)[0] == ("A", 0, 30) and ts.non_floor.count() == 1
    assert [(r["interrupter"], r["successful"]) for r in rows(ts.interruptions, "time_s")] == [("B", False)]
    assert [r["fto"] for r in rows(sets(spark, [(0, 12)], [(10, 25)], 30).turns, "turn_index")][1] == pytest.approx(-2.0)
    ts = sets(spark, [(0, 2), (5, 7)], [(2.5, 4.5), (7.5, 9.5)], 11)
    assert [p for p, *_ in shape(ts)] == ["A", "B", "A", "B"] and [r["fto"] for r in rows(ts.turns, "turn_index")][1:] == pytest.approx([0.5] * 3)
    assert shape(sets(spark, [(5, 8)], [(0, 3)], 10))[0][0] == "B"
    assert shape(sets(spark, [(0, 10), (10.4, 20)], [(10.15, 10.25)], 21)) == [("A", 0, 20)]


def test_mutual_silence(spark):
    corpus = talk(spark, [(0, 2)], [(3, 5)], 6)
    assert sum(r["end_s"] - r["start_s"] for r in tn.mutual_silence(corpus.turn_set.speech, corpus.sessions).collect()) == pytest.approx(2.0)


@pytest.mark.parametrize("seed", range(4))
def test_floor_against_a_loop(spark, seed):
    """The window formulation against the rule stated one unit at a time."""
    rng, cfg = random.Random(seed), TurnSettings()
    mk = lambda: [(t, t + rng.uniform(0.3, 5)) for t in (rng.uniform(0, 90) for _ in range(14))]
    ts = sets(spark, mk(), mk(), 100)
    units = [r for r in rows(ts.ipus, "start_s", "person") if not r["is_backchannel"]]
    strong = lambda u: u["containment"] < 0.5 or u["end_s"] - u["start_s"] >= 3 or u["partner_after"] <= 0.15 or u["own_after"] > u["partner_after"]
    turns, non_floor = [], 0
    for u in units:
        if turns and u["person"] == turns[-1]["person"]:
            if u["start_s"] - turns[-1]["end"] <= cfg.max_gap_s:
                turns[-1]["end"] = max(turns[-1]["end"], u["end_s"])
            else:
                turns.append({"person": u["person"], "start": u["start_s"], "end": u["end_s"]})
        elif not turns or strong(u):
            turns.append({"person": u["person"], "start": u["start_s"], "end": u["end_s"]})
        else:
            non_floor += 1
    turns = [t for t in turns if t["end"] - t["start"] >= cfg.min_turn_s]
    merged = []
    for t in turns:
        if merged and merged[-1]["person"] == t["person"] and t["start"] - merged[-1]["end"] <= cfg.max_gap_s:
            merged[-1]["end"] = max(merged[-1]["end"], t["end"])
        else:
            merged.append(dict(t))
    assert shape(ts) == [(t["person"], round(t["start"], 3), round(t["end"], 3)) for t in merged]
    assert ts.non_floor.count() == non_floor


def test_listening(spark):
    held = spans(spark, (0, 10), person="A").withColumn("turn_index", tn.F.lit(0))
    heard = tn.listening(held, spans(spark, (4, 5), person="B")).collect()
    assert sorted((r["person"], r["start_s"], r["end_s"]) for r in heard) == [("B", 0.0, 4.0), ("B", 5.0, 10.0)]
