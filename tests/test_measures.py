import math

import pytest
from builders import reasons, rows, sessions, spans, talk, values
from pyspark.sql import functions as F

from duologue.plans import measures, reports  # noqa: F401
from duologue.plans.catalogue import SPECS
from duologue.plans.corpus import Corpus
from duologue.plans.registry import MEASURES, compute, register

TEN = [(p, s, s + 4.0, f) for p, s, f in (("A", 0.0, None), ("B", 4.2, 0.2), ("A", 8.6, 0.4), ("B", 12.8, 0.2), ("A", 17.2, 0.4), ("B", 21.4, 0.2), ("A", 25.8, 0.4), ("B", 30.0, 0.2), ("A", 34.4, 0.4), ("B", 38.6, 0.2))]


def ten_turns(spark, **more):
    made = [("s", i, p, a, b, [(a, b, " ".join(["word"] * 10), 10)], " ".join(["word"] * 10), 10, 4.0, f, TEN[i - 1][0] if i else None, False) for i, (p, a, b, f) in enumerate(TEN)]
    turns = spark.createDataFrame(made, "session_id string, turn_index int, person string, start_s double, end_s double, ipus array<struct<start_s:double,end_s:double,text:string,n_words:int>>, text string, n_words int, speech_s double, fto double, prev_person string, is_overlap_onset boolean")
    speech = spark.createDataFrame([("s", p, a, b) for p, a, b, _ in TEN], "session_id string, person string, start_s double, end_s double")
    return Corpus(sessions(spark, 45), speech, turns=turns, **more)


def test_catalogue():
    assert len(SPECS) == 132 == len(MEASURES) and set(SPECS) == set(MEASURES)
    assert sum(s.level == "person" for s in SPECS.values()) == 94 and len({s.family for s in SPECS.values()}) == 14
    assert all(i == i.lower() and i.replace("_", "").isalnum() for i in SPECS)
    with pytest.raises(ValueError):
        register("turn_count", "turns", lambda: F.lit(1))


def test_ten_turns(spark):
    ids = "response_latency_median response_latency_asymmetry response_latency_iqr fast_response_proportion turn_count turn_rate mean_turn_duration talk_time_share talk_time_balance silence_proportion words_per_turn spoke_first".split()
    v = values(compute(ten_turns(spark), [i for i in ids if i != "words_per_turn"]))
    assert v["response_latency_median", "A"] == pytest.approx(0.4) and v["response_latency_median", "B"] == pytest.approx(0.2)
    assert v["response_latency_asymmetry", "dyad"] == pytest.approx(0.2)
    assert v["response_latency_iqr", "A"] == pytest.approx(0) and v["response_latency_iqr", "B"] == pytest.approx(0)
    assert (v["fast_response_proportion", "A"], v["fast_response_proportion", "B"]) == (0, 1)
    assert v["turn_count", "A"] == v["turn_count", "B"] == 5 and v["turn_rate", "A"] == pytest.approx(5 / 45 * 60)
    assert v["mean_turn_duration", "A"] == pytest.approx(4) and v["talk_time_share", "A"] == pytest.approx(0.5)
    assert v["talk_time_balance", "dyad"] == pytest.approx(1) and (v["spoke_first", "A"], v["spoke_first", "B"]) == (1, 0)
    # the last turn ends at 42.6, so silence is the nine gaps and the rest of the session
    assert v["silence_proportion", "dyad"] == pytest.approx(5 / 45)


def test_lopsided(spark):
    assert values(compute(talk(spark, [(0, 9)], [(9, 10)], 10), ["talk_time_balance"]))["talk_time_balance", "dyad"] == pytest.approx(0.2)


def test_every_row_survives_with_a_reason(spark):
    long = reports.measures_long(talk(spark, [(0, 3), (8, 11)], [(4, 7)], 12)).collect()
    assert len(long) == 226 and all(r["available"] != (r["unavailable_reason"] is not None) for r in long)
    missing = {r["measure"]: r["unavailable_reason"] for r in long}
    assert missing["word_count"] == "requires transcript" and missing["speech_rate_wpm"] == "requires transcript"
    assert missing["nod_rate"] == "requires face"


def test_overlap_is_withheld(spark):
    corpus = talk(spark, [(0, 10)], [(4, 12)], 13)
    corpus.sessions = sessions(spark, 13, overlap=False)
    assert reasons(compute(corpus, ["interruption_rate"]))["interruption_rate", "A"] == "requires overlap_evidence"


def test_backchannel_measures(spark):
    corpus = talk(spark, [(0, 60)], [(10, 10.3), (20, 20.3)], 60)
    v = values(compute(corpus, ["backchannel_rate", "backchannel_reciprocity", "backchannel_coverage", "backchannel_relative_position", "backchannel_count"]))
    assert v["backchannel_rate", "B"] == pytest.approx(2.0) and v["backchannel_count", "B"] == 2 and v["backchannel_count", "A"] == 0
    assert v["backchannel_reciprocity", "dyad"] == 0 and v["backchannel_coverage", "B"] == 1
    assert v["backchannel_relative_position", "B"] == pytest.approx(0.25)


def test_words(spark):
    same = [(p, t * 0.5 + k * 30, t * 0.5 + 0.4 + k * 30, w) for k, p in enumerate("AB") for t, w in enumerate("well i think we like you and the dog was happy so very much".split() * 4)]
    corpus = talk(spark, [(0, 28)], [(30, 58)], 60, same)
    v = values(compute(corpus, ["linguistic_style_matching", "word_count", "first_person_plural_rate", "hedge_rate", "politeness_marker_rate", "emotion_word_rate"]))
    assert v["linguistic_style_matching", "dyad"] == pytest.approx(1.0) and v["word_count", "A"] == 56
    # "we", "well" and "was": contractions fold onto words, so "well" counts and "was" does not
    assert v["first_person_plural_rate", "A"] == pytest.approx(100 * 8 / 56) and v["hedge_rate", "A"] == pytest.approx(100 * 4 / 56)
    few = values(compute(talk(spark, [(0, 1)], [(2, 3)], 4, [("A", 0, 1, "hi"), ("B", 2, 3, "hi")]), ["linguistic_style_matching"]))
    assert few["linguistic_style_matching", "dyad"] is None


def frames(spark, n, **columns):
    base = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("person", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return base.select(F.lit("s").alias("session_id"), "person", "i", (F.col("i") / 10.0).alias("t_s"), *(x.alias(k) for k, x in columns.items()))


def test_face(spark):
    i = F.col("i")
    nan = F.lit(float("nan"))
    f = frames(spark, 600, tracked=F.lit(True), on_partner=(i % 4 != 0), smile=F.lit(0.0), duchenne=F.when(i.between(100, 120), 0.3).otherwise(0.0), brow_raise=F.when(i.between(50, 59), 0.5).otherwise(0.1), valence=F.when(i % 2 == 0, nan).otherwise(i / 600.0), expressivity=F.lit(0.2), head_pitch=F.lit(0.0))
    kinds = spans(spark, (10, 12), (30, 31)).withColumn("kind", F.lit("smile")).unionByName(spans(spark, (11, 13), person="B").withColumn("kind", F.lit("smile")))
    corpus = Corpus(sessions(spark, 60, hz=10.0), spans(spark, (0, 20)).unionByName(spans(spark, (20, 60), person="B")), spans=kinds, frames=f)
    v = values(compute(corpus, ["gaze_partner_proportion", "mutual_gaze_proportion", "smile_count", "smile_total_duration", "shared_smile_proportion", "duchenne_smile_ratio", "brow_raise_rate", "facial_valence_mean", "positive_affect_proportion", "gaze_partner_time"]))
    assert v["gaze_partner_proportion", "A"] == pytest.approx(0.75) == v["mutual_gaze_proportion", "dyad"]
    assert v["smile_count", "A"] == 2 and v["smile_total_duration", "A"] == pytest.approx(3)
    assert v["shared_smile_proportion", "dyad"] == pytest.approx(1 / 60) and v["duchenne_smile_ratio", "A"] == pytest.approx(0.5)
    assert v["brow_raise_rate", "A"] == pytest.approx(1.0) and v["facial_valence_mean", "A"] == pytest.approx(sum(range(1, 600, 2)) / 300 / 600)
    assert v["positive_affect_proportion", "A"] == pytest.approx(0.25, abs=0.01) and v["gaze_partner_time", "A"] == pytest.approx(45)


def test_quality_and_rollups(spark):
    corpus = talk(spark, [(0, 9), (20, 29)], [(10, 19), (30, 39)], 80)
    checks = reports.quality_checks(corpus)
    got = {r["name"]: r["passed"] for r in checks.collect()}
    assert got["duration"] and got["speech_proportion"] and not got["turn_count_minimum"] and got["talk_time_A"]
    assert rows(reports.verdicts(checks), "session_id")[0]["verdict"] == "fail"
    long = reports.measures_long(corpus, ["turn_count", "word_count"])
    assert reports.withheld(long).first()["reason"] == "requires transcript"
    assert reports.measures_wide(long, ["turn_count", "word_count"]).columns == ["session_id", "person", "turn_count", "word_count"]
    assert reports.session_summary(reports.verdicts(checks), checks, long, corpus.sessions).first()["values_total"] == 4
    assert "turn_count_minimum" in {r["check"] for r in reports.common_warnings(checks).collect()}
    assert reports.codebook(spark).count() == 132 and reports.codebook_markdown().count("- `") == 132
    assert math.isclose(reports.overview(reports.verdicts(checks), corpus.sessions).first()["minutes"], 80 / 60)


def test_video_checks_states_and_player(spark):
    import json

    from duologue.operators import intervals as iv

    said = spans(spark, (0, 5), (10, 12))
    session = spark.createDataFrame([("s", 20.0, 40.0, True)], "session_id string, duration_s double, frame_hz double, overlap_identifiable boolean").withColumn("meta", F.create_map().cast("map<string,string>"))
    state = spark.createDataFrame([("s", i, 1 if i < 200 else 2 if i < 500 else 0) for i in range(800)], "session_id string, i int, speaker_state int").withColumn("confidence", F.lit(0.9))
    from duologue.settings import load

    corpus = Corpus(session, said, state=state, settings=load(frame_hz=40.0))
    video = spark.createDataFrame([("s", "close_a", 0.5, 0.1, 720), ("s", "close_b", float("nan"), 0.001, 0)], "session_id string, role string, freeze_rate double, motion double, height int")
    got = {r["name"]: r["passed"] for r in reports.quality_checks(corpus, video=video).filter("name LIKE 'video%'").collect()}
    assert got == {"video_continuity_close_a": False, "video_motion_close_a": True, "video_resolution_close_a": True, "video_motion_close_b": False}
    payload = json.loads(reports.player_data(corpus, offsets=spark.createDataFrame([("s", "wide", 1.5)], "session_id string, role string, offset_s double")).first()["payload"])
    assert len(payload["state"]) == 400 and payload["state"][:100] == [1] * 100 and payload["duration"] == 20.0 and payload["sources"] == [{"role": "wide", "offset": -1.5}]
    assert [x["start"] for x in payload["spans"] if x["kind"] == "speech"] == [0.0, 10.0]
    bars = {r["bin"]: r["speaker_state"] for r in reports.ribbon(state, session, 40.0, 8).collect()}
    assert bars == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 0, 6: 0, 7: 0}
    labelled = said.withColumn("kind", F.lit("x")).unionByName(spans(spark, (4, 6)).withColumn("kind", F.lit("y")))
    labels = {r["i"]: r["labels"] for r in iv.frame_labels(labelled, "kind", 1.0).collect()}
    assert labels == {0: ["x"], 1: ["x"], 2: ["x"], 3: ["x"], 4: ["x", "y"], 5: ["y"], 10: ["x"], 11: ["x"]}
