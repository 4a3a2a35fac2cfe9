"""Small corpora for tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from duologue.plans.corpus import Corpus


def spans(spark, *pairs, person="A", session="s"):
    return spark.createDataFrame([(session, person, float(a), float(b)) for a, b in pairs], "session_id string, person string, start_s double, end_s double")


def pairs(df):
    return sorted((round(r["start_s"], 9), round(r["end_s"], 9)) for r in df.collect())


def sessions(spark, duration, hz=100.0, overlap=True, session="s"):
    return spark.createDataFrame([(session, float(duration), float(hz), overlap, {"site": "x"})], "session_id string, duration_s double, frame_hz double, overlap_identifiable boolean, meta map<string,string>")


def talk(spark, a, b, duration, words=None, **more):
    speech = spans(spark, *a, person="A").unionByName(spans(spark, *b, person="B"))
    said = spark.createDataFrame([("s", p, float(x), float(y), t, 1.0) for p, x, y, t in words], "session_id string, person string, start_s double, end_s double, text string, probability double") if words else None
    return Corpus(sessions(spark, duration), speech, said, **more)


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def values(df):
    return {(r["measure"], r["person"]): r["value"] for r in df.collect()}


def reasons(df):
    return {(r["measure"], r["person"]): r["unavailable_reason"] for r in df.filter(F.col("value").isNull()).collect()}
