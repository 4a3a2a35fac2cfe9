"""Corpora from the driver's tables.

Times are whole milliseconds until the last step, so that every engine derives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.operators import intervals as iv
from duologue.plans.corpus import Corpus
from duologue.settings import Settings

DURATION_MS = 1_800_000
WORD_MS = 350
c, lit = F.col, F.lit


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the events file whose sessions make one task's frames.
FRAME_BYTES = 1 << 18


def _noise(a: int, b: int, d: int, m: int, person: Column | None = None) -> Column:
    """A whole number in [0, m) from frame, session and person."""
    person = c("person") if person is None else person
    return (c("i") * a + c("num") * b + F.when(person == "A", lit(0)).otherwise(lit(d))) % m


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(num, session_id, person, event_id, event_type, start_s, end_s): events of two users each, folded into half an hour."""
    e = read(spark, sf_dir, "events")
    num, start = F.floor(c("user_id") / 2), F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1000) % DURATION_MS
    end = F.least(start + F.round(c("value") * 100).cast("long"), lit(DURATION_MS))
    person = F.when(c("user_id") % 2 == 0, "A").otherwise("B")
    return e.select(num.alias("num"), F.format_string("s%05d", num).alias("session_id"), person.alias("person"), "event_id", "event_type", (start / 1000.0).alias("start_s"), (end / 1000.0).alias("end_s"))


def event_sessions(rows: DataFrame) -> DataFrame:
    return rows.select("num", "session_id").distinct().select("num", "session_id", lit(DURATION_MS / 1000.0).alias("duration_s"), lit(1.0).alias("frame_hz"), (c("num") % 7 != 0).alias("overlap_identifiable"), F.create_map(lit("site"), F.concat(lit("site"), (c("num") % 3).cast("string"))).alias("meta"))


def dealt(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """Sessions dealt out by their id, to tasks whose number grows with the size of the events.

    A session becomes thousands of frames, which Spark's estimates, the size of its own row, do not see. All frames of
    a session stay in its task, so what is grouped by session is not shuffled again.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().collectLeaves().head().stats().sizeInBytes())
    return sessions.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // FRAME_BYTES)), "session_id")


def _frame_numbers(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", c("num").cast("long").alias("num"), F.explode(F.sequence(lit(0), F.floor(c("duration_s") * c("frame_hz")).cast("int"))).alias("i"))


def _smile(person: Column | None = None) -> Column:
    return _noise(7919, 104729, 613, 101, person) / 100.0


def _intensity(person: Column | None = None) -> Column:
    return 50.0 + _noise(71, 73, 79, 30, person)


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, i, energy_a, energy_b, speech_prob): both persons' intensities and the larger smile of each frame, side by side."""
    rows = event_rows(spark, sf_dir)
    at = _frame_numbers(dealt(event_sessions(rows), rows))
    return at.select("session_id", "i", _intensity(lit("A")).alias("energy_a"), _intensity(lit("B")).alias("energy_b"), F.greatest(_smile(lit("A")), _smile(lit("B"))).alias("speech_prob"))


def event_frames(sessions: DataFrame) -> DataFrame:
    f = _frame_numbers(sessions).withColumn("person", F.explode(F.array(lit("A"), lit("B"))))
    poor = (c("num") % 5 == 0) & (c("person") == "B")
    return f.select(
        "session_id",
        "person",
        "i",
        (c("i") / 1.0).alias("t_s"),
        F.when(poor, _noise(7, 3, 1, 2) != 0).otherwise(_noise(7, 3, 1, 10) != 0).alias("tracked"),
        (_noise(11, 5, 2, 3) != 0).alias("on_partner"),
        _smile().alias("smile"),
        (_noise(13, 17, 5, 50) / 100.0).alias("duchenne"),
        F.when(_noise(3, 1, 7, 11) == 0, lit(float("nan"))).otherwise(_noise(29, 31, 37, 60) / 100.0).alias("brow_raise"),
        F.when(_noise(5, 1, 3, 13) == 0, lit(float("nan"))).otherwise((_noise(997, 89, 41, 201) - 100) / 100.0).alias("valence"),
        (_noise(31, 7, 11, 97) / 1000.0).alias("expressivity"),
        (_noise(53, 59, 61, 41) / 10.0).alias("head_pitch"),
        (_noise(43, 47, 3, 37) / 10.0).alias("head_yaw"),
        F.when(_noise(3, 2, 1, 4) == 0, lit(float("nan"))).otherwise(100.0 + _noise(17, 19, 23, 150)).alias("f0_hz"),
        _intensity().alias("intensity_db"),
        (_noise(83, 89, 97, 50) / 10.0).alias("wrist_speed"),
        (_noise(101, 103, 107, 4) == 0).alias("self_touch"),
    )


def event_corpus(spark: SparkSession, sf_dir: str, frames: bool = True) -> Corpus:
    rows = event_rows(spark, sf_dir)
    speech = iv.normalize(rows.filter(c("event_type").isin("view", "click", "purchase")))
    e = c("event_id")
    kind = (
        F.when(c("event_type") == "error", F.element_at(F.array(*map(lit, ("smile", "laughter", "head_shake"))), (e % 3 + 1).cast("int")))
        .when(c("event_type") == "signup", F.element_at(F.array(*map(lit, ("nod", "gesture", "posture_shift", "filled_pause"))), (e % 4 + 1).cast("int")))
    )
    spans = iv.normalize(rows.withColumn("kind", kind).filter("kind IS NOT NULL"), ["session_id", "person", "kind"])
    sessions = event_sessions(rows)
    voice = sessions.select("session_id", F.explode(F.array(lit("A"), lit("B"))).alias("person"), ((c("num") % 17) / 1000.0).alias("jitter"), ((c("num") % 13) / 100.0).alias("shimmer"))
    return Corpus(sessions.drop("num"), speech, None, spans, event_frames(dealt(sessions, rows)) if frames else None, voice, settings=Settings(frame_hz=1.0))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, session_id, person, turn, text, n, start_ms): user and assistant turns with derived times."""
    from pyspark.sql import Window

    t = read(spark, sf_dir, "conversations").filter(c("role").isin("user", "assistant"))
    words = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != ""))
    gap = ((c("conv_id") * 31 + c("turn") * 17) % 9 - 2) * 100
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("n", words).filter("n > 0").withColumn("gap", gap)
    start = 1000 + F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(c("n") * WORD_MS).over(by.rowsBetween(Window.unboundedPreceding, -1)), lit(0))
    person = F.when(c("role") == "user", "A").otherwise("B")
    return t.select("conv_id", F.format_string("c%06d", "conv_id").alias("session_id"), person.alias("person"), "turn", "text", "n", start.alias("start_ms"))


def conversation_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    t = conversation_turns(spark, sf_dir)
    end = c("start_ms") + c("n") * WORD_MS
    speech = iv.normalize(t.select("session_id", "person", (c("start_ms") / 1000.0).alias("start_s"), (end / 1000.0).alias("end_s")))
    split = F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")
    words = t.select("session_id", "person", "start_ms", F.posexplode(split).alias("k", "text")).select("session_id", "person", ((c("start_ms") + c("k") * WORD_MS) / 1000.0).alias("start_s"), ((c("start_ms") + (c("k") + 1) * WORD_MS) / 1000.0).alias("end_s"), "text", lit(1.0).alias("probability"))
    sessions = t.groupBy("session_id").agg(((F.max(end) + 1000) / 1000.0).alias("duration_s")).select("session_id", "duration_s", lit(100.0).alias("frame_hz"), lit(True).alias("overlap_identifiable"), F.create_map().cast("map<string,string>").alias("meta"))
    corpus = Corpus(sessions, speech, words)
    return corpus


def turn_embeddings(spark: SparkSession, sf_dir: str, turns: DataFrame) -> DataFrame:
    """Vectors for turns: those whose vec_id is (session number * 8 + turn index) modulo their number, at unit length."""
    e = read(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    n = F.broadcast(e.agg(F.greatest(F.count("*"), lit(1)).alias("n")))  # one row
    number = F.regexp_extract("session_id", "([0-9]+)", 1).cast("long")
    keyed = turns.crossJoin(n).select("session_id", "turn_index", ((number * 8 + c("turn_index")) % c("n")).alias("vec_id"))
    norm = F.sqrt(F.aggregate("embedding", lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = e.select("vec_id", F.transform("embedding", lambda x: (x / norm).cast("float")).alias("v"))
    return keyed.join(unit, "vec_id").select("session_id", "turn_index", "v")


def spoken_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The conversation corpus with embeddings."""
    corpus = conversation_corpus(spark, sf_dir)
    corpus.embeddings = turn_embeddings(spark, sf_dir, corpus.turn_set.turns)
    return corpus
