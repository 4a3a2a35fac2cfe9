"""From speech intervals to turns, by window functions over each session.

Inter-pausal units, backchannels, the floor, floor-transfer offsets and interruptions. With two
speakers the floor rule needs no loop: whether a unit takes the floor depends on the unit alone,
the holder is the latest unit that did, and a unit is part of a turn if it did or is the holder's.
"""

from __future__ import annotations

from collections.abc import Callable

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duologue.functions.text import is_backchannel_text
from duologue.operators import intervals as iv
from duologue.settings import TurnSettings

#: Seconds of a time bucket in joins of units with spans near them.
BUCKET_S = 8.0


def other(person: Column) -> Column:
    return F.when(person == "A", F.lit("B")).otherwise(F.lit("A"))


@dataclass(frozen=True)
class TurnSet:
    speech: DataFrame
    ipus: DataFrame
    backchannels: DataFrame
    turns: DataFrame
    non_floor: DataFrame
    interruptions: DataFrame


def probes(units: DataFrame, spans: DataFrame, windows: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds to each unit, for each named window, the seconds of it that spans of (session_id, person) cover.

    Units and spans meet by time bucket, each pair in the first bucket both touch, so a long
    session costs what its overlaps cost and not the square of its spans.
    """
    lo = F.least(*(w[0] for w in windows.values())) if len(windows) > 1 else next(iter(windows.values()))[0]
    hi = F.greatest(*(w[1] for w in windows.values())) if len(windows) > 1 else next(iter(windows.values()))[1]
    cell = lambda x: F.floor(x / BUCKET_S)
    u = units.select("unit", "session_id", "person", *(w[i].alias(f"{n}_{s}") for n, w in windows.items() for i, s in ((0, "lo"), (1, "hi"))), cell(lo).alias("u0"), F.explode(F.sequence(cell(lo), cell(hi))).alias("cell"))
    s = spans.select("session_id", "person", F.col("start_s").alias("a"), F.col("end_s").alias("b"), cell(F.col("start_s")).alias("s0"), F.explode(F.sequence(cell(F.col("start_s")), cell(F.col("end_s")))).alias("cell"))
    met = u.join(s, ["session_id", "person", "cell"]).filter(F.col("cell") == F.greatest("u0", "s0"))
    sums = [F.sum(F.greatest(F.lit(0.0), F.least(f"{n}_hi", "b") - F.greatest(f"{n}_lo", "a"))).alias(n) for n in windows]
    return units.join(met.groupBy("unit").agg(*sums), "unit", "left").fillna(0.0, list(windows))


def build_ipus(speech: DataFrame, words: DataFrame | None, cfg: TurnSettings) -> DataFrame:
    """(unit, session_id, person, start_s, end_s, containment, partner_after, own_after, text, n_words)."""
    spans = iv.merge_gaps(speech, cfg.ipu_gap_s).withColumn("unit", F.struct("session_id", "person", "start_s"))
    partner = speech.withColumn("person", other(F.col("person")))
    after = (F.col("end_s"), F.col("end_s") + cfg.floor_probe_s)
    units = probes(spans, partner, {"covered": (F.col("start_s"), F.col("end_s")), "partner_after": after})
    units = probes(units, speech, {"own_after": after})
    units = units.withColumn("containment", F.col("covered") / F.greatest(F.col("end_s") - F.col("start_s"), F.lit(1e-9))).drop("covered")
    if words is None:
        return units.select("unit", "session_id", "person", "start_s", "end_s", "containment", "partner_after", "own_after", F.lit("").alias("text"), F.lit(0).alias("n_words"))
    # a word belongs to the unit that holds its midpoint: the latest unit start before it, if the unit has not ended
    mid = words.select("session_id", "person", ((F.col("start_s") + F.col("end_s")) * 0.5).alias("t"), F.struct(F.col("start_s").alias("at"), "text").alias("word"), F.lit(1).alias("kind"))
    starts = units.select("session_id", "person", F.col("start_s").alias("t"), F.lit(None).cast("struct<at:double,text:string>").alias("word"), F.lit(0).alias("kind"), "unit", "end_s")
    by = Window.partitionBy("session_id", "person").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = mid.unionByName(starts, allowMissingColumns=True).withColumn("u", F.last(F.when(F.col("kind") == 0, F.struct("unit", "end_s")), ignorenulls=True).over(by))
    picked = placed.filter((F.col("kind") == 1) & (F.col("t") < F.col("u.end_s"))).groupBy(F.col("u.unit").alias("unit")).agg(F.sort_array(F.collect_list("word")).alias("w"))
    texts = picked.select("unit", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.size("w").alias("n_words"))
    joined = units.join(texts, "unit", "left")
    return joined.select("unit", "session_id", "person", "start_s", "end_s", "containment", "partner_after", "own_after", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


def classify_backchannels(ipus: DataFrame, cfg: TurnSettings) -> DataFrame:
    short = F.col("end_s") - F.col("start_s") <= cfg.backchannel_max_s
    inside = (F.col("containment") >= cfg.containment_min) & (F.col("partner_after") > cfg.floor_kept_s * cfg.floor_probe_s)
    worded = (F.col("n_words") == 0) | is_backchannel_text(F.col("text"), cfg.backchannel_max_words)
    return ipus.withColumn("is_backchannel", short & inside & worded)


def takes_the_floor(cfg: TurnSettings) -> Column:
    return (
        (F.col("containment") < cfg.containment_min)
        | (F.col("end_s") - F.col("start_s") >= cfg.max_incursion_s)
        | (F.col("partner_after") <= cfg.floor_silent_s * cfg.floor_probe_s)
        | (F.col("own_after") > F.col("partner_after"))
    )


def assign_floor(units: DataFrame, cfg: TurnSettings) -> DataFrame:
    """Adds ``accepted`` and, for accepted units, ``turn``: the number of the turn they are part of."""
    by = Window.partitionBy("session_id").orderBy("start_s", "person")
    strong = units.withColumn("strong", (F.row_number().over(by) == 1) | takes_the_floor(cfg))
    holder = F.last(F.when(F.col("strong"), F.col("person")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return strong.withColumn("accepted", F.col("strong") | (F.col("person") == holder)).drop("strong")


def _runs(rows: DataFrame, cfg: TurnSettings) -> DataFrame:
    """Adds ``turn``: runs of one person's rows at most max_gap_s apart."""
    by = Window.partitionBy("session_id").orderBy("start_s", "person")
    fresh = F.lag("person").over(by).isNull() | (F.lag("person").over(by) != F.col("person")) | (F.col("start_s") - F.lag("end_s").over(by) > cfg.max_gap_s)
    return rows.withColumn("__new", fresh.cast("int")).withColumn("turn", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def build_turns(units: DataFrame, cfg: TurnSettings) -> tuple[DataFrame, DataFrame]:
    """(turns, non_floor) of units that are not backchannels."""
    placed = assign_floor(units, cfg)
    piece = F.struct("start_s", "end_s", "text", "n_words").alias("piece")
    raw = _runs(placed.filter("accepted"), cfg).groupBy("session_id", "turn", "person").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sort_array(F.collect_list(piece)).alias("ipus"))
    kept = raw.drop("turn").filter(F.col("end_s") - F.col("start_s") >= cfg.min_turn_s)
    whole = _runs(kept, cfg).groupBy("session_id", "turn", "person").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sort_array(F.flatten(F.collect_list("ipus"))).alias("ipus"))
    by = Window.partitionBy("session_id").orderBy("start_s", "person")
    before = F.lag("end_s").over(by)
    offset = F.col("start_s") - before
    turns = whole.select(
        "session_id",
        (F.row_number().over(by) - 1).alias("turn_index"),
        "person",
        "start_s",
        "end_s",
        "ipus",
        F.array_join(F.filter(F.transform("ipus", lambda x: x["text"]), lambda x: x != ""), " ").alias("text"),
        F.aggregate("ipus", F.lit(0), lambda a, x: a + x["n_words"]).alias("n_words"),
        F.aggregate("ipus", F.lit(0.0), lambda a, x: a + (x["end_s"] - x["start_s"])).alias("speech_s"),
        F.when(F.abs(offset) <= cfg.max_gap_s, offset).alias("fto"),
        F.lag("person").over(by).alias("prev_person"),
        F.coalesce(offset < 0, F.lit(False)).alias("is_overlap_onset"),
    )
    return turns, placed.filter("NOT accepted").drop("accepted")


def find_interruptions(turns: DataFrame, non_floor: DataFrame, speech: DataFrame, cfg: TurnSettings) -> DataFrame:
    by = Window.partitionBy("session_id").orderBy("turn_index")
    pairs = turns.select("session_id", "person", "start_s", F.lag("person").over(by).alias("interrupted"), F.lag("turn_index").over(by).alias("turn_index"), (F.lag("end_s").over(by) - F.col("start_s")).alias("overlap"))
    pairs = pairs.filter((F.col("interrupted") != F.col("person")) & (F.col("overlap") >= cfg.overlap_min_s)).withColumn("unit", F.struct("session_id", "turn_index"))
    late = (F.col("start_s") + cfg.success_delay_s, F.col("start_s") + 2 * cfg.success_delay_s)
    judged = probes(pairs.withColumnRenamed("person", "interrupter").withColumn("person", F.col("interrupted")), speech, {"still": late})
    taken = judged.select(
        "session_id",
        F.col("start_s").alias("time_s"),
        "interrupter",
        "interrupted",
        "turn_index",
        (F.col("still") <= cfg.success_limit_s * cfg.success_delay_s).alias("successful"),
        F.col("overlap").alias("overlap_duration"),
        F.col("overlap").alias("remaining_after"),
        F.when(F.col("overlap") <= cfg.transition_max_s, F.lit("transition_overlap")).otherwise(F.lit("interruption")).alias("kind"),
    )
    tried = non_floor.withColumn("overlap", F.col("containment") * (F.col("end_s") - F.col("start_s"))).filter(F.col("overlap") >= cfg.overlap_min_s)
    # the partner's turn that a unit starts in is the last one to start before it: a person's turns do not overlap
    h = "struct<turn_index:int,h1:double>"
    held = turns.select("session_id", other(F.col("person")).alias("person"), F.col("start_s").alias("t"), F.lit(0).alias("kind"), F.struct("turn_index", F.col("end_s").alias("h1")).cast(h).alias("h"))
    asked = tried.select("session_id", "person", F.col("start_s").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(h).alias("h"), "start_s", "overlap")
    upto = Window.partitionBy("session_id", "person").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = held.unionByName(asked, allowMissingColumns=True).withColumn("h", F.last("h", ignorenulls=True).over(upto))
    last = met.filter((F.col("kind") == 1) & (F.col("start_s") <= F.col("h.h1")))
    failed = last.filter(F.col("h.h1") - F.col("start_s") > cfg.transition_max_s).select(
        "session_id",
        F.col("start_s").alias("time_s"),
        F.col("person").alias("interrupter"),
        other(F.col("person")).alias("interrupted"),
        F.col("h.turn_index").alias("turn_index"),
        F.lit(False).alias("successful"),
        F.col("overlap").alias("overlap_duration"),
        (F.col("h.h1") - F.col("start_s")).alias("remaining_after"),
        F.lit("interruption").alias("kind"),
    )
    return taken.unionByName(failed)


def build_turn_set(speech: DataFrame, words: DataFrame | None = None, cfg: TurnSettings = TurnSettings(), hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> TurnSet:
    """``hold`` is given the two tables that others are made of, to persist them for as long as the caller wants."""
    speech = iv.normalize(speech)
    ipus = hold(classify_backchannels(build_ipus(speech, words, cfg), cfg))
    turns, non_floor = build_turns(ipus.filter("NOT is_backchannel"), cfg)
    turns = hold(turns)
    return TurnSet(speech, ipus, ipus.filter("is_backchannel"), turns, non_floor, find_interruptions(turns, non_floor, speech, cfg))


def mutual_silence(speech: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, start_s, end_s): what neither person's speech covers of [0, duration)."""
    windows = sessions.select("session_id", F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s")).filter("end_s > 0")
    return iv.complement(iv.normalize(speech, ["session_id"]), windows, ["session_id"])


def pauses(turns: DataFrame) -> DataFrame:
    """(session_id, person, start_s, end_s): silences between the units of a turn."""
    between = F.transform(F.sequence(F.lit(1), F.size("ipus") - 1), lambda i: F.struct(F.element_at("ipus", i)["end_s"].alias("start_s"), F.element_at("ipus", i + 1)["start_s"].alias("end_s")))
    return turns.filter(F.size("ipus") > 1).select("session_id", "person", F.explode(between).alias("p")).select("session_id", "person", "p.*")


def listening(turns: DataFrame, speech: DataFrame) -> DataFrame:
    """(session_id, person, start_s, end_s): the partner holds a turn and the person does not speak."""
    held = iv.normalize(turns.withColumn("person", other(F.col("person"))))
    return iv.subtract(held, speech)
