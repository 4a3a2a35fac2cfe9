"""Interval algebra on rows (keys..., start_s, end_s): sets of sorted, disjoint, half-open spans for each key.

Every operator partitions by the keys, so spans of different sessions never meet. Those that
combine two sets do it in one sweep over the union of their boundaries -- one shuffle, linear in
the number of spans -- instead of a pairwise interval join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERSON_KEYS = ("session_id", "person")
SESSION_KEYS = ("session_id",)


def islands(spans: DataFrame, keys: Sequence[str], gap: float = 0.0) -> DataFrame:
    """Adds ``island``: spans whose start lies at most ``gap`` after the latest end before them stand together."""
    by = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    latest = F.max("end_s").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(latest.isNull() | (F.col("start_s") - latest > gap if gap else F.col("start_s") > latest), 1).otherwise(0)
    return spans.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def _merged(spans: DataFrame, keys: Sequence[str], gap: float = 0.0) -> DataFrame:
    return islands(spans, keys, gap).groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")


def normalize(spans: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """Drops empty spans; overlapping and touching ones become one."""
    return _merged(spans.select(*keys, "start_s", "end_s").filter(F.col("end_s") > F.col("start_s")), keys)


def merge_gaps(spans: DataFrame, gap: float, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """Joins neighbours at most ``gap`` apart, the bound included."""
    return _merged(spans.select(*keys, "start_s", "end_s"), keys, gap) if gap > 0 else spans.select(*keys, "start_s", "end_s")


def drop_short(spans: DataFrame, least: float) -> DataFrame:
    return spans.filter(F.col("end_s") - F.col("start_s") >= least)


def pad(spans: DataFrame, amount: float, lo: float | None = None, hi: float | None = None, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    start, end = F.col("start_s") - amount, F.col("end_s") + amount
    grown = spans.select(*keys, (F.greatest(start, F.lit(lo)) if lo is not None else start).alias("start_s"), (F.least(end, F.lit(hi)) if hi is not None else end).alias("end_s"))
    return normalize(grown, keys)


def clip(spans: DataFrame, lo: Column | float, hi: Column | float) -> DataFrame:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return spans.withColumn("start_s", F.greatest("start_s", lo)).withColumn("end_s", F.least("end_s", hi)).filter(F.col("end_s") > F.col("start_s"))


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    return normalize(a.select(*keys, "start_s", "end_s").unionByName(b.select(*keys, "start_s", "end_s")), keys)


def sweep(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start_s, end_s, in_a, in_b): elementary pieces between successive boundaries of two disjoint sets."""

    def edges(spans: DataFrame, da: int, db: int) -> DataFrame:
        point = F.explode(F.array(F.struct(F.col("start_s").alias("t"), F.lit(da).alias("da"), F.lit(db).alias("db")), F.struct(F.col("end_s").alias("t"), F.lit(-da).alias("da"), F.lit(-db).alias("db"))))
        return spans.select(*keys, point.alias("e")).select(*keys, "e.t", "e.da", "e.db")

    points = edges(a, 1, 0).unionByName(edges(b, 0, 1)).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    by = Window.partitionBy(*keys).orderBy("t")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*keys, F.col("t").alias("start_s"), F.lead("t").over(by).alias("end_s"), (F.sum("da").over(running) > 0).alias("in_a"), (F.sum("db").over(running) > 0).alias("in_b")).filter("end_s IS NOT NULL")


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """Pieces in both; pieces of different pairs stay apart only where a boundary gap separates them."""
    return normalize(sweep(a, b, keys).filter("in_a AND in_b"), keys)


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    return normalize(sweep(a, b, keys).filter("in_a AND NOT in_b"), keys)


def complement(spans: DataFrame, windows: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """What of each key's window (keys, start_s, end_s) the spans leave free, edges included."""
    return subtract(windows, spans, keys)


def gaps(spans: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """Silences strictly between consecutive spans."""
    by = Window.partitionBy(*keys).orderBy("start_s")
    return spans.select(*keys, F.lag("end_s").over(by).alias("start_s"), F.col("start_s").alias("end_s")).filter("start_s IS NOT NULL AND end_s > start_s")


def contains(points: DataFrame, spans: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """points (keys, t_s, ...) with ``inside``: start <= t < end for some span. An as-of look-up of the latest start."""
    extra = [c for c in points.columns if c not in keys]
    p = points.select(*keys, F.struct(*extra).alias("__row"), F.col("t_s").alias("__t"), F.lit(None).cast("double").alias("__end"), F.lit(1).alias("__kind"))
    s = spans.select(*keys, F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.col("start_s").alias("__t"), F.col("end_s").alias("__end"), F.lit(0).alias("__kind"))
    by = Window.partitionBy(*keys).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = p.unionByName(s).withColumn("__last", F.last("__end", ignorenulls=True).over(by)).filter("__kind = 1")
    return found.select(*keys, "__row.*", F.coalesce(F.col("__last") > F.col("__t"), F.lit(False)).alias("inside"))


def total(spans: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("total_s"), F.count("*").alias("n"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))


def overlap_duration(a: DataFrame, b: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    return sweep(a, b, keys).filter("in_a AND in_b").groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("overlap_s"))


def coverage(spans: DataFrame, lo: float, hi: float, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """Share of [lo, hi) that the spans cover; 0 where the window is empty."""
    inside = F.greatest(F.lit(0.0), F.least("end_s", F.lit(hi)) - F.greatest("start_s", F.lit(lo)))
    share = F.sum(inside) / (hi - lo) if hi > lo else F.lit(0.0)
    return spans.groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias("coverage"))


def from_mask(frames: DataFrame, mask: str, hz: Column | float, keys: Sequence[str] = PERSON_KEYS, t0: float = 0.0) -> DataFrame:
    """Runs of true frames (keys, i, mask) as spans; a single frame is one frame long."""
    hz = hz if isinstance(hz, Column) else F.lit(float(hz))
    true = frames.filter(F.col(mask)).select(*keys, "i", hz.alias("__hz"))
    run = F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    return true.withColumn("__run", run).groupBy(*keys, "__run").agg((F.min("i") / F.first("__hz") + t0).alias("start_s"), ((F.max("i") + 1) / F.first("__hz") + t0).alias("end_s")).drop("__run")


def frame_ranges(spans: DataFrame, hz: Column | float, keys: Sequence[str] = PERSON_KEYS, outer: bool = False) -> DataFrame:
    """(keys, a, b): first and last frame inside each span, without those of the spans before it, so no frame comes twice."""
    hz = hz if isinstance(hz, Column) else F.lit(float(hz))
    first = F.floor(F.col("start_s") * hz) if outer else F.ceil(F.col("start_s") * hz)
    last = F.ceil(F.col("end_s") * hz) - 1
    some = spans.select(*keys, F.greatest(first, F.lit(0)).cast("int").alias("a"), last.cast("int").alias("b")).filter("b >= a")
    before = F.max("b").over(Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    return some.withColumn("a", F.greatest("a", before + 1)).filter("b >= a")


def to_frames(spans: DataFrame, hz: Column | float, keys: Sequence[str] = PERSON_KEYS, outer: bool = False) -> DataFrame:
    """(keys, i) of frames inside spans. The left edge i/hz decides; ``outer`` uses floor(start) to ceil(end) instead."""
    return frame_ranges(spans, hz, keys, outer).select(*keys, F.explode(F.sequence("a", "b")).alias("i"))


PERSONS = ("A", "B")


def _own(name: str) -> Column:
    return F.when(F.col("person") == PERSONS[0], F.col(f"__{name}_{PERSONS[0]}")).when(F.col("person") == PERSONS[1], F.col(f"__{name}_{PERSONS[1]}"))


def flag_frames(frames: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """frames (session_id, person, i, ...) with a flag for each kind: whether the frame lies in its ranges (session_id, person, a, b), which do not overlap.

    The ranges become one row a session, with an array of a flag a frame, so frames are looked up and not shuffled by their number.
    """
    rows = reduce(DataFrame.unionByName, (r.select("session_id", "person", "a", "b", F.lit(name).alias("kind")) for name, r in kinds.items()))
    sides = [(name, p) for name in kinds for p in PERSONS]
    packed = rows.groupBy("session_id").agg(*(F.sort_array(F.collect_list(F.when((F.col("kind") == name) & (F.col("person") == p), F.struct("a", "b")))).alias(f"__{name}_{p}") for name, p in sides))

    def flags(r: str) -> Column:
        free = lambda x, k: x["a"] - F.coalesce(F.get(r, k - 1)["b"] + 1, F.lit(0))
        return F.flatten(F.transform(r, lambda x, k: F.concat(F.array_repeat(F.lit(False), free(x, k)), F.array_repeat(F.lit(True), x["b"] - x["a"] + 1))))

    flat = packed.select("session_id", *(flags(f"__{name}_{p}").alias(f"__{name}_{p}") for name, p in sides))
    met = frames.join(flat.hint("shuffle_hash"), "session_id", "left")
    return met.select(*frames.columns, *(F.coalesce(F.get(_own(name), F.col("i")), F.lit(False)).alias(name) for name in kinds))


def frames_within(frames: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """frames (session_id, person, i, ...) with ``key`` of each range (session_id, person, key, a, b) that they lie in; ranges may overlap.

    The ranges become one row a session. For each frame it holds the first and last range, in order of ``a``, that can hold it.
    """
    upto = Window.partitionBy("session_id", "person").orderBy("a", "b", key).rowsBetween(Window.unboundedPreceding, 0)
    piece = F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col(key).alias("key"), F.col("m").cast("int").alias("m"))
    packed = ranges.withColumn("m", F.max("b").over(upto)).groupBy("session_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("person") == p, piece))).alias(f"__r_{p}") for p in PERSONS))

    def first(r: str) -> Column:
        return F.flatten(F.transform(r, lambda x, k: F.array_repeat(k, x["m"] - F.coalesce(F.get(r, k - 1)["m"], F.lit(-1)))))

    def last(r: str) -> Column:
        until = lambda x, k: F.coalesce(F.get(r, k + 1)["a"], x["m"] + 1)
        return F.concat(F.array_repeat(F.lit(-1), F.coalesce(F.get(r, F.lit(0))["a"], F.lit(0))), F.flatten(F.transform(r, lambda x, k: F.array_repeat(k, until(x, k) - x["a"]))))

    sides = ((f"__r_{p}", p) for p in PERSONS)
    flat = packed.select("session_id", *(x.alias(f"__{name}_{p}") for r, p in sides for name, x in (("lo", first(r)), ("hi", last(r)), ("b", F.col(r)["b"]), ("key", F.col(r)["key"]))))
    # no higher-order function below: those are not compiled, and a row with a session's arrays would be copied for each frame
    lo, hi = F.get(_own("lo"), F.col("i")), F.get(_own("hi"), F.col("i"))
    met = frames.join(flat.hint("shuffle_hash"), "session_id").withColumn("__k", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    return met.filter(F.get(_own("b"), F.col("__k")) >= F.col("i")).select(*frames.columns, F.get(_own("key"), F.col("__k")).alias(key))


def overlap_with(units: DataFrame, spans: DataFrame, lo: Column, hi: Column, name: str, keys: Sequence[str], unit: str = "unit") -> DataFrame:
    """(unit, name): seconds of [lo, hi) of each unit row that the spans of its keys cover. One equi join on the keys with a residual."""
    u = units.select(unit, *keys, lo.alias("__lo"), hi.alias("__hi"))
    s = spans.select(*keys, F.col("start_s").alias("__a"), F.col("end_s").alias("__b"))
    inside = F.least("__hi", "__b") - F.greatest("__lo", "__a")
    return u.join(s, list(keys)).filter((F.col("__a") < F.col("__hi")) & (F.col("__b") > F.col("__lo"))).groupBy(unit).agg(F.sum(inside).alias(name))


def frame_labels(spans: DataFrame, label: str, hz: Column | float, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """(keys, i, labels): the labels of all spans that each frame lies in, sorted; frames in none have no row."""
    inside = to_frames(spans, hz, [*keys, label])
    return inside.groupBy(*keys, "i").agg(F.sort_array(F.collect_set(label)).alias("labels"))
