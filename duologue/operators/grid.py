"""Resampling to a frame grid and per-span statistics of frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duologue.operators import intervals as iv


def frame_grid(sessions: DataFrame, persons: Sequence[str] = ("A", "B")) -> DataFrame:
    """(session_id, person, i, t_s): floor(duration * hz) + 1 frames."""
    frames = F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_s") * F.col("frame_hz")).cast("int")))
    return sessions.select("session_id", "frame_hz", frames.alias("i")).select("session_id", F.explode(F.array(*map(F.lit, persons))).alias("person"), "i", (F.col("i") / F.col("frame_hz")).alias("t_s"))


def resample(samples: DataFrame, grid: DataFrame, max_gap_s: float, kind: str = "linear", keys: Sequence[str] = iv.PERSON_KEYS) -> DataFrame:
    """grid (keys, i, t_s) with ``value`` of samples (keys, t_s, value); null outside the source and over gaps longer than max_gap_s.

    Both neighbours of a grid point come from one window over samples and points together.
    """
    s = samples.filter("value IS NOT NULL AND NOT isnan(value)").select(*keys, "t_s", F.struct("t_s", "value").alias("s"), F.lit(None).cast("int").alias("i"))
    s = s.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    g = grid.select(*keys, "t_s", F.lit(None).cast("struct<t_s:double,value:double>").alias("s"), "i", F.lit(None).cast("long").alias("n"))
    by = Window.partitionBy(*keys).orderBy("t_s", F.col("i").isNotNull())
    after = Window.partitionBy(*keys).orderBy(F.desc("t_s"), F.col("i").isNotNull())
    past, future = by.rowsBetween(Window.unboundedPreceding, 0), after.rowsBetween(Window.unboundedPreceding, 0)
    near = s.unionByName(g).withColumn("lo", F.last("s", ignorenulls=True).over(past)).withColumn("hi", F.last("s", ignorenulls=True).over(future)).withColumn("n", F.max("n").over(Window.partitionBy(*keys))).filter("i IS NOT NULL")
    width = F.col("hi.t_s") - F.col("lo.t_s")
    linear = F.col("lo.value") + (F.col("hi.value") - F.col("lo.value")) * (F.col("t_s") - F.col("lo.t_s")) / width
    nearest = F.when(F.col("t_s") - F.col("lo.t_s") <= F.col("hi.t_s") - F.col("t_s"), F.col("lo.value")).otherwise(F.col("hi.value"))
    only = F.coalesce("lo", "hi")
    value = (
        F.when((F.col("n") == 1) & (F.abs(F.col("t_s") - only["t_s"]) <= max_gap_s), only["value"])
        .when((F.col("n") > 1) & (width == 0), F.col("lo.value"))
        .when((F.col("n") > 1) & (width <= max_gap_s), linear if kind == "linear" else nearest)
    )
    return near.select(*keys, "i", "t_s", value.alias("value"))


def frames_in(frames: DataFrame, spans: DataFrame, hz: Column | float, keys: Sequence[str] = iv.PERSON_KEYS, outer: bool = True) -> DataFrame:
    """The frames inside spans: an equi join on the spans' own frame numbers."""
    return frames.join(iv.to_frames(spans, hz, keys, outer), [*keys, "i"], "left_semi")


def slice_stats(frames: DataFrame, turns: DataFrame, hz: float, column: str, least: int) -> DataFrame:
    """(session_id, turn_index, person, n, mean, median) of a column over each turn's frames; fewer than ``least`` finite values give null."""
    rows = turns.select("session_id", "person", "turn_index", F.explode(F.sequence(F.floor(F.col("start_s") * hz).cast("int"), (F.ceil(F.col("end_s") * hz) - 1).cast("int"))).alias("i"))
    met = rows.join(frames.select("session_id", "person", "i", F.nanvl(F.col(column), F.lit(None)).alias("x")), ["session_id", "person", "i"]).filter("x IS NOT NULL")
    stats = met.groupBy("session_id", "turn_index", "person").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"))
    return stats.filter(F.col("n") >= least)


def log_energy(frames: DataFrame, column: str, keys: Sequence[str] = iv.PERSON_KEYS) -> DataFrame:
    """Adds ``<column>_z``: the logarithm's deviation from its mean in population standard deviations."""
    by = Window.partitionBy(*keys)
    x = F.log(F.greatest(F.col(column), F.lit(1e-12)))
    return frames.withColumn("__x", x).withColumn(f"{column}_z", (F.col("__x") - F.avg("__x").over(by)) / F.nullif(F.stddev_pop("__x").over(by), F.lit(0.0))).drop("__x")


def levels(samples: DataFrame, column: str = "x", keys: Sequence[str] = iv.PERSON_KEYS) -> DataFrame:
    """(keys, rms_dbfs, clipping): level in dB of full scale and the share of samples at or above 0.999."""
    rms = F.sqrt(F.avg(F.col(column) * F.col(column)))
    return samples.groupBy(*keys).agg((20 * F.log10(F.greatest(rms, F.lit(1e-12)))).alias("rms_dbfs"), F.avg((F.abs(column) >= 0.999).cast("double")).alias("clipping"))
