"""Streaming twins: inter-pausal units by session windows, and the floor as state of a session.

Speech intervals arrive as rows with an event time. Units close when no speech of a person follows
within the gap; the watermark bounds how late a row may come. The floor operator keeps one row of
state for each session: who holds the floor, and since when.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duologue.settings import TurnSettings


def stream_ipus(speech: DataFrame, cfg: TurnSettings = TurnSettings(), late: str = "10 seconds") -> DataFrame:
    """(session_id, person, start, end, n) of units, from a stream (session_id, person, ts, end_ts).

    Rows become points every half gap, so that a long interval keeps its session window open.
    """
    step = f"{int(cfg.ipu_gap_s * 1000 / 2)} milliseconds"
    points = speech.select("session_id", "person", F.explode(F.sequence("ts", "end_ts", F.expr(f"interval {step}"))).alias("at"), "ts", "end_ts")
    gap = f"{int(cfg.ipu_gap_s * 1000)} milliseconds"
    units = points.withWatermark("at", late).groupBy("session_id", "person", F.session_window("at", gap)).agg(F.min("ts").alias("start"), F.max("end_ts").alias("end"))
    return units.select("session_id", "person", "start", "end")


FLOOR = "session_id string, person string, start double, end double, turn long"
STATE = "holder string, end double, turn long"


def stream_turns(units: DataFrame, cfg: TurnSettings = TurnSettings()) -> DataFrame:
    """Each unit with the number of the turn it is part of, from a stream (session_id, person, start, end, takes_floor)."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, end, turn = state.get if state.exists else (None, 0.0, -1)
        rows = pd.concat(list(batches)).sort_values(["start", "person"])
        out = []
        for r in rows.itertuples(index=False):
            if holder == r.person:
                turn += r.start - end > cfg.max_gap_s
                end = max(end, r.end)
            elif holder is None or r.takes_floor:
                holder, end, turn = r.person, r.end, turn + 1
            else:
                continue
            out.append((key[0], r.person, r.start, r.end, turn))
        state.update((holder, end, turn))
        yield pd.DataFrame(out, columns=["session_id", "person", "start", "end", "turn"])

    return units.groupBy("session_id").applyInPandasWithState(advance, FLOOR, STATE, "append", GroupStateTimeout.NoTimeout)
