"""Framing of audio and placement of tracks on a session's grid.

Samples come as one array a track (session_id, role, sample_rate, samples), whose length the
recording bounds; each kernel is a map over tracks, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duologue.operators.signals import fourier_filter

#: Frames whose spectra are in memory at once.
CHUNK = 4096
QUIET = 1e-10


def highpass(x: np.ndarray, rate: float, cutoff: float) -> np.ndarray:
    """Zero-phase, so onsets stay where they are; a cutoff of zero or less leaves the signal alone."""
    return fourier_filter(np.asarray(x, float), rate, lo=cutoff) if cutoff > 0 else np.asarray(x, float)


def n_frames(samples: int, rate: float, hz: float) -> int:
    return int(samples / rate * hz) + 1


def framed(x: np.ndarray, rate: float, hz: float, win_s: float, n: int) -> Iterator[np.ndarray]:
    """Blocks of frames; frame i is centred on sample i * hop, with zeros beyond both ends."""
    hop = max(1, round(rate / hz))
    size = max(hop, round(win_s * rate))
    need = (n - 1) * hop + size
    padded = np.r_[np.zeros(size // 2), np.asarray(x, float), np.zeros(max(0, need - size // 2 - len(x)))]
    view = np.lib.stride_tricks.sliding_window_view(padded, size)[: (n - 1) * hop + 1 : hop]
    for at in range(0, n, CHUNK):
        yield view[at : at + CHUNK]


def spectra(x: np.ndarray, rate: float, hz: float, win_s: float, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(frequencies, power) of Hann-windowed frames, block by block."""
    for block in framed(x, rate, hz, win_s, n):
        size = block.shape[1]
        bins = 1 << max(1, int(np.ceil(np.log2(size))))
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        yield np.fft.rfftfreq(bins, 1 / rate), np.abs(np.fft.rfft(block * hann, bins, axis=1)) ** 2


def frame_energy(x: np.ndarray, rate: float, hz: float = 100.0, band: tuple[float, float] | None = None, win_s: float = 0.032, n: int | None = None) -> np.ndarray:
    """Decibels of each frame's power, of all frequencies or of a band."""
    n = n_frames(len(x), rate, hz) if n is None else n
    parts = []
    for f, power in spectra(x, rate, hz, win_s, n):
        inside = np.ones(len(f), bool) if band is None else (f >= band[0]) & (f <= band[1])
        if not inside.any():
            raise ValueError(f"no frequency of the spectrum lies in {band} at {rate} samples a second")
        parts.append(10 * np.log10(power[:, inside].sum(axis=1) + QUIET))
    return np.concatenate(parts)


def energy_envelope(x: np.ndarray, rate: float, hz: float = 100.0) -> np.ndarray:
    """Standardised log energy."""
    e = frame_energy(x, rate, hz)
    return (e - e.mean()) / max(float(e.std()), 1e-9)


def placed(x: np.ndarray, offset_s: float, rate: float, n: int, hz: float) -> np.ndarray:
    """A track on the session clock: its start cut off or filled with zeros, its end a second beyond the last frame."""
    target, shift = int(np.ceil(n / hz * rate)) + int(rate), round(offset_s * rate)
    out = np.zeros(target)
    here = np.asarray(x, float)[max(0, -shift) :][: max(0, target - max(0, shift))]
    out[max(0, shift) : max(0, shift) + len(here)] = here
    return out


def fitted(x: np.ndarray, n: int) -> np.ndarray:
    """The first n values; what is missing is not a number."""
    out = np.full(n, np.nan)
    out[: min(n, len(x))] = np.asarray(x, float)[:n]
    return out


def track_frames(tracks: DataFrame, hz: float = 100.0, band: tuple[float, float] | None = None, cutoff: float = 0.0) -> DataFrame:
    """(session_id, role, i, energy_db) of tracks (session_id, role, sample_rate, samples)."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                e = frame_energy(highpass(np.asarray(r.samples, float), r.sample_rate, cutoff), r.sample_rate, hz, band)
                yield pd.DataFrame({"session_id": r.session_id, "role": r.role, "i": np.arange(len(e), dtype=np.int32), "energy_db": e})

    return tracks.select("session_id", "role", "sample_rate", "samples").mapInPandas(run, "session_id string, role string, i int, energy_db double")


# ---------------------------------------------------------------- column expressions


def probability_to_grid(chunks: DataFrame, frames: DataFrame, chunk_hz: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, speech_prob): chunk decisions (keys, chunk, p) at frame times (keys, i, t_s).

    A chunk stands for its centre; between centres the value is linear, before the first and after
    the last it is held. Chunks are numbered without gaps, so a frame's two neighbours are found by
    their numbers: two joins on keys and number. Tracks without chunks have probability zero. Both tables have many rows
    a session, which Spark's estimates may not see, so neither is sent to the driver.
    """
    keys = keys or ["session_id"]
    last = chunks.groupBy(*keys).agg(F.max("chunk").alias("__last"))
    at = F.col("t_s") * chunk_hz - 0.5
    low = F.greatest(F.lit(0), F.least(F.floor(at), F.col("__last")))
    rows = frames.join(last.hint("shuffle_hash"), keys, "left").withColumn("__lo", low).withColumn("__hi", F.least(F.col("__lo") + 1, F.col("__last"))).withColumn("__w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - F.col("__lo"))))
    side = lambda name: chunks.select(*keys, F.col("chunk").alias(f"__{name}"), F.col("p").alias(f"__p{name}")).hint("merge")
    met = rows.join(side("lo"), [*keys, "__lo"], "left").join(side("hi"), [*keys, "__hi"], "left")
    return met.select(*keys, "i", F.coalesce(F.col("__plo") + F.col("__w") * (F.col("__phi") - F.col("__plo")), F.lit(0.0)).alias("speech_prob"))


def loudest_probability(probabilities: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, speech_prob): the largest of several tracks' probabilities at each frame."""
    return probabilities.groupBy(*(keys or ["session_id"]), "i").agg(F.max("speech_prob").alias("speech_prob"))


def shifted(t: Column, offset_s: Column | float) -> Column:
    """Times of a track on the session clock; what lies before its start is null."""
    moved = t + offset_s
    return F.when(moved >= 0, moved)


def by_track(tracks: DataFrame, kernel: Callable[[np.ndarray, float], list[tuple[float, float]]]) -> DataFrame:
    """(session_id, role, start_s, end_s): spans that a kernel of (samples, rate) finds in each track."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                found = kernel(np.asarray(r.samples, float), float(r.sample_rate))
                yield pd.DataFrame({"session_id": r.session_id, "role": r.role, "start_s": [a for a, _ in found], "end_s": [b for _, b in found]}).astype({"session_id": object, "role": object, "start_s": float, "end_s": float})

    return tracks.select("session_id", "role", "sample_rate", "samples").mapInPandas(run, "session_id string, role string, start_s double, end_s double")
