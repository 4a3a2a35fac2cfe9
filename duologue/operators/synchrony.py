"""Coordination between two signals or event series, against surrogates that keep their rhythm.

Windows are correlated at all lags in a map over sessions packed to a row each: a session's signals are bounded by
its length. Few lags of short windows are products of matrices, others go by FFT. Shifts come from a fixed seed for
each signal, so results repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.operators.signals import map_groups
from duologue.settings import SynchronySettings

TINY = 1e-12
#: Values of surrogate windows that are in memory at once.
CHUNK = 1 << 21


@dataclass(frozen=True)
class Synchrony:
    peak_r: float = np.nan
    lag_s: float = np.nan
    surrogate_mean: float = np.nan
    surrogate_sd: float = np.nan
    z: float = np.nan
    n_windows: int = 0
    n_surrogates: int = 0

    @property
    def excess(self) -> float:
        return self.peak_r - self.surrogate_mean

    @property
    def above_chance(self) -> bool:
        return bool(np.isfinite(self.z) and self.z > 1.96)


class Series:
    """A signal laid out twice, so that a window of any circular shift of it is a slice; gaps are known by their edges."""

    def __init__(self, x: np.ndarray):
        twice = np.r_[x, x]
        self.n, known = len(x), np.isfinite(twice)
        self.values, at = np.where(known, twice, 0.0), np.arange(len(twice))
        self.count = np.r_[0, np.cumsum(known)]
        self.whole = bool(known.all())
        self.past = np.maximum.accumulate(np.where(known, at, -1))
        self.next = np.minimum.accumulate(np.where(known, at, len(twice))[::-1])[::-1]

    def windows(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Standardised windows as rows, gaps filled linearly within each, and which of them are usable."""
        at = starts[:, None] + np.arange(width)
        rows = self.values[at]
        ok = self.count[starts + width] - self.count[starts] >= max(2, 0.5 * width)
        if not self.whole:
            last = len(self.values) - 1
            a, b = self.past[at], self.next[at]
            first, end = starts[:, None], starts[:, None] + width
            left, right = a >= first, b < end
            x, y = self.values[np.maximum(a, 0)], self.values[np.minimum(b, last)]
            between = x + (y - x) * (at - a) / np.maximum(b - a, 1)
            rows = np.where(left & right, between, np.where(left, x, np.where(right, y, 0.0)))
        rows[~ok] = 0
        sd = rows.std(axis=1)
        ok &= sd >= TINY
        return (rows - rows.mean(axis=1, keepdims=True)) / np.where(ok, sd, 1)[:, None], ok


def windowed_correlation(a: np.ndarray, b: np.ndarray, hz: float, cfg: SynchronySettings = SynchronySettings(), restrict: str | None = None) -> Synchrony:
    """Mean peak correlation over windows and lags, with circular shifts of b as baseline. Negative lags: a leads."""
    n = min(len(a), len(b))
    a, b = np.asarray(a[:n], float), np.asarray(b[:n], float)
    width, step = int(cfg.window_s * hz), max(1, int(cfg.step_s * hz))
    reach = min(int(cfg.max_lag_s * hz), width - 4)
    if n < width or width < 8 or reach < 1:
        return Synchrony()
    starts = np.arange(0, n - width + 1, step)
    lags = np.arange(-reach, reach + 1)
    allowed = lags < 0 if restrict == "a_leads" else lags > 0 if restrict == "b_leads" else np.ones(len(lags), bool)
    size = 1 << (2 * width - 1).bit_length()
    wa, ok_a = Series(a).windows(starts, width)
    other, wanted = Series(b), lags[allowed]
    per_lag = width - np.abs(wanted)
    by_product = len(wanted) * width <= 4 * size * size.bit_length()
    # every shifted window of b is one of its n circular ones, which are laid out once where they are few
    ready = other.windows(np.arange(n), width) if n * width <= CHUNK and cfg.surrogates * len(starts) > n else None
    if by_product:
        moved = np.arange(width) + wanted[:, None]
        left = np.where((moved >= 0) & (moved < width), wa[:, np.clip(moved, 0, width - 1)], 0.0)  # window, lag, frame
    else:
        fa = np.fft.rfft(wa, size, axis=1)

    def peaks(shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each circular shift of b and window the peak, its lag, and whether the window is usable."""
        at = (starts[:, None] - shifts) % n  # window, shift
        if ready is None:
            wb, ok_b = (x.reshape(*at.shape, *x.shape[1:]) for x in other.windows(at.ravel(), width))
        else:
            wb, ok_b = (x[at] for x in ready)
        if by_product:
            values = wb @ left.transpose(0, 2, 1) / per_lag
        else:
            c = np.fft.irfft(fa[:, None] * np.conj(np.fft.rfft(wb, size, axis=2)), size, axis=2)
            values = np.concatenate([c[:, :, -reach:], c[:, :, : reach + 1]], axis=2)[:, :, allowed] / per_lag
        best = values.argmax(axis=2)
        return np.take_along_axis(values, best[:, :, None], 2)[:, :, 0].T, wanted[best].T, (ok_a[:, None] & ok_b).T

    top, at, ok = (x[0] for x in peaks(np.zeros(1, np.int64)))
    count = int(ok.sum())
    if not count:
        return Synchrony()
    peak, lag = float(top[ok].mean()), float(np.median(at[ok])) / hz
    least = max(1, int(min(cfg.min_shift_s, n / hz / 4) * hz))
    if n - least <= least:
        return Synchrony(peak, lag, n_windows=count)
    rng = np.random.default_rng(cfg.seed)
    shifts = np.array([int(rng.integers(least, n - least)) for _ in range(cfg.surrogates)], np.int64)
    step_ = max(1, CHUNK // (len(starts) * size))  # surrogates at a time, in bounded memory
    found = [peaks(shifts[k : k + step_]) for k in range(0, len(shifts), step_)]
    tops, oks = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
    used = oks.any(axis=1)
    with np.errstate(invalid="ignore"):
        means = np.where(oks, tops, 0.0).sum(axis=1) / np.maximum(oks.sum(axis=1), 1)
    null_r = means[used & np.isfinite(means)]
    if len(null_r) < 5:
        return Synchrony(peak, lag, n_windows=count, n_surrogates=len(null_r))
    mean, sd = float(null_r.mean()), float(null_r.std())
    return Synchrony(peak, lag, mean, sd, (peak - mean) / sd if sd > TINY else np.nan, count, len(null_r))


SCHEMA = "signal string, restrict string, peak_r double, lag_s double, surrogate_mean double, surrogate_sd double, z double, n_windows int, n_surrogates int"
WHO = "CASE person WHEN 'A' THEN 0 WHEN 'B' THEN 1 END"


def synchrony(frames: DataFrame, sessions: DataFrame, signals: dict[str, tuple[str, ...]], cfg: SynchronySettings = SynchronySettings()) -> DataFrame:
    """One row for each session, signal and direction: ``signals`` maps a frame column to the directions wanted ('', or the leader: 'a_leads', 'b_leads')."""
    wanted = {k: v for k, v in signals.items()}
    rates = sessions.select("session_id", "frame_hz").hint("shuffle_hash")  # frames are many, and stay where they are
    slim = frames.select("session_id", F.expr(WHO).alias("who"), "i", *wanted).filter("who IS NOT NULL").join(rates, "session_id")

    def run(g: dict[str, np.ndarray]) -> dict[str, list]:
        hz, n, rows = float(g["frame_hz"][0]), int(g["i"][-1]) + 1, []
        sides = [g["who"] == k for k in (0, 1)]
        for signal, directions in wanted.items():
            x = np.full((2, n), np.nan)
            for k, side in enumerate(sides):
                x[k, g["i"][side]] = g[signal][side]
            for restrict in directions:
                lead, follow = (1, 0) if restrict == "b_leads" else (0, 1)
                r = windowed_correlation(x[lead], x[follow], hz, cfg, "a_leads" if restrict else None) if all(s.any() for s in sides) and n >= 10 else Synchrony()
                rows.append((signal, restrict, r.peak_r, r.lag_s, r.surrogate_mean, r.surrogate_sd, r.z, r.n_windows, r.n_surrogates))
        return {c.split(" ")[0]: list(x) for c, x in zip(SCHEMA.split(", "), zip(*rows))}

    found = map_groups(slim, ["session_id"], ["who", "frame_hz", *wanted], lambda groups: [run(g) for g in groups], SCHEMA)
    doubles = ("peak_r", "lag_s", "surrogate_mean", "surrogate_sd", "z")
    return found.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in doubles else F.col(c) for c in found.columns)).withColumn("excess", F.col("peak_r") - F.col("surrogate_mean"))


def follow_rate(partner: np.ndarray, own: np.ndarray, window: float) -> float:
    own = np.sort(own)
    return float(followed(own, partner, window).mean())


def followed(own: np.ndarray, partner: np.ndarray, window: float) -> np.ndarray:
    return np.searchsorted(own, partner + window, "right") > np.searchsorted(own, partner, "right")


def uptake(partner: np.ndarray, own: np.ndarray, duration: float, cfg: SynchronySettings = SynchronySettings()) -> float:
    """Share of partner onsets followed by an own one within the window, beyond that of shifted partner onsets."""
    w = cfg.uptake_window_s
    if len(partner) < 3 or duration <= 4 * w:
        return np.nan
    shifts = np.random.default_rng(cfg.seed).uniform(2 * w, duration - 2 * w, cfg.uptake_surrogates)
    moved = (partner + shifts[:, None]) % duration  # all surrogates at once
    return follow_rate(partner, own, w) - float(followed(np.sort(own), moved, w).mean(axis=1).mean())


def uptake_by_person(onsets: DataFrame, sessions: DataFrame, name: str, cfg: SynchronySettings = SynchronySettings()) -> DataFrame:
    """(session_id, person, name) from onsets (session_id, person, start_s)."""
    slim = onsets.select("session_id", F.col("start_s").alias("i"), F.expr(WHO).alias("who")).join(sessions.select("session_id", "duration_s"), "session_id")

    def run(g: dict[str, np.ndarray]) -> dict[str, list]:
        a, b = (g["i"][g["who"] == k] for k in (0, 1))
        duration = float(g["duration_s"][0])
        return {"person": ["A", "B"], name: [uptake(b, a, duration, cfg), uptake(a, b, duration, cfg)]}

    found = map_groups(slim, ["session_id"], ["who", "duration_s"], lambda groups: [run(g) for g in groups], f"person string, {name} double")
    return found.withColumn(name, F.when(F.isnan(name), None).otherwise(F.col(name)))
