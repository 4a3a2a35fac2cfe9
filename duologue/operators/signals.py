"""Kernels over one signal at a time that no column expression can hold, and grouped maps that apply them.

Each works on one session and person, whose signals are bounded by the session's length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def run_edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each run of true values, and what comes after its last."""
    edge = np.flatnonzero(np.diff(np.r_[0, np.asarray(mask, np.int8), 0]))
    return edge[::2], edge[1::2]


def runs_of(mask: np.ndarray) -> list[list[int]]:
    """[first, after last] of each run of true values."""
    return [[a, b] for a, b in zip(*(x.tolist() for x in run_edges(mask)))]


def hysteresis(p: np.ndarray, hz: float, on: float = 0.5, fall: float = 0.15, hold_s: float = 0.06, min_s: float = 0.1, pad_s: float = 0.03) -> list[tuple[float, float]]:
    """Spans that open at ``on`` and close once the value stays below ``on - fall`` for ``hold_s``; short ones go, the rest grow by ``pad_s``.

    A span that is open when the track ends lasts to its end, through a dip that was too short to close it.
    """
    p = np.asarray(p, float)
    hold, last = max(1, round(hold_s * hz)), len(p)
    # silences that close a span: runs below the lower threshold that are long enough; what lies between them opens where it reaches ``on``
    low, high = run_edges(p < max(0.01, on - fall))
    closing = high - low >= hold
    begin, end = np.r_[0, high[closing]], np.r_[low[closing], last]
    opened = np.r_[np.flatnonzero(p >= on), last]
    first = opened[np.searchsorted(opened, begin)]
    found = (first < end) & ((end - first) / hz >= min_s)
    a, b = np.maximum(0.0, first[found] / hz - pad_s), np.minimum(last / hz, end[found] / hz + pad_s)
    if not len(a):
        return []
    apart = a[1:] > b[:-1]
    return list(zip(a[np.r_[True, apart]].tolist(), b[np.r_[apart, True]].tolist()))


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    return viterbi_all([emission], transition)[0]


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, parts, states) of tracks side by side, and their lengths."""
    lengths = np.array([len(x) for x in parts])
    out = np.zeros((lengths.max(), len(parts), parts[0].shape[1]))
    for k, x in enumerate(parts):
        out[: len(x), k] = x
    return out, lengths


def viterbi_all(emissions: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """The best path of each track; a step is taken for all tracks at once, and a track that has ended stays where it is."""
    e, lengths = _padded(emissions)
    n, tracks, k = e.shape
    back, score, same = np.zeros((n, tracks, k), np.int8), e[0].copy(), np.arange(k, dtype=np.int8)
    shortest = lengths.min()
    for t in range(1, n):
        best, source = score[:, :1] + transition[0], back[t]
        for i in range(1, k):
            step = score[:, i : i + 1] + transition[i]
            source[step > best] = i
            np.maximum(best, step, out=best)
        best += e[t]
        if t < shortest:
            score = best
        else:
            over = t >= lengths
            source[over] = same
            score = np.where(over[:, None], score, best)
    path, at = np.empty((n, tracks), np.int8), np.arange(tracks)
    path[-1] = score.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, at, path[t]]
    return [path[:m, j] for j, m in enumerate(lengths)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posteriors(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """State probabilities of each frame given all frames."""
    return posteriors_all([emission], transition)[0]


def posteriors_all(emissions: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """State probabilities of each frame of each track given all of its frames; a step is taken for all tracks at once.

    Likelihoods are kept as shares of their sum at each frame. Every transition is possible, so those of what comes
    after differ by no more than the transitions do, and a product of both is never zero for all states.
    """
    e, lengths = _padded(emissions)
    n, shortest, move = len(e), lengths.min(), np.exp(transition)
    p = np.exp(e - e.max(axis=2, keepdims=True))
    forward, backward, every = np.empty_like(p), np.ones_like(p), np.ones((e.shape[2], e.shape[2]))
    forward[0] = p[0] / p[0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        at = (forward[t - 1] @ move) * p[t]
        np.divide(at, at @ every, out=forward[t])
    for t in range(n - 2, -1, -1):
        at = (backward[t + 1] * p[t + 1]) @ move.T
        at /= at @ every
        backward[t] = at if t + 1 < shortest else np.where((t + 1 < lengths)[:, None], at, 1.0)
    joint = forward * backward
    joint /= joint.sum(axis=2, keepdims=True)
    return [joint[:m, j] for j, m in enumerate(lengths)]


def speaker_transitions(stay: float = 6.0, swap_penalty: float = 1.0) -> np.ndarray:
    """Log transitions of (silence, A, B, both): long stays by a logit, and changes straight from A to B made less likely."""
    logits = np.eye(4) * stay
    logits[[1, 2], [2, 1]] -= swap_penalty
    return logits - _logsum(logits, 1)[:, None]


def absorb_short_runs(states: np.ndarray, least: int, only: int | None = None) -> np.ndarray:
    """Runs below ``least`` frames join their longer neighbour, the shortest first, the left one in ties."""
    edges = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
    runs = [[int(states[a]), int(b - a)] for a, b in zip(edges, np.r_[edges[1:], len(states)])]
    while len(runs) > 1:
        short = [(n, i) for i, (s, n) in enumerate(runs) if n < least and (only is None or s == only)]
        if not short:
            break
        _, i = min(short)
        left, right = (runs[i - 1][1] if i else -1), (runs[i + 1][1] if i + 1 < len(runs) else -1)
        runs[i][0] = runs[i - 1][0] if left >= right else runs[i + 1][0]
        merged: list[list[int]] = []
        for s, n in runs:
            if merged and merged[-1][0] == s:
                merged[-1][1] += n
            else:
                merged.append([s, n])
        runs = merged
    return np.repeat([s for s, _ in runs], [n for _, n in runs]).astype(states.dtype)


def clean_states(states: np.ndarray, least: int, least_overlap: int = 0) -> np.ndarray:
    """Runs below their least lengths are absorbed, overlap by its own one first, so that bursts of it do not grow together."""
    return absorb_short_runs(absorb_short_runs(states, least_overlap, only=3), least)


def fourier_filter(x: np.ndarray, hz: float, lo: float | None = None, hi: float | None = None, power: int = 8) -> np.ndarray:
    """Zero-phase high-, low- or band-pass by Fourier transform, on the signal mirrored at both ends."""
    n, pad = len(x), min(len(x), int(hz))
    y = np.r_[x[:pad][::-1], x, x[n - pad :][::-1]] if pad else x
    f = np.fft.rfftfreq(len(y), 1 / hz)
    gain = np.ones(len(f))
    if lo:
        gain /= 1 + (lo / np.maximum(f, 1e-9)) ** power
    if hi:
        gain /= 1 + (f / hi) ** power
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y))[pad : pad + n]


def bandpass(x: np.ndarray, hz: float, lo: float, hi: float) -> np.ndarray:
    return fourier_filter(x, hz, lo, hi)


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal with its Hilbert transform as imaginary part."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def oscillations(main: np.ndarray, other: np.ndarray, hz: float, lo: float = 1.5, hi: float = 5.0, amplitude: float = 1.5, cycles: float = 1.2) -> list[tuple[float, float]]:
    """Spans where ``main`` swings by at least the amplitude, and by no less than ``other`` does, for enough cycles: nods in pitch, shakes in yaw."""
    return swings(main, other, hz, lo, hi, amplitude, cycles)[0]


def swings(pitch: np.ndarray, yaw: np.ndarray, hz: float, lo: float = 1.5, hi: float = 5.0, amplitude: float = 1.5, cycles: float = 1.2) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """The oscillations of pitch and those of yaw, each signal filtered once."""
    known = np.isfinite(pitch) & np.isfinite(yaw)
    if known.sum() < hz:
        return [], []
    at = np.arange(len(pitch))
    z = [analytic(bandpass(np.interp(at, at[known], x[known]), hz, lo, hi)) for x in (pitch, yaw)]
    size, found = [np.abs(x) for x in z], []
    for own, rest in ((0, 1), (1, 0)):
        a, b = run_edges((size[own] >= amplitude) & (size[own] >= size[rest]) & known)
        if len(a):
            phase = np.unwrap(np.angle(z[own])) / (2 * np.pi)
            # cycles are counted to the frame after the span, where there is one
            enough = np.abs(phase[np.minimum(b, len(phase) - 1)] - phase[a]) >= cycles
            a, b = a[enough], b[enough]
        found.append(list(zip((a / hz).tolist(), (b / hz).tolist())))
    return found[0], found[1]


def correlation_peak(surface: np.ndarray, reach: int, refine: bool = False) -> tuple[float, float]:
    """(lag, sharpness) of the peak of a correlation over lags -reach..reach: sharpness is the peak over the standard deviation."""
    k, spread = int(np.argmax(surface)), float(surface.std())
    shift = 0.0
    if refine and 0 < k < len(surface) - 1:
        left, top, right = surface[k - 1 : k + 2]
        if abs(curve := left - 2 * top + right) > 1e-9:
            shift = float(np.clip((left - right) / (2 * curve), -0.5, 0.5))
    return k - reach + shift, float(surface[k] / spread) if spread > 1e-9 else 0.0


def _correlation(a: np.ndarray, b: np.ndarray, reach: int, whiten: bool) -> tuple[np.ndarray, int]:
    """Circular correlation of a against b at lags -reach..reach, with zeros between them; positive lags: a is later."""
    n = 1 << (len(a) + len(b) - 1).bit_length()
    cross = np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n))
    r = np.fft.irfft(cross / (np.abs(cross) + 1e-9) if whiten else cross, n)
    reach = min(reach, n // 2 - 1)
    return np.roll(r, reach)[: 2 * reach + 1], reach


def gcc_phat(a: np.ndarray, b: np.ndarray, hz: float, max_lag_s: float) -> tuple[float, float]:
    """(delay of a in seconds, sharpness): the peak of the whitened cross-correlation, refined by a parabola. Positive: a is later."""
    if not len(a) or not len(b) or round(max_lag_s * hz) < 1:
        return float("nan"), 0.0
    surface, reach = _correlation(np.asarray(a, float), np.asarray(b, float), round(max_lag_s * hz), True)
    lag, sharp = correlation_peak(surface, reach, refine=True)
    return lag / hz, sharp


def coarse_lag(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, float]:
    """(samples by which a is later, sharpness) of the plain correlation, each lag over the samples that overlap at it."""
    surface, reach = _correlation(np.asarray(a, float), np.asarray(b, float), reach, False)
    overlap = np.maximum(1.0, min(len(a), len(b)) - np.abs(np.arange(-reach, reach + 1)))
    lag, sharp = correlation_peak(surface / overlap, reach)
    return int(lag), sharp


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Running mean over ``size`` values, the edge values held beyond the ends."""
    left = size // 2
    total = np.cumsum(np.r_[0.0, np.pad(np.asarray(x, float), (left, size - 1 - left), mode="edge")])
    return (total[size:] - total[:-size]) / size


def filled_pauses(mfcc: np.ndarray, log_f0: np.ndarray, speech: np.ndarray, hz: float, steady_pct: float = 15, flat_pct: float = 45, smooth_s: float = 0.05, gap_s: float = 0.06, min_s: float = 0.16, max_s: float = 1.2, min_speech_s: float = 5.0) -> list[tuple[float, float]]:
    """Held vowels in one person's speech: voiced frames whose spectrum and pitch hardly move, by the speaker's own percentiles.

    ``mfcc`` is (frames, coefficients), ``log_f0`` is not a number where unvoiced. With too little speech, or
    too few voiced frames, there is nothing to judge by and nothing is found.
    """
    speech, voiced = np.asarray(speech, bool), np.isfinite(log_f0)
    if speech.sum() < max(50, int(min_speech_s * hz)) or (speech & voiced).sum() < 25:
        return []
    at, size = np.arange(len(log_f0)), max(1, round(smooth_s * hz))
    step = lambda x: np.abs(np.diff(x, axis=0, prepend=x[:1]))
    flux = box_mean(np.sqrt((step(mfcc) ** 2).sum(axis=1)), size)
    semitones = np.interp(at, at[voiced], log_f0[voiced]) * 12 / np.log(2)
    slope = box_mean(step(semitones) * hz, size)
    steady = flux <= np.percentile(flux[speech], steady_pct)
    flat = slope <= np.percentile(slope[speech & voiced], flat_pct)
    spans: list[list[float]] = []
    for a, b in runs_of(speech & voiced & steady & flat):
        if spans and a / hz - spans[-1][1] <= gap_s:
            spans[-1][1] = b / hz
        else:
            spans.append([a / hz, b / hz])
    return [(a, b) for a, b in spans if min_s <= b - a <= max_s]


#: Groups that a kernel is given at once.
TOGETHER = 128


def map_groups(rows: DataFrame, keys: list[str], columns: list[str], kernel: Callable[[list[dict[str, np.ndarray]]], list[dict[str, np.ndarray]]], made: str) -> DataFrame:
    """(keys, made): what ``kernel`` makes of the groups' columns, each an array in order of ``i``.

    Groups are packed to one row each, so many of them reach Python at once and a kernel may take the same step for all
    it is given. Rows that are dealt out by a key already are not shuffled.
    """
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", *columns))).alias("__rows"))
    schema = StructType([packed.schema[k] for k in keys] + StructType.fromDDL(made).fields)
    names, arrow = schema.names[len(keys) :], to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                lists = part.column(len(keys))
                cuts = np.cumsum(lists.value_lengths().to_numpy())[:-1]
                split = {name: np.split(x.to_numpy(zero_copy_only=False), cuts) for name, x in zip(["i", *columns], lists.flatten().flatten())}
                found = kernel([{name: x[k] for name, x in split.items()} for k in range(part.num_rows)])
                owner = pa.array(np.repeat(np.arange(part.num_rows), [len(f[names[0]]) for f in found]))
                values = [pa.concat_arrays([pa.array(f[name], arrow.field(name).type, from_pandas=False) for f in found]) for name in names]
                yield pa.RecordBatch.from_arrays([part.column(k).take(owner) for k in range(len(keys))] + values, schema=arrow)

    return packed.mapInArrow(run, schema)


SPANS = "start_s double, end_s double"


def _spans(found: list[tuple[float, float]]) -> dict[str, np.ndarray]:
    both = np.array(found, float).reshape(-1, 2)
    return {"start_s": both[:, 0], "end_s": both[:, 1]}


def spans_by(frames: DataFrame, columns: list[str], kernel: Callable[..., list[tuple[float, float]]], hz: float) -> DataFrame:
    """Applies a kernel of arrays to every (session, person) and returns its spans as rows."""
    return map_groups(frames, ["session_id", "person"], columns, lambda groups: [_spans(kernel(*(g[x] for x in columns), hz)) for g in groups], SPANS)


def nods(frames: DataFrame, hz: float) -> DataFrame:
    return spans_by(frames, ["head_pitch", "head_yaw"], oscillations, hz)


def shakes(frames: DataFrame, hz: float) -> DataFrame:
    return spans_by(frames, ["head_yaw", "head_pitch"], oscillations, hz)


def head_movements(frames: DataFrame, hz: float) -> DataFrame:
    """(session_id, person, start_s, end_s, kind): nods and shakes in one pass over the frames."""

    def kernel(groups):
        for g in groups:
            nodded, shaken = swings(g["head_pitch"], g["head_yaw"], hz)
            yield _spans(nodded + shaken) | {"kind": np.array(["nod"] * len(nodded) + ["head_shake"] * len(shaken), object)}

    return map_groups(frames, ["session_id", "person"], ["head_pitch", "head_yaw"], lambda groups: list(kernel(groups)), f"{SPANS}, kind string")


def decode_speakers(emissions: DataFrame, hz: float, min_run_s: float = 0.15, min_overlap_s: float = 0.2) -> DataFrame:
    """(session_id, i, speaker_state, confidence) from frame log likelihoods (session_id, i, e array of 4)."""

    def kernel(groups):
        t, e = speaker_transitions(), [np.stack([g[f"e{k}"] for k in range(4)], axis=1) for g in groups]
        for g, path, p in zip(groups, viterbi_all(e, t), posteriors_all(e, t)):
            states = clean_states(path, max(1, round(min_run_s * hz)), max(1, round(min_overlap_s * hz)))
            yield {"i": g["i"], "speaker_state": states, "confidence": p[np.arange(len(p)), states].astype(np.float32)}

    rows = emissions.select("session_id", "i", *(F.col("e")[k].cast("double").alias(f"e{k}") for k in range(4)))
    return map_groups(rows, ["session_id"], [f"e{k}" for k in range(4)], lambda groups: list(kernel(groups)), "i int, speaker_state tinyint, confidence float")


# ---------------------------------------------------------------- pure column expressions


def unmix(a_db: Column, b_db: Column, leak_a: Column | float, leak_b: Column | float, noise_a: Column | float = -200.0, noise_b: Column | float = -200.0, uncertainty: float = 0.15) -> tuple[Column, Column]:
    """Own levels of two microphones, with the share of each voice that reaches the other taken out.

    leak_a: the share of A's power in B's microphone. What cannot be told keeps a floor in proportion to the
    leakage and the noise; microphones too much alike are left as they were heard.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    leak_a, leak_b = as_column(leak_a), as_column(leak_b)
    pa, pb, na, nb = (F.pow(F.lit(10.0), as_column(x) / 10) for x in (a_db, b_db, noise_a, noise_b))
    own_a, own_b, det = F.greatest(pa - na, F.lit(0.0)), F.greatest(pb - nb, F.lit(0.0)), 1 - leak_a * leak_b

    def clean(own: Column, other: Column, leak: Column, noise: Column) -> Column:
        alone = F.when(det <= 0.05, own).otherwise(F.greatest((own - leak * other) / det, F.lit(0.0)))
        return 10 * F.log10(F.greatest(alone + uncertainty * leak * other + 0.3 * noise, F.lit(1e-15)))

    return clean(own_a, own_b, leak_b, na), clean(own_b, own_a, leak_a, nb)


def level_model(frames: DataFrame, column: str, state: str = "speaker_state") -> DataFrame:
    """(session_id, state, centre, spread): median and scaled median deviation of a level by provisional state, the spread at least 1.5 dB."""
    by = Window.partitionBy("session_id", state)
    centred = frames.withColumn("__m", F.median(column).over(by)).withColumn("__d", F.abs(F.col(column) - F.col("__m")))
    return centred.groupBy("session_id", F.col(state).alias("state")).agg(F.first("__m").alias("centre"), F.greatest(1.4826 * F.median("__d"), F.lit(1.5)).alias("spread"))


def euler(r: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(pitch, yaw, roll) in degrees of a rotation matrix given as r00..r22."""
    level = F.sqrt(r["r00"] * r["r00"] + r["r10"] * r["r10"])
    return F.degrees(F.atan2(r["r21"], r["r22"])), F.degrees(F.atan2(-r["r20"], level)), F.degrees(F.atan2(r["r10"], r["r00"]))


def wrist_speed(frames: DataFrame, x: str, y: str, scale: str, hz: float) -> DataFrame:
    """Adds ``wrist_speed``: distance between neighbouring frames in shoulder widths a second, a running median of three."""
    by = Window.partitionBy("session_id", "person").orderBy("i")
    step = F.hypot(F.col(x) - F.lag(x).over(by), F.col(y) - F.lag(y).over(by)) / F.nullif(F.col(scale), F.lit(0.0)) * hz
    rows = frames.withColumn("__s", step)
    three = F.array_sort(F.array(F.lag("__s").over(by), F.col("__s"), F.lead("__s").over(by)))
    return rows.withColumn("wrist_speed", F.when(F.col("__s").isNotNull(), F.coalesce(F.element_at(F.filter(three, lambda v: v.isNotNull()), F.floor(F.size(F.filter(three, lambda v: v.isNotNull())) / 2 + 1).cast("int")), F.col("__s")))).drop("__s")


def short_state_fraction(runs: DataFrame, hz: float, short_s: float = 0.3) -> DataFrame:
    """(session_id, short): the share of speaking runs shorter than ``short_s``."""
    return runs.filter("speaker_state <> 0").groupBy("session_id").agg(F.avg((F.col("n") / hz < short_s).cast("double")).alias("short"))
