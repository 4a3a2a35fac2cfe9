"""Telling two voices apart in one recording: spectral features, a discriminant learned from provisional labels.

The discriminant is made of class moments (counts, sums and sums of products), which add up: the
moments of blocks give the model of any choice of blocks without another look at the frames, which
is how held-out accuracy is measured.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from duologue.operators.audio import framed
from duologue.operators.signals import box_mean, runs_of

#: Length of spectra, mel bands, cepstral coefficients, range of pitch, least strength of a voiced frame's peak.
N_FFT, N_MELS, N_CEPS = 512, 40, 12
F0_HZ = (70.0, 400.0)
VOICED = 2.0
#: End of the fixed values.
TINY = 1e-10
LEAST_A_CLASS, LEAST_SEEDS = 30, 100


def mel_bands(rate: float, bins: int = N_FFT // 2 + 1, bands: int = N_MELS, low: float = 80.0) -> np.ndarray:
    """(bands, bins): triangles that are equally wide in mel, each of area one."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    corner = 700 * (10 ** (np.linspace(mel(low), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)
    tent = np.stack([np.interp(f, corner[k : k + 3], [0.0, 1.0, 0.0]) for k in range(bands)])
    return tent / np.maximum(tent.sum(axis=1, keepdims=True), TINY)


def cosines(n: int, k: int) -> np.ndarray:
    """(n, k): an orthonormal cosine transform's columns 1 to k."""
    return np.sqrt(2 / n) * np.cos(np.pi / n * (np.arange(n)[:, None] + 0.5) * np.arange(1, k + 1))


def spectral_features(x: np.ndarray, rate: float, hz: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cepstral coefficients, log pitch or not a number, strength of voicing) of n frames."""
    bands, transform = mel_bands(rate), cosines(N_MELS, N_CEPS)
    lo, hi = max(2, int(rate // F0_HZ[1])), min(N_FFT // 2 - 1, int(np.ceil(rate / F0_HZ[0])))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for block in framed(x, rate, hz, N_FFT / rate, n):
        power = np.abs(np.fft.rfft(block * np.hanning(block.shape[1]), N_FFT, axis=1)) ** 2
        # a comb of harmonics is a peak of the cepstrum at its period
        cepstrum = np.fft.irfft(np.log(power + TINY), N_FFT, axis=1)[:, lo : hi + 1]
        strength = cepstrum.max(axis=1) / (cepstrum.std(axis=1) + TINY)
        pitch = np.where(strength >= VOICED, np.log(rate / (cepstrum.argmax(axis=1) + lo)), np.nan)
        parts.append((np.log(power @ bands.T + TINY) @ transform, pitch, strength))
    return tuple(np.concatenate(p) for p in zip(*parts))


def context_features(mfcc: np.ndarray, log_f0: np.ndarray, voicing: np.ndarray, weight: np.ndarray, hz: float, window_s: float = 0.5) -> np.ndarray:
    """Means and spreads over half a second, weighted by how likely speech is: what stays of a voice when its sounds change."""
    size, w, voiced = max(3, round(window_s * hz)), np.maximum(np.asarray(weight, float), 1e-3), np.isfinite(log_f0)
    over = lambda v, by: box_mean(v * by, size) / np.maximum(box_mean(by, size), 1e-6)

    def both(v: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = over(v, by)
        return mean, np.sqrt(np.maximum(over(v * v, by) - mean**2, 0))

    cepstral = [both(c, w) for c in np.asarray(mfcc, float).T]
    columns = [m for m, _ in cepstral] + [s for _, s in cepstral]
    columns += [*both(np.where(voiced, log_f0, 0.0), w * voiced), over(voiced.astype(float), w), over(np.asarray(voicing, float), w)]
    return np.stack(columns, axis=1)


# ---------------------------------------------------------------- the discriminant


@dataclass
class Moments:
    """Count, sum and sum of products of rows; moments of disjoint rows add up."""

    n: float
    total: np.ndarray
    product: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        return Moments(len(x), x.sum(axis=0), x.T @ x)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.product + other.product)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.product - other.product)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def scatter(self) -> np.ndarray:
        return self.product - np.outer(self.total, self.total) / self.n


@dataclass
class Discriminant:
    """A direction, and where the two classes lie along it."""

    direction: np.ndarray
    means: tuple[float, float]
    spread: float

    def along(self, x: np.ndarray) -> np.ndarray:
        return x @ self.direction

    def log_odds(self, x: np.ndarray, limit: float = 6.0) -> np.ndarray:
        """Of class 0 over class 1, both normal with one spread."""
        (m0, m1), at = self.means, self.along(x)
        return np.clip((m0 - m1) * (at - (m0 + m1) / 2) / self.spread**2, -limit, limit)

    @property
    def separation(self) -> float:
        return abs(self.means[0] - self.means[1]) / self.spread


def discriminant_of(a: Moments, b: Moments, shrink: float = 0.25, least: int = LEAST_A_CLASS) -> Discriminant | None:
    """Fisher's direction from class moments, on standardised features, with the covariance drawn towards a sphere."""
    if min(a.n, b.n) < least:
        return None
    whole = a + b
    unit = np.sqrt(np.maximum(np.diag(whole.scatter) / whole.n, 0))
    unit = np.where(unit < 1e-6, 1.0, unit)
    share = lambda m: m.n / whole.n / (m.n - 1)
    within = (a.scatter * share(a) + b.scatter * share(b)) / np.outer(unit, unit)
    sphere = np.eye(len(unit)) * (np.trace(within) / len(unit))
    try:
        w = np.linalg.solve((1 - shrink) * within + shrink * sphere, (a.mean - b.mean) / unit)
    except np.linalg.LinAlgError:
        return None
    length = np.linalg.norm(w)
    if not 1e-9 <= length < np.inf:
        return None
    w = w / length / unit
    spread = float(np.sqrt((w @ (a.scatter / a.n + b.scatter / b.n) @ w) / 2))
    return Discriminant(w, (float(a.mean @ w), float(b.mean @ w)), spread) if spread >= 1e-9 else None


def blocked_accuracy(x: np.ndarray, y: np.ndarray, t: np.ndarray | None = None, blocks: int = 5) -> float:
    """Share of frames named rightly when contiguous blocks of time are held out in turn; blocks under ten frames are left out.

    Frames close in time are nearly alike, so frames held out one by one would have their likes among those learned from.
    """
    if t is not None:
        order = np.argsort(t, kind="stable")
        x, y = x[order], y[order]
    x = x - x.mean(axis=0)  # moments of centred rows keep their digits
    edge = np.linspace(0, len(y), blocks + 1).astype(int)
    parts = [(slice(a, b), [Moments.of(x[a:b][y[a:b] == k]) for k in (0, 1)]) for a, b in zip(edge, edge[1:])]
    whole = [sum((m[k] for _, m in parts[1:]), parts[0][1][k]) for k in (0, 1)]
    right = total = 0
    for at, own in parts:
        if at.stop - at.start >= 10 and (model := discriminant_of(whole[0] - own[0], whole[1] - own[1])) is not None:
            guess = (model.along(x[at]) < sum(model.means) / 2).astype(int)
            right, total = right + int((guess == y[at]).sum()), total + at.stop - at.start
    return right / total if total else float("nan")


def seed_labels(state: np.ndarray, margin: np.ndarray, hz: float, min_run_s: float = 0.3, drop_share: float = 0.4) -> np.ndarray:
    """0 for A, 1 for B, -1 unused: frames of runs long enough, without the weakest share by margin."""
    labels, least = np.full(len(state), -1, np.int8), max(1, round(min_run_s * hz))
    for k in (0, 1):
        for a, b in runs_of(state == k + 1):
            if b - a >= least:
                labels[a:b] = k
    use = labels >= 0
    if use.sum() > 200 and np.isfinite(margin).any():
        labels[use & (np.abs(margin) < np.quantile(np.abs(margin[use]), drop_share))] = -1
    return labels


@dataclass
class VoiceCue:
    log_odds: np.ndarray
    accuracy: float
    ok: bool
    note: str


def speaker_log_odds(features: np.ndarray, state: np.ndarray, margin: np.ndarray, hz: float, min_accuracy: float = 0.68) -> VoiceCue:
    """Log odds of A over B for every frame, learned from the provisional states whose evidence is strongest.

    Too few such frames, or voices that cannot be told apart on held-out blocks, give no cue.
    """
    y, none = seed_labels(state, margin, hz), np.zeros(len(features))
    n = [int((y == k).sum()) for k in (0, 1)]
    if min(n) < LEAST_SEEDS:
        return VoiceCue(none, float("nan"), False, f"too few frames to learn from: {n[0]} and {n[1]}")
    used = np.flatnonzero(y >= 0)
    accuracy = blocked_accuracy(features[used], y[used], used)
    if not accuracy >= min_accuracy:
        return VoiceCue(none, accuracy, False, f"the voices are alike: {accuracy:.2f} right on held-out blocks")
    centre = features[used].mean(axis=0)
    model = discriminant_of(*(Moments.of(features[y == k] - centre) for k in (0, 1)))
    if model is None:
        return VoiceCue(none, accuracy, False, "the features do not vary")
    return VoiceCue(model.log_odds(features - centre), accuracy, True, f"{sum(n)} frames, {accuracy:.2f} right on held-out blocks, {model.separation:.2f} spreads apart")


def voice_cues(frames: DataFrame, hz: float, min_accuracy: float = 0.68) -> DataFrame:
    """(session_id, i, voice, accuracy, ok) of frames (session_id, i, features array, speaker_state, margin): a model for each session."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = np.stack(pdf["features"].map(lambda v: np.asarray(v, float)).to_list())
        cue = speaker_log_odds(x, pdf["speaker_state"].to_numpy(), pdf["margin"].to_numpy(float), hz, min_accuracy)
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "i": pdf["i"].to_numpy(), "voice": cue.log_odds, "accuracy": cue.accuracy, "ok": cue.ok})

    return frames.select("session_id", "i", "features", "speaker_state", "margin").groupBy("session_id").applyInPandas(run, "session_id string, i int, voice double, accuracy double, ok boolean")
