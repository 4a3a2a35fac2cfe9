"""Alignment of a session's views by their audio: a coarse lag of loudness, then probes along the recording."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.operators.audio import energy_envelope
from duologue.operators.signals import coarse_lag, gcc_phat
from duologue.settings import SyncSettings

ENVELOPE_HZ = 100.0
#: A peak so many standard deviations high counts as certain.
CERTAIN = 12.0
PROBES = "session_id string, role string, coarse_s double, coarse_sharp double, center_s double, residual_s double, sharp double"


def probe(other: np.ndarray, reference: np.ndarray, rate: float, cfg: SyncSettings = SyncSettings()) -> tuple[float, float, list[tuple[float, float, float]]]:
    """(coarse delay of other, its sharpness, probes): each probe is (centre, what remains of the delay there, sharpness)."""
    lag, sharp = coarse_lag(energy_envelope(other, rate, ENVELOPE_HZ), energy_envelope(reference, rate, ENVELOPE_HZ), int(cfg.max_offset_s * ENVELOPE_HZ))
    coarse = lag / ENVELOPE_HZ
    shift, size = round(coarse * rate), int(cfg.probe_window_s * rate)
    # the stretch of the reference that both recordings cover
    first, last = max(0, -shift), min(len(reference), len(other) - shift)
    if last - first < size:
        size = max(int(0.5 * rate), (last - first) // 2)
    probes: list[tuple[float, float, float]] = []
    if 0 < size < last - first:
        for at in np.linspace(first, last - size, max(1, cfg.n_probes)).astype(int).tolist():
            a, b = other[at + shift : at + shift + size], reference[at : at + size]
            if len(a) == len(b) and min(a.std(), b.std()) >= 1e-4:  # silence tells nothing
                left, s = gcc_phat(a, b, rate, min(1.0, cfg.probe_window_s / 4))
                if np.isfinite(left):
                    probes.append(((at + size / 2) / rate, left, s))
    return coarse, sharp, probes


def probe_views(tracks: DataFrame, reference: str, cfg: SyncSettings = SyncSettings()) -> DataFrame:
    """A row for each probe of each view but the reference; views without any have one row without a residual.

    tracks: (session_id, role, sample_rate, samples). A session's tracks meet in one task: they are compared with each other.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        samples = {r.role: (np.asarray(r.samples, float), float(r.sample_rate)) for r in pdf.itertuples(index=False)}
        if reference not in samples:
            raise KeyError(f"session {pdf['session_id'].iloc[0]} has no view {reference!r}")
        rows = []
        for role, (x, rate) in sorted(samples.items()):
            if role != reference:
                coarse, sharp, probes = probe(x, samples[reference][0], rate, cfg)
                rows += [(pdf["session_id"].iloc[0], role, coarse, sharp, *p) for p in probes or [(None, None, None)]]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PROBES.split(", ")]).astype({c: float for c in ("coarse_s", "coarse_sharp", "center_s", "residual_s", "sharp")})

    return tracks.select("session_id", "role", "sample_rate", "samples").groupBy("session_id").applyInPandas(run, PROBES)


def offsets(probes: DataFrame, cfg: SyncSettings = SyncSettings()) -> DataFrame:
    """(session_id, role, offset_s, confidence, scatter_s, drift_ppm, n_probes, method): what maps each view's clock onto the reference's.

    The offset is the coarse one corrected by the median of the probes; how far they lie apart, how
    they drift and how sharp their peaks are say how far to trust it.
    """
    known = lambda name: F.nanvl(F.col(name), F.lit(None).cast("double"))
    p = probes.select("session_id", "role", "coarse_s", "coarse_sharp", *(known(x).alias(x) for x in ("center_s", "residual_s", "sharp")))
    middle = p.groupBy("session_id", "role").agg(F.median("residual_s").alias("mid"))
    rows = p.join(middle, ["session_id", "role"]).groupBy("session_id", "role").agg(
        F.first("coarse_s").alias("coarse"),
        F.first("coarse_sharp").alias("coarse_sharp"),
        F.first("mid").alias("mid"),
        F.count("residual_s").alias("n_probes"),
        F.median(F.abs(F.col("residual_s") - F.col("mid"))).alias("scatter_s"),
        F.median("sharp").alias("sharp"),
        (F.max("center_s") - F.min("center_s")).alias("reach"),
        F.regr_slope("residual_s", "center_s").alias("slope"),
    )
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    coarse_trust = share(F.col("coarse_sharp") / CERTAIN)
    agreement = share(1 - F.col("scatter_s") / max(cfg.min_agreement_s, 1e-9))
    probed = F.col("n_probes") > 0
    drift = F.when(F.lit(cfg.drift_check) & (F.col("n_probes") >= 3) & (F.col("reach") > 1.0), F.col("slope") * 1e6).otherwise(F.lit(0.0))
    return rows.select(
        "session_id",
        "role",
        (-(F.col("coarse") + F.coalesce("mid", F.lit(0.0)))).alias("offset_s"),
        F.when(probed, F.cbrt(agreement * share(F.col("sharp") / CERTAIN) * coarse_trust)).otherwise(0.5 * coarse_trust).alias("confidence"),
        "scatter_s",
        F.coalesce(drift, F.lit(0.0)).alias("drift_ppm"),
        "n_probes",
        F.when(probed, "probes").otherwise("envelope-only").alias("method"),
    )


def align_views(tracks: DataFrame, reference: str, cfg: SyncSettings = SyncSettings(), starts: DataFrame | None = None) -> DataFrame:
    """Offsets with ``warnings``. starts: (session_id, role, start_s), where each view's audio begins in its own container."""
    found = offsets(probe_views(tracks, reference, cfg), cfg)
    if starts is not None:
        own = starts.select("session_id", "role", F.col("start_s").alias("own"))
        base = starts.filter(F.col("role") == reference).select("session_id", F.col("start_s").alias("base"))
        found = found.join(own, ["session_id", "role"], "left").join(base, "session_id", "left")
        found = found.withColumn("offset_s", F.col("offset_s") + F.coalesce("base", F.lit(0.0)) - F.coalesce("own", F.lit(0.0))).drop("own", "base")
    warnings = F.array(
        F.when(F.col("scatter_s") > cfg.min_agreement_s, F.lit("probes disagree")),
        F.when(F.abs("drift_ppm") > cfg.max_drift_ppm, F.lit("the clock drifts")),
        F.when(F.col("confidence") < cfg.min_confidence, F.lit("low confidence")),
    )
    return found.withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))
