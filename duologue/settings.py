"""Parameters that change results, as frozen dataclasses; unknown keys are refused."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any, get_type_hints


@dataclass(frozen=True)
class TurnSettings:
    ipu_gap_s: float = 0.18
    backchannel_max_s: float = 1.2
    backchannel_max_words: int = 4
    containment_min: float = 0.5
    floor_probe_s: float = 1.0
    floor_kept_s: float = 0.25
    floor_silent_s: float = 0.15
    min_turn_s: float = 0.2
    max_gap_s: float = 10.0
    overlap_min_s: float = 0.1
    transition_max_s: float = 1.0
    max_incursion_s: float = 3.0
    success_delay_s: float = 1.0
    success_limit_s: float = 0.3


@dataclass(frozen=True)
class SemanticSettings:
    min_turn_words: int = 4
    topic_window: int = 3
    topic_min_turns: int = 4
    topic_percentile: float = 0.8
    callback_min_lag: int = 4
    callback_max_lag: int = 40
    min_similarity: float = 0.35
    anchor_len: int = 4
    anchor_max_df: float = 0.25
    sensitivity_lags: tuple[int, ...] = (2, 3, 4, 5, 6, 8, 10)


@dataclass(frozen=True)
class SynchronySettings:
    window_s: float = 30.0
    step_s: float = 10.0
    max_lag_s: float = 5.0
    surrogates: int = 50
    min_shift_s: float = 60.0
    seed: int = 20260730
    colaughter_s: float = 1.5
    uptake_window_s: float = 2.0
    uptake_surrogates: int = 200


@dataclass(frozen=True)
class VisionSettings:
    min_coverage: float = 0.6
    gaze_degrees: float = 12.0
    duchenne_min: float = 0.18
    brow_min: float = 0.35
    mutual_gaze_gap_s: float = 0.15
    mutual_gaze_min_s: float = 0.3


@dataclass(frozen=True)
class ProsodySettings:
    min_voiced_frames: int = 10
    entrainment_min_turns: int = 8


@dataclass(frozen=True)
class DynamicsSettings:
    n_bins: int = 3
    min_events_per_bin: int = 3


@dataclass(frozen=True)
class QualitySettings:
    min_duration_s: float = 60.0
    min_speech: float = 0.25
    max_uncertain: float = 0.20
    max_short_runs: float = 0.25
    short_run_s: float = 0.3
    max_overlap_onsets: float = 0.30
    min_onsets: int = 20
    min_turns: int = 8
    reliable_turns: int = 20
    min_turn_rate: float = 1.5
    min_talk: float = 0.02
    min_snr_db: float = 15.0
    min_asr: float = 0.45
    min_coverage: float = 0.60
    min_sync: float = 0.5
    max_freeze_rate: float = 0.20
    min_motion: float = 0.005
    min_video_height: int = 480


@dataclass(frozen=True)
class SyncSettings:
    max_offset_s: float = 30.0
    probe_window_s: float = 20.0
    n_probes: int = 9
    min_agreement_s: float = 0.05
    drift_check: bool = True
    max_drift_ppm: float = 200.0
    min_confidence: float = 0.5


@dataclass(frozen=True)
class AttributionSettings:
    energy_weight: float = 1.0
    visual_weight: float = 0.6
    visual_weight_solo: float = 2.5
    visual_activity_weight: float = 0.3
    av_weight: float = 0.8
    av_window_s: float = 1.0
    voice_weight: float = 1.2
    voice_min_accuracy: float = 0.68
    voice_context_s: float = 0.5
    identical_channel_db: float = 0.5
    calibration_percentile: float = 90.0
    ratio_scale_db: float = 6.0
    both_penalty: float = 1.0
    source_smooth_s: float = 0.15
    source_smooth_percentile: float = 70.0
    self_transition_logit: float = 6.0
    min_state_s: float = 0.15
    min_overlap_state_s: float = 0.20
    lip_motion_band: tuple[float, float] = (1.5, 8.0)


@dataclass(frozen=True)
class Settings:
    frame_hz: float = 100.0
    turns: TurnSettings = field(default_factory=TurnSettings)
    semantic: SemanticSettings = field(default_factory=SemanticSettings)
    synchrony: SynchronySettings = field(default_factory=SynchronySettings)
    vision: VisionSettings = field(default_factory=VisionSettings)
    prosody: ProsodySettings = field(default_factory=ProsodySettings)
    dynamics: DynamicsSettings = field(default_factory=DynamicsSettings)
    quality: QualitySettings = field(default_factory=QualitySettings)
    sync: SyncSettings = field(default_factory=SyncSettings)
    attribution: AttributionSettings = field(default_factory=AttributionSettings)

    def dump(self) -> str:
        """The JSON text that ``load`` reads."""
        return json.dumps(self.to_dict(), indent=2, sort_keys=True)

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(dataclasses.asdict(self)))


def build(kind: type, values: dict[str, Any]):
    """A settings object from nested plain values; lists become tuples, unknown keys raise ValueError."""
    hints = get_type_hints(kind)
    if unknown := set(values) - set(hints):
        raise ValueError(f"unknown settings for {kind.__name__}: {', '.join(sorted(unknown))}")
    made = {}
    for name, value in values.items():
        if dataclasses.is_dataclass(hints[name]):
            value = build(hints[name], value or {})
        elif isinstance(value, list):
            value = tuple(value)
        made[name] = value
    return kind(**made)


def load(text: str = "{}", **overrides: Any) -> Settings:
    """Settings from JSON text and dotted overrides such as ``turns.max_gap_s``."""
    values = json.loads(text)
    for dotted, value in overrides.items():
        *path, last = dotted.replace("__", ".").split(".")
        at = values
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return build(Settings, values)
