"""Schemas of the input and output tables."""

from __future__ import annotations

SESSIONS = "session_id string, duration_s double, frame_hz double, overlap_identifiable boolean, meta map<string,string>"
SPEECH = "session_id string, person string, start_s double, end_s double"
WORDS = "session_id string, person string, start_s double, end_s double, text string, probability double"
SPANS = "session_id string, person string, kind string, start_s double, end_s double"
FRAMES = (
    "session_id string, person string, i int, t_s double, tracked boolean, on_partner boolean, smile double, duchenne double, brow_raise double, valence double, expressivity double, "
    "head_pitch double, head_yaw double, f0_hz double, intensity_db double, wrist_speed double, self_touch boolean"
)
VOICE = "session_id string, person string, jitter double, shimmer double"
STATE = "session_id string, i int, speaker_state tinyint, confidence float"
EMBEDDINGS = "session_id string, turn_index int, v array<float>"
ARTIFACTS = "session_id string, name string"
MEASURES_LONG = "session_id string, person string, level string, family string, measure string, value double, unit string, n int, available boolean, unavailable_reason string"
