"""The catalogue of measures: family, id, level (P: one value for each person, D: one for the dyad), unit, required inputs.

Fixed values: ids, levels, units and requirements.
"""

from __future__ import annotations

from dataclasses import dataclass

LINES = """
turn_taking | response_latency_median | P | s | turn_set
turn_taking | response_latency_iqr | P | s | turn_set
turn_taking | response_latency_asymmetry | D | s | turn_set
turn_taking | fast_response_proportion | P | proportion | turn_set
turn_taking | talk_time_share | P | proportion | turn_set
turn_taking | talk_time_balance | D | index | turn_set
turn_taking | turn_count | P | count | turn_set
turn_taking | turn_rate | P | per minute | turn_set
turn_taking | mean_turn_duration | P | s | turn_set
turn_taking | turn_duration_variability | P | ratio | turn_set
turn_taking | silence_proportion | D | proportion | turn_set
turn_taking | silence_rate | D | per minute | turn_set
turn_taking | mean_silence_duration | D | s | turn_set
turn_taking | longest_silence | D | s | turn_set
turn_taking | within_turn_pause_rate | P | per minute | turn_set
turn_taking | overlap_proportion | D | proportion | turn_set, overlap_evidence
turn_taking | turn_transition_overlap_rate | P | per minute | turn_set, overlap_evidence
turn_taking | spoke_first | P | indicator | turn_set
turn_taking | speaking_time | P | seconds | turn_set
turn_taking | silent_time | P | seconds | turn_set
turn_taking | listening_time | P | seconds | turn_set
turn_taking | median_turn_duration | P | seconds | turn_set
interruption | interruption_rate | P | per minute | turn_set, overlap_evidence
interruption | transition_overlap_rate | P | per minute | turn_set, overlap_evidence
interruption | interruption_success_rate | P | proportion | turn_set, overlap_evidence
interruption | interrupted_rate | P | per minute | turn_set, overlap_evidence
interruption | floor_hold_rate | P | proportion | turn_set, overlap_evidence
interruption | interruption_asymmetry | D | per minute | turn_set, overlap_evidence
interruption | mean_overlap_duration | D | s | turn_set, overlap_evidence
backchannel | backchannel_rate | P | per minute of partner speech | turn_set
backchannel | backchannel_count | P | count | turn_set
backchannel | backchannel_coverage | P | proportion | turn_set
backchannel | backchannel_relative_position | P | proportion of turn | turn_set
backchannel | backchannel_latency | P | s | turn_set
backchannel | backchannel_reciprocity | D | index | turn_set
lexical | word_count | P | count | transcript
lexical | speech_rate_wpm | P | words per minute | transcript, turn_set
lexical | words_per_turn | P | words | transcript, turn_set
lexical | lexical_diversity | P | ratio | transcript
lexical | question_rate | P | per minute | transcript, turn_set
lexical | open_question_ratio | P | proportion | transcript, turn_set
lexical | question_reciprocity | D | index | transcript, turn_set
lexical | filler_rate | P | per 100 words | transcript
lexical | hesitation_rate | P | per minute of speech | filled_pauses
lexical | hesitation_duration_mean | P | seconds | filled_pauses
lexical | discourse_marker_rate | P | per 100 words | transcript
lexical | hedge_rate | P | per 100 words | transcript
lexical | first_person_singular_rate | P | per 100 words | transcript
lexical | second_person_rate | P | per 100 words | transcript
lexical | first_person_plural_rate | P | per 100 words | transcript
lexical | emotion_word_rate | P | per 100 words | transcript
lexical | agreement_rate | P | per 100 words | transcript, turn_set
lexical | positive_word_rate | P | per 100 words | transcript
lexical | politeness_marker_rate | P | per 100 words | transcript
lexical | linguistic_style_matching | D | index | transcript
prosody | f0_median | P | Hz | prosody
prosody | pitch_variability | P | semitones | prosody
prosody | pitch_range | P | semitones | prosody
prosody | intensity_variability | P | dB | prosody
prosody | voice_jitter | P | proportion | prosody
prosody | voice_shimmer | P | proportion | prosody
prosody | pitch_entrainment_synchrony | D | correlation | prosody, turn_set
prosody | intensity_entrainment_synchrony | D | correlation | prosody, turn_set
prosody | pitch_entrainment_convergence | D | correlation | prosody, turn_set
prosody | pitch_proximity | D | semitones (negated) | prosody, turn_set
semantic | semantic_coherence_mean | P | cosine similarity | semantics, turn_set
semantic | semantic_coherence_variability | D | cosine similarity | semantics
semantic | topic_count | D | count | semantics
semantic | mean_topic_duration | D | s | semantics
semantic | topic_initiation_share | P | proportion | semantics
semantic | topic_turnover_rate | D | per minute | semantics
semantic | callback_rate | P | per minute | semantics
semantic | other_directed_callback_rate | P | per minute | semantics
semantic | callback_mean_lag | P | turns | semantics
semantic | callback_max_lag | P | turns | semantics
semantic | callback_reciprocity | D | index | semantics
semantic | topics_initiated | P | count | semantics
semantic | median_topic_duration | D | seconds | semantics
gaze | gaze_partner_proportion | P | proportion | face
gaze | gaze_while_listening | P | proportion | face, turn_set
gaze | gaze_while_speaking | P | proportion | face, turn_set
gaze | gaze_speaker_listener_gap | P | proportion | face, turn_set
gaze | mutual_gaze_proportion | D | proportion | face
gaze | mutual_gaze_episode_rate | D | per minute | face
gaze | gaze_partner_time | P | seconds | face
head | nod_rate_while_listening | P | per minute of partner speech | face, turn_set
head | nod_rate | P | per minute | face
head | head_shake_rate | P | per minute | face
head | nod_count | P | count | face
head | nod_total_duration | P | seconds | face
head | nod_mean_duration | P | seconds | face
facial_expression | smile_proportion | P | proportion | face
facial_expression | duchenne_smile_ratio | P | proportion | face
facial_expression | facial_expressivity | P | activation per frame | face
facial_expression | brow_raise_rate | P | per minute | face
facial_expression | shared_smile_proportion | D | proportion | face
facial_expression | smile_count | P | count | face
facial_expression | smile_total_duration | P | seconds | face
facial_expression | smile_mean_duration | P | seconds | face
body | gesture_rate | P | per minute of own speech | body, turn_set
body | posture_shift_rate | P | per minute | body
body | self_touch_proportion | P | proportion | body
affect | facial_valence_mean | P | index | face
affect | facial_valence_variability | P | index | face
affect | valence_while_listening | P | index | face, turn_set
affect | valence_while_speaking | P | index | face, turn_set
affect | positive_affect_proportion | P | proportion | face
affect | negative_affect_proportion | P | proportion | face
affect | partner_smile_uptake | P | probability above chance | face
affect | partner_laughter_uptake | P | probability above chance | laughter
affect | valence_reactivity | P | correlation above chance | face
affect | valence_synchrony | D | correlation above chance | face
affect | valence_synchrony_z | D | z | face
laughter | laughter_rate | P | per minute | laughter
laughter | laughter_proportion | P | proportion | laughter
laughter | shared_laughter_rate | D | per minute | laughter
laughter | laughter_reciprocity | D | index | laughter
synchrony | smile_synchrony | D | correlation above chance | face
synchrony | smile_synchrony_z | D | z | face
synchrony | head_movement_synchrony | D | correlation above chance | face
synchrony | expressivity_synchrony | D | correlation above chance | face
synchrony | loudness_synchrony | D | correlation above chance | prosody
synchrony | movement_synchrony | D | correlation above chance | body
synchrony | smile_synchrony_lag | D | s | face
dynamics | response_latency_trend | P | s | turn_set
dynamics | backchannel_rate_trend | P | per minute | turn_set
dynamics | turn_duration_trend | P | s | turn_set
dynamics | silence_trend | D | proportion | turn_set
dynamics | laughter_trend | P | per minute | laughter
dynamics | gaze_trend | P | proportion | face
dynamics | smile_trend | P | proportion | face
dynamics | coherence_trend | D | cosine similarity | semantics, turn_set
"""


@dataclass(frozen=True)
class Spec:
    id: str
    family: str
    level: str
    unit: str
    requires: tuple[str, ...]

    @property
    def label(self) -> str:
        return self.id.replace("_", " ").capitalize()


def _parse(line: str) -> Spec:
    family, id_, level, unit, requires = (x.strip() for x in line.split("|"))
    return Spec(id_, family, "person" if level == "P" else "dyad", unit, tuple(x.strip() for x in requires.split(",")))


SPECS: dict[str, Spec] = {s.id: s for s in sorted(map(_parse, LINES.strip().splitlines()), key=lambda s: (s.family, s.id))}
FAMILIES = tuple(dict.fromkeys(s.family for s in SPECS.values()))
