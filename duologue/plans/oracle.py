"""DuckDB statements for the engine's queries, written apart from the DataFrame code they check.

Interval work is done here by pairwise joins and correlated sums instead of sweeps and probes.
"""

from __future__ import annotations

from duologue.functions import lexicon
from duologue.plans.catalogue import SPECS


def islands(name: str, source: str, keys: str, gap: float = 0.0) -> str:
    fresh = f"start_s - prev > {gap}" if gap else "start_s > prev"
    return f"""{name}_1 AS (SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {source}),
{name}_2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR {fresh} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM {name}_1),
{name} AS (SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s FROM {name}_2 GROUP BY {keys}, island)"""


EVENTS = f"""ev AS (
  SELECT user_id // 2 AS num, printf('s%05d', user_id // 2) AS session_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS person, event_id, event_type,
         CAST((epoch_us(ts) // 1000) % 1800000 AS DOUBLE) / 1000 AS start_s,
         CAST(least((epoch_us(ts) // 1000) % 1800000 + CAST(round(value * 100) AS BIGINT), 1800000) AS DOUBLE) / 1000 AS end_s
  FROM events),
sess AS (SELECT DISTINCT num, session_id, CAST(1800 AS DOUBLE) AS duration_s, num % 7 <> 0 AS overlap_ok FROM ev),
spine AS (SELECT s.*, p.person FROM sess s, (VALUES ('A'), ('B')) p(person)),
said AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'purchase') AND end_s > start_s),
{islands("speech", "said", "session_id, person")}"""

KINDS = f"""kinds_0 AS (
  SELECT session_id, person, start_s, end_s, CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'smile' WHEN 1 THEN 'laughter' ELSE 'head_shake' END
         WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'nod' WHEN 1 THEN 'gesture' WHEN 2 THEN 'posture_shift' ELSE 'filled_pause' END END AS kind
  FROM ev WHERE event_type IN ('error', 'signup') AND end_s > start_s),
{islands("spans", "kinds_0", "session_id, person, kind")}"""

CONVERSATIONS = f"""conv_0 AS (
  SELECT conv_id, printf('c%06d', conv_id) AS session_id, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS person, turn, text,
         list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w, ((conv_id * 31 + turn * 17) % 9 - 2) * 100 AS gap
  FROM conversations WHERE role IN ('user', 'assistant')),
conv_1 AS (SELECT *, len(w) AS n FROM conv_0 WHERE len(w) > 0),
conv AS (SELECT *, 1000 + sum(gap) OVER c + coalesce(sum(n * 350) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_ms
         FROM conv_1 WINDOW c AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
sess AS (SELECT session_id, CAST(max(s_ms + n * 350) + 1000 AS DOUBLE) / 1000 AS duration_s, true AS overlap_ok FROM conv GROUP BY session_id),
spine AS (SELECT s.*, p.person FROM sess s, (VALUES ('A'), ('B')) p(person)),
said AS (SELECT session_id, person, CAST(s_ms AS DOUBLE) / 1000 AS start_s, CAST(s_ms + n * 350 AS DOUBLE) / 1000 AS end_s FROM conv),
{islands("speech", "said", "session_id, person")},
words AS (SELECT session_id, person, CAST(s_ms + (k - 1) * 350 AS DOUBLE) / 1000 AS start_s, CAST(s_ms + k * 350 AS DOUBLE) / 1000 AS end_s, w[k] AS text
          FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM conv))"""


def covered(table: str, lo: str, hi: str, person: str) -> str:
    return f"coalesce((SELECT sum(least({hi}, p.end_s) - greatest({lo}, p.start_s)) FROM {table} p WHERE p.session_id = u.session_id AND p.person {person} u.person AND p.start_s < {hi} AND p.end_s > {lo}), 0)"


def turn_set(words: bool = False) -> str:
    texts = (
        """worded AS (SELECT u.session_id, u.person, u.start_s, string_agg(w.text, ' ' ORDER BY w.start_s) AS text, count(*) AS n_words FROM units_0 u JOIN words w
             ON w.session_id = u.session_id AND w.person = u.person AND (w.start_s + w.end_s) * 0.5 >= u.start_s AND (w.start_s + w.end_s) * 0.5 < u.end_s GROUP BY ALL)"""
        if words
        else "worded AS (SELECT session_id, person, start_s, '' AS text, 0 AS n_words FROM units_0)"
    )
    known = ", ".join(f"'{x}'" for x in lexicon.BACKCHANNELS)
    toks = r"list_filter(list_transform(string_split_regex(trim(text), '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}]', '', 'g')), lambda x: x <> '')"
    return f"""{islands("units_0", "speech", "session_id, person", 0.18)},
{texts},
units_1 AS (SELECT u.*, coalesce(w.text, '') AS text, coalesce(w.n_words, 0) AS n_words, {covered("speech", "u.start_s", "u.end_s", "<>")} / greatest(u.end_s - u.start_s, 1e-9) AS containment,
  {covered("speech", "u.end_s", "u.end_s + 1.0", "<>")} AS partner_after, {covered("speech", "u.end_s", "u.end_s + 1.0", "=")} AS own_after
  FROM units_0 u LEFT JOIN worded w USING (session_id, person, start_s)),
units_2 AS (SELECT *, {toks} AS toks FROM units_1),
ipus AS (SELECT * EXCLUDE (toks), end_s - start_s <= 1.2 AND containment >= 0.5 AND partner_after > 0.25 AND (n_words = 0 OR (len(toks) BETWEEN 1 AND 4
  AND (array_to_string(toks, '') IN ({known}) OR len(list_filter(toks, lambda x: x NOT IN ({known}))) = 0))) AS is_backchannel FROM units_2),
floor_1 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s, person) = 1 OR containment < 0.5 OR end_s - start_s >= 3.0 OR partner_after <= 0.15 OR own_after > partner_after AS strong FROM ipus WHERE NOT is_backchannel),
floor_2 AS (SELECT *, last_value(CASE WHEN strong THEN person END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start_s, person ROWS UNBOUNDED PRECEDING) AS holder FROM floor_1),
floor AS (SELECT *, strong OR person = holder AS accepted FROM floor_2),
run_1 AS (SELECT *, CASE WHEN lag(person) OVER o IS DISTINCT FROM person OR start_s - lag(end_s) OVER o > 10.0 THEN 1 ELSE 0 END AS fresh FROM floor WHERE accepted WINDOW o AS (PARTITION BY session_id ORDER BY start_s, person)),
run_2 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start_s, person ROWS UNBOUNDED PRECEDING) AS run FROM run_1),
run_3 AS (SELECT session_id, person, run, min(start_s) AS start_s, max(end_s) AS end_s, list({{'s': start_s, 'e': end_s, 't': text, 'n': n_words}} ORDER BY start_s) AS parts FROM run_2 GROUP BY session_id, person, run),
run_4 AS (SELECT *, CASE WHEN lag(person) OVER o IS DISTINCT FROM person OR start_s - lag(end_s) OVER o > 10.0 THEN 1 ELSE 0 END AS fresh FROM run_3 WHERE end_s - start_s >= 0.2 WINDOW o AS (PARTITION BY session_id ORDER BY start_s, person)),
run_5 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start_s, person ROWS UNBOUNDED PRECEDING) AS joined FROM run_4),
run_6 AS (SELECT session_id, person, joined, min(start_s) AS start_s, max(end_s) AS end_s, flatten(list(parts ORDER BY start_s)) AS parts FROM run_5 GROUP BY session_id, person, joined),
turns AS (SELECT session_id, row_number() OVER o - 1 AS turn_index, person, start_s, end_s, parts, array_to_string(list_filter(list_transform(parts, lambda x: x.t), lambda x: x <> ''), ' ') AS text,
  list_sum(list_transform(parts, lambda x: x.n)) AS n_words, list_sum(list_transform(parts, lambda x: x.e - x.s)) AS speech_s,
  CASE WHEN abs(start_s - lag(end_s) OVER o) <= 10.0 THEN start_s - lag(end_s) OVER o END AS fto, lag(person) OVER o AS prev_person, coalesce(start_s - lag(end_s) OVER o < 0, false) AS is_overlap_onset
  FROM run_6 WINDOW o AS (PARTITION BY session_id ORDER BY start_s, person)),
non_floor AS (SELECT * FROM floor WHERE NOT accepted),
after_1 AS (SELECT t.session_id, t.start_s AS time_s, t.person AS interrupter, p.person AS person, p.turn_index, p.end_s - t.start_s AS overlap FROM turns t JOIN turns p ON p.session_id = t.session_id AND p.turn_index = t.turn_index - 1 AND p.person <> t.person AND p.end_s - t.start_s >= 0.1),
taken AS (SELECT u.session_id, time_s, interrupter, person AS interrupted, turn_index, {covered("speech", "u.time_s + 1.0", "u.time_s + 2.0", "=")} <= 0.3 AS successful, overlap AS overlap_duration, overlap AS remaining_after, CASE WHEN overlap <= 1.0 THEN 'transition_overlap' ELSE 'interruption' END AS kind FROM after_1 u),
failed AS (SELECT n.session_id, n.start_s AS time_s, n.person AS interrupter, CASE n.person WHEN 'A' THEN 'B' ELSE 'A' END AS interrupted, max(t.turn_index) AS turn_index, false AS successful, n.containment * (n.end_s - n.start_s) AS overlap_duration, arg_max(t.end_s, t.turn_index) - n.start_s AS remaining_after, 'interruption' AS kind
  FROM non_floor n JOIN turns t ON t.session_id = n.session_id AND t.person <> n.person AND t.start_s <= n.start_s AND n.start_s <= t.end_s
  WHERE n.containment * (n.end_s - n.start_s) >= 0.1 GROUP BY n.session_id, n.start_s, n.person, n.containment, n.end_s HAVING arg_max(t.end_s, t.turn_index) - n.start_s > 1.0),
interruptions AS (SELECT * FROM taken UNION ALL SELECT * FROM failed)"""


def minus(name: str, a: str, b: str, keys: str) -> str:
    """Pieces of a outside b: each starts at a's start or at an end of b, and runs to the next start of b."""
    on = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}_p AS (SELECT {keys}, start_s AS s, end_s AS a_end FROM {a} UNION SELECT {cols}, b.end_s, a.end_s FROM {a} a JOIN {b} b ON {on} AND b.end_s > a.start_s AND b.end_s < a.end_s),
{name} AS (SELECT {keys}, s AS start_s, least(a_end, coalesce((SELECT min(b.start_s) FROM {b} b WHERE {on.replace("a.", "x.")} AND b.start_s >= x.s), a_end)) AS end_s FROM {name}_p x
  WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE {on.replace("a.", "x.")} AND b.start_s <= x.s AND x.s < b.end_s))"""


BOTH = """both_ AS (SELECT a.session_id, greatest(a.start_s, b.start_s) AS start_s, least(a.end_s, b.end_s) AS end_s FROM speech a JOIN speech b ON a.session_id = b.session_id AND a.person = 'A' AND b.person = 'B' AND a.start_s < b.end_s AND b.start_s < a.end_s)"""
SILENCE = f"""{islands("any_speech", "speech", "session_id")},
whole AS (SELECT session_id, CAST(0 AS DOUBLE) AS start_s, duration_s AS end_s FROM sess),
{minus("silence", "whole", "any_speech", "session_id")}"""
LISTENING = f"""held_0 AS (SELECT session_id, CASE person WHEN 'A' THEN 'B' ELSE 'A' END AS person, start_s, end_s FROM turns),
{islands("held", "held_0", "session_id, person")},
{minus("listening", "held", "speech", "session_id, person")},
listen_f AS (SELECT session_id, person, sum(end_s - start_s) AS listen FROM listening WHERE end_s > start_s GROUP BY ALL)"""
TURN_FACTS = """turn_f AS (SELECT t.session_id, t.person, count(*) AS n_turns, avg(end_s - start_s) AS turn_mean, stddev_pop(end_s - start_s) AS turn_sd, median(end_s - start_s) AS turn_median,
  count(fto) FILTER (WHERE prev_person <> person) AS n_r, median(fto) FILTER (WHERE prev_person <> person) AS r_median,
  quantile_cont(fto, 0.75) FILTER (WHERE prev_person <> person) - quantile_cont(fto, 0.25) FILTER (WHERE prev_person <> person) AS r_iqr,
  avg(CAST(fto <= 0.2 AS INT)) FILTER (WHERE prev_person <> person AND fto IS NOT NULL) AS r_fast, sum(len(parts) - 1) AS n_pauses,
  count(*) FILTER (WHERE is_overlap_onset AND prev_person <> person) AS n_onset, avg(n_words) AS turn_words,
  CASE WHEN count(fto) FILTER (WHERE prev_person <> person AND b = 2) >= 3 AND count(fto) FILTER (WHERE prev_person <> person AND b = 0) >= 3 THEN median(fto) FILTER (WHERE prev_person <> person AND b = 2) - median(fto) FILTER (WHERE prev_person <> person AND b = 0) END AS r_trend,
  CASE WHEN count(*) FILTER (WHERE b = 2) >= 3 AND count(*) FILTER (WHERE b = 0) >= 3 THEN avg(end_s - start_s) FILTER (WHERE b = 2) - avg(end_s - start_s) FILTER (WHERE b = 0) END AS d_trend
  FROM (SELECT turns.*, CASE WHEN start_s < duration_s * 1 / 3 THEN 0 WHEN start_s < duration_s * 2 / 3 THEN 1 WHEN start_s < duration_s THEN 2 END AS b FROM turns JOIN sess USING (session_id)) t GROUP BY ALL),
talk_f AS (SELECT session_id, person, sum(end_s - start_s) AS talk FROM speech GROUP BY ALL),
opener_f AS (SELECT session_id, arg_min(person, turn_index) AS opener FROM turns GROUP BY ALL)"""
INTERRUPTION_FACTS = """made_f AS (SELECT session_id, interrupter AS person, count(*) FILTER (WHERE kind = 'interruption') AS n_made, count(*) FILTER (WHERE kind <> 'interruption') AS n_transition, avg(CAST(successful AS INT)) FILTER (WHERE kind = 'interruption') AS made_success FROM interruptions GROUP BY ALL),
got_f AS (SELECT session_id, interrupted AS person, count(*) AS n_got, avg(CAST(NOT successful AS INT)) AS held FROM interruptions WHERE kind = 'interruption' GROUP BY ALL)"""
BACKCHANNEL_FACTS = """bc AS (SELECT session_id, person, start_s, end_s FROM ipus WHERE is_backchannel),
bc_f AS (SELECT session_id, person, count(*) AS n_bc, count(*) FILTER (WHERE start_s >= duration_s * 2 / 3 AND start_s < duration_s) AS bc_last, count(*) FILTER (WHERE start_s < duration_s / 3) AS bc_first FROM bc JOIN sess USING (session_id) GROUP BY session_id, person),
cover_f AS (SELECT t.session_id, CASE t.person WHEN 'A' THEN 'B' ELSE 'A' END AS person, avg(CAST(EXISTS (SELECT 1 FROM bc WHERE bc.session_id = t.session_id AND bc.person <> t.person AND bc.start_s >= t.start_s AND bc.start_s < t.end_s) AS INT)) AS bc_coverage FROM turns t WHERE t.end_s - t.start_s >= 3.0 GROUP BY ALL),
place_f AS (SELECT session_id, person, avg(place) AS bc_place FROM (SELECT b.session_id, b.person, b.start_s, arg_min((b.start_s - t.start_s) / (t.end_s - t.start_s), t.turn_index) AS place FROM bc b JOIN turns t ON t.session_id = b.session_id AND t.person <> b.person AND b.start_s >= t.start_s AND b.start_s < t.end_s AND t.end_s - t.start_s > 0.5 GROUP BY ALL) GROUP BY ALL),
quiet AS (SELECT session_id, person, lag(end_s) OVER (PARTITION BY session_id, person ORDER BY start_s) AS at0, start_s AS at1 FROM speech),
late_f AS (SELECT session_id, person, median(d) AS bc_latency FROM (SELECT b.session_id, b.person, b.start_s - max(q.at0) AS d FROM bc b JOIN quiet q ON q.session_id = b.session_id AND q.person <> b.person AND q.at1 - q.at0 >= 0.05 AND q.at0 <= b.start_s GROUP BY b.session_id, b.person, b.start_s) WHERE d BETWEEN 0 AND 2 GROUP BY ALL)"""


def permin(n: str, seconds: str) -> str:
    return f"({n}) / greatest(({seconds}) / 60, 1e-9)"


def balanced(x: str) -> str:
    return f"CASE WHEN a_{x} + b_{x} > 0 THEN 1 - abs(a_{x} - b_{x}) / (a_{x} + b_{x}) END"


def long_form(ctes: list[str], person_table: str, columns: list[str], person: dict[str, str], dyad_table: str, dyad: dict[str, str]) -> str:
    """Unpivoted measures with reasons. person_table and dyad_table follow FROM; the pair of persons' columns is joined to the latter as a_ and b_."""
    pair = "pair AS (SELECT session_id" + "".join(f", max({x}) FILTER (WHERE person = '{p}') AS {p.lower()}_{x}" for p in "AB" for x in columns) + " FROM people GROUP BY session_id)"
    rows = [f"SELECT session_id, person, '{i}' AS measure, CAST({e} AS DOUBLE) AS value, overlap_ok FROM people" for i, e in person.items()]
    rows += [f"SELECT session_id, 'dyad' AS person, '{i}' AS measure, CAST({e} AS DOUBLE) AS value, overlap_ok FROM {dyad_table}" for i, e in dyad.items()]
    gated = ", ".join(f"'{i}'" for i in [*person, *dyad] if "overlap_evidence" in SPECS[i].requires) or "''"
    return f"""WITH {', '.join(ctes)},
people AS (SELECT * FROM {person_table}),
{pair},
vals AS ({' UNION ALL '.join(rows)}),
gate AS (SELECT session_id, person, measure, NOT overlap_ok AND measure IN ({gated}) AS shut, CASE WHEN isfinite(value) THEN value END AS value FROM vals)
SELECT session_id, person, measure, round(CASE WHEN NOT shut THEN value END, 9) AS value,
       CASE WHEN shut THEN 'requires overlap_evidence' WHEN value IS NULL THEN 'value is not finite' END AS unavailable_reason FROM gate"""


TURN_TAKING = long_form(
    [EVENTS, turn_set(), BOTH, SILENCE, LISTENING, TURN_FACTS,
     "both_f AS (SELECT session_id, sum(end_s - start_s) AS overlap FROM both_ GROUP BY ALL)",
     "silence_f AS (SELECT session_id, sum(end_s - start_s) AS silent, count(*) FILTER (WHERE end_s - start_s >= 0.5) AS n_silences, avg(end_s - start_s) FILTER (WHERE end_s - start_s >= 0.5) AS silence_mean, max(end_s - start_s) AS silence_max FROM silence WHERE end_s > start_s GROUP BY ALL)"],
    "spine LEFT JOIN turn_f USING (session_id, person) LEFT JOIN talk_f USING (session_id, person) LEFT JOIN listen_f USING (session_id, person) LEFT JOIN opener_f USING (session_id) LEFT JOIN (SELECT session_id, CASE person WHEN 'A' THEN 'B' ELSE 'A' END AS person, talk AS partner_talk FROM talk_f) USING (session_id, person)",
    ["r_median", "n_r", "talk"],
    {
        "response_latency_median": "r_median", "response_latency_iqr": "CASE WHEN n_r >= 4 THEN r_iqr END", "fast_response_proportion": "r_fast",
        "talk_time_share": "CASE WHEN coalesce(talk, 0) + coalesce(partner_talk, 0) > 0 THEN coalesce(talk, 0) / (coalesce(talk, 0) + coalesce(partner_talk, 0)) END",
        "turn_count": "coalesce(n_turns, 0)", "turn_rate": permin("coalesce(n_turns, 0)", "duration_s"), "mean_turn_duration": "turn_mean",
        "turn_duration_variability": "CASE WHEN n_turns >= 3 AND turn_mean > 0 THEN turn_sd / turn_mean END", "within_turn_pause_rate": f"CASE WHEN talk > 0 THEN {permin('coalesce(n_pauses, 0)', 'talk')} END",
        "turn_transition_overlap_rate": permin("coalesce(n_onset, 0)", "duration_s"), "spoke_first": "CASE WHEN opener IS NOT NULL THEN CAST(opener = person AS INT) END",
        "speaking_time": "coalesce(talk, 0)", "silent_time": "greatest(duration_s - coalesce(talk, 0), 0)", "listening_time": "coalesce(listen, 0)", "median_turn_duration": "turn_median",
    },
    "sess LEFT JOIN pair USING (session_id) LEFT JOIN both_f USING (session_id) LEFT JOIN silence_f USING (session_id)",
    {
        "response_latency_asymmetry": "CASE WHEN a_n_r >= 3 AND b_n_r >= 3 THEN a_r_median - b_r_median END",
        "talk_time_balance": "CASE WHEN coalesce(a_talk, 0) + coalesce(b_talk, 0) > 0 THEN 1 - abs(coalesce(a_talk, 0) - coalesce(b_talk, 0)) / (coalesce(a_talk, 0) + coalesce(b_talk, 0)) END",
        "silence_proportion": "coalesce(silent, 0) / duration_s", "silence_rate": permin("coalesce(n_silences, 0)", "duration_s"), "mean_silence_duration": "silence_mean", "longest_silence": "silence_max",
        "overlap_proportion": "coalesce(overlap, 0) / duration_s",
    },
)

INTERRUPTION = long_form(
    [EVENTS, turn_set(), BOTH, INTERRUPTION_FACTS, "both_f AS (SELECT session_id, avg(end_s - start_s) FILTER (WHERE end_s - start_s >= 0.1) AS overlap_mean FROM both_ GROUP BY ALL)"],
    "spine LEFT JOIN made_f USING (session_id, person) LEFT JOIN got_f USING (session_id, person)",
    ["n_made"],
    {
        "interruption_rate": permin("coalesce(n_made, 0)", "duration_s"), "transition_overlap_rate": permin("coalesce(n_transition, 0)", "duration_s"), "interruption_success_rate": "made_success",
        "interrupted_rate": permin("coalesce(n_got, 0)", "duration_s"), "floor_hold_rate": "held",
    },
    "sess LEFT JOIN pair USING (session_id) LEFT JOIN both_f USING (session_id)",
    {"interruption_asymmetry": f"{permin('coalesce(a_n_made, 0)', 'duration_s')} - {permin('coalesce(b_n_made, 0)', 'duration_s')}", "mean_overlap_duration": "overlap_mean"},
)

BACKCHANNEL = long_form(
    [EVENTS, turn_set(), BACKCHANNEL_FACTS, "talk_f AS (SELECT session_id, CASE person WHEN 'A' THEN 'B' ELSE 'A' END AS person, sum(end_s - start_s) AS partner_talk FROM speech GROUP BY ALL)"],
    "spine LEFT JOIN bc_f USING (session_id, person) LEFT JOIN cover_f USING (session_id, person) LEFT JOIN place_f USING (session_id, person) LEFT JOIN late_f USING (session_id, person) LEFT JOIN talk_f USING (session_id, person)",
    ["n_bc"],
    {
        "backchannel_rate": f"CASE WHEN partner_talk > 1 THEN {permin('coalesce(n_bc, 0)', 'partner_talk')} END", "backchannel_count": "coalesce(n_bc, 0)", "backchannel_coverage": "bc_coverage",
        "backchannel_relative_position": "bc_place", "backchannel_latency": "bc_latency",
    },
    "sess LEFT JOIN pair USING (session_id)",
    {"backchannel_reciprocity": "CASE WHEN coalesce(a_n_bc, 0) + coalesce(b_n_bc, 0) > 0 THEN 1 - abs(coalesce(a_n_bc, 0) - coalesce(b_n_bc, 0)) / (coalesce(a_n_bc, 0) + coalesce(b_n_bc, 0)) END"},
)


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + ")"


TOKENS = "list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z'']+'), lambda x: replace(x, '''', '')), lambda x: x <> '')"


def n_in(toks: str, words) -> str:
    return f"len(list_filter({toks}, lambda x: x IN {in_list(words)}))"


def n_phrases(toks: str, phrases) -> str:
    parts = []
    for n in sorted({len(p.split()) for p in phrases}):
        group = in_list([p for p in phrases if len(p.split()) == n])
        parts.append(n_in(toks, [p for p in phrases if len(p.split()) == n]) if n == 1 else f"len(list_filter(range(1, len({toks}) - {n - 1} + 1), lambda i: array_to_string({toks}[i:i + {n - 1}], ' ') IN {group}))")
    return " + ".join(parts)


QUESTION = f"""CASE WHEN regexp_matches(text, '{lexicon.TAG_QUESTION.replace("'", "''")}') THEN 'tag' WHEN t[1] IN {in_list(lexicon.WH_WORDS)} THEN 'wh' WHEN t[1] IN {in_list(lexicon.YES_NO_OPENERS)} THEN 'yes_no'
  WHEN len(t) > 0 AND ends_with(rtrim(text), '?') THEN 'declarative' END"""
TTR = "CASE WHEN len(t) = 0 THEN NULL WHEN len(t) < 100 THEN len(list_distinct(t)) / len(t) ELSE list_avg(list_transform(range(0, len(t) // 100), lambda k: len(list_distinct(t[k * 100 + 1:k * 100 + 100])) / 100)) END"
_SIMPLE = {"filler": lexicon.FILLERS, "fps": lexicon.FIRST_PERSON_SINGULAR, "second": lexicon.SECOND_PERSON, "fpp": lexicon.FIRST_PERSON_PLURAL, "emotion": lexicon.EMOTION_WORDS, "positive": lexicon.POSITIVE} | {f"lsm_{k}": v for k, v in lexicon.LSM_CATEGORIES.items()}
_STYLE = " + ".join(f"CASE WHEN a_k_lsm_{k} / a_n_tokens + b_k_lsm_{k} / b_n_tokens > 0 THEN 1 - abs(a_k_lsm_{k} / a_n_tokens - b_k_lsm_{k} / b_n_tokens) / (a_k_lsm_{k} / a_n_tokens + b_k_lsm_{k} / b_n_tokens) ELSE 1 END" for k in lexicon.LSM_CATEGORIES)
_RATE = lambda k: f"CASE WHEN n_tokens > 0 THEN 100.0::DOUBLE * k_{k} / n_tokens END"
_POLITE = " + ".join(n_phrases("t", p) for p in (lexicon.GRATITUDE, lexicon.APOLOGY, lexicon.PLEASE))

LEXICAL = long_form(
    [CONVERSATIONS, turn_set(True),
     "word_0 AS (SELECT session_id, person, count(*) AS n_words, string_agg(text, ' ' ORDER BY start_s, text) AS text FROM words GROUP BY ALL)",
     f"word_1 AS (SELECT *, {TOKENS.format('text')} AS t FROM word_0)",
     f"word_f AS (SELECT session_id, person, n_words, len(t) AS n_tokens, {TTR} AS ttr, {', '.join(f'{n_in("t", v)} AS k_{k}' for k, v in _SIMPLE.items())}, {n_phrases('t', lexicon.DISCOURSE_MARKERS)} AS k_marker, {n_phrases('t', lexicon.HEDGES)} AS k_hedge, {_POLITE} AS k_polite FROM word_1)",
     f"asked_0 AS (SELECT session_id, person, turn_index, text, {TOKENS.format('text')} AS t FROM turns WHERE trim(text) <> '')",
     f"asked_1 AS (SELECT *, {QUESTION} AS q FROM asked_0)",
     "asked_2 AS (SELECT session_id, person, count(*) FILTER (WHERE q IN ('wh', 'yes_no', 'tag')) AS n_questions, count(*) FILTER (WHERE q = 'wh') AS n_open, flatten(list(t ORDER BY turn_index)) AS t FROM asked_1 GROUP BY ALL)",
     f"asked_f AS (SELECT session_id, person, n_questions, n_open, len(t) AS turn_tokens, {n_phrases('t', lexicon.AGREEMENT)} AS k_agree FROM asked_2)",
     "talk_f AS (SELECT session_id, person, sum(end_s - start_s) AS talk FROM speech GROUP BY ALL)", "wpt_f AS (SELECT session_id, person, avg(n_words) AS turn_words FROM turns GROUP BY ALL)"],
    "spine LEFT JOIN word_f USING (session_id, person) LEFT JOIN asked_f USING (session_id, person) LEFT JOIN talk_f USING (session_id, person) LEFT JOIN wpt_f USING (session_id, person)",
    ["n_questions", "n_tokens", *(f"k_lsm_{k}" for k in lexicon.LSM_CATEGORIES)],
    {
        "word_count": "coalesce(n_words, 0)", "speech_rate_wpm": f"CASE WHEN talk > 1 THEN {permin('coalesce(n_words, 0)', 'talk')} END", "words_per_turn": "turn_words", "lexical_diversity": "ttr",
        "question_rate": permin("coalesce(n_questions, 0)", "duration_s"), "open_question_ratio": "CASE WHEN n_questions > 0 THEN n_open / n_questions END", "filler_rate": _RATE("filler"),
        "discourse_marker_rate": _RATE("marker"), "hedge_rate": _RATE("hedge"), "first_person_singular_rate": _RATE("fps"), "second_person_rate": _RATE("second"), "first_person_plural_rate": _RATE("fpp"),
        "emotion_word_rate": _RATE("emotion"), "positive_word_rate": _RATE("positive"), "politeness_marker_rate": _RATE("polite"), "agreement_rate": "CASE WHEN turn_tokens > 0 THEN 100.0::DOUBLE * k_agree / turn_tokens END",
    },
    "sess LEFT JOIN pair USING (session_id)",
    {
        "question_reciprocity": "CASE WHEN coalesce(a_n_questions, 0) + coalesce(b_n_questions, 0) > 0 THEN 1 - abs(coalesce(a_n_questions, 0) - coalesce(b_n_questions, 0)) / (coalesce(a_n_questions, 0) + coalesce(b_n_questions, 0)) END",
        "linguistic_style_matching": f"CASE WHEN a_n_tokens >= 50 AND b_n_tokens >= 50 THEN ({_STYLE}) / 9 END",
    },
)


def noise(a: int, b: int, d: int, m: int) -> str:
    return f"((i * {a} + num * {b} + CASE person WHEN 'A' THEN 0 ELSE {d} END) % {m})"


FRAMES = f"""frames AS (SELECT session_id, person, i, CASE WHEN num % 5 = 0 AND person = 'B' THEN {noise(7, 3, 1, 2)} <> 0 ELSE {noise(7, 3, 1, 10)} <> 0 END AS tracked, {noise(11, 5, 2, 3)} <> 0 AS on_partner,
  {noise(13, 17, 5, 50)} / 100.0::DOUBLE AS duchenne, CASE WHEN {noise(3, 1, 7, 11)} <> 0 THEN {noise(29, 31, 37, 60)} / 100.0::DOUBLE END AS brow_raise, CASE WHEN {noise(5, 1, 3, 13)} <> 0 THEN ({noise(997, 89, 41, 201)} - 100) / 100.0::DOUBLE END AS valence0,
  {noise(31, 7, 11, 97)} / 1000.0::DOUBLE AS expressivity, CASE WHEN {noise(3, 2, 1, 4)} <> 0 THEN 100.0::DOUBLE + {noise(17, 19, 23, 150)} END AS f0_hz, 50.0::DOUBLE + {noise(71, 73, 79, 30)} AS intensity_db, {noise(101, 103, 107, 4)} = 0 AS self_touch
  FROM spine, range(0, 1801) r(i)),
fr AS (SELECT *, CASE WHEN tracked THEN valence0 END AS valence FROM frames)"""


def frames_of(name: str, spans: str, outer: bool) -> str:
    lo = "floor(x.start_s)" if outer else "ceil(x.start_s)"
    return f"""{name}_i AS (SELECT DISTINCT f.session_id, f.person, f.i FROM {spans} x JOIN fr f ON f.session_id = x.session_id AND f.person = x.person AND f.i >= {lo} AND f.i < ceil(x.end_s)),
{name}_f AS (SELECT session_id, person, count(*) FILTER (WHERE tracked) AS {name}_n, avg(CAST(on_partner AS INT)) FILTER (WHERE tracked) AS {name}_gaze, count(valence) AS {name}_nv, avg(valence) AS {name}_valence FROM fr JOIN {name}_i USING (session_id, person, i) GROUP BY ALL)"""


def kind_f(kind: str, short: str) -> str:
    return f"{short}_f AS (SELECT session_id, person, count(*) AS {short}_n, sum(end_s - start_s) AS {short}_s, avg(end_s - start_s) AS {short}_mean FROM spans WHERE kind = '{kind}' GROUP BY ALL)"


def trend_f(kind: str, short: str) -> str:
    cover = lambda k: f"sum(greatest(0, least(end_s, duration_s * {k + 1} / 3) - greatest(start_s, duration_s * {k} / 3)) / (duration_s * {k + 1} / 3 - duration_s * {k} / 3))"
    return f"{short}_t AS (SELECT session_id, person, {cover(2)} - {cover(0)} AS {short}_cover, count(*) FILTER (WHERE start_s >= duration_s * 2 / 3 AND start_s < duration_s) AS {short}_last, count(*) FILTER (WHERE start_s < duration_s / 3) AS {short}_first FROM spans JOIN sess USING (session_id) WHERE kind = '{kind}' GROUP BY session_id, person)"


def runs_f(name: str, mask: str, keys: str, gap: float, least: float) -> str:
    on = "session_id, person" if "person" in keys else "session_id"
    return f"""{name}_m AS ({mask}),
{name}_r AS (SELECT {keys}, CAST(min(i) AS DOUBLE) AS start_s, CAST(max(i) + 1 AS DOUBLE) AS end_s FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS run FROM {name}_m) GROUP BY {keys}, run),
{islands(f"{name}_g", f"{name}_r", keys, gap)},
{name}_f AS (SELECT {on}, count(*) AS n_{name} FROM {name}_g WHERE end_s - start_s >= {least} GROUP BY ALL)"""


_OK, _BOTH_OK = "CASE WHEN coverage >= 0.6 THEN {0} END", "CASE WHEN a_coverage >= 0.6 AND b_coverage >= 0.6 THEN {0} END"
ok, both_ok = _OK.format, _BOTH_OK.format
_JOIN = lambda *names: " ".join(f"LEFT JOIN {n} USING (session_id, person)" for n in names)

FACE = long_form(
    [EVENTS, KINDS, turn_set(), LISTENING, FRAMES, frames_of("lis", "listening", False), frames_of("vlis", "listening", True), islands("own_turns", "(SELECT session_id, person, start_s, end_s FROM turns)", "session_id, person"), frames_of("spk", "own_turns", False), frames_of("vspk", "speech", True),
     *(kind_f(*x) for x in (("nod", "nod"), ("head_shake", "shake"), ("smile", "smile"), ("posture_shift", "shift"))), trend_f("smile", "smile"),
     "face_f AS (SELECT session_id, person, count(*) FILTER (WHERE tracked) AS n_tracked, avg(CAST(tracked AS INT)) AS coverage, avg(CAST(on_partner AS INT)) FILTER (WHERE tracked) AS gaze, count(*) FILTER (WHERE tracked AND on_partner) AS n_on, avg(expressivity) AS expressive, count(valence) AS n_valence, avg(valence) AS v_mean, stddev_pop(valence) AS v_sd, avg(CAST(self_touch AS INT)) FILTER (WHERE tracked) AS touch FROM fr GROUP BY ALL)",
     "cut AS (SELECT session_id, quantile_cont(valence, 0.25) AS q1, quantile_cont(valence, 0.75) AS q3 FROM fr WHERE valence IS NOT NULL GROUP BY ALL HAVING count(*) >= 100)",
     "share_f AS (SELECT session_id, person, avg(CAST(valence > q3 AS INT)) AS pos_share, avg(CAST(valence < q1 AS INT)) AS neg_share FROM fr JOIN cut USING (session_id) WHERE valence IS NOT NULL GROUP BY ALL)",
     "mutual_f AS (SELECT a.session_id, count(*) FILTER (WHERE a.tracked AND b.tracked) AS n_both, avg(CAST(a.on_partner AND b.on_partner AS INT)) FILTER (WHERE a.tracked AND b.tracked) AS mutual FROM fr a JOIN fr b ON a.session_id = b.session_id AND a.i = b.i AND a.person = 'A' AND b.person = 'B' GROUP BY ALL)",
     runs_f("episodes", "SELECT a.session_id, a.i FROM fr a JOIN fr b ON a.session_id = b.session_id AND a.i = b.i AND a.person = 'A' AND b.person = 'B' WHERE a.on_partner AND b.on_partner AND a.tracked AND b.tracked", "session_id", 0.15, 0.3),
     runs_f("brows", "SELECT session_id, person, i FROM fr WHERE brow_raise >= 0.35", "session_id, person", 0.15, 0.1),
     runs_f("looks", "SELECT session_id, person, i FROM fr WHERE on_partner AND tracked", "session_id, person", 0.0, 0.0),
     "look_t AS (SELECT session_id, person, sum(greatest(0, least(end_s, duration_s) - greatest(start_s, duration_s * 2 / 3)) / (duration_s - duration_s * 2 / 3)) - sum(greatest(0, least(end_s, duration_s / 3) - start_s) / (duration_s / 3)) AS look_cover FROM looks_g JOIN sess USING (session_id) GROUP BY session_id, person)",
     "peaks AS (SELECT s.session_id, s.person, s.start_s, max(f.duchenne) AS d FROM spans s JOIN fr f ON f.session_id = s.session_id AND f.person = s.person AND f.i >= floor(s.start_s) AND f.i < floor(s.end_s) WHERE s.kind = 'smile' GROUP BY ALL)",
     "duch_f AS (SELECT session_id, person, avg(CAST(d >= 0.18 AS INT)) AS duch FROM peaks GROUP BY ALL)",
     "heard_f AS (SELECT n.session_id, n.person, count(*) AS nods_heard FROM spans n WHERE n.kind = 'nod' AND EXISTS (SELECT 1 FROM listening l WHERE l.session_id = n.session_id AND l.person = n.person AND l.start_s <= (n.start_s + n.end_s) * 0.5 AND (n.start_s + n.end_s) * 0.5 < l.end_s) GROUP BY ALL)",
     "gest_f AS (SELECT n.session_id, n.person, count(*) AS gest_own FROM spans n WHERE n.kind = 'gesture' AND EXISTS (SELECT 1 FROM speech l WHERE l.session_id = n.session_id AND l.person = n.person AND l.start_s <= (n.start_s + n.end_s) * 0.5 AND (n.start_s + n.end_s) * 0.5 < l.end_s) GROUP BY ALL)",
     "talk_f AS (SELECT session_id, person, sum(end_s - start_s) AS talk FROM speech GROUP BY ALL)",
     "shared_f AS (SELECT a.session_id, sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS smile_both FROM spans a JOIN spans b ON a.session_id = b.session_id AND a.person = 'A' AND b.person = 'B' AND a.kind = 'smile' AND b.kind = 'smile' AND a.start_s < b.end_s AND b.start_s < a.end_s GROUP BY ALL)"],
    "spine " + _JOIN("face_f", "lis_f", "vlis_f", "spk_f", "vspk_f", "nod_f", "shake_f", "smile_f", "shift_f", "smile_t", "look_t", "share_f", "brows_f", "duch_f", "heard_f", "gest_f", "talk_f", "listen_f"),
    ["coverage"],
    {
        "gaze_partner_proportion": ok("CASE WHEN n_tracked >= 10 THEN gaze END"), "gaze_while_listening": ok("CASE WHEN lis_n >= 10 THEN lis_gaze END"), "gaze_while_speaking": ok("CASE WHEN spk_n >= 10 THEN spk_gaze END"),
        "gaze_speaker_listener_gap": ok("CASE WHEN lis_n >= 10 AND spk_n >= 10 THEN lis_gaze - spk_gaze END"), "gaze_partner_time": "n_on",
        "nod_rate_while_listening": ok(f"CASE WHEN listen >= 5 THEN {permin('coalesce(nods_heard, 0)', 'listen')} END"), "nod_rate": ok(permin("coalesce(nod_n, 0)", "duration_s")), "head_shake_rate": ok(permin("coalesce(shake_n, 0)", "duration_s")),
        "nod_count": "coalesce(nod_n, 0)", "nod_total_duration": "coalesce(nod_s, 0)", "nod_mean_duration": "nod_mean", "smile_proportion": ok("CASE WHEN n_tracked > 5 THEN coalesce(smile_s, 0) / n_tracked END"),
        "duchenne_smile_ratio": ok("duch"), "facial_expressivity": ok("expressive"), "brow_raise_rate": ok(permin("coalesce(n_brows, 0)", "duration_s")), "smile_count": "coalesce(smile_n, 0)",
        "smile_total_duration": "coalesce(smile_s, 0)", "smile_mean_duration": "smile_mean", "gesture_rate": ok(f"CASE WHEN talk >= 5 THEN {permin('coalesce(gest_own, 0)', 'talk')} END"), "posture_shift_rate": ok(permin("coalesce(shift_n, 0)", "duration_s")),
        "self_touch_proportion": ok("touch"), "facial_valence_mean": "v_mean", "facial_valence_variability": "v_sd", "valence_while_listening": "CASE WHEN vlis_nv >= 25 THEN vlis_valence END",
        "valence_while_speaking": "CASE WHEN vspk_nv >= 25 THEN vspk_valence END", "positive_affect_proportion": "pos_share", "negative_affect_proportion": "neg_share", "gaze_trend": ok("coalesce(look_cover, 0)"), "smile_trend": ok("coalesce(smile_cover, 0)"),
    },
    "sess LEFT JOIN pair USING (session_id) LEFT JOIN mutual_f USING (session_id) LEFT JOIN episodes_f USING (session_id) LEFT JOIN shared_f USING (session_id)",
    {"mutual_gaze_proportion": both_ok("CASE WHEN n_both >= 50 THEN mutual END"), "mutual_gaze_episode_rate": both_ok(permin("coalesce(n_episodes, 0)", "duration_s")), "shared_smile_proportion": both_ok("coalesce(smile_both, 0) / duration_s")},
)

DYNAMICS = long_form(
    [EVENTS, KINDS, turn_set(), SILENCE, TURN_FACTS, BACKCHANNEL_FACTS, kind_f("laughter", "laugh"), kind_f("filled_pause", "hes"), trend_f("laughter", "laugh"),
     "hush_f AS (SELECT session_id, sum(greatest(0, least(end_s, duration_s) - greatest(start_s, duration_s * 2 / 3)) / (duration_s - duration_s * 2 / 3)) - sum(greatest(0, least(end_s, duration_s / 3) - start_s) / (duration_s / 3)) AS hush FROM silence JOIN sess USING (session_id) WHERE end_s > start_s GROUP BY session_id)",
     "near_f AS (SELECT a.session_id, count(*) AS n_shared FROM spans a WHERE a.kind = 'laughter' AND a.person = 'A' AND EXISTS (SELECT 1 FROM spans b WHERE b.session_id = a.session_id AND b.kind = 'laughter' AND b.person = 'B' AND abs(a.start_s - b.start_s) <= 1.5) GROUP BY ALL)"],
    "spine " + _JOIN("turn_f", "talk_f", "bc_f", "laugh_f", "hes_f", "laugh_t"),
    ["laugh_n"],
    {
        "response_latency_trend": "r_trend", "turn_duration_trend": "d_trend", "backchannel_rate_trend": permin("coalesce(bc_last, 0) - coalesce(bc_first, 0)", "duration_s / 3"),
        "laughter_trend": permin("coalesce(laugh_last, 0) - coalesce(laugh_first, 0)", "duration_s / 3"), "laughter_rate": permin("coalesce(laugh_n, 0)", "duration_s"), "laughter_proportion": "coalesce(laugh_s, 0) / duration_s",
        "hesitation_rate": f"CASE WHEN talk > 5 THEN {permin('coalesce(hes_n, 0)', 'talk')} END", "hesitation_duration_mean": "hes_mean",
    },
    "sess LEFT JOIN pair USING (session_id) LEFT JOIN hush_f USING (session_id) LEFT JOIN near_f USING (session_id)",
    {"silence_trend": "coalesce(hush, 0)", "shared_laughter_rate": permin("coalesce(n_shared, 0)", "duration_s"), "laughter_reciprocity": "CASE WHEN coalesce(a_laugh_n, 0) + coalesce(b_laugh_n, 0) > 0 THEN 1 - abs(coalesce(a_laugh_n, 0) - coalesce(b_laugh_n, 0)) / (coalesce(a_laugh_n, 0) + coalesce(b_laugh_n, 0)) END"},
)

_ST = "12 * log2(f0_hz)"
PROSODY = long_form(
    [EVENTS, turn_set(), FRAMES,
     f"voice_f AS (SELECT session_id, person, count(f0_hz) AS n_f0, median(f0_hz) AS f0, stddev_pop({_ST}) AS st_sd, quantile_cont({_ST}, 0.95) - quantile_cont({_ST}, 0.05) AS st_range, stddev_pop(intensity_db) AS db_sd FROM fr GROUP BY ALL)",
     f"slices AS (SELECT t.session_id, t.turn_index, t.person, count(f0_hz) AS n, avg({_ST}) AS st, avg(intensity_db) AS db FROM turns t JOIN fr f ON f.session_id = t.session_id AND f.person = t.person AND f.i >= floor(t.start_s) AND f.i < ceil(t.end_s) GROUP BY ALL)",
     *(f"{n}_z AS (SELECT session_id, person, turn_index, ({x} - avg({x}) OVER o) / stddev_pop({x}) OVER o AS z, stddev_pop({x}) OVER o AS sd FROM slices WHERE {w} WINDOW o AS (PARTITION BY session_id, person)), {n}_p AS (SELECT *, lag(z) OVER o AS z0, lag(person) OVER o AS p0, lag(turn_index) OVER o AS i0 FROM {n}_z WHERE sd > 1e-9 WINDOW o AS (PARTITION BY session_id ORDER BY turn_index)), {n}_f AS (SELECT session_id, CASE WHEN count(*) >= 8 AND stddev_pop(z) >= 1e-9 AND stddev_pop(z0) >= 1e-9 THEN corr(z0, z) END AS {n}_r FROM {n}_p WHERE p0 <> person AND turn_index = i0 + 1 GROUP BY ALL)" for n, x, w in (("pitch", "st", "n >= 10"), ("level", "db", "db IS NOT NULL"))),
     "raw_p AS (SELECT *, lag(st) OVER o AS st0, lag(person) OVER o AS p0, lag(turn_index) OVER o AS i0 FROM slices WHERE n >= 10 WINDOW o AS (PARTITION BY session_id ORDER BY turn_index))",
     "raw_f AS (SELECT session_id, CASE WHEN count(*) >= 8 AND stddev_pop(abs(st - st0)) >= 1e-9 THEN corr(turn_index, abs(st - st0)) END AS conv, CASE WHEN count(*) >= 8 THEN -avg(abs(st - st0)) END AS near_ FROM raw_p WHERE p0 <> person AND turn_index = i0 + 1 GROUP BY ALL)"],
    "spine LEFT JOIN voice_f USING (session_id, person)",
    ["n_f0"],
    {"f0_median": "CASE WHEN n_f0 >= 10 THEN f0 END", "pitch_variability": "CASE WHEN n_f0 >= 10 THEN st_sd END", "pitch_range": "CASE WHEN n_f0 >= 10 THEN st_range END", "intensity_variability": "db_sd", "voice_jitter": "(num % 17) / 1000.0::DOUBLE", "voice_shimmer": "(num % 13) / 100.0::DOUBLE"},
    "sess LEFT JOIN pair USING (session_id) LEFT JOIN pitch_f USING (session_id) LEFT JOIN level_f USING (session_id) LEFT JOIN raw_f USING (session_id)",
    {"pitch_entrainment_synchrony": "pitch_r", "intensity_entrainment_synchrony": "level_r", "pitch_entrainment_convergence": "conv", "pitch_proximity": "near_"},
)

SEMANTIC = f"""dim AS (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL),
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS FLOAT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
usable AS (SELECT t.session_id, row_number() OVER (PARTITION BY t.session_id ORDER BY t.turn_index) - 1 AS pos, t.turn_index, t.person, t.start_s, t.end_s, t.text, list_transform(e.v, lambda x: CAST(x AS DOUBLE)) AS v
  FROM turns t, dim JOIN vecs e ON e.vec_id = (CAST(regexp_extract(t.session_id, '([0-9]+)', 1) AS BIGINT) * 8 + t.turn_index) % dim.n WHERE len({TOKENS.format("t.text")}) >= 4)"""
STOP = in_list(lexicon.stopwords())
CONTENT = f"""kept AS (SELECT session_id, pos, list_filter({TOKENS.format("text")}, lambda x: len(x) >= 4 AND x NOT IN {STOP}) AS k FROM usable),
terms AS (SELECT DISTINCT session_id, pos, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM kept)"""
COHERENCE = f"""WITH {CONVERSATIONS}, {turn_set(True)}, {SEMANTIC},
pairs AS (SELECT *, lag(v) OVER (PARTITION BY session_id ORDER BY pos) AS v0 FROM usable)
SELECT session_id, turn_index, person, round(greatest(-1, least(1, list_dot_product(v, v0))), 6) AS coherence FROM pairs WHERE v0 IS NOT NULL"""
CALLBACKS = f"""WITH {CONVERSATIONS}, {turn_set(True)}, {SEMANTIC}, {CONTENT},
sizes AS (SELECT session_id, count(*) AS n FROM usable GROUP BY ALL),
df AS (SELECT session_id, term, count(*) AS df FROM terms GROUP BY ALL),
links AS (SELECT j.session_id, j.pos AS j, i.pos AS i, j.term FROM terms j JOIN terms i ON i.session_id = j.session_id AND i.term = j.term AND j.pos - i.pos BETWEEN {{lag}} AND 40
  JOIN df ON df.session_id = j.session_id AND df.term = j.term JOIN sizes s ON s.session_id = j.session_id
  WHERE df.df <= greatest(1, floor(s.n * 0.25)) AND s.n >= {{lag}} + 2 AND NOT EXISTS (SELECT 1 FROM terms k WHERE k.session_id = j.session_id AND k.term = j.term AND k.pos > i.pos AND k.pos < j.pos)),
scored AS (SELECT l.session_id, a.turn_index, b.turn_index AS source_index, a.turn_index - b.turn_index AS lag, a.person, b.person AS source_person, greatest(-1, least(1, list_dot_product(a.v, b.v))) AS sim, string_agg(DISTINCT l.term, ', ' ORDER BY l.term) AS anchors
  FROM links l JOIN usable a ON a.session_id = l.session_id AND a.pos = l.j JOIN usable b ON b.session_id = l.session_id AND b.pos = l.i GROUP BY l.session_id, a.turn_index, b.turn_index, a.person, b.person, a.v, b.v)
SELECT session_id, turn_index, source_index, lag, person, source_person, round(sim, 6) AS similarity, anchors FROM scored WHERE sim >= {{sim}}
QUALIFY row_number() OVER (PARTITION BY session_id, turn_index ORDER BY sim DESC, lag DESC) = 1"""
