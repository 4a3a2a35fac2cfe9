"""The engine's queries over the driver's tables, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.functions import text as tx
from duologue.operators import grid, semantics, turns
from duologue.operators import intervals as iv
from duologue.plans import measures, oracle, reports  # noqa: F401
from duologue.plans.catalogue import SPECS
from duologue.plans.registry import compute
from duologue.settings import SemanticSettings
from duologue.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def six(df: DataFrame, *doubles: str) -> DataFrame:
    return df.select(*(F.round(x, 6).alias(x) if x in doubles else c(x) for x in df.columns))


def spans_out(df: DataFrame) -> DataFrame:
    return six(df, "start_s", "end_s")


_SPANS = "SELECT {k}, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM {t}"
_P, _S = "session_id, person", "session_id"


def _speech(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = td.event_corpus(spark, sf_dir, frames=False)
    a, b = (corpus.speech.filter(c("person") == p).select("session_id", "start_s", "end_s") for p in "AB")
    return corpus.speech, a, b


_A = "a AS (SELECT session_id, start_s, end_s FROM speech WHERE person = 'A'), b AS (SELECT session_id, start_s, end_s FROM speech WHERE person = 'B')"


@query("interval_normalize", f"WITH {oracle.EVENTS} " + _SPANS.format(k=_P, t="speech"))
def interval_normalize(spark, sf_dir):
    return spans_out(_speech(spark, sf_dir)[0])


@query("interval_merge_gaps", f"WITH {oracle.EVENTS}, {oracle.islands('m', 'speech', _P, 5.0)} " + _SPANS.format(k=_P, t="m"))
def interval_merge_gaps(spark, sf_dir):
    return spans_out(iv.merge_gaps(_speech(spark, sf_dir)[0], 5.0))


@query("interval_pad", f"WITH {oracle.EVENTS}, p AS (SELECT session_id, person, greatest(start_s - 2, 0) AS start_s, least(end_s + 2, 1800) AS end_s FROM speech), {oracle.islands('m', 'p', _P)} " + _SPANS.format(k=_P, t="m"))
def interval_pad(spark, sf_dir):
    return spans_out(iv.pad(_speech(spark, sf_dir)[0], 2.0, 0.0, 1800.0))


@query("interval_clip_drop_short", f"WITH {oracle.EVENTS}, k AS (SELECT session_id, person, greatest(start_s, 300) AS start_s, least(end_s, 900) AS end_s FROM speech) " + _SPANS.format(k=_P, t="k") + " WHERE end_s > start_s AND end_s - start_s >= 1.5")
def interval_clip_drop_short(spark, sf_dir):
    return spans_out(iv.drop_short(iv.clip(_speech(spark, sf_dir)[0], 300.0, 900.0), 1.5).select("session_id", "person", "start_s", "end_s"))


@query("interval_union", f"WITH {oracle.EVENTS}, {oracle.islands('m', 'speech', _S)} " + _SPANS.format(k=_S, t="m"))
def interval_union(spark, sf_dir):
    _, a, b = _speech(spark, sf_dir)
    return spans_out(iv.union(a, b, ["session_id"]))


@query("interval_intersect", f"WITH {oracle.EVENTS}, {oracle.BOTH} " + _SPANS.format(k=_S, t="both_"))
def interval_intersect(spark, sf_dir):
    _, a, b = _speech(spark, sf_dir)
    return spans_out(iv.intersect(a, b, ["session_id"]))


@query("interval_subtract", f"WITH {oracle.EVENTS}, {_A}, {oracle.minus('m', 'a', 'b', _S)} " + _SPANS.format(k=_S, t="m") + " WHERE end_s > start_s")
def interval_subtract(spark, sf_dir):
    _, a, b = _speech(spark, sf_dir)
    return spans_out(iv.subtract(a, b, ["session_id"]))


@query("interval_complement", f"WITH {oracle.EVENTS}, {oracle.SILENCE} " + _SPANS.format(k=_S, t="silence") + " WHERE end_s > start_s")
def interval_complement(spark, sf_dir):
    corpus = td.event_corpus(spark, sf_dir, frames=False)
    return spans_out(turns.mutual_silence(corpus.speech, corpus.sessions))


@query("interval_gaps", f"WITH {oracle.EVENTS}, g AS (SELECT session_id, person, lag(end_s) OVER (PARTITION BY session_id, person ORDER BY start_s) AS start_s, start_s AS end_s FROM speech) " + _SPANS.format(k=_P, t="g") + " WHERE start_s IS NOT NULL")
def interval_gaps(spark, sf_dir):
    return spans_out(iv.gaps(_speech(spark, sf_dir)[0]))


@query("interval_contains", f"WITH {oracle.EVENTS} SELECT e.event_id, EXISTS (SELECT 1 FROM speech s WHERE s.session_id = e.session_id AND s.person = e.person AND s.start_s <= e.start_s AND e.start_s < s.end_s) AS inside FROM ev e WHERE e.event_type IN ('error', 'signup')")
def interval_contains(spark, sf_dir):
    points = td.event_rows(spark, sf_dir).filter(c("event_type").isin("error", "signup")).select("session_id", "person", "event_id", c("start_s").alias("t_s"))
    return iv.contains(points, _speech(spark, sf_dir)[0]).select("event_id", "inside")


@query("interval_coverage", f"WITH {oracle.EVENTS} SELECT session_id, person, round(sum(greatest(0, least(end_s, 900) - greatest(start_s, 300))) / 600, 6) AS coverage FROM speech GROUP BY ALL")
def interval_coverage(spark, sf_dir):
    return six(iv.coverage(_speech(spark, sf_dir)[0], 300.0, 900.0), "coverage")


@query("interval_overlap_duration", f"WITH {oracle.EVENTS}, {oracle.BOTH} SELECT session_id, round(sum(end_s - start_s), 6) AS overlap_s FROM both_ GROUP BY ALL")
def interval_overlap_duration(spark, sf_dir):
    _, a, b = _speech(spark, sf_dir)
    return six(iv.overlap_duration(a, b, ["session_id"]), "overlap_s")


@query("interval_totals", f"WITH {oracle.EVENTS} SELECT session_id, person, round(sum(end_s - start_s), 6) AS total_s, count(*) AS n, round(min(start_s), 6) AS first_s, round(max(end_s), 6) AS last_s FROM speech GROUP BY ALL")
def interval_totals(spark, sf_dir):
    return six(iv.total(_speech(spark, sf_dir)[0]), "total_s", "first_s", "last_s")


@query("interval_to_frames", f"WITH {oracle.EVENTS} SELECT DISTINCT session_id, person, CAST(i AS INT) AS i FROM (SELECT session_id, person, unnest(range(CAST(ceil(start_s * 4) AS BIGINT), CAST(ceil(end_s * 4) AS BIGINT))) AS i FROM speech)")
def interval_to_frames(spark, sf_dir):
    return iv.to_frames(_speech(spark, sf_dir)[0], 4.0)


@query("interval_from_mask", f"WITH {oracle.EVENTS}, {oracle.FRAMES}, {oracle.runs_f('looks', 'SELECT session_id, person, i FROM fr WHERE on_partner AND tracked', _P, 0.0, 0.0)} " + _SPANS.format(k=_P, t="looks_r"))
def interval_from_mask(spark, sf_dir):
    f = td.event_corpus(spark, sf_dir).frames
    return spans_out(iv.from_mask(f.withColumn("m", c("on_partner") & c("tracked")), "m", 1.0))


def _turn_set(spark: SparkSession, sf_dir: str, spoken: bool = False):
    return (td.conversation_corpus(spark, sf_dir) if spoken else td.event_corpus(spark, sf_dir, frames=False)).turn_set


_TS, _TW = f"WITH {oracle.EVENTS}, {oracle.turn_set()} ", f"WITH {oracle.CONVERSATIONS}, {oracle.turn_set(True)} "


@query("turn_ipus", _TS + "SELECT session_id, person, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(containment, 6) AS containment, is_backchannel FROM ipus")
def turn_ipus(spark, sf_dir):
    return six(_turn_set(spark, sf_dir).ipus.select("session_id", "person", "start_s", "end_s", "containment", "is_backchannel"), "start_s", "end_s", "containment")


@query("turn_turns", _TS + "SELECT session_id, CAST(turn_index AS INT) AS turn_index, person, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(speech_s, 6) AS speech_s, round(fto, 6) AS fto, prev_person, is_overlap_onset, len(parts) AS n_ipus FROM turns")
def turn_turns(spark, sf_dir):
    return six(_turn_set(spark, sf_dir).turns.select("session_id", "turn_index", "person", "start_s", "end_s", "speech_s", "fto", "prev_person", "is_overlap_onset", F.size("ipus").alias("n_ipus")), "start_s", "end_s", "speech_s", "fto")


@query("turn_spoken", _TW + "SELECT session_id, CAST(turn_index AS INT) AS turn_index, person, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(fto, 6) AS fto, CAST(n_words AS INT) AS n_words, md5(text) AS text_md5 FROM turns")
def turn_spoken(spark, sf_dir):
    return six(_turn_set(spark, sf_dir, True).turns.select("session_id", "turn_index", "person", "start_s", "end_s", "fto", "n_words", F.md5("text").alias("text_md5")), "start_s", "end_s", "fto")


@query("turn_non_floor", _TS + "SELECT session_id, person, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM non_floor")
def turn_non_floor(spark, sf_dir):
    return spans_out(_turn_set(spark, sf_dir).non_floor.select("session_id", "person", "start_s", "end_s"))


@query("turn_interruptions", _TS + "SELECT session_id, round(time_s, 6) AS time_s, interrupter, interrupted, CAST(turn_index AS INT) AS turn_index, successful, round(overlap_duration, 6) AS overlap_duration, round(remaining_after, 6) AS remaining_after, kind FROM interruptions")
def turn_interruptions(spark, sf_dir):
    return six(_turn_set(spark, sf_dir).interruptions, "time_s", "overlap_duration", "remaining_after")


@query("turn_listening", _TS.rstrip() + f", {oracle.LISTENING} " + _SPANS.format(k=_P, t="listening") + " WHERE end_s > start_s")
def turn_listening(spark, sf_dir):
    ts = _turn_set(spark, sf_dir)
    return spans_out(turns.listening(ts.turns, ts.speech))


@query("response_latency", f"WITH {oracle.CONVERSATIONS}, {oracle.turn_set(True)} SELECT session_id, person, round(median(fto), 6) AS response_latency_median, count(*) AS n FROM turns WHERE fto IS NOT NULL AND prev_person <> person GROUP BY ALL")
def response_latency(spark, sf_dir):
    t = _turn_set(spark, sf_dir, True).turns.filter(c("fto").isNotNull() & (c("prev_person") != c("person")))
    return six(t.groupBy("session_id", "person").agg(F.median("fto").alias("response_latency_median"), F.count("*").alias("n")), "response_latency_median")


def _measures(corpus: Callable, ids: list[str]) -> Query:
    return lambda spark, sf_dir: compute(corpus(spark, sf_dir), ids).withColumn("value", F.round("value", 9))


def _ids(sql: str) -> list[str]:
    return [i for i in SPECS if f"'{i}' AS measure" in sql]


for _name, _sql, _corpus in (
    ("measures_turn_taking", oracle.TURN_TAKING, lambda s, d: td.event_corpus(s, d, frames=False)),
    ("measures_interruption", oracle.INTERRUPTION, lambda s, d: td.event_corpus(s, d, frames=False)),
    ("measures_backchannel", oracle.BACKCHANNEL, lambda s, d: td.event_corpus(s, d, frames=False)),
    ("measures_lexical", oracle.LEXICAL, td.conversation_corpus),
    ("measures_face_gaze_body_affect", oracle.FACE, td.event_corpus),
    ("measures_dynamics_laughter", oracle.DYNAMICS, lambda s, d: td.event_corpus(s, d, frames=False)),
    ("measures_prosody", oracle.PROSODY, td.event_corpus),
):
    query(_name, _sql)(_measures(_corpus, _ids(_sql)))

SEMANTIC_IDS = [i for i, s in SPECS.items() if s.family == "semantic"]
SURROGATE_IDS = [i for i, s in SPECS.items() if s.family == "synchrony"] + ["partner_smile_uptake", "partner_laughter_uptake", "valence_reactivity", "valence_synchrony", "valence_synchrony_z"]
query("measures_semantic")(_measures(td.spoken_corpus, SEMANTIC_IDS + ["coherence_trend"]))
query("measures_synchrony_uptake")(_measures(td.event_corpus, SURROGATE_IDS))


@query("semantic_coherence", oracle.COHERENCE)
def semantic_coherence(spark, sf_dir):
    found = semantics.coherence(td.spoken_corpus(spark, sf_dir).usable_turns)
    return six(found.select("session_id", "turn_index", "person", "coherence"), "coherence")


#: Turns are few in the test tables, so callbacks are asked for with a small lag and similarity.
_LINK = SemanticSettings(callback_min_lag=1, min_similarity=0.0)


@query("semantic_callbacks", oracle.CALLBACKS.replace("{lag}", "1").replace("{sim}", "0"))
def semantic_callbacks(spark, sf_dir):
    found = semantics.find_callbacks(td.spoken_corpus(spark, sf_dir).usable_turns, _LINK)
    return six(found.select("session_id", "turn_index", "source_index", "lag", "person", "source_person", "similarity", F.array_join("anchors", ", ").alias("anchors")), "similarity")


@query("semantic_topics")
def semantic_topics(spark, sf_dir):
    usable = td.spoken_corpus(spark, sf_dir).usable_turns
    topics = semantics.segment_topics(usable)
    return topics.join(semantics.describe_topics(topics, usable), ["session_id", "topic"], "left")


@query(
    "text_lexical_documents",
    f"""WITH d AS (SELECT doc_id, text, {oracle.TOKENS.format("text")} AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, round({oracle.TTR}, 6) AS ttr, {oracle.n_in("t", oracle.lexicon.LSM_CATEGORIES["articles"])} AS articles, {oracle.n_phrases("t", oracle.lexicon.HEDGES)} AS hedges, {oracle.n_phrases("t", oracle.lexicon.GRATITUDE)} AS gratitude FROM d""",
)
def text_lexical_documents(spark, sf_dir):
    d = td.read(spark, sf_dir, "documents").select("doc_id", tx.tokens(c("text")).alias("t"))
    lex = oracle.lexicon
    return six(d.select("doc_id", F.size("t").alias("n_tokens"), tx.type_token_ratio(c("t")).alias("ttr"), tx.count_in(c("t"), lex.LSM_CATEGORIES["articles"]).alias("articles"), tx.count_phrases(c("t"), lex.HEDGES).alias("hedges"), tx.count_phrases(c("t"), lex.GRATITUDE).alias("gratitude")), "ttr")


@query("text_question_types", f"WITH d AS (SELECT conv_id, turn, text, {oracle.TOKENS.format('text')} AS t FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, {oracle.QUESTION} AS question FROM d")
def text_question_types(spark, sf_dir):
    return td.read(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", tx.question_type(c("text")).alias("question"))


@query(
    "text_document_frequency",
    f"""WITH usable AS (SELECT conv_id AS session_id, turn AS pos, text FROM conversations), {oracle.CONTENT}
SELECT session_id AS conv_id, term, count(*) AS df FROM terms GROUP BY ALL""",
)
def text_document_frequency(spark, sf_dir):
    t = td.read(spark, sf_dir, "conversations").select("conv_id", F.explode(tx.content_terms(c("text"))).alias("term"))
    return t.groupBy("conv_id", "term").agg(F.count("*").alias("df"))


@query(
    "resample_to_grid",
    """WITH s AS (SELECT user_id, CAST(epoch_us(ts) % 3600000000 AS DOUBLE) / 1000000 AS t, value FROM events),
u AS (SELECT user_id, t, avg(value) AS value FROM s GROUP BY ALL), g AS (SELECT DISTINCT user_id, i, CAST(i AS DOUBLE) * 10 AS t FROM u, range(0, 361) r(i)),
n AS (SELECT g.user_id, g.i, g.t, (SELECT max(u.t) FROM u WHERE u.user_id = g.user_id AND u.t <= g.t) AS lo, (SELECT min(u.t) FROM u WHERE u.user_id = g.user_id AND u.t >= g.t) AS hi, (SELECT count(*) FROM u WHERE u.user_id = g.user_id) AS k FROM g)
SELECT n.user_id, CAST(n.i AS INT) AS i, round(CASE WHEN k > 1 AND hi = lo THEN a.value WHEN k > 1 AND hi - lo <= 60 THEN a.value + (b.value - a.value) * (n.t - lo) / (hi - lo) END, 6) AS value
FROM n LEFT JOIN u a ON a.user_id = n.user_id AND a.t = n.lo LEFT JOIN u b ON b.user_id = n.user_id AND b.t = n.hi""",
)
def resample_to_grid(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    s = td.read(spark, sf_dir, "events").select("user_id", ((micros % 3_600_000_000) / 1_000_000.0).alias("t_s"), "value").groupBy("user_id", "t_s").agg(F.avg("value").alias("value"))
    g = s.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(360))).alias("i")).withColumn("t_s", c("i") * 10.0)
    return six(grid.resample(s, g, 60.0, keys=["user_id"]).select("user_id", "i", "value"), "value")


_SHORT = ["turn_count", "turn_rate", "talk_time_share", "speaking_time", "median_turn_duration", "mean_turn_duration"]


@query(
    "measures_wide",
    f"SELECT session_id, person, {', '.join(f'max(value) FILTER (WHERE measure = {chr(39)}{i}{chr(39)}) AS {i}' for i in _SHORT)} FROM ({oracle.TURN_TAKING}) WHERE person <> 'dyad' GROUP BY ALL",
)
def measures_wide(spark, sf_dir):
    long = reports.measures_long(td.event_corpus(spark, sf_dir, frames=False), _SHORT)
    return reports.measures_wide(long.withColumn("value", F.round("value", 9)), _SHORT)


@query(
    "corpus_distributions",
    f"SELECT 'turn_taking' AS family, measure, count(*) AS n, round(median(value), 5) AS median, round(min(value), 5) AS low, round(max(value), 5) AS high FROM ({oracle.TURN_TAKING}) WHERE value IS NOT NULL AND measure IN ({', '.join(f'{chr(39)}{i}{chr(39)}' for i in _SHORT)}) GROUP BY ALL HAVING count(*) >= 2",
)
def corpus_distributions(spark, sf_dir):
    long = reports.measures_long(td.event_corpus(spark, sf_dir, frames=False), _SHORT).withColumn("value", F.round("value", 9))
    return reports.distributions(long).select("family", "measure", "n", *(F.round(x, 5).alias(x) for x in ("median", "low", "high")))


@query("corpus_withheld", f"SELECT unavailable_reason AS reason, count(DISTINCT measure) AS n_measures FROM ({oracle.INTERRUPTION}) WHERE value IS NULL GROUP BY ALL")
def corpus_withheld(spark, sf_dir):
    long = reports.measures_long(td.event_corpus(spark, sf_dir, frames=False), _ids(oracle.INTERRUPTION))
    return reports.withheld(long).select("reason", "n_measures")


_QC = f"""{_TS.rstrip()}, {oracle.islands("any_speech", "speech", "session_id")},
tot AS (SELECT s.session_id, coalesce(sum(a.end_s - a.start_s), 0) / s.duration_s AS share FROM sess s LEFT JOIN any_speech a USING (session_id) GROUP BY s.session_id, s.duration_s),
own AS (SELECT p.session_id, p.person, coalesce(sum(x.end_s - x.start_s), 0) / p.duration_s AS share FROM spine p LEFT JOIN speech x ON x.session_id = p.session_id AND x.person = p.person GROUP BY p.session_id, p.person, p.duration_s),
cnt AS (SELECT s.session_id, s.duration_s, s.overlap_ok, count(t.turn_index) AS n, count(t.fto) FILTER (WHERE t.prev_person <> t.person) AS nf, avg(CAST(t.fto < 0 AS INT)) FILTER (WHERE t.prev_person <> t.person AND t.fto IS NOT NULL) AS early FROM sess s LEFT JOIN turns t USING (session_id) GROUP BY ALL),
checks AS (SELECT session_id, 'duration' AS name, duration_s >= 60 AS passed, duration_s AS value, 'fatal' AS severity FROM cnt
 UNION ALL SELECT session_id, 'speech_proportion', share >= 0.25, share, 'fatal' FROM tot UNION ALL SELECT session_id, 'talk_time_' || person, share >= 0.02, share, 'warning' FROM own
 UNION ALL SELECT session_id, 'overlapping_onset_rate', early <= 0.3, early, 'fatal' FROM cnt WHERE nf >= 20 UNION ALL SELECT session_id, 'turn_count_minimum', n >= 8, n, 'fatal' FROM cnt
 UNION ALL SELECT session_id, 'turn_count_reliable', n >= 20, n, 'warning' FROM cnt UNION ALL SELECT session_id, 'turn_rate', n / (duration_s / 60) >= 1.5, n / (duration_s / 60), 'fatal' FROM cnt
 UNION ALL SELECT session_id, 'overlap_measurable', overlap_ok, CAST(overlap_ok AS INT), 'warning' FROM cnt)"""


@query("quality_checks", _QC + " SELECT session_id, name, passed, round(CAST(value AS DOUBLE), 6) AS value, severity FROM checks")
def quality_checks(spark, sf_dir):
    return six(reports.quality_checks(td.event_corpus(spark, sf_dir, frames=False)).select("session_id", "name", "passed", "value", "severity"), "value")


@query("quality_verdicts", _QC + " SELECT session_id, CASE WHEN bool_or(NOT passed AND severity = 'fatal') THEN 'fail' WHEN bool_or(NOT passed) THEN 'review' ELSE 'pass' END AS verdict FROM checks GROUP BY ALL")
def quality_verdicts(spark, sf_dir):
    return reports.verdicts(reports.quality_checks(td.event_corpus(spark, sf_dir, frames=False)))


@query("corpus_common_warnings", _QC + """ SELECT * FROM (SELECT regexp_replace(name, '_(close_a|close_b|wide|A|B)$', '') AS "check", severity, count(DISTINCT session_id) AS sessions FROM checks WHERE NOT passed GROUP BY ALL) ORDER BY CASE severity WHEN 'fatal' THEN 0 ELSE 1 END, sessions DESC, "check" LIMIT 8""")
def corpus_common_warnings(spark, sf_dir):
    return reports.common_warnings(reports.quality_checks(td.event_corpus(spark, sf_dir, frames=False))).select("check", "severity", "sessions")


@query("player_data")
def player_data(spark, sf_dir):
    return reports.player_data(td.event_corpus(spark, sf_dir, frames=False))
