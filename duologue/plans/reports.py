"""Output tables: measures long and wide, turns, events, timeline, codebook, quality, corpus roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duologue.operators import intervals as iv
from duologue.operators import semantics
from duologue.plans import measures as _measures  # noqa: F401  registers the catalogue
from duologue.plans.catalogue import SPECS
from duologue.plans.corpus import Corpus
from duologue.plans.registry import MEASURES, compute

c, lit = F.col, F.lit


def codebook(spark: SparkSession) -> DataFrame:
    """(measure, label, family, level, unit, requires), in order of family and id."""
    specs = sorted((m.spec for m in MEASURES.values()), key=lambda s: (s.family, s.id))
    return spark.createDataFrame([(s.id, s.label, s.family, s.level, s.unit, ", ".join(s.requires)) for s in specs], "measure string, label string, family string, level string, unit string, requires string")


def codebook_markdown() -> str:
    lines, family = [], None
    for s in sorted((m.spec for m in MEASURES.values()), key=lambda s: (s.family, s.id)):
        if s.family != family:
            family = s.family
            lines += [f"## {family.replace('_', ' ').capitalize()}", ""]
        lines.append(f"- `{s.id}` ({s.level}, {s.unit}): {s.label}; requires {', '.join(s.requires)}")
    return "\n".join(lines) + "\n"


def measures_long(corpus: Corpus, only: list[str] | None = None) -> DataFrame:
    values = compute(corpus, only)
    book = F.broadcast(codebook(corpus.sessions.sparkSession).select("measure", "family", "level", "unit"))
    return values.join(book, "measure").join(corpus.sessions.select("session_id", "meta"), "session_id").select(
        "session_id", "person", "level", "family", "measure", "value", "unit", lit(None).cast("int").alias("n"), c("value").isNotNull().alias("available"), "unavailable_reason", "meta"
    )


def flatten_meta(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*(x for x in rows.columns if x != "meta"), *(c("meta")[k].alias(f"meta_{k}") for k in keys))


def measures_wide(long: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One row for each session and person, one column for each measure, all-null ones included."""
    return long.groupBy("session_id", "person").pivot("measure", ids or sorted(SPECS)).agg(F.first("value"))


def turns_table(turns: DataFrame) -> DataFrame:
    three = lambda x: F.round(x, 3)
    return turns.select("session_id", "turn_index", "person", three(c("start_s")).alias("start_s"), three(c("end_s")).alias("end_s"), three(c("end_s") - c("start_s")).alias("duration_s"), three(c("speech_s")).alias("speech_s"), F.size("ipus").alias("n_ipus"), "n_words", three(c("fto")).alias("fto_s"), "prev_person", c("is_overlap_onset").alias("overlap_onset"), "text")


def events_table(corpus: Corpus) -> DataFrame:
    """Nine kinds of events of all inputs that there are, in one bag."""

    def part(rows: DataFrame, event: Column, person: Column, start: Column, end: Column, detail: Column, source: str) -> DataFrame:
        return rows.select("session_id", event.alias("event"), person.alias("person"), F.round(start, 3).alias("start_s"), F.round(end, 3).alias("end_s"), F.round(end - start, 3).alias("duration_s"), detail.cast("string").alias("detail"), lit(source).alias("source"))

    parts = []
    if corpus.speech is not None:
        ts = corpus.turn_set
        parts.append(part(ts.backchannels, lit("backchannel"), c("person"), c("start_s"), c("end_s"), c("text"), "turns"))
        parts.append(part(ts.interruptions, c("kind"), c("interrupter"), c("time_s"), c("time_s") + c("overlap_duration"), F.when(c("successful"), "successful").otherwise("unsuccessful"), "turns"))
    if corpus.spans is not None:
        shown = corpus.spans.filter(c("kind").isin("nod", "head_shake", "smile", "laughter"))
        parts.append(part(shown, c("kind"), c("person"), c("start_s"), c("end_s"), lit(""), "spans"))
    if corpus.embeddings is not None:
        cfg = corpus.settings.semantic
        calls = semantics.find_callbacks(corpus.usable_turns, cfg)
        parts.append(part(calls, lit("callback"), c("person"), c("start_s"), c("start_s"), F.array_join("anchors", ", "), "semantics"))
        topics = semantics.segment_topics(corpus.usable_turns, cfg)
        parts.append(part(topics, lit("topic"), c("person"), c("start_s"), c("end_s"), c("topic"), "semantics"))
    return reduce(DataFrame.unionByName, parts)


def timeline_table(corpus: Corpus) -> DataFrame:
    """One row for each session and frame with both persons' signals side by side."""
    signals = {"f0_hz": "f0", "intensity_db": "intensity", "smile": "smile", "head_pitch": "head_pitch", "head_yaw": "head_yaw", "on_partner": "gaze_on_partner", "tracked": "face_tracked", "expressivity": "expressivity", "wrist_speed": "wrist_speed"}
    have = {k: v for k, v in signals.items() if k in corpus.frames.columns}
    speaking = iv.frame_ranges(corpus.turn_set.speech.join(corpus.sessions.select("session_id", "frame_hz"), "session_id"), c("frame_hz"))
    rows = iv.flag_frames(corpus.frames, {"speech": speaking})
    wide = [F.max(F.when(c("person") == p, c(k))).alias(f"{v}_{p}") for k, v in have.items() for p in "AB"]
    spoke = [F.max(F.when(c("person") == p, c("speech").cast("int"))).alias(f"speech_{p}") for p in "AB"]
    out = rows.groupBy("session_id", "i").agg(F.first("t_s").alias("t_s"), *spoke, *wide)
    if corpus.state is not None:
        out = out.join(corpus.state.select("session_id", "i", "speaker_state", c("confidence").alias("attribution_confidence")), ["session_id", "i"], "left")
    return out.drop("i")


# ---------------------------------------------------------------- quality


def state_runs(state: DataFrame) -> DataFrame:
    """(session_id, speaker_state, n): runs of equal states, silence included."""
    by = Window.partitionBy("session_id").orderBy("i")
    fresh = F.coalesce(F.lag("speaker_state").over(by) != c("speaker_state"), lit(True)).cast("int")
    runs = state.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("session_id", "run", "speaker_state").agg(F.count("*").alias("n"))


def quality_checks(corpus: Corpus, sync: DataFrame | None = None, audio: DataFrame | None = None, video: DataFrame | None = None) -> DataFrame:
    """(session_id, name, passed, value, threshold, severity, message) of every check whose input there is.

    sync: (session_id, confidence). audio: (session_id, role, snr_db). video: (session_id, role,
    freeze_rate, motion, height); what was not measured is null or not a number and is not checked.
    """
    q = corpus.settings.quality
    s = corpus.sessions.select("session_id", "duration_s", "frame_hz", "overlap_identifiable")
    made: list[DataFrame] = []

    def add(rows: DataFrame, name: Column | str, value: Column, threshold: float, at_least: bool, severity: str, message: str, valid: Column | None = None) -> None:
        rows = rows if valid is None else rows.filter(valid)
        passed = value >= threshold if at_least else value <= threshold
        made.append(rows.select("session_id", (name if isinstance(name, Column) else lit(name)).alias("name"), F.coalesce(passed, lit(False)).alias("passed"), value.cast("double").alias("value"), lit(float(threshold)).alias("threshold"), lit(severity).alias("severity"), lit(message).alias("message")))

    add(s, "duration", c("duration_s"), q.min_duration_s, True, "fatal", "the recording is long enough")
    if sync is not None:
        add(sync, "camera_sync", c("confidence"), q.min_sync, True, "fatal", "the views could be aligned")
    if corpus.speech is not None:
        ts = corpus.turn_set
        talk = corpus.spine.join(iv.total(ts.speech).select("session_id", "person", "total_s"), ["session_id", "person"], "left").fillna(0.0, ["total_s"]).join(s, "session_id").withColumn("share", c("total_s") / F.greatest("duration_s", lit(1e-9)))
        whole = iv.total(iv.normalize(ts.speech, ["session_id"]), ["session_id"]).select("session_id", "total_s")
        spoken = s.join(whole, "session_id", "left").fillna(0.0, ["total_s"]).withColumn("share", c("total_s") / F.greatest("duration_s", lit(1e-9)))
        add(spoken, "speech_proportion", c("share"), q.min_speech, True, "fatal", "enough of the recording is speech")
        add(talk, F.concat(lit("talk_time_"), c("person")), c("share"), q.min_talk, True, "warning", "the person speaks enough")
        counted = s.join(ts.turns.groupBy("session_id").agg(F.count("*").alias("n"), F.count(F.when(c("prev_person") != c("person"), c("fto"))).alias("n_fto"), F.avg(F.when(c("prev_person") != c("person"), (c("fto") < 0).cast("double"))).alias("early")), "session_id", "left").fillna(0, ["n", "n_fto"])
        add(counted, "overlapping_onset_rate", c("early"), q.max_overlap_onsets, False, "fatal", "few turns begin before the last one ends", c("n_fto") >= q.min_onsets)
        add(counted, "turn_count_minimum", c("n"), q.min_turns, True, "fatal", "there are enough turns")
        add(counted, "turn_count_reliable", c("n"), q.reliable_turns, True, "warning", "there are enough turns for rates")
        add(counted, "turn_rate", c("n") / F.greatest(c("duration_s") / 60, lit(1e-9)), q.min_turn_rate, True, "fatal", "turns are frequent enough")
        add(s, "overlap_measurable", c("overlap_identifiable").cast("double"), 1.0, True, "warning", "overlapping speech can be told apart")
    if corpus.state is not None:
        speaking = corpus.state.filter("speaker_state > 0").groupBy("session_id").agg(F.avg((c("confidence") < 0.5).cast("double")).alias("uncertain"))
        add(speaking, "attribution_confidence", c("uncertain"), q.max_uncertain, False, "fatal", "speakers are told apart with confidence")
        short = state_runs(corpus.state).join(s, "session_id").groupBy("session_id").agg(F.avg((c("n") / c("frame_hz") < q.short_run_s).cast("double")).alias("short"))
        add(short, "speaker_track_stability", c("short"), q.max_short_runs, False, "fatal", "the speaker track does not flicker")
    if corpus.words is not None:
        add(corpus.words.groupBy("session_id").agg(F.avg("probability").alias("p")), "asr_confidence", c("p"), q.min_asr, True, "warning", "words were recognised with confidence")
    if corpus.frames is not None and "tracked" in corpus.frames.columns:
        add(corpus.frames.groupBy("session_id", "person").agg(F.avg(c("tracked").cast("double")).alias("cover")), F.concat(lit("face_coverage_"), c("person")), c("cover"), q.min_coverage, True, "warning", "the face is seen often enough")
    if audio is not None:
        add(audio, F.concat(lit("audio_snr_"), c("role")), c("snr_db"), q.min_snr_db, True, "warning", "speech stands out from noise")
    if video is not None:
        for name, column, limit, at_least, message in (
            ("video_continuity_", "freeze_rate", q.max_freeze_rate, False, "the picture does not freeze"),
            ("video_motion_", "motion", q.min_motion, True, "the picture moves"),
            ("video_resolution_", "height", q.min_video_height, True, "the picture is large enough"),
        ):
            value = F.nanvl(c(column).cast("double"), lit(None))
            known = value.isNotNull() & (value > 0) if column == "height" else value.isNotNull()
            add(video, F.concat(lit(name), c("role")), value, limit, at_least, "warning", message, known)
    return reduce(DataFrame.unionByName, made)


def verdicts(checks: DataFrame) -> DataFrame:
    """(session_id, verdict): fail if a fatal check failed, review if another did, else pass."""
    failed = ~c("passed")
    flags = checks.groupBy("session_id").agg(F.max((failed & (c("severity") == "fatal")).cast("int")).alias("f"), F.max((failed & (c("severity") == "warning")).cast("int")).alias("w"))
    return flags.select("session_id", F.when(c("f") == 1, "fail").when(c("w") == 1, "review").otherwise("pass").alias("verdict"))


def snr(frames: DataFrame, speech: DataFrame, hz: float, column: str = "intensity_db", least: int = 25) -> DataFrame:
    """(session_id, person, snr_db): the upper quartile of speech over the median of the rest."""
    inside = iv.to_frames(speech, hz).withColumn("__in", lit(True))
    rows = frames.select("session_id", "person", "i", F.nanvl(c(column), lit(None)).alias("x")).join(inside, ["session_id", "person", "i"], "left")
    loud, rest = F.when(c("__in"), c("x")), F.when(c("__in").isNull(), c("x"))
    return rows.groupBy("session_id", "person").agg(F.when((F.count(loud) >= least) & (F.count(rest) >= least), F.percentile(loud, lit(0.75)) - F.percentile(rest, lit(0.5))).alias("snr_db"))


# ---------------------------------------------------------------- corpus roll-ups


def overview(verdict: DataFrame, sessions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    rows = verdict.join(sessions.select("session_id", "duration_s"), "session_id")
    if turns is not None:
        rows = rows.join(turns.groupBy("session_id").agg(F.count("*").alias("n_turns")), "session_id", "left")
    else:
        rows = rows.withColumn("n_turns", lit(None).cast("long"))
    return rows.groupBy("verdict").agg(F.count("*").alias("sessions"), (F.sum("duration_s") / 60).alias("minutes"), F.sum("n_turns").alias("turns"))


def session_summary(verdict: DataFrame, checks: DataFrame, long: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, verdict, duration_s, values_available, values_total, warnings), worst first; fatal messages first, two of them."""
    failed = checks.filter(~c("passed")).groupBy("session_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((c("severity") != "fatal").alias("late"), "name"))), 1, 2).alias("w"))
    counts = long.groupBy("session_id").agg(F.count("value").alias("values_available"), F.count("*").alias("values_total"))
    rows = verdict.join(sessions.select("session_id", "duration_s"), "session_id").join(counts, "session_id", "left").join(failed, "session_id", "left")
    rank = F.when(c("verdict") == "fail", 0).when(c("verdict") == "review", 1).otherwise(2)
    return rows.select("session_id", "verdict", "duration_s", "values_available", "values_total", F.array_join(F.transform("w", lambda x: x["name"]), "; ").alias("warnings")).orderBy(rank, "session_id")


def distributions(long: DataFrame) -> DataFrame:
    """(family, measure, n, median, low, high) of measures with at least two values."""
    return long.filter("value IS NOT NULL").groupBy("family", "measure").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high")).filter("n >= 2")


def withheld(long: DataFrame, least: int = 1, shown: int = 8) -> DataFrame:
    """(reason, n_measures, measures): distinct measures by the reason they are missing, most first."""
    rows = long.filter("value IS NULL").groupBy(c("unavailable_reason").alias("reason")).agg(F.sort_array(F.collect_set("measure")).alias("m"))
    return rows.select("reason", F.size("m").alias("n_measures"), F.array_join(F.slice("m", 1, shown), ", ").alias("measures")).filter(c("n_measures") >= least).orderBy(F.desc("n_measures"), "reason")


def check_family(name: Column) -> Column:
    """The check's name without a view or person at its end."""
    return F.regexp_replace(name, "_(close_a|close_b|wide|A|B)$", "")


def common_warnings(checks: DataFrame, top: int = 8, shown: int = 6) -> DataFrame:
    """The checks that fail in most sessions, fatal ones first: a top-k report."""
    failed = checks.filter(~c("passed")).select(check_family(c("name")).alias("check"), "severity", "session_id").distinct()
    counted = failed.groupBy("check", "severity").agg(F.count("*").alias("sessions"))
    # the smallest ids of each check, ranked before anything is gathered
    few = failed.withColumn("k", F.row_number().over(Window.partitionBy("check", "severity").orderBy("session_id"))).filter(c("k") <= shown)
    examples = few.groupBy("check", "severity").agg(F.array_join(F.sort_array(F.collect_list("session_id")), ", ").alias("examples"))
    rows = counted.join(examples, ["check", "severity"])
    return rows.select("check", "severity", "sessions", "examples").orderBy(F.when(c("severity") == "fatal", 0).otherwise(1), F.desc("sessions"), "check").limit(top)


def histogram(rows: DataFrame, column: str, bins: int = 26, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n) between the 1st and 99th percentile; what lies beyond is in the outer bins."""
    edges = rows.groupBy(*keys).agg(F.percentile(column, F.array(lit(0.01), lit(0.99))).alias("e"))
    joined = rows.crossJoin(F.broadcast(edges)) if not keys else rows.join(edges, list(keys))
    at = F.floor((c(column) - c("e")[0]) / F.greatest(c("e")[1] - c("e")[0], lit(1e-12)) * bins)
    return joined.filter(c(column).isNotNull()).groupBy(*keys, F.greatest(lit(0), F.least(lit(bins - 1), at)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def review_jumps(turns: DataFrame, callbacks: DataFrame | None = None) -> DataFrame:
    """(session_id, earliest_onset, longest_wait, first_callback): moments to look at, three seconds early."""
    early = lambda x: F.greatest(x - 3.0, lit(0.0))
    found = turns.groupBy("session_id").agg(early(F.min_by("start_s", F.when(c("fto") < 0, c("fto")))).alias("earliest_onset"), early(F.max_by("start_s", F.when(c("fto") > 0, c("fto")))).alias("longest_wait"))
    if callbacks is None:
        return found.withColumn("first_callback", lit(None).cast("double"))
    return found.join(callbacks.groupBy("session_id").agg(early(F.min("start_s")).alias("first_callback")), "session_id", "left")


def state_samples(state: DataFrame, frame_hz: float, hz: float = 20.0) -> DataFrame:
    """(session_id, state): every so many frames' speaker state, in order, at about ``hz``."""
    step = max(1, round(frame_hz / hz))
    kept = state.filter(c("i") % step == 0).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("i", "speaker_state"))).alias("s"))
    return kept.select("session_id", F.transform("s", lambda x: x["speaker_state"].cast("int")).alias("state"))


def ribbon(state: DataFrame, sessions: DataFrame, frame_hz: float, bins: int = 600) -> DataFrame:
    """(session_id, bin, speaker_state, share): the commonest state in each of equally long parts of a session, the lower one in ties."""
    part = F.least(lit(bins - 1), F.floor(c("i") / frame_hz / c("duration_s") * bins)).cast("int").alias("bin")
    counts = state.join(sessions.select("session_id", "duration_s"), "session_id").groupBy("session_id", part, "speaker_state").agg(F.count("*").alias("n"))
    best = counts.groupBy("session_id", "bin").agg(F.max(F.struct("n", (-c("speaker_state")).alias("s"))).alias("x"), F.sum("n").alias("all"))
    return best.select("session_id", "bin", (-c("x.s")).cast("int").alias("speaker_state"), (c("x.n") / c("all")).alias("share"))


def player_data(corpus: Corpus, hz: float = 20.0, most: int = 4000, offsets: DataFrame | None = None) -> DataFrame:
    """(session_id, payload): JSON for a viewer: duration, spans by kind and speech, two decimals, turns with 160 characters of text, and where there are, sampled states, callbacks and sources.

    offsets: (session_id, role, offset_s), the views' places on the session clock.
    """
    two = lambda x: F.round(x, 2)
    turns = corpus.turn_set.turns.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", "person", two(c("start_s")).alias("start"), two(c("end_s")).alias("end"), F.substring("text", 1, 160).alias("text")))).alias("turns"))
    shown = corpus.turn_set.speech.select("session_id", lit("speech").alias("kind"), "person", "start_s", "end_s")
    if corpus.spans is not None:
        shown = shown.unionByName(corpus.spans.select("session_id", "kind", "person", "start_s", "end_s"))
    if corpus.frames is not None and {"on_partner", "tracked"} <= set(corpus.frames.columns):
        looks = corpus.frames.withColumn("m", c("on_partner") & c("tracked")).filter("m").join(corpus.sessions.select("session_id", "frame_hz"), "session_id")
        shown = shown.unionByName(iv.from_mask(looks, "m", c("frame_hz")).select("session_id", lit("gaze").alias("kind"), "person", "start_s", "end_s"))
    # a viewer shows so many spans of a kind and person; the tables hold all
    first = shown.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "kind", "person").orderBy("start_s"))).filter(c("k") <= most)
    spans = first.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("kind", "person", two(c("start_s")).alias("start"), two(c("end_s")).alias("end")))).alias("spans"))
    rows, fields = corpus.sessions.select("session_id", "frame_hz", two(c("duration_s")).alias("duration")).join(turns, "session_id", "left").join(spans, "session_id", "left"), ["duration", "turns", "spans"]
    if corpus.state is not None:
        rate = corpus.settings.frame_hz
        rows, fields = rows.join(state_samples(corpus.state, rate, hz), "session_id", "left"), [*fields, "state"]
    if corpus.embeddings is not None:
        calls = semantics.find_callbacks(corpus.usable_turns, corpus.settings.semantic).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(two(c("start_s")).alias("start"), "person", "lag", F.array_join(F.slice("anchors", 1, 3), ", ").alias("anchors")))).alias("callbacks"))
        rows, fields = rows.join(calls, "session_id", "left"), [*fields, "callbacks"]
    if offsets is not None:
        # seconds from session time to the file's own clock
        sources = offsets.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("role", F.round(-c("offset_s"), 3).alias("offset")))).alias("sources"))
        rows, fields = rows.join(sources, "session_id", "left"), [*fields, "sources"]
    return rows.select("session_id", F.replace(F.to_json(F.struct(*fields)), lit("</"), lit("<\\/")).alias("payload"))
