"""The 132 measures: fact tables, then one expression for each measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duologue.functions import lexicon
from duologue.functions import text as tx
from duologue.operators import semantics, synchrony, turns
from duologue.operators import intervals as iv
from duologue.plans.corpus import Corpus
from duologue.plans.registry import per_minute, person_facts, register, session_facts

KEYS = ["session_id", "person"]
c, lit = F.col, F.lit
zero = lambda name: F.coalesce(F.col(name), F.lit(0))
a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))


def share(x: Column) -> Column:
    return F.avg(x.cast("double"))


def balance(x: Column, y: Column) -> Column:
    """1 for equal amounts, 0 for one-sided ones, null for none."""
    return F.when(x + y > 0, 1 - F.abs(x - y) / (x + y))


def tracked_ok(corpus: Corpus) -> float:
    return corpus.settings.vision.min_coverage


def third(t: Column, duration: Column, n: int) -> Column:
    """The bin of t among n equal ones of [0, duration), compared with the bins' own bounds; null outside."""
    bins = F.lit(None).cast("int")
    for k in range(n - 1, -1, -1):
        bins = F.when((t >= duration * k / n) & (t < duration * (k + 1) / n), F.lit(k)).otherwise(bins)
    return bins


def with_sessions(corpus: Corpus, rows: DataFrame) -> DataFrame:
    return rows.join(corpus.sessions.select("session_id", "duration_s", "frame_hz"), "session_id")


def with_rate(corpus: Corpus, frames: DataFrame) -> DataFrame:
    """Frames with their rate; they are many, so it is the sessions that are looked up, each in the task of its frames."""
    return frames.join(corpus.sessions.select("session_id", "frame_hz").hint("shuffle_hash"), "session_id")


def n_bins(corpus: Corpus) -> int:
    return max(2, corpus.settings.dynamics.n_bins)


# ---------------------------------------------------------------- turns and speech


@person_facts("turns")
def turn_facts(corpus: Corpus) -> DataFrame:
    bins, least = n_bins(corpus), corpus.settings.dynamics.min_events_per_bin
    rows = with_sessions(corpus, corpus.turn_set.turns)
    response = F.when((c("prev_person") != c("person")), c("fto"))
    d, bin_ = c("end_s") - c("start_s"), third(c("start_s"), c("duration_s"), bins)
    rows = rows.withColumn("r", response).withColumn("d", d).withColumn("bin", bin_)

    def trend(value: Column, agg, last: int, alias: str) -> list[Column]:
        both = []
        for k in (0, last):
            x = F.when(c("bin") == k, value)
            both.append(F.when(F.count(x) >= least, agg(x)))
        return [(both[1] - both[0]).alias(alias)]

    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_turns"),
        F.avg("d").alias("turn_mean"),
        F.stddev_pop("d").alias("turn_sd"),
        F.median("d").alias("turn_median"),
        F.count("r").alias("n_r"),
        F.median("r").alias("r_median"),
        (F.percentile("r", lit(0.75)) - F.percentile("r", lit(0.25))).alias("r_iqr"),
        share(c("r") <= 0.2).alias("r_fast"),
        F.sum(F.size("ipus") - 1).alias("n_pauses"),
        F.count_if(c("is_overlap_onset") & (c("prev_person") != c("person"))).alias("n_onset_overlaps"),
        F.avg("n_words").alias("turn_words"),
        F.min("turn_index").alias("first_turn"),
        *trend(c("r"), F.median, bins - 1, "r_trend"),
        *trend(c("d"), F.avg, bins - 1, "d_trend"),
    )


@session_facts("any_turn")
def any_turn(corpus: Corpus) -> DataFrame:
    return corpus.turn_set.turns.groupBy("session_id").agg(F.count("*").alias("all_turns"))


@person_facts("speech")
def speech_facts(corpus: Corpus) -> DataFrame:
    own = iv.total(corpus.turn_set.speech).select(*KEYS, c("total_s").alias("talk"))
    heard = iv.total(turns.listening(corpus.turn_set.turns, corpus.turn_set.speech)).select(*KEYS, c("total_s").alias("listen"))
    full = corpus.spine.join(own, KEYS, "left").join(heard, KEYS, "left").fillna(0.0, ["talk", "listen"])
    partner = full.select("session_id", turns.other(c("person")).alias("person"), c("talk").alias("partner_talk"))
    return full.join(partner, KEYS)


@session_facts("silence")
def silence_facts(corpus: Corpus) -> DataFrame:
    bins = n_bins(corpus)
    rows = with_sessions(corpus, turns.mutual_silence(corpus.turn_set.speech, corpus.sessions))
    d = c("end_s") - c("start_s")

    def inside(k: int) -> Column:
        lo, hi = c("duration_s") * k / bins, c("duration_s") * (k + 1) / bins
        return F.sum(F.greatest(lit(0.0), F.least("end_s", hi) - F.greatest("start_s", lo)) / (hi - lo))

    found = rows.groupBy("session_id").agg(F.sum(d).alias("silent"), F.count_if(d >= 0.5).alias("n_silences"), F.avg(F.when(d >= 0.5, d)).alias("silence_mean"), F.max(d).alias("silence_max"), (inside(bins - 1) - inside(0)).alias("silence_trend"))
    return corpus.sessions.select("session_id").join(found, "session_id", "left").fillna(0.0, ["silent", "silence_trend"]).fillna(0, ["n_silences"])


def ab(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.filter(c("person") == p).select("session_id", "start_s", "end_s") for p in "AB")


@session_facts("overlap")
def overlap_facts(corpus: Corpus) -> DataFrame:
    least = corpus.settings.turns.overlap_min_s
    both = iv.intersect(*ab(corpus.turn_set.speech), ["session_id"])
    d = c("end_s") - c("start_s")
    found = both.groupBy("session_id").agg(F.sum(d).alias("overlap"), F.avg(F.when(d >= least, d)).alias("overlap_mean"))
    return corpus.sessions.select("session_id").join(found, "session_id", "left").fillna(0.0, ["overlap"])


@person_facts("interruptions")
def interruption_facts(corpus: Corpus) -> DataFrame:
    rows = corpus.turn_set.interruptions
    is_own, hit = c("kind") == "interruption", F.when(c("successful"), 1.0).otherwise(0.0)
    made = rows.groupBy("session_id", c("interrupter").alias("person")).agg(F.count_if(is_own).alias("n_made"), F.count_if(~is_own).alias("n_transition"), F.avg(F.when(is_own, hit)).alias("made_success"))
    got = rows.filter(is_own).groupBy("session_id", c("interrupted").alias("person")).agg(F.count("*").alias("n_got"), F.avg(1 - hit).alias("held"))
    return corpus.spine.join(made, KEYS, "left").join(got, KEYS, "left").fillna(0, ["n_made", "n_transition", "n_got"])


@person_facts("backchannels")
def backchannel_facts(corpus: Corpus) -> DataFrame:
    bins = n_bins(corpus)
    rows = with_sessions(corpus, corpus.turn_set.backchannels.select(*KEYS, "start_s", "end_s"))
    width = c("duration_s") / bins
    bin_ = third(c("start_s"), c("duration_s"), bins)
    counts = rows.groupBy(*KEYS).agg(F.count("*").alias("n_bc"), (per_minute(F.count_if(bin_ == bins - 1), F.first(width)) - per_minute(F.count_if(bin_ == 0), F.first(width))).alias("bc_trend"))
    return corpus.spine.join(counts, KEYS, "left").fillna(0, ["n_bc"]).fillna(0.0, ["bc_trend"])


@person_facts("backchannel_places")
def backchannel_places(corpus: Corpus) -> DataFrame:
    units = corpus.turn_set.backchannels.select(*KEYS, "start_s", "unit")
    held = corpus.turn_set.turns.select("session_id", turns.other(c("person")).alias("person"), "turn_index", c("start_s").alias("t0"), c("end_s").alias("t1"))
    inside = held.join(units, KEYS, "left").withColumn("hit", (c("start_s") >= c("t0")) & (c("start_s") < c("t1")))
    long_ = inside.filter(c("t1") - c("t0") >= 3.0).groupBy(*KEYS, "turn_index").agg(F.max(F.coalesce(c("hit"), lit(False))).alias("any"))
    cover = long_.groupBy(*KEYS).agg(share(c("any")).alias("bc_coverage"))
    place = inside.filter(c("hit") & (c("t1") - c("t0") > 0.5)).groupBy(*KEYS, "unit").agg(F.min_by((c("start_s") - c("t0")) / (c("t1") - c("t0")), "turn_index").alias("place"))
    placed = place.groupBy(*KEYS).agg(F.avg("place").alias("bc_place"))
    # the latest gap of the partner's speech that starts at or before the backchannel: an as-of join
    gaps = iv.gaps(corpus.turn_set.speech).filter(c("end_s") - c("start_s") >= 0.05).select("session_id", turns.other(c("person")).alias("person"), c("start_s").alias("t"), c("start_s").alias("gap"), lit(0).alias("kind"))
    both = units.select(*KEYS, c("start_s").alias("t"), lit(None).cast("double").alias("gap"), lit(1).alias("kind")).unionByName(gaps)
    by = Window.partitionBy(*KEYS).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    delay = both.withColumn("delay", c("t") - F.last("gap", ignorenulls=True).over(by)).filter((c("kind") == 1) & c("delay").between(0.0, 2.0))
    late = delay.groupBy(*KEYS).agg(F.median("delay").alias("bc_latency"))
    return corpus.spine.join(cover, KEYS, "left").join(placed, KEYS, "left").join(late, KEYS, "left")


register("response_latency_median", "turns", lambda: c("r_median"))
register("response_latency_iqr", "turns", lambda: F.when(c("n_r") >= 4, c("r_iqr")))
register("response_latency_asymmetry", "turns", lambda: F.when((a("n_r") >= 3) & (b("n_r") >= 3), a("r_median") - b("r_median")))
register("fast_response_proportion", "turns", lambda: c("r_fast"))
register("talk_time_share", "speech", lambda: F.when(c("talk") + c("partner_talk") > 0, c("talk") / (c("talk") + c("partner_talk"))))
register("talk_time_balance", "speech", lambda: balance(a("talk"), b("talk")))
register("turn_count", "turns", lambda: zero("n_turns"))
register("turn_rate", "turns", lambda: per_minute(zero("n_turns"), c("duration_s")))
register("mean_turn_duration", "turns", lambda: c("turn_mean"))
register("turn_duration_variability", "turns", lambda: F.when((c("n_turns") >= 3) & (c("turn_mean") > 0), c("turn_sd") / c("turn_mean")))
register("silence_proportion", "silence", lambda: F.when(c("duration_s") > 0, c("silent") / c("duration_s")))
register("silence_rate", "silence", lambda: per_minute(c("n_silences"), c("duration_s")))
register("mean_silence_duration", "silence", lambda: c("silence_mean"))
register("longest_silence", "silence", lambda: c("silence_max"))
register("within_turn_pause_rate", "turns speech", lambda: F.when(c("talk") > 0, per_minute(zero("n_pauses"), c("talk"))))
register("overlap_proportion", "overlap", lambda: F.when(c("duration_s") > 0, c("overlap") / c("duration_s")))
register("turn_transition_overlap_rate", "turns", lambda: per_minute(zero("n_onset_overlaps"), c("duration_s")))
register("spoke_first", "turns opener", lambda: F.when(c("opener").isNotNull(), (c("opener") == c("person")).cast("double")))
register("speaking_time", "speech", lambda: c("talk"))
register("silent_time", "speech", lambda: F.greatest(c("duration_s") - c("talk"), lit(0.0)))
register("listening_time", "speech", lambda: c("listen"))
register("median_turn_duration", "turns", lambda: c("turn_median"))


@person_facts("opener")
def opener_facts(corpus: Corpus) -> DataFrame:
    first = corpus.turn_set.turns.groupBy("session_id").agg(F.min_by("person", "turn_index").alias("opener"))
    return corpus.spine.join(first, "session_id", "left")


register("interruption_rate", "interruptions", lambda: per_minute(c("n_made"), c("duration_s")))
register("transition_overlap_rate", "interruptions", lambda: per_minute(c("n_transition"), c("duration_s")))
register("interruption_success_rate", "interruptions", lambda: c("made_success"))
register("interrupted_rate", "interruptions", lambda: per_minute(c("n_got"), c("duration_s")))
register("floor_hold_rate", "interruptions", lambda: c("held"))
register("interruption_asymmetry", "interruptions", lambda: per_minute(a("n_made"), c("duration_s")) - per_minute(b("n_made"), c("duration_s")))
register("mean_overlap_duration", "overlap", lambda: c("overlap_mean"))

register("backchannel_rate", "backchannels speech", lambda: F.when(c("partner_talk") > 1.0, per_minute(c("n_bc"), c("partner_talk"))))
register("backchannel_count", "backchannels", lambda: c("n_bc"))
register("backchannel_coverage", "backchannel_places", lambda: c("bc_coverage"))
register("backchannel_relative_position", "backchannel_places", lambda: c("bc_place"))
register("backchannel_latency", "backchannel_places", lambda: c("bc_latency"))
register("backchannel_reciprocity", "backchannels", lambda: balance(a("n_bc"), b("n_bc")))

# ---------------------------------------------------------------- words


@person_facts("words")
def word_facts(corpus: Corpus) -> DataFrame:
    """All of a person's words, backchannels included, as one token array in time order."""
    said = corpus.words.groupBy(*KEYS).agg(F.count("*").alias("n_words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "text"))), lambda x: x["text"]), " ").alias("said"))
    toks = said.withColumn("t", tx.tokens(c("said"))).withColumn("n_tokens", F.size("t"))
    simple = {"filler": lexicon.FILLERS, "fps": lexicon.FIRST_PERSON_SINGULAR, "second": lexicon.SECOND_PERSON, "fpp": lexicon.FIRST_PERSON_PLURAL, "emotion": lexicon.EMOTION_WORDS, "positive": lexicon.POSITIVE} | {f"lsm_{k}": v for k, v in lexicon.LSM_CATEGORIES.items()}
    phrases = {"marker": lexicon.DISCOURSE_MARKERS, "hedge": lexicon.HEDGES}
    polite = tx.count_phrases(c("t"), lexicon.GRATITUDE) + tx.count_phrases(c("t"), lexicon.APOLOGY) + tx.count_phrases(c("t"), lexicon.PLEASE)
    return toks.select(*KEYS, "n_words", "n_tokens", tx.type_token_ratio(c("t")).alias("ttr"), *(tx.count_in(c("t"), v).alias(f"k_{k}") for k, v in simple.items()), *(tx.count_phrases(c("t"), v).alias(f"k_{k}") for k, v in phrases.items()), polite.alias("k_polite"))


@person_facts("turn_words")
def turn_word_facts(corpus: Corpus) -> DataFrame:
    rows = corpus.turn_set.turns.filter(F.trim("text") != "").withColumn("q", tx.question_type(c("text"))).withColumn("t", tx.tokens(c("text")))
    asked = c("q").isin("wh", "yes_no", "tag")
    # phrases may run from one turn into the next, as the turns' texts are read as one
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "t"))), lambda x: x["t"]))
    found = rows.groupBy(*KEYS).agg(F.count_if(asked).alias("n_questions"), F.count_if(c("q") == "wh").alias("n_open"), joined.alias("t"))
    counted = found.select(*KEYS, "n_questions", "n_open", F.size("t").alias("turn_tokens"), tx.count_phrases(c("t"), lexicon.AGREEMENT).alias("k_agree"))
    return corpus.spine.join(counted, KEYS, "left").fillna(0, ["n_questions", "n_open"])


@person_facts("fillers")
def filler_facts(corpus: Corpus) -> DataFrame:
    return span_facts(corpus, "filled_pause", "hes")


def per_100(name: str):
    return lambda: F.when(c("n_tokens") > 0, 100.0 * c(f"k_{name}") / c("n_tokens"))


register("word_count", "words", lambda: zero("n_words"))
register("speech_rate_wpm", "words speech", lambda: F.when(c("talk") > 1.0, per_minute(zero("n_words"), c("talk"))))
register("words_per_turn", "turns", lambda: c("turn_words"))
register("lexical_diversity", "words", lambda: c("ttr"))
register("question_rate", "turn_words", lambda: per_minute(c("n_questions"), c("duration_s")))
register("open_question_ratio", "turn_words", lambda: F.when(c("n_questions") > 0, c("n_open") / c("n_questions")))
register("question_reciprocity", "turn_words", lambda: balance(a("n_questions"), b("n_questions")))
register("filler_rate", "words", per_100("filler"))
register("hesitation_rate", "fillers speech", lambda: F.when(c("talk") > 5.0, per_minute(c("hes_n"), c("talk"))))
register("hesitation_duration_mean", "fillers", lambda: c("hes_mean"))
register("discourse_marker_rate", "words", per_100("marker"))
register("hedge_rate", "words", per_100("hedge"))
register("first_person_singular_rate", "words", per_100("fps"))
register("second_person_rate", "words", per_100("second"))
register("first_person_plural_rate", "words", per_100("fpp"))
register("emotion_word_rate", "words", per_100("emotion"))
register("agreement_rate", "turn_words", lambda: F.when(c("turn_tokens") > 0, 100.0 * c("k_agree") / c("turn_tokens")))
register("positive_word_rate", "words", per_100("positive"))
register("politeness_marker_rate", "words", per_100("polite"))


def _style() -> Column:
    total = lit(0.0)
    for k in lexicon.LSM_CATEGORIES:
        pa, pb = a(f"k_lsm_{k}") / a("n_tokens"), b(f"k_lsm_{k}") / b("n_tokens")
        total = total + F.when(pa + pb > 0, 1 - F.abs(pa - pb) / (pa + pb)).otherwise(1.0)
    return F.when((a("n_tokens") >= 50) & (b("n_tokens") >= 50), total / len(lexicon.LSM_CATEGORIES))


register("linguistic_style_matching", "words", _style)

# ---------------------------------------------------------------- prosody


@person_facts("voice_frames")
def voice_frames(corpus: Corpus) -> DataFrame:
    f0, db = F.nanvl(c("f0_hz"), lit(None)), F.nanvl(c("intensity_db"), lit(None))
    st = F.when(f0 > 0, 12 * F.log2(f0))
    return corpus.frames.groupBy(*KEYS).agg(F.count(f0).alias("n_f0"), F.median(f0).alias("f0"), F.stddev_pop(st).alias("st_sd"), (F.percentile(st, lit(0.95)) - F.percentile(st, lit(0.05))).alias("st_range"), F.count(db).alias("n_db"), F.stddev_pop(db).alias("db_sd"))


@person_facts("voice")
def voice_facts(corpus: Corpus) -> DataFrame:
    if corpus.voice is None:
        return corpus.spine.select(*KEYS, lit(None).cast("double").alias("jitter"), lit(None).cast("double").alias("shimmer"))
    return corpus.voice.select(*KEYS, "jitter", "shimmer")


def _adjacent(series: DataFrame) -> DataFrame:
    """Consecutive rows of neighbouring turns by different persons: (session_id, turn_index, x, before)."""
    by = Window.partitionBy("session_id").orderBy("turn_index")
    rows = series.withColumn("before", F.lag("x").over(by)).withColumn("i0", F.lag("turn_index").over(by)).withColumn("p0", F.lag("person").over(by))
    return rows.filter((c("p0") != c("person")) & (c("turn_index") == c("i0") + 1))


def entrainment(series: DataFrame, name: str, least: int) -> DataFrame:
    """(session_id, name): correlation of neighbouring turns after each speaker's own mean and deviation are taken out."""
    own = Window.partitionBy(*KEYS)
    sd = F.stddev_pop("x").over(own)
    z = series.withColumn("z", F.when(sd > 1e-9, (c("x") - F.avg("x").over(own)) / sd)).filter("z IS NOT NULL").select("session_id", "person", "turn_index", c("z").alias("x"))
    pairs = _adjacent(z).groupBy("session_id").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("s1"), F.stddev_pop("before").alias("s0"), F.corr("before", "x").alias("r"))
    return pairs.select("session_id", F.when((c("n") >= least) & (c("s1") >= 1e-9) & (c("s0") >= 1e-9), c("r")).alias(name))


@session_facts("entrainment")
def entrainment_facts(corpus: Corpus) -> DataFrame:
    cfg, hz = corpus.settings.prosody, c("frame_hz")
    rows = with_sessions(corpus, corpus.turn_set.turns.select("session_id", "person", "turn_index", "start_s", "end_s"))
    ranges = rows.select(*KEYS, "turn_index", F.floor(c("start_s") * hz).alias("a"), (F.ceil(c("end_s") * hz) - 1).alias("b"))
    f0 = F.nanvl(c("f0_hz"), lit(None))
    heard = corpus.frames.select(*KEYS, "i", F.when(f0 > 0, 12 * F.log2(f0)).alias("st"), F.nanvl(c("intensity_db"), lit(None)).alias("db"))
    stats = iv.frames_within(heard, ranges, "turn_index").groupBy("session_id", "person", "turn_index").agg(F.count("st").alias("n"), F.avg("st").alias("st"), F.avg("db").alias("db"))
    voiced = stats.filter(c("n") >= cfg.min_voiced_frames)
    pitch = voiced.select("session_id", "person", "turn_index", c("st").alias("x"))
    level = stats.filter("db IS NOT NULL").select("session_id", "person", "turn_index", c("db").alias("x"))
    raw = _adjacent(pitch).withColumn("d", F.abs(c("x") - c("before")))
    least = cfg.entrainment_min_turns
    shape = raw.groupBy("session_id").agg(F.count("*").alias("n"), F.stddev_pop("d").alias("s"), F.corr("turn_index", "d").alias("r"), F.avg("d").alias("m"))
    shape = shape.select("session_id", F.when((c("n") >= least) & (c("s") >= 1e-9), c("r")).alias("pitch_convergence"), F.when(c("n") >= least, -c("m")).alias("pitch_near"))
    return corpus.sessions.select("session_id").join(entrainment(pitch, "pitch_sync", least), "session_id", "left").join(entrainment(level, "level_sync", least), "session_id", "left").join(shape, "session_id", "left")


register("f0_median", "voice_frames", lambda: F.when(c("n_f0") >= 10, c("f0")))
register("pitch_variability", "voice_frames", lambda: F.when(c("n_f0") >= 10, c("st_sd")))
register("pitch_range", "voice_frames", lambda: F.when(c("n_f0") >= 10, c("st_range")))
register("intensity_variability", "voice_frames", lambda: F.when(c("n_db") >= 20, c("db_sd")))
register("voice_jitter", "voice", lambda: c("jitter"))
register("voice_shimmer", "voice", lambda: c("shimmer"))
register("pitch_entrainment_synchrony", "entrainment", lambda: c("pitch_sync"))
register("intensity_entrainment_synchrony", "entrainment", lambda: c("level_sync"))
register("pitch_entrainment_convergence", "entrainment", lambda: c("pitch_convergence"))
register("pitch_proximity", "entrainment", lambda: c("pitch_near"))

# ---------------------------------------------------------------- semantics


@person_facts("coherence")
def coherence_by_person(corpus: Corpus) -> DataFrame:
    return semantics.coherence(corpus.usable_turns).groupBy(*KEYS).agg(F.avg("coherence").alias("coherence_mean"))


@session_facts("coherence_all")
def coherence_all(corpus: Corpus) -> DataFrame:
    bins, least = n_bins(corpus), corpus.settings.dynamics.min_events_per_bin
    rows = with_sessions(corpus, semantics.coherence(corpus.usable_turns))
    bin_ = third(c("start_s"), c("duration_s"), bins)
    part = lambda k: F.when(F.count_if(bin_ == k) >= least, F.avg(F.when(bin_ == k, c("coherence"))))
    return rows.groupBy("session_id").agg(F.count("*").alias("n_coherence"), F.stddev_pop("coherence").alias("coherence_sd"), (part(bins - 1) - part(0)).alias("coherence_trend_"))


@person_facts("callbacks")
def callback_facts(corpus: Corpus) -> DataFrame:
    found = semantics.find_callbacks(corpus.usable_turns, corpus.settings.semantic)
    counts = found.groupBy(*KEYS).agg(F.count("*").alias("n_callbacks"), F.count_if(c("person") != c("source_person")).alias("n_other"), F.avg("lag").alias("lag_mean"), F.max("lag").alias("lag_max"))
    return corpus.spine.join(counts, KEYS, "left").fillna(0, ["n_callbacks", "n_other"])


@session_facts("topics")
def topic_facts(corpus: Corpus) -> DataFrame:
    d = c("end_s") - c("start_s")
    found = semantics.segment_topics(enough(corpus), corpus.settings.semantic).groupBy("session_id").agg(F.count("*").alias("n_topics"), F.avg(d).alias("topic_mean"), F.median(d).alias("topic_median"))
    return corpus.sessions.select("session_id").join(found, "session_id", "left").fillna(0, ["n_topics"])


@person_facts("topic_starts")
def topic_starts(corpus: Corpus) -> DataFrame:
    topics = semantics.segment_topics(enough(corpus), corpus.settings.semantic)
    own, every = topics.groupBy(*KEYS).agg(F.count("*").alias("n_started")), topics.groupBy("session_id").agg(F.count("*").alias("n_all_topics"))
    return corpus.spine.join(own, KEYS, "left").join(every, "session_id", "left").fillna(0, ["n_started"])


def enough(corpus: Corpus) -> DataFrame:
    """Usable turns of sessions with at least three of them."""
    return corpus.usable_turns.withColumn("__n", F.count("*").over(Window.partitionBy("session_id"))).filter("__n >= 3").drop("__n")


register("semantic_coherence_mean", "coherence", lambda: c("coherence_mean"))
register("semantic_coherence_variability", "coherence_all", lambda: F.when(c("n_coherence") >= 5, c("coherence_sd")))
register("topic_count", "topics", lambda: c("n_topics"))
register("mean_topic_duration", "topics", lambda: c("topic_mean"))
register("topic_initiation_share", "topic_starts", lambda: F.when(c("n_all_topics") > 0, c("n_started") / c("n_all_topics")))
register("topic_turnover_rate", "topics", lambda: per_minute(F.greatest(c("n_topics") - 1, lit(0)), c("duration_s")))
register("callback_rate", "callbacks", lambda: per_minute(c("n_callbacks"), c("duration_s")))
register("other_directed_callback_rate", "callbacks", lambda: per_minute(c("n_other"), c("duration_s")))
register("callback_mean_lag", "callbacks", lambda: c("lag_mean"))
register("callback_max_lag", "callbacks", lambda: c("lag_max"))
register("callback_reciprocity", "callbacks", lambda: balance(a("n_other"), b("n_other")))
register("topics_initiated", "topic_starts", lambda: F.when(c("n_all_topics") > 0, c("n_started")))
register("median_topic_duration", "topics", lambda: c("topic_median"))

# ---------------------------------------------------------------- face, gaze, body: frames


def _flagged_frames(corpus: Corpus) -> DataFrame:
    """Frames with a flag for each kind of span they lie in; all kinds are looked up at once."""
    if corpus.speech is None:
        return corpus.frames
    ts, rate = corpus.turn_set, corpus.sessions.select("session_id", "frame_hz")
    heard = turns.listening(ts.turns, ts.speech)
    kinds = {"lis": (heard, False), "vlis": (heard, True), "spk": (iv.normalize(ts.turns), False), "vspk": (ts.speech, True)}
    return iv.flag_frames(corpus.frames, {name: iv.frame_ranges(spans.join(rate, "session_id"), c("frame_hz"), KEYS, outer) for name, (spans, outer) in kinds.items()})


@person_facts("face")
def face_facts(corpus: Corpus) -> DataFrame:
    """All that is counted over frames of faces, in one aggregate: overall, while listening, and while speaking."""
    f = _flagged_frames(corpus)
    tracked, on = c("tracked"), c("on_partner")
    valence = F.when(tracked, F.nanvl(c("valence"), lit(None)))
    expressive = F.nanvl(c("expressivity"), lit(None))
    within: list[Column] = []
    if corpus.speech is not None:
        for name in ("lis", "spk"):
            within += [F.count_if(tracked & c(name)).alias(f"{name}_n"), F.avg(F.when(tracked & c(name), on.cast("double"))).alias(f"{name}_gaze")]
        for name in ("vlis", "vspk"):
            within += [F.count(F.when(c(name), valence)).alias(f"{name}_nv"), F.avg(F.when(c(name), valence)).alias(f"{name}_valence")]
    return f.groupBy(*KEYS).agg(
        F.count_if(tracked).alias("n_tracked"),
        share(tracked).alias("coverage"),
        F.avg(F.when(tracked, on.cast("double"))).alias("gaze"),
        F.count_if(on & tracked).alias("n_on"),
        F.count(on).alias("n_gaze"),
        F.avg(expressive).alias("expressive"),
        F.count(expressive).alias("n_expressive"),
        F.count(valence).alias("n_valence"),
        F.avg(valence).alias("valence_mean"),
        F.stddev_pop(valence).alias("valence_sd"),
        *within,
    )


@person_facts("affect_share")
def affect_share(corpus: Corpus) -> DataFrame:
    """Shares of a person's frames beyond the quartiles of both persons' together."""
    rows = corpus.frames.select(*KEYS, F.when(c("tracked"), F.nanvl(c("valence"), lit(None))).alias("v")).filter("v IS NOT NULL")
    rows = rows.withColumn("own", F.count("*").over(Window.partitionBy(*KEYS))).filter("own >= 50")
    cut = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.percentile("v", F.array(lit(0.25), lit(0.75))).alias("q")).filter("n >= 100")
    return rows.join(cut.hint("shuffle_hash"), "session_id").groupBy(*KEYS).agg(share(c("v") > c("q")[1]).alias("pos_share"), share(c("v") < c("q")[0]).alias("neg_share"))


@session_facts("mutual_gaze")
def mutual_gaze(corpus: Corpus) -> DataFrame:
    cfg = corpus.settings.vision
    pair = corpus.frames.groupBy("session_id", "i").agg(F.bool_and("tracked").alias("both"), F.bool_and("on_partner").alias("on"), F.count("*").alias("k")).filter("k = 2")
    level = pair.groupBy("session_id").agg(F.count_if(c("both")).alias("n_both"), F.avg(F.when(c("both"), c("on").cast("double"))).alias("mutual"))
    mask = with_rate(corpus, pair.withColumn("m", c("both") & c("on")))
    runs = iv.drop_short(iv.merge_gaps(iv.from_mask(mask.filter("m"), "m", c("frame_hz"), ["session_id"]), cfg.mutual_gaze_gap_s, ["session_id"]), cfg.mutual_gaze_min_s)
    counts = runs.groupBy("session_id").agg(F.count("*").alias("n_mutual"))
    return corpus.sessions.select("session_id").join(level, "session_id", "left").join(counts, "session_id", "left").fillna(0, ["n_mutual"])


@person_facts("brows")
def brow_facts(corpus: Corpus) -> DataFrame:
    mask = with_rate(corpus, corpus.frames.withColumn("m", F.coalesce(F.nanvl(c("brow_raise"), lit(None)) >= corpus.settings.vision.brow_min, lit(False))))
    runs = iv.drop_short(iv.merge_gaps(iv.from_mask(mask.filter("m"), "m", c("frame_hz")), 0.15), 0.1)
    return corpus.spine.join(runs.groupBy(*KEYS).agg(F.count("*").alias("n_brows")), KEYS, "left").fillna(0, ["n_brows"])


@person_facts("duchenne")
def duchenne_facts(corpus: Corpus) -> DataFrame:
    rate = corpus.sessions.select("session_id", "frame_hz")
    smiles = kind(corpus, "smile").join(rate, "session_id").select(*KEYS, "start_s", F.floor(c("start_s") * c("frame_hz")).alias("a"), (F.floor(c("end_s") * c("frame_hz")) - 1).alias("b")).filter("b >= a")
    shown = corpus.frames.select(*KEYS, "i", F.nanvl(c("duchenne"), lit(None)).alias("d"))
    peak = iv.frames_within(shown, smiles, "start_s").groupBy(*KEYS, "start_s").agg(F.max("d").alias("d")).filter("d IS NOT NULL")
    return peak.groupBy(*KEYS).agg(share(c("d") >= corpus.settings.vision.duchenne_min).alias("duchenne_share"))


def kind(corpus: Corpus, name: str) -> DataFrame:
    if corpus.spans is None:
        return corpus.spine.select(*KEYS, lit(0.0).alias("start_s"), lit(0.0).alias("end_s")).limit(0)
    return corpus.spans.filter(c("kind") == name).select(*KEYS, "start_s", "end_s")


def span_facts(corpus: Corpus, name: str, short: str) -> DataFrame:
    d = c("end_s") - c("start_s")
    found = kind(corpus, name).groupBy(*KEYS).agg(F.count("*").alias(f"{short}_n"), F.sum(d).alias(f"{short}_s"), F.avg(d).alias(f"{short}_mean"))
    return corpus.spine.join(found, KEYS, "left").fillna(0, [f"{short}_n"]).fillna(0.0, [f"{short}_s"])


for _name, _short in (("nod", "nod"), ("head_shake", "shake"), ("smile", "smile"), ("laughter", "laugh"), ("gesture", "gest"), ("posture_shift", "shift")):
    person_facts(f"spans_{_name}")(lambda corpus, n=_name, s=_short: span_facts(corpus, n, s))


def _midpoints(corpus: Corpus, name: str, inside: DataFrame, alias: str) -> DataFrame:
    mid = kind(corpus, name).select(*KEYS, ((c("start_s") + c("end_s")) * 0.5).alias("t_s"))
    counts = iv.contains(mid, inside).filter("inside").groupBy(*KEYS).agg(F.count("*").alias(alias))
    return corpus.spine.join(counts, KEYS, "left").fillna(0, [alias])


@person_facts("nods_listening")
def nods_listening(corpus: Corpus) -> DataFrame:
    return _midpoints(corpus, "nod", turns.listening(corpus.turn_set.turns, corpus.turn_set.speech), "nods_heard")


@person_facts("gestures_speaking")
def gestures_speaking(corpus: Corpus) -> DataFrame:
    return _midpoints(corpus, "gesture", corpus.turn_set.speech, "gest_own")


@session_facts("shared_smiles")
def shared_smiles(corpus: Corpus) -> DataFrame:
    both = iv.intersect(*ab(iv.normalize(kind(corpus, "smile"))), ["session_id"])
    found = both.groupBy("session_id").agg(F.sum(c("end_s") - c("start_s")).alias("smile_both"))
    return corpus.sessions.select("session_id").join(found, "session_id", "left").fillna(0.0, ["smile_both"])


@person_facts("body")
def body_facts(corpus: Corpus) -> DataFrame:
    seen = c("body_tracked") if "body_tracked" in corpus.frames.columns else c("tracked")
    return corpus.frames.groupBy(*KEYS).agg(share(seen).alias("body_coverage"), F.count_if(seen).alias("n_body"), F.avg(F.when(seen, c("self_touch").cast("double"))).alias("touch"))


ok = lambda x: F.when(c("coverage") >= 0.6, x)
both_ok = lambda x: F.when((a("coverage") >= 0.6) & (b("coverage") >= 0.6), x)
body_ok = lambda x: F.when(c("body_coverage") >= 0.6, x)

register("gaze_partner_proportion", "face", lambda: ok(F.when(c("n_tracked") >= 10, c("gaze"))))
register("gaze_while_listening", "face", lambda: ok(F.when(c("lis_n") >= 10, c("lis_gaze"))))
register("gaze_while_speaking", "face", lambda: ok(F.when(c("spk_n") >= 10, c("spk_gaze"))))
register("gaze_speaker_listener_gap", "face", lambda: ok(F.when((c("lis_n") >= 10) & (c("spk_n") >= 10), c("lis_gaze") - c("spk_gaze"))))
register("mutual_gaze_proportion", "face mutual_gaze", lambda: both_ok(F.when(c("n_both") >= 50, c("mutual"))))
register("mutual_gaze_episode_rate", "face mutual_gaze", lambda: both_ok(per_minute(c("n_mutual"), c("duration_s"))))
register("gaze_partner_time", "face", lambda: F.when(c("n_gaze") > 0, c("n_on") / c("frame_hz")))
register("nod_rate_while_listening", "face nods_listening speech", lambda: ok(F.when(c("listen") >= 5.0, per_minute(c("nods_heard"), c("listen")))))
register("nod_rate", "face spans_nod", lambda: ok(per_minute(c("nod_n"), c("duration_s"))))
register("head_shake_rate", "face spans_head_shake", lambda: ok(per_minute(c("shake_n"), c("duration_s"))))
register("nod_count", "spans_nod", lambda: c("nod_n"))
register("nod_total_duration", "spans_nod", lambda: c("nod_s"))
register("nod_mean_duration", "spans_nod", lambda: c("nod_mean"))
register("smile_proportion", "face spans_smile", lambda: ok(F.when(c("n_tracked") / c("frame_hz") > 5.0, c("smile_s") / (c("n_tracked") / c("frame_hz")))))
register("duchenne_smile_ratio", "face duchenne", lambda: ok(c("duchenne_share")))
register("facial_expressivity", "face", lambda: ok(F.when(c("n_expressive") > 50, c("expressive"))))
register("brow_raise_rate", "face brows", lambda: ok(per_minute(c("n_brows"), c("duration_s"))))
register("shared_smile_proportion", "face shared_smiles", lambda: both_ok(F.when(c("duration_s") > 0, c("smile_both") / c("duration_s"))))
register("smile_count", "spans_smile", lambda: c("smile_n"))
register("smile_total_duration", "spans_smile", lambda: c("smile_s"))
register("smile_mean_duration", "spans_smile", lambda: c("smile_mean"))
register("gesture_rate", "body gestures_speaking speech", lambda: body_ok(F.when(c("talk") >= 5.0, per_minute(c("gest_own"), c("talk")))))
register("posture_shift_rate", "body spans_posture_shift", lambda: body_ok(per_minute(c("shift_n"), c("duration_s"))))
register("self_touch_proportion", "body", lambda: body_ok(F.when(c("n_body") >= 50, c("touch"))))
register("facial_valence_mean", "face", lambda: F.when(c("n_valence") >= 50, c("valence_mean")))
register("facial_valence_variability", "face", lambda: F.when(c("n_valence") >= 50, c("valence_sd")))
register("valence_while_listening", "face", lambda: F.when((c("n_valence") >= 50) & (c("vlis_nv") >= 25), c("vlis_valence")))
register("valence_while_speaking", "face", lambda: F.when((c("n_valence") >= 50) & (c("vspk_nv") >= 25), c("vspk_valence")))
register("positive_affect_proportion", "affect_share", lambda: c("pos_share"))
register("negative_affect_proportion", "affect_share", lambda: c("neg_share"))

# ---------------------------------------------------------------- uptake, laughter, synchrony, change over time


@person_facts("smile_uptake")
def smile_uptake(corpus: Corpus) -> DataFrame:
    return synchrony.uptake_by_person(kind(corpus, "smile"), corpus.sessions, "smile_follow", corpus.settings.synchrony)


@person_facts("laugh_uptake")
def laugh_uptake(corpus: Corpus) -> DataFrame:
    return synchrony.uptake_by_person(kind(corpus, "laughter"), corpus.sessions, "laugh_follow", corpus.settings.synchrony)


@session_facts("shared_laughter")
def shared_laughter(corpus: Corpus) -> DataFrame:
    """Onsets of A with an onset of B near: the nearest before and after each, by windows over both."""
    reach = corpus.settings.synchrony.colaughter_s
    rows = kind(corpus, "laughter").select("session_id", "person", "start_s")
    of_b = F.when(c("person") == "B", c("start_s"))
    past = F.last(of_b, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("start_s").rangeBetween(Window.unboundedPreceding, 0))
    future = F.first(of_b, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("start_s").rangeBetween(0, Window.unboundedFollowing))
    near = rows.withColumn("p", past).withColumn("f", future).filter(c("person") == "A")
    hit = F.coalesce(c("start_s") - c("p") <= reach, lit(False)) | F.coalesce(c("f") - c("start_s") <= reach, lit(False))
    found = near.groupBy("session_id").agg(F.count_if(hit).alias("n_shared"))
    return corpus.sessions.select("session_id").join(found, "session_id", "left").fillna(0, ["n_shared"])


#: Signals that are correlated between the two persons, in the directions that measures read.
SYNCHRONY = {"smile": ("",), "head_pitch": ("",), "expressivity": ("",), "intensity_db": ("",), "wrist_speed": ("",), "valence_seen": ("", "a_leads", "b_leads")}
SYNCHRONY_FIELDS = {
    "smile_excess": ("smile", "excess"),
    "smile_z": ("smile", "z"),
    "smile_lag": ("smile", "lag_s"),
    "head_excess": ("head_pitch", "excess"),
    "expr_excess": ("expressivity", "excess"),
    "loud_excess": ("intensity_db", "excess"),
    "move_excess": ("wrist_speed", "excess"),
    "val_excess": ("valence_seen", "excess"),
    "val_z": ("valence_seen", "z"),
}


def _synchrony(corpus: Corpus) -> DataFrame:
    """Synchrony of all signals there are: one grouped map over the frames, however many measures read it."""
    if "synchrony" not in corpus.made:
        frames = corpus.frames
        if "valence" in frames.columns:
            frames = frames.withColumn("valence_seen", F.when(c("tracked"), c("valence")))
        signals = {k: v for k, v in SYNCHRONY.items() if k in frames.columns}
        corpus.made["synchrony"] = corpus.hold(synchrony.synchrony(frames, corpus.sessions, signals, corpus.settings.synchrony))
    return corpus.made["synchrony"]


@session_facts("sync")
def sync_facts(corpus: Corpus) -> DataFrame:
    whole = c("restrict") == ""
    return _synchrony(corpus).groupBy("session_id").agg(*(F.max(F.when((c("signal") == s) & whole, c(f))).alias(n) for n, (s, f) in SYNCHRONY_FIELDS.items()))


@person_facts("reactivity")
def reactivity(corpus: Corpus) -> DataFrame:
    rows = _synchrony(corpus).filter(c("restrict") != "")
    return rows.select("session_id", F.when(c("restrict") == "a_leads", lit("B")).otherwise(lit("A")).alias("person"), c("excess").alias("react"))


def _trend_counts(corpus: Corpus, rows: DataFrame, alias: str) -> DataFrame:
    bins = n_bins(corpus)
    timed = with_sessions(corpus, rows)
    bin_ = third(c("start_s"), c("duration_s"), bins)
    width = F.first(c("duration_s")) / bins
    found = timed.groupBy(*KEYS).agg((per_minute(F.count_if(bin_ == bins - 1), width) - per_minute(F.count_if(bin_ == 0), width)).alias(alias))
    return corpus.spine.join(found, KEYS, "left").fillna(0.0, [alias])


def _trend_cover(corpus: Corpus, rows: DataFrame, alias: str) -> DataFrame:
    bins = n_bins(corpus)
    timed = with_sessions(corpus, rows)

    def part(k: int) -> Column:
        lo, hi = c("duration_s") * k / bins, c("duration_s") * (k + 1) / bins
        return F.sum(F.greatest(lit(0.0), F.least("end_s", hi) - F.greatest("start_s", lo)) / (hi - lo))

    found = timed.groupBy(*KEYS).agg((part(bins - 1) - part(0)).alias(alias))
    return corpus.spine.join(found, KEYS, "left").fillna(0.0, [alias])


person_facts("laugh_trend")(lambda corpus: _trend_counts(corpus, kind(corpus, "laughter"), "laugh_change"))
person_facts("smile_trend")(lambda corpus: _trend_cover(corpus, kind(corpus, "smile"), "smile_change"))


@person_facts("gaze_trend")
def gaze_trend(corpus: Corpus) -> DataFrame:
    mask = with_rate(corpus, corpus.frames.withColumn("m", c("on_partner") & c("tracked")))
    return _trend_cover(corpus, iv.from_mask(mask.filter("m"), "m", c("frame_hz")), "gaze_change")


register("partner_smile_uptake", "smile_uptake", lambda: c("smile_follow"))
register("partner_laughter_uptake", "laugh_uptake", lambda: c("laugh_follow"))
register("valence_reactivity", "face partner_valence reactivity", lambda: F.when((c("n_valence") >= 50) & (c("partner_n_valence") >= 50), c("react")))
register("valence_synchrony", "face sync", lambda: F.when((a("n_valence") >= 50) & (b("n_valence") >= 50), c("val_excess")))
register("valence_synchrony_z", "face sync", lambda: F.when((a("n_valence") >= 50) & (b("n_valence") >= 50), c("val_z")))


@person_facts("partner_valence")
def partner_valence(corpus: Corpus) -> DataFrame:
    n = F.count(F.when(c("tracked"), F.nanvl(c("valence"), lit(None))))
    return corpus.frames.groupBy("session_id", turns.other(c("person")).alias("person")).agg(n.alias("partner_n_valence"))


register("laughter_rate", "spans_laughter", lambda: per_minute(c("laugh_n"), c("duration_s")))
register("laughter_proportion", "spans_laughter", lambda: F.when(c("duration_s") > 0, c("laugh_s") / c("duration_s")))
register("shared_laughter_rate", "shared_laughter", lambda: per_minute(c("n_shared"), c("duration_s")))
register("laughter_reciprocity", "spans_laughter", lambda: balance(a("laugh_n"), b("laugh_n")))
register("smile_synchrony", "sync", lambda: c("smile_excess"))
register("smile_synchrony_z", "sync", lambda: c("smile_z"))
register("head_movement_synchrony", "sync", lambda: c("head_excess"))
register("expressivity_synchrony", "sync", lambda: c("expr_excess"))
register("loudness_synchrony", "sync", lambda: c("loud_excess"))
register("movement_synchrony", "sync", lambda: c("move_excess"))
register("smile_synchrony_lag", "sync", lambda: c("smile_lag"))
register("response_latency_trend", "turns", lambda: c("r_trend"))
register("backchannel_rate_trend", "backchannels", lambda: c("bc_trend"))
register("turn_duration_trend", "turns", lambda: c("d_trend"))
register("silence_trend", "silence", lambda: c("silence_trend"))
register("laughter_trend", "laugh_trend", lambda: c("laugh_change"))
register("gaze_trend", "face gaze_trend", lambda: ok(c("gaze_change")))
register("smile_trend", "face smile_trend", lambda: ok(c("smile_change")))
register("coherence_trend", "coherence_all", lambda: c("coherence_trend_"))
