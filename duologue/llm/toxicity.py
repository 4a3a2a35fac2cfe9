"""Toxicity by a weighted finite-state grammar over clauses.

Words map to symbols, and a cascade of weighted transducers rewrites them, each reading what the one
before it wrote. The insult transducer turns insulting words, and phrases of several words, into
offences; the threat transducer turns a verb of harm after words of intent into a threat; negation
rewrites offences in its scope of a few words, reported speech those of its clause, and the target
transducer those that stand near someone addressed. Arcs carry weights, and weights add up along a
path. The cascade is composed into one machine, tabulated as far as texts lead, which reads a clause
forwards; a second one, of reported speech and targets, reads its output backwards. Only clauses that
hold an offence are read. A document's score is the logistic of its clauses' weights, each kind of
arc counted at most ``COUNT_LIMIT`` times; an isolated word outside any clause reading has no score.

Insult words and stems are learned: those whose labelled documents are nearly all toxic and that
stand in many different word contexts there (copies of one document share their contexts, so they
do not count as many). The arcs' weights are fitted by logistic regression towards prior weights, on
the same sample of at most ``MAX_ROWS`` labelled rows, chosen by a hash of the id; beyond that bound
more labels change nothing. The sample bounds the lexicon too. Scoring is one map over whole texts.

Null and empty texts get the score of a document without matches. Rows are returned one for one.
A row without an id is scored and counts as not held out. Without labels of both classes, built-in
words and prior weights are used. Labels that repeat an id count as toxic if any of them is. Only id and text are read of the input, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from itertools import product
from math import exp, log

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm.batches import as_texts, batch, out, slices
from duologue.llm.store import Scratch

#: Labelled rows that the fit reads at most.
MAX_ROWS = 12_000
FOLDS = 5
STEM_LENGTHS = (4, 5, 6)
MIN_CONTEXTS, MIN_DOCS, MIN_PRECISION = 6, 4, 0.9
#: A stem stands for at least so many different words; else the word itself is learned.
MIN_FORMS = 3

INSULTS = "idiot idiots moron morons stupid scum loser losers pathetic worthless trash disgusting dumb fool vermin filth imbecile idiotisch dummkopf abschaum arschloch versager imbécile connard crétin salaud abruti estúpido estúpida imbécil cabrón inútil".split()
PHRASES = [
    tuple(p.split())
    for p in (
        "piece of trash, piece of garbage, piece of dirt, waste of space, good for nothing, shut up, go to hell, drop dead, get lost, screw you, "
        "stück dreck, halt die klappe, fahr zur hölle, scher dich weg, zu nichts zu gebrauchen, "
        "moins que rien, va au diable, ferme ta gueule, bon à rien, sac à merde, "
        "bueno para nada, vete al infierno, cierra la boca, pedazo de basura, hijo de perra"
    ).split(", ")
]
HARMS = "kill murder hurt destroy burn stab shoot strangle töten umbringen verletzen vernichten tuer détruire frapper brûler matar destruir golpear quemar".split()
INTENTS = "will would gonna going should must shall deserve deserves i'll we'll they'll werde werden wird sollte sollten muss müssen vais va allons vont devrait doit voy va vamos van debería debe".split()
TARGETS = "you your yours yourself he she him her they them these those people du dich dein deine ihr euch sie tu toi vous ton votre ils elles tú usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never neither nor without cannot isn't aren't wasn't don't doesn't didn't won't nicht kein keine niemals nie ohne ne pas jamais aucun sans nunca jamás tampoco sin".split()
REPORTS = "said says say wrote writes quoted quotes claimed claims reported reports called alleged stated sagte sagt schrieb behauptet berichtet dit disait écrit affirme rapporte dijo dice escribió afirma informó".split()
CLAUSE_END = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: Words after a negation that it still covers, and words around an offence in which a target counts.
NEGATION_SCOPE, TARGET_SCOPE = 3, 4

#: Symbols of words. Each word of a phrase has a symbol of its own, from PHRASED on.
OTHER, LEARNED, LISTED, HARM, INTENT, TARGET, NEGATION, REPORT, PHRASED = range(9)
INSULT, THREAT = 1, 2  # kinds of offences, beside HARM
#: Offences as the machine writes them: (kind, negated, reported, aimed), numbered from OFFENCE on.
KINDS = list(product((INSULT, THREAT, HARM), (False, True), (False, True), (False, True)))
OFFENCE = 1 << 20
NUMBER = {k: n for n, k in enumerate(KINDS)}
#: How many words after an intent a verb of harm still completes a threat.
INTENT_SCOPE = 3
#: Kinds of arcs and their prior weights: of offences, and of what rewrites them.
ARCS = ("learned", "listed", "phrase", "threat", "harm", "negated", "reported", "aimed")
WORD_LEARNED, WORD_LISTED, PHRASE, INTENDED, HARMFUL, NEGATED, REPORTED, AIMED = range(len(ARCS))
FEATURES = len(ARCS) + 2
#: After the arcs' weights those of the number of offences, as a logarithm, and of every document.
PRIOR = np.array([2.5, 1.2, 2.2, 2.0, 0.6, -1.5, -1.2, 0.6, 0.5, -3.0])
COUNT_LIMIT = 3
PULL = 1.0


class Transducer:
    """arc(state, symbol) -> (next state, symbol written, kinds of weights of the arc)."""

    def __init__(self, start, arc: Callable):
        self.start, self.arc = start, arc


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The machine that reads what ``first`` reads and writes what ``then`` makes of its output; weights add up."""

    def arc(state, symbol):
        a, between, w = first.arc(state[0], symbol)
        b, written, v = then.arc(state[1], between)
        return (a, b), written, w + v

    return Transducer((first.start, then.start), arc)


def offence(kind: int, negated: bool = False, reported: bool = False, aimed: bool = False) -> int:
    return OFFENCE + NUMBER[kind, negated, reported, aimed]


def insults(phrases: list[tuple[int, ...]], base: dict[int, int]) -> Transducer:
    """Writes an offence for an insulting word and at the end of a phrase. Its states are the beginnings of phrases.

    ``base`` tells what a symbol of phrases is on its own.
    """
    whole, begun = set(phrases), {p[:n] for p in phrases for n in range(len(p))}

    def arc(state: tuple[int, ...], x: int):
        after = state + (x,)
        done = any(after[k:] in whole for k in range(len(after)))
        while after not in begun:
            after = after[1:]
        x = base.get(x, x)
        if done:
            return after, offence(INSULT), (PHRASE,)
        if x in (LEARNED, LISTED):
            return after, offence(INSULT), (WORD_LEARNED if x == LEARNED else WORD_LISTED,)
        return after, x, ()

    return Transducer((), arc)


def threats() -> Transducer:
    def arc(s: int, x: int):
        if x == HARM:
            return s and s - 1, offence(THREAT if s else HARM), (INTENDED if s else HARMFUL,)
        return (INTENT_SCOPE, x, ()) if x == INTENT else (s and s - 1, x, ())

    return Transducer(0, arc)


def _marking(symbol: int, place: int, weight: int, scope: int | None) -> Transducer:
    """Marks offences after ``symbol``, within ``scope`` words or to the end. State: how many words it still reaches."""

    def arc(s: int, x: int):
        if x == symbol:
            return scope or 1, x, ()
        after = s if scope is None else s and s - 1
        if s and x >= OFFENCE and not KINDS[x - OFFENCE][place]:
            kind = list(KINDS[x - OFFENCE])
            kind[place] = True
            return after, offence(*kind), (weight,)
        return after, x, ()

    return Transducer(0, arc)


def negation() -> Transducer:
    return _marking(NEGATION, 1, NEGATED, NEGATION_SCOPE)


def reported_speech() -> Transducer:
    return _marking(REPORT, 2, REPORTED, None)


def targets() -> Transducer:
    return _marking(TARGET, 3, AIMED, TARGET_SCOPE)


class Machine:
    """A transducer whose states are numbered and tabulated when they are first reached."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.number, self.table = transducer, {transducer.start: 0}, [{}]
        self.states = [transducer.start]

    def run(self, symbols) -> list[tuple[int, tuple[int, ...]]]:
        state, done = 0, []
        for x in symbols:
            arc = self.table[state].get(x)
            if arc is None:
                after, written, weights = self.transducer.arc(self.states[state], x)
                if after not in self.number:
                    self.number[after] = len(self.states)
                    self.states.append(after)
                    self.table.append({})
                arc = self.table[state][x] = (self.number[after], (written, weights))
            state = arc[0]
            done.append(arc[1])
        return done


class Grammar:
    """The composed machines with their lexicon; picklable, rebuilt lazily on each worker."""

    def __init__(self, words: list[str], stems: list[str], listed: list[str] = INSULTS):
        self.words, self.stems, self.listed, self.built = sorted(words), sorted(stems), sorted(set(listed) - set(words)), False

    def __getstate__(self):
        return self.words, self.stems, self.listed

    def __setstate__(self, state):
        (self.words, self.stems, self.listed), self.built = state, False

    def _build(self) -> None:
        lists = ((TARGET, TARGETS), (INTENT, INTENTS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (HARM, HARMS), (LISTED, self.listed), (LEARNED, self.words))
        self.symbol = {w: s for s, ws in lists for w in ws}
        self.stemmed = set(self.stems)
        self.lengths = sorted({len(s) for s in self.stems})
        parts = {w: PHRASED + n for n, w in enumerate(dict.fromkeys(w for p in PHRASES for w in p))}
        base = {n: self.classify(w) for w, n in parts.items()}
        self.symbol |= parts
        cascade = insults([tuple(parts[w] for w in p) for p in PHRASES], base)
        for machine in (threats(), negation(), reported_speech(), targets()):
            cascade = compose(cascade, machine)
        self.forwards, self.backwards = Machine(cascade), Machine(compose(reported_speech(), targets()))
        self.anchors = ahocorasick.Automaton()
        for w in dict.fromkeys([*self.stems, *self.words, *self.listed, *HARMS, *(p[-1] for p in PHRASES)]):
            self.anchors.add_word(w, (len(w), w in self.stemmed))
        self.anchors.make_automaton()
        self.built = True

    def classify(self, word: str) -> int:
        found = self.symbol.get(word, OTHER)
        if found in (OTHER, TARGET, INTENT, LISTED) and any(word[:n] in self.stemmed for n in self.lengths if n <= len(word)):
            return LEARNED
        return found

    def read(self, words: list[str]) -> list[tuple[int, tuple[int, ...]]]:
        """(kind, weights) of a clause's offences, in order; a kind is a place in KINDS."""
        if not self.built:
            self._build()
        ahead = self.forwards.run(map(self.classify, words))
        back = self.backwards.run(x for x, _ in reversed(ahead))
        return [(z - OFFENCE, w + v) for (z, v), (_, w) in zip(reversed(back), ahead) if z >= OFFENCE]

    def matches(self, text: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
        """(kind, clause start, clause end, weights) of every offence, in order."""
        if not self.built:
            self._build()
        low, starts = text.lower(), []
        if len(low) != len(text):  # some letters have longer lower-case forms
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for end, (n, stem) in self.anchors.iter(low):
            start = end - n + 1
            if (start == 0 or not low[start - 1].isalnum()) and (stem or end + 1 == len(low) or not low[end + 1].isalnum()):
                starts.append(start)
        if not starts:
            return []
        cuts = [-1, *(m.start() for m in CLAUSE_END.finditer(low)), len(low)]
        found: list[tuple[int, int, int, tuple[int, ...]]] = []
        for k in sorted({bisect_left(cuts, s) for s in starts}):
            begin, end = cuts[k - 1] + 1, cuts[k]
            found += [(kind, begin, end, weights) for kind, weights in self.read([m[0] for m in WORD.finditer(low, begin, end)])]
        return found

    def features(self, found: list[tuple[int, int, int, tuple[int, ...]]]) -> np.ndarray:
        counts = np.zeros(FEATURES)
        for *_, weights in found:
            for w in weights:
                counts[w] += 1
        counts = np.minimum(counts, COUNT_LIMIT)
        counts[-2], counts[-1] = log(1 + len(found)), 1
        return counts


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


COUNTS, COUNTS_ARROW = out("term string, stem boolean, toxic long, clean long")


def _terms(text: str) -> set[tuple[str, bool]]:
    words = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
    return {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEM_LENGTHS if len(w) > n}


def _count_terms(batches):
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for rows in slices(batches):
        for text, toxic in zip(as_texts(rows.column(0)), rows.column(1).to_pylist()):
            seen[bool(toxic)].update(_terms(text))
    terms = list(seen[True])
    if terms:
        yield batch(COUNTS_ARROW, [t for t, _ in terms], [s for _, s in terms], [seen[True][t] for t in terms], [seen[False][t] for t in terms])
    rest = [t for t in seen[False] if t not in seen[True]]
    if rest:
        yield batch(COUNTS_ARROW, [t for t, _ in rest], [s for _, s in rest], [0] * len(rest), [seen[False][t] for t in rest])


CONTEXTS, CONTEXTS_ARROW = out("term string, stem boolean, context long, word long")


def _contexts(likely: set[tuple[str, bool]]):
    def run(batches):
        seen = set()
        for rows in slices(batches):
            for text, toxic in zip(as_texts(rows.column(0)), rows.column(1).to_pylist()):
                if toxic:
                    words = ["", *WORD.findall(text.lower()), ""]
                    for before, w, after in zip(words, words[1:], words[2:]):
                        hits = [t for t in ((w, False), *((w[:n], True) for n in STEM_LENGTHS if len(w) > n)) if t in likely]
                        if hits:
                            h = xxhash.xxh3_64_intdigest(f"{before} {after}") >> 1
                            seen.update((t, s, h, xxhash.xxh3_64_intdigest(w) >> 1) for t, s in hits)
        if seen:
            yield batch(CONTEXTS_ARROW, *zip(*sorted(seen)))

    return run


VECTORS, VECTORS_ARROW = out("toxic long, features binary")


def _vectors(grammar: Grammar):
    def run(batches):
        for rows in slices(batches):
            yield batch(VECTORS_ARROW, rows.column(1).to_pylist(), [grammar.features(grammar.matches(t)).tobytes() for t in as_texts(rows.column(0))])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = PULL) -> np.ndarray:
    """Newton steps on the log-loss with a Gaussian pull towards the prior weights."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` (text, toxic) of labelled rows outside the held-out fold."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    some = one.filter(fold(F.col("__id")) != 0).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    # at most max_rows ids and labels are broadcast; rows that repeat a text are one row of the sample
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "__id").groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", F.col("toxic").cast("long").alias("toxic"))


def fit(sample: DataFrame) -> tuple[Grammar, np.ndarray]:
    """Learns the lexicon and the weights from a sample that is stored or cheap to read again."""
    counts = sample.mapInArrow(_count_terms, COUNTS).groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    precise = counts.filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    likely = {(r["term"], r["stem"]) for r in precise.collect()}  # the sample bounds them
    chosen = set()
    if likely:
        contexts = sample.mapInArrow(_contexts(likely), CONTEXTS).groupBy("term", "stem").agg(F.count_distinct("context").alias("n"), F.collect_set("word").alias("words"))
        varied = contexts.filter((F.col("n") >= MIN_CONTEXTS) & (~F.col("stem") | (F.size("words") >= MIN_FORMS)))
        chosen = {(r["term"], r["stem"]) for r in varied.collect()}
    grammar = Grammar([t for t, stem in chosen if not stem], [t for t, stem in chosen if stem])
    rows = sample.mapInArrow(_vectors(grammar), VECTORS).collect()
    if not rows or len({r["toxic"] for r in rows}) < 2:
        return grammar, PRIOR.copy()
    x, y = np.stack([np.frombuffer(r["features"]) for r in rows]), np.array([r["toxic"] for r in rows], float)
    return grammar, fit_logistic(x, y)


SCORES, SCORES_ARROW = out("id long, score double, n_matches int, clauses string")


def _score(grammar: Grammar, weights: np.ndarray):
    def run(batches):
        for rows in slices(batches):
            scores, ns, clauses = [], [], []
            for text in as_texts(rows.column(1)):
                found = grammar.matches(text)
                z = float(np.clip(grammar.features(found) @ weights, -30, 30)) if found else float(weights[-1])
                scores.append(1 / (1 + exp(-z)))
                ns.append(len(found))
                clauses.append(",".join(f"{a}:{b}" for a, b in dict.fromkeys((a, b) for _, a, b, _ in found)))
            yield batch(SCORES_ARROW, rows.column(0).to_pylist(), scores, ns, clauses)

    return run


def score_toxicity(docs: DataFrame, model: tuple[Grammar, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_matches, clauses): clauses are ``start:end`` of the clauses that matched."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(_score(*model), SCORES)


def _keep_clean(grammar: Grammar, weights: np.ndarray, text_at: int, threshold: float):
    def run(batches):
        for rows in slices(batches):
            z = [float(grammar.features(found) @ weights) if (found := grammar.matches(t)) else float(weights[-1]) for t in as_texts(rows.column(text_at))]
            yield rows.filter(pa.array([x < log(threshold / (1 - threshold)) for x in z], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: tuple[Grammar, np.ndarray], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they are; nothing is shuffled."""
    return docs.mapInArrow(_keep_clean(*model, docs.columns.index(text_col), threshold), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Grammar, np.ndarray]:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(training_rows(docs, labels).repartition(8), "sample")
    model = fit(sample)
    scratch.drop("sample")
    return model


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches", "clauses")
