"""Secret scan: fixed patterns, and strings that a primed compressor finds new.

Pattern spans come from three expressions. The compressor adds what they miss: a token that
stands in a sensitive context (a word such as *key* or *bearer* shortly before it) is appended to
its surrounding text and compressed with zstandard, primed with a dictionary of code words and of
the corpus's own identifiers. The bytes it adds, over the bytes of the surroundings alone, are its
novelty; words and identifiers compress well, keys do not. Spans with at least ``MIN_NOVELTY``
bytes a character are reported as ``novel``.

The corpus's identifiers are learned from all documents: words of letters that stand beside
candidates in at least ``MIN_CONTEXTS`` different surroundings (copies of a document share theirs,
so a key that a copied document repeats is not learned). The most frequent fill a dictionary of
``DICTIONARY_BYTES``. Only words beside candidates are shuffled.

Scanning is one map over whole texts. Null texts count as empty. Very long texts cost time in
proportion to their length and no memory beyond it, since the compressor sees windows of
``AROUND`` characters. Rows are returned one for one, repeated or not; extra columns are not read.
Empty tables give empty results, and a corpus without candidates the dictionary of code words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm.batches import as_texts, batch, out, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "novel")
#: Any text that ASSIGN matches holds one of these in lower case.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CONTEXT_WORDS = ("key", "secret", "token", "auth", "credential", "bearer", "private", "passw", "pwd", "passphrase", "signature", "webhook", "session", "cookie")
CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.ASCII)
MIN_CANDIDATE = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}", re.ASCII)
PART = re.compile("[^=]+")
#: A sensitive word stands within so many characters before a candidate.
REACH = 48
AROUND = 256
MIN_NOVELTY = 0.62
#: A word enters the dictionary with at least so many different surroundings.
MIN_CONTEXTS = 8
#: The size of a dictionary of learned words; a compressor's dictionary is of fixed size at any number of documents.
DICTIONARY_BYTES = 32 << 10
#: Words of letters, and the humps of camel case.
LEARNED = re.compile("[A-Z]?[a-z]{3,}|[A-Z]{4,}", re.ASCII)
LEVEL = 3
IDENTIFIERS = (
    "import from return class def self None True False const let var function public private static void final string int bool float double "
    "if else elif for while try except finally raise throw catch switch case break continue lambda async await yield export default extends "
    "implements interface package namespace struct enum template include define ifdef endif typedef sizeof malloc printf console.log println "
    "username password passwd secret token api_key apikey access_key client_id client_secret authorization bearer credential private_key "
    "public_key certificate signature session cookie header request response config environment variable settings properties database host "
    "port user admin root localhost example.com http:// https:// www. .com .org .net /home/ /usr/local/ /etc/ .json .yaml .xml .html "
    "getElementById addEventListener toString hashCode equals isEmpty hasNext iterator ArrayList HashMap StringBuilder Exception "
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 aaaaaaaaaaaaaaaa ---------------- ================ ________________ xxxxxxxxxxxxxxxx"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and a priming dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = LEVEL):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        """Bytes a character that text[start:end] adds to what stands around it."""
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "replace")
        string = text[start:end].encode("utf-8", "replace")
        return (len(self.compressor.compress(around + b"\n" + string)) - len(self.compressor.compress(around + b"\n"))) / len(string)


class Taken:
    """Spans that are reported already; tells in logarithmic time whether another overlaps one."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        spans = sorted(spans, key=_order)
        self.starts, self.ends = [s for _, s, _ in spans], list(accumulate((e for *_, e in spans), max))

    def overlap(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)
        return before > 0 and self.ends[before - 1] > a


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """Groups of strings in sensitive context that no reported span overlaps: parts first, then, apart from them, the whole."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return
    if len(low) != len(text):  # some letters have longer lower-case forms
        low = "".join(c.lower() if c.isascii() else c for c in text)
    reported = Taken(taken)

    def apt(span: tuple[int, int]) -> bool:
        return CONTEXT.search(low, max(0, span[0] - REACH), span[0]) is not None and not reported.overlap(*span)

    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # NAME=value: a name is context of its value; equals signs at the end are padding
        parts = [(a + p.start(), a + p.end()) for p in PART.finditer(m[0])]
        parts = [(s, b if e == parts[-1][1] else e) for s, e in parts]
        whole = [(a, b)] if parts != [(a, b)] else []
        yield [p for p in parts if p[1] - p[0] >= MIN_CANDIDATE and apt(p)], [p for p in whole if apt(p)]


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty, least: float = MIN_NOVELTY) -> list[tuple[str, int, int]]:
    spans: list[tuple[str, int, int]] = []
    for parts, whole in candidates(text, taken):
        new = [p for p in parts if novelty(text, *p) >= least] or [p for p in whole if novelty(text, *p) >= least]
        spans += [("novel", a, b) for a, b in new]
    return spans


BESIDE, BESIDE_ARROW = out("word string, context long")


def _beside(batches):
    """Words of letters around candidates, each with a hash of the surroundings."""
    for rows in slices(batches):
        seen = set()
        for text in as_texts(rows.column(0)):
            for parts, whole in candidates(text, base_spans(text)):
                for a, b in parts or whole:
                    around = text[max(0, a - REACH) : b + REACH]
                    context = xxhash.xxh3_64_intdigest(around.encode("utf-8", "replace")) >> 1
                    seen.update((w, context) for w in LEARNED.findall(around))
        if seen:
            yield batch(BESIDE_ARROW, *map(list, zip(*sorted(seen))))


def learned_words(docs: DataFrame, text_col: str = "text", least: int = MIN_CONTEXTS, size: int = DICTIONARY_BYTES) -> str:
    """The identifiers of a corpus, commonest last, where a compressor reaches them most cheaply; at most ``size`` bytes."""
    beside = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(_beside, BESIDE)
    counted = beside.groupBy("word").agg(F.count_distinct("context").alias("n")).filter(F.col("n") >= least)
    words, left = [], size
    # no more words than fit are fetched: each has four letters at least
    for r in counted.orderBy(F.desc("n"), "word").limit(size // 5).collect():
        left -= len(r["word"]) + 1
        if left < 0:
            break
        words.append(r["word"])
    return " ".join(reversed(words))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND, FOUND_ARROW = out("id long, kinds string, spans string, base string, n_assign long, n_access long, n_hex long")


def _scan(least: float, identifiers: str):
    def run(batches):
        novelty = None
        for rows in slices(batches):
            novelty = novelty or Novelty(identifiers)
            columns: list[list] = [[] for _ in FOUND_ARROW]
            for i, text in zip(rows.column(0).to_pylist(), as_texts(rows.column(1))):
                base = base_spans(text)
                every = sorted(base + novel_spans(text, base, novelty, least), key=_order)
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                for c, v in zip(columns, (i, ",".join(sorted({s[0] for s in every})), written(every), written(base), *n)):
                    c.append(v)
            yield batch(FOUND_ARROW, *columns)

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_novelty: float = MIN_NOVELTY, identifiers: str | None = None) -> DataFrame:
    """(id, kinds, spans, base, n_assign, n_access, n_hex): spans are ``kind:start:end`` in code points, end exclusive.

    ``identifiers`` are the words of the priming dictionary; by default the corpus's own and the code words.
    """
    if identifiers is None:
        identifiers = f"{IDENTIFIERS} {learned_words(docs, text_col)}"
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(_scan(min_novelty, identifiers), FOUND)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def op8_base_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op8_secrets``, which SQL can express; the spans that compression adds it cannot."""
    return op8_secrets(spark, sf_dir).drop("spans")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql() -> str:
    names = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
    kinds = {"assign": f"""({names})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{32,}"}
    kept = {"assign": f"length(regexp_extract(m, '{kinds['assign']}', 2)) >= {MIN_ASSIGN}", "access": f"length(m) >= {MIN_ACCESS}", "hex": f"length(m) >= {MIN_HEX}"}
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, '{k}' AS kind, {i} AS rank, start, start + length(m) AS stop FROM (
          SELECT doc_id, unnest(ms) AS m, unnest(list_transform(generate_series(1, len(ms)), lambda i: list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda p: length(p))), 0))) AS start
          FROM (SELECT doc_id, regexp_extract_all(text, '{r}') AS ms, string_split_regex(text, '{r}') AS ps FROM texts)) WHERE {kept[k]}"""
        for i, (k, r) in enumerate(kinds.items())
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({parts})
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, rank) FILTER (WHERE kind IS NOT NULL), '')) AS base_sha256
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


SQL = _sql()
