"""Repeated passages: compressed FM-indexes over content shards, searched by streamed passages.

A window is ``span`` consecutive words. Equal windows hold the same least gram (of GRAM words, by
hash), so maximal runs of windows with one least gram -- passages -- are dealt out by it, and all
places where a window occurs meet in one shard, however many documents there are. Grams found in
many documents rank last, so that a passage that many share does not draw its surroundings into
one shard. Passages whose gram occurs once cannot repeat and stop here. Passages of equal words
travel as one, with their first place and their number.

Each shard indexes the first passage of each of its grams. All other passages, later copies
included, are not in that index; they are streamed through it by backward search, which gives the
matching statistic of every word: where it reaches the span, the window starts earlier. Passages
that hold windows the index lacks, and may share them with others, go into a second index and are
streamed through it; there a window starts earlier if its interval's earliest place is another.
What a shard reports are intervals of windows, for the first place of a passage and for later ones.

A gram whose passages would exceed a shard is dealt again, window by window: then equal windows are
one string, and a string that occurs once stops there, so no gram is too frequent for a task.

Null or empty texts have no words. Ids are those of documents: rows that repeat an id with its
text are returned alike; under one id with another text, only what holds the found words is
removed. Rows without an id neither remove nor lose words. Empty tables give empty results;
extra columns are not read.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm.batches import as_bytes, groups, out, slices
from duologue.llm.fmindex import FMIndex
from duologue.llm.store import Scratch

SPAN = 20
GRAM = 6
#: Words of one shard. A gram with more is dealt out by windows.
SHARD_WORDS = 400_000
#: Grams in at least this share of documents rank last; estimated on one document in SAMPLE_EVERY by hash. It moves work, not results.
COMMON_SHARE, COMMON_LEAST, SAMPLE_EVERY, MAX_COMMON = 2e-4, 8, 32, 500_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
    size = len(hashes) - n + 1
    code = np.zeros(max(0, size), np.uint64)
    for j in range(n):
        code = (code ^ hashes[j : size + j]) * FACTOR
        code ^= code >> np.uint64(31)
    return code


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept and grown as longer texts come."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        x = np.full(max(n, 4096), base, np.uint64)
        x[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(x)
    return known[:n]


class Content:
    """64-bit hashes of word ranges, from sums of word hashes times powers."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.r_[np.zeros(1, np.uint64), np.add.accumulate(hashes * _powers(BASE, n))]
        self.back = _powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start] ^ ((end - start).astype(np.uint64) * FACTOR)


def passages(hashes: np.ndarray, common: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(least gram, content, first window, windows, times): times is 2 where a window may repeat inside its passage."""
    grams = gram_hashes(hashes)
    order = grams >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        order[common[at] == grams] |= np.uint64(1 << 63)
    least, width, want = order, 1, span - GRAM + 1
    while 2 * width <= want:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (want - width)], least[want - width :]) if want > width else least
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    content = Content(hashes).of(first, first + count + span - 1)
    times = np.ones(len(first), np.int64)
    in_order = np.sort(order)
    if (in_order[1:] == in_order[:-1]).any():
        # how often the least gram stands in each passage's words; the last windows of one reach into the next
        ends, held = first + count + want - 1, np.zeros(len(first), np.int64)
        hits = np.flatnonzero(np.isin(order, least[first]))
        for back in range(want):
            owner = np.searchsorted(first, hits, "right") - 1 - back
            ok = owner >= 0
            ok[ok] &= (order[hits[ok]] == least[first[owner[ok]]]) & (hits[ok] < ends[owner[ok]])
            np.add.at(held, owner[ok], 1)
        times[held > 1] = 2
    return least[first], content, first, count, times


PASSAGES, PASSAGES_ARROW = out("gram long, content long, id long, at int, windows int, times int")


def _cut(common_b, span: int):
    def run(batches):
        common = common_b.value
        for rows in slices(batches):
            parts: list[list[np.ndarray]] = [[] for _ in PASSAGES_ARROW]
            for i, text in zip(rows.column(0).to_pylist(), as_bytes(rows.column(1))):
                words = text.split()
                if i is None or len(words) < span:
                    continue
                gram, content, first, count, times = passages(word_hashes(words), common, span)
                for p, x in zip(parts, (gram, content, np.full(len(gram), i), first, count, times)):
                    p.append(x)
            if parts[0]:
                arrays = [np.concatenate(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, type=f.type, safe=False) for a, f in zip(arrays, PASSAGES_ARROW)], schema=PASSAGES_ARROW)

    return run


GRAMS, GRAMS_ARROW = out("gram long, n long")


def _count_grams(batches):
    for rows in slices(batches):
        found = [np.unique(gram_hashes(word_hashes(w))) for t in as_bytes(rows.column(0)) if len(w := t.split()) >= GRAM]
        if found:
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], schema=GRAMS_ARROW)


def common_grams(slim: DataFrame) -> np.ndarray:
    """Sorted hashes of grams that stand in many documents; at most MAX_COMMON of 8 bytes are broadcast."""
    some = slim.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_EVERY)) == 0)
    least = max(COMMON_LEAST, int(COMMON_SHARE * some.count()))
    counted = some.select("text").mapInArrow(_count_grams, GRAMS).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counted.orderBy(F.desc("n"), "gram").limit(MAX_COMMON).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def _windows(span: int):
    """Every window of the wanted passages as a passage of its own, dealt by its words."""

    def run(batches):
        for rows in slices(batches):
            for i, text, wanted in zip(rows.column(0).to_pylist(), as_bytes(rows.column(1)), rows.column(2).to_pylist()):
                hashes = word_hashes(text.split())
                at = np.unique(np.concatenate([np.arange(w["at"], w["at"] + w["windows"]) for w in wanted]))
                at = at[at + span <= len(hashes)]
                if len(at):
                    content, one = pa.array(Content(hashes).of(at, at + span).view(np.int64)), pa.array(np.ones(len(at), np.int32))
                    yield pa.RecordBatch.from_arrays([content, content, pa.array(np.full(len(at), i)), pa.array(at.astype(np.int32)), one, one], schema=PASSAGES_ARROW)

    return run


STRINGS, STRINGS_ARROW = out("gram long, content long, id long, at int, windows int, places long, times int, words binary")


def _extract(span: int):
    def run(batches):
        for rows in slices(batches):
            done: list[list] = [[] for _ in STRINGS_ARROW]
            for i, text, wanted in zip(rows.column(0).to_pylist(), as_bytes(rows.column(1)), rows.column(2).to_pylist()):
                words = text.split()
                for w in wanted:
                    string = words[w["at"] : w["at"] + w["windows"] + span - 1]
                    if len(string) == w["windows"] + span - 1:
                        for c, v in zip(done, (w["gram"], w["content"], i, w["at"], w["windows"], w["places"], w["times"], b" ".join(string))):
                            c.append(v)
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, STRINGS_ARROW)], schema=STRINGS_ARROW)

    return run


class Strings:
    """Strings one after another, as numbers of words; a zero stands after each."""

    def __init__(self, strings: list[bytes], symbol: dict[bytes, int]):
        words = b" ".join(strings).split(b" ")
        sizes = np.array([s.count(b" ") + 1 for s in strings])
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        self.text = np.zeros(self.ends[-1] + 1, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.ends] = False
        self.text[inside] = np.fromiter(map(symbol.get, words, repeat(0)), np.int64, len(words))


def indexed(strings: list[bytes], span: int) -> tuple[FMIndex, dict[bytes, int]]:
    symbol = {w: k for k, w in enumerate(dict.fromkeys(b" ".join(strings).split(b" ")), 1)}
    return FMIndex(Strings(strings, symbol).text, len(symbol) + 1, span), symbol


def matched(index: FMIndex, symbol: dict[bytes, int], strings: list[bytes], span: int, own: bool = False) -> list[np.ndarray]:
    """For each string whether each of its windows is in the index; with ``own``, where the strings are the indexed ones, whether another place has it earlier."""
    s = Strings(strings, symbol)
    flags = np.zeros(len(s.text), bool)
    for _, place, lo, hi in index.statistics(s.text, s.begins, s.ends):
        flags[place] = index.first_place(lo, hi, place) < place if own else True
    return [flags[b : e - span + 1] for b, e in zip(s.begins.tolist(), s.ends.tolist())]


@cache
def _whole(n: int) -> bytes:
    return np.array([0, n], np.int32).tobytes()


def _intervals(flags: np.ndarray) -> bytes | None:
    """Starts and lengths of the runs of true flags."""
    n = int(np.count_nonzero(flags))
    if n in (0, len(flags)):
        return _whole(n) if n else None
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return np.stack([edge[::2], edge[1::2] - edge[::2]]).astype(np.int32).tobytes() if len(edge) else None


def search_shard(strings: list[bytes], gram: np.ndarray, places: np.ndarray, times: np.ndarray, span: int) -> tuple[list[bytes | None], list[bytes | None]]:
    """Intervals of windows that start earlier, for each string's first place and for its later ones.

    Strings are distinct and in order of gram and, within one, of their first places. ``times`` is 2
    where a window may repeat inside its string.
    """
    new = np.r_[True, gram[1:] != gram[:-1]]
    own = [np.zeros(s.count(b" ") + 2 - span, bool) for s in strings]
    later = [f.copy() for f in own]
    streamed = np.flatnonzero(~new | (places > 1))
    if len(streamed):
        founders = np.unique(np.cumsum(new)[streamed] - 1)
        index, symbol = indexed([strings[i] for i in np.flatnonzero(new)[founders]], span)
        for i, found in zip(streamed.tolist(), matched(index, symbol, [strings[i] for i in streamed], span)):
            later[i] = found
            if not new[i]:
                own[i] = found
        del index
    left = np.array([not new[i] and not f.all() for i, f in enumerate(own)])
    group = np.cumsum(new) - 1
    company = np.bincount(group, weights=left)[group] > 1
    rest = np.flatnonzero((times > 1) | left & (company | (places > 1)))
    if len(rest):
        some = [strings[i] for i in rest]
        index, symbol = indexed(some, span)
        for i, found in zip(rest.tolist(), matched(index, symbol, some, span, own=True)):
            own[i] = own[i] | found
            later[i] = np.ones(len(found), bool)  # the string itself is in the index, at its first place
    return [_intervals(f) for f in own], [_intervals(f) if n > 1 else None for f, n in zip(later, places)]


FOUND, FOUND_ARROW = out("gram long, content long, first_id long, first_at int, own binary, later binary")


def _search(span: int):
    def run(batches):
        held, words = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            # in order of first places within grams, and of grams within the shard
            order = np.lexsort((rows.column("at").to_numpy(), rows.column("id").to_numpy(), rows.column("gram").to_numpy()))
            rows = rows.take(pa.array(order)).combine_chunks()
            own, later = search_shard(rows.column("words").to_pylist(), *(rows.column(c).to_numpy() for c in ("gram", "places", "times")), span)
            return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in ("gram", "content", "id", "at")), pa.array(own, pa.binary()), pa.array(later, pa.binary())], schema=FOUND_ARROW)

        for table in groups(batches, "gram"):
            # whole groups of a gram, cut into shards of bounded size between groups
            table = table.combine_chunks()
            gram, windows = table.column("gram").to_numpy(), table.column("windows").to_numpy()
            begin = 0
            for end in [*np.flatnonzero(np.r_[gram[1:] != gram[:-1], True]) + 1]:
                words += int(windows[begin:end].sum()) + (end - begin) * span
                held += table.slice(begin, end - begin).to_batches()
                begin = end
                if words >= SHARD_WORDS:
                    yield flush()
                    held, words = [], 0
        if held:
            yield flush()

    return run


def _with_texts(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text, wanted): documents with the passages asked of them. wanted: (wid, what)."""
    lists = wanted.groupBy("wid").agg(F.collect_list("what").alias("wanted"))
    return slim.join(lists.hint("shuffle_hash"), F.col("id") == F.col("wid")).select("id", "text", "wanted")


def _cooled(slim: DataFrame, suspects: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """The suspects, those of grams with too many different words dealt out by windows."""
    size = F.max("windows").alias("windows")
    hot = suspects.groupBy("gram", "content").agg(size).groupBy("gram").agg(F.sum(F.col("windows") + span).alias("words")).filter(F.col("words") > SHARD_WORDS)
    hot = scratch.keep(hot.select("gram"), "hot")
    if hot.isEmpty():
        return suspects
    asked = suspects.join(hot, "gram", "left_semi").select(F.col("id").alias("wid"), F.struct("at", "windows").alias("what"))
    single = scratch.keep(_with_texts(slim, asked).mapInArrow(_windows(span), PASSAGES), "windows")
    again = single.groupBy("gram").count().filter("count > 1").select("gram")
    return scratch.keep(suspects.join(hot, "gram", "left_anti").unionByName(single.join(again, "gram", "left_semi")), "cooled")


def _searched(slim: DataFrame, suspects: DataFrame, span: int) -> DataFrame:
    """The distinct strings of suspected passages, dealt out by gram and searched."""
    firsts = suspects.groupBy("gram", "content").agg(F.min(F.struct("id", "at")).alias("first"), F.max("windows").alias("windows"), F.count("*").alias("places"), F.max("times").alias("times"))
    what = F.struct(F.col("first.at").alias("at"), "windows", "gram", "content", "places", "times").alias("what")
    strings = _with_texts(slim, firsts.select(F.col("first.id").alias("wid"), what)).mapInArrow(_extract(span), STRINGS)
    return strings.repartition("gram").sortWithinPartitions("gram").mapInArrow(_search(span), FOUND)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """(id, runs): for each document its passages with windows that start earlier somewhere: (at, windows, content, which); which holds starts and lengths of the intervals."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id IS NOT NULL")
    common = spark.sparkContext.broadcast(common_grams(slim))
    every = scratch.keep(slim.mapInArrow(_cut(common, span), PASSAGES), "passages")
    often = scratch.keep(every.groupBy("gram").agg(F.sum("times").alias("n")).filter("n > 1").select("gram"), "often")
    suspects = scratch.keep(every.join(often, "gram", "left_semi"), "suspects")
    scratch.drop("passages", "often")
    suspects = _cooled(slim, suspects, span, scratch)
    found = scratch.keep(_searched(slim, suspects, span), "found")
    judged = suspects.join(found, ["gram", "content"])
    first = (F.col("id") == F.col("first_id")) & (F.col("at") == F.col("first_at"))
    which = F.when(first, F.col("own")).otherwise(F.col("later")).alias("which")
    gone = judged.select("id", "at", "windows", "content", which).filter("which IS NOT NULL")
    return gone.groupBy("id").agg(F.collect_list(F.struct("at", "windows", "content", "which")).alias("runs"))


CLEAN, CLEAN_ARROW = out("id long, n_words long, n_removed long, text string")


def removed_words(words: list[bytes], runs: list[dict], span: int = SPAN) -> np.ndarray:
    begin = np.array([r["at"] for r in runs], np.int64)
    end = begin + np.array([r["windows"] for r in runs], np.int64) + span - 1
    known = np.flatnonzero(end <= len(words))
    same = Content(word_hashes(words)).of(begin[known], end[known]).view(np.int64) == np.array([runs[k]["content"] for k in known], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    for k in known[same].tolist():
        first, count = np.frombuffer(runs[k]["which"], np.int32).reshape(2, -1)
        np.add.at(edge, runs[k]["at"] + first, 1)
        np.add.at(edge, runs[k]["at"] + first + count + span - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _clean(span: int):
    def run(batches):
        for rows in slices(batches):
            n, gone, kept = [], [], []
            for text, runs in zip(as_bytes(rows.column(1)), rows.column(2).to_pylist()):
                words = text.split()
                left = words
                if runs:
                    left = [w for w, g in zip(words, removed_words(words, runs, span).tolist()) if not g]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema=CLEAN_ARROW)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id, n_words, n_removed, text): kept words, joined by single spaces."""
    runs = repeats(docs, id_col, text_col, span).withColumnRenamed("id", "rid")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.join(runs.hint("shuffle_hash"), F.col("id") == F.col("rid"), "left").select("id", "text", "runs").mapInArrow(_clean(span), CLEAN)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = f"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p : p + {SPAN - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {SPAN - 1})) AS p FROM lists)),
repeated AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + {SPAN - 1})) AS p FROM repeated),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM lists)
SELECT l.doc_id, max(len(l.w)) AS n_words, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL AND word IS NOT NULL), '')) AS kept_sha256
FROM lists l LEFT JOIN words w ON l.doc_id = w.doc_id LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY l.doc_id"""
