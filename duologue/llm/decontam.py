"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first pass over the texts counts, for every word n-gram of the test items, the documents that hold
it, and those that hold it *apart*, with neither neighbour beside it an n-gram of an item. A phrase
of the language stands apart in many documents. A leaked item does not, exact or edited, in however
many documents it is, since wherever more than n of its words are whole its n-grams stand side by
side. Seeds of an item are its n-grams that stand apart in few documents and in few other items; an
item made of common phrases only keeps its rarest. A second pass joins the texts with the seeds
alone: places that share some with an item, on diagonals close together, are a passage.

No alignment scores more than the words that passage and item have in common, so passages with too
few of them are not aligned, which is exact. The score is the best local alignment's over that of
the item with itself, words as letters, so edited copies score high and chance phrases low. A copy
so edited that only common phrases of it are whole has no seed and is not found; one that an
insertion of more than a quarter of the item cuts in two is scored by its better part.

The items travel to the tasks in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark is
handled block by block, each with two passes of its own.

Null or empty texts and items, and items of fewer words than an n-gram, match nothing. Rows
without an id are skipped. Rows that repeat an id count as one document with the best score.
Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm.batches import as_bytes, batch, out, slices

NGRAM = 4
MIN_SCORE = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 32 << 20
#: A seed stands apart in at most this share of the documents, or in so many.
APART_SHARE, APART_LEAST = 1e-3, 8
#: A seed is in at most so many items more than twice as many as its item's n-gram that is in fewest.
OTHER_ITEMS = 8
PLAIN = bytes((c + 32) if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """ASCII letters lower-cased, ASCII punctuation as space."""
    return text.translate(PLAIN).split()


def codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for the n-gram at each place; equal n-grams have equal codes, and alignment settles the rest."""
    x, code = ids.astype(np.uint64) + np.uint64(1), np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        code = (code ^ x[j : len(x) - n + 1 + j]) * FACTOR
        code ^= code >> np.uint64(29)
    return code


class Items:
    """Test items as vocabulary numbers, with their n-grams in order of code."""

    def __init__(self, rows: list[tuple[int, bytes]], n: int):
        self.n, self.vocabulary = n, {}
        self.tokens: dict[int, np.ndarray] = {}
        every, item, place = [], [], []
        for i, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int32)
            if len(ids) < n:
                continue
            self.tokens[i] = ids
            c = codes(ids, n)
            every.append(c)
            item.append(np.full(len(c), i))
            place.append(np.arange(len(c)))
        if not every:
            self.grams = np.zeros(0, np.uint64)
            return
        code, item, place = np.concatenate(every), np.concatenate(item), np.concatenate(place)
        order = np.argsort(code, kind="stable")
        self._set(code[order], item[order], place[order])

    def _set(self, code: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        self.grams, first = np.unique(code, return_index=True)
        self.first = np.r_[first, len(code)]
        self.item, self.place = item, place

    def only_seeds(self, docs: np.ndarray, apart: np.ndarray, n_docs: int) -> None:
        """Keeps the rare n-grams of each item. docs, apart: counts for each n-gram."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        _, item = np.unique(self.item, return_inverse=True)
        pair = np.unique(gram * (int(item.max()) + 1) + item)
        holders = np.bincount(pair // (int(item.max()) + 1), minlength=len(self.grams))[gram]

        def least(values: np.ndarray) -> np.ndarray:
            low = np.full(item.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, item, values)
            return low[item]

        occurs = docs[gram] > 0
        limit = max(APART_LEAST, APART_SHARE * n_docs)
        shared = holders <= OTHER_ITEMS + 2 * least(holders)
        spread = np.where(occurs & shared, apart[gram], np.iinfo(np.int64).max)
        seed = occurs & shared & ((spread <= limit) | (spread <= least(spread)))
        self._set(self.grams[gram[seed]], self.item[seed], self.place[seed])


def in_common(item: np.ndarray, passage: np.ndarray) -> int:
    """Words of the item that the passage has too, repeated ones as often as in both: no alignment matches more."""
    word, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(word, passage), len(word) - 1)
    there = np.bincount(at[word[at] == passage], minlength=len(word))
    return int(np.minimum(n, there).sum())


def _look_up(items: Items, rows):
    """A batch's (documents, word numbers, starts, sizes, places of n-grams of items, their numbers, their documents), or None."""
    get = items.vocabulary.get
    docs = [(i, [get(w, -1) for w in words(t)]) for i, t in zip(rows.column(0).to_pylist(), as_bytes(rows.column(1))) if i is not None and t]
    if not docs:
        return None
    sizes = np.array([len(x) for _, x in docs])
    ids = np.full(int(sizes.sum()) + items.n * len(docs), -1, np.int32)  # documents stand apart
    starts = np.cumsum(sizes + items.n) - sizes - items.n
    for s, (_, x) in zip(starts.tolist(), docs):
        ids[s : s + len(x)] = x
    known = ids >= 0
    whole = known[: len(ids) - items.n + 1].copy()
    for j in range(1, items.n):
        whole &= known[j : len(ids) - items.n + 1 + j]
    at = np.flatnonzero(whole)
    code = np.zeros(len(at), np.uint64)
    for j in range(items.n):
        code = (code ^ (ids[at + j].astype(np.uint64) + np.uint64(1))) * FACTOR
        code ^= code >> np.uint64(29)
    spot = np.minimum(np.searchsorted(items.grams, code), len(items.grams) - 1)
    hit = items.grams[spot] == code
    at, spot = at[hit], spot[hit]
    return docs, ids, starts, sizes, at, spot, np.searchsorted(starts, at, "right") - 1


COUNTS, COUNTS_ARROW = out("gram long, docs long, apart long")


def _count(shared):
    def run(batches):
        items: Items = shared.value
        for rows in slices(batches):
            looked = _look_up(items, rows)
            if looked is None or not len(looked[4]):
                continue
            *_, at, spot, doc = looked
            alone = np.r_[True, np.diff(at) > 1] & np.r_[np.diff(at) > 1, True]
            # the documents of each n-gram, each once
            pairs, first = np.unique(spot.astype(np.int64) * (int(doc[-1]) + 1) + doc, return_inverse=True)
            lonely = np.bincount(first, weights=alone) > 0
            gram = pairs // (int(doc[-1]) + 1)
            grams, which = np.unique(gram, return_inverse=True)
            yield batch(COUNTS_ARROW, grams, np.bincount(which), np.bincount(which, weights=lonely).astype(np.int64))

    return run


def gram_counts(slim: DataFrame, shared) -> DataFrame:
    """(gram, docs, apart) of the n-grams of items that occur, by their numbers. slim: (id, text)."""
    return slim.mapInArrow(_count(shared), COUNTS).groupBy("gram").agg(F.sum("docs").alias("docs"), F.sum("apart").alias("apart"))


HITS, HITS_ARROW = out("id long, item long, at long, passage binary")


def _find(shared, min_score: float):
    def run(batches):
        items: Items = shared.value
        for rows in slices(batches):
            looked = _look_up(items, rows)
            if looked is None:
                continue
            docs, ids, starts, sizes, at, spot, doc = looked
            out_rows: list[tuple] = []
            found: dict[tuple[int, int], list[int]] = {}
            for p, g, d in zip(at.tolist(), spot.tolist(), doc.tolist()):
                for k in range(items.first[g], items.first[g + 1]):
                    found.setdefault((d, int(items.item[k])), []).append(p - int(starts[d]) - int(items.place[k]))
            for (d, item), hits in found.items():
                size, pad = len(items.tokens[item]), len(items.tokens[item]) // 4 + 2
                hits.sort()
                group = [hits[0]]
                for h in [*hits[1:], None]:
                    if h is None or h - group[-1] > pad:  # diagonals far apart are different passages
                        a, b = max(0, group[0] - pad), min(int(sizes[d]), group[-1] + size + pad)
                        passage = ids[starts[d] + a : starts[d] + b]
                        if in_common(items.tokens[item], passage) >= min_score * size:
                            out_rows.append((docs[d][0], item, a, passage.tobytes()))
                        group = []
                    if h is not None:
                        group.append(h)
            if out_rows:
                yield batch(HITS_ARROW, *map(list, zip(*out_rows)))

    return run


def _matrix_best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of a against b, and where it ends in both (exclusive)."""
    row, steps, best = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1) * -GAP, (0, 0, 0)
    for i, x in enumerate(a):
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score over the item's own, start and end in the passage) of the best Smith-Waterman alignment."""
    best, i, j = _matrix_best(item, passage)
    if not best:
        return 0.0, 0, 0
    _, _, back = _matrix_best(item[:i][::-1], passage[:j][::-1])
    return best / (MATCH * len(item)), j - back, j


SCORED, SCORED_ARROW = out("id long, item long, score double, start long, end long, length long")


def _align(shared):
    def run(batches):
        items: Items = shared.value
        for rows in slices(batches):
            done = []
            for i, item, at, passage in zip(*(c.to_pylist() for c in rows.columns)):
                tokens = items.tokens[item]
                score, a, b = align(tokens, np.frombuffer(passage, np.int32))
                done.append((i, item, score, at + a, at + b, len(tokens)))
            if done:
                yield batch(SCORED_ARROW, *map(list, zip(*done)))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; a block at a time is in memory."""
    blocks, now, size = [], [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t")
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        if now and size + len(text) > BLOCK_BYTES:
            blocks.append(now)
            now, size = [], 0
        now.append((r["i"], text))
        size += len(text)
    return [*blocks, now] if now else blocks


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, item, score, start, end): documents that hold a test item, with the words where its best alignment lies."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found, n_docs = spark.createDataFrame([], "id long, item long, score double, start long, end long"), None
    for rows in _blocks(benchmark, item_col, item_text_col):
        items = Items(rows, n)
        if not len(items.grams):
            continue
        everything = spark.sparkContext.broadcast(items)
        # a row for each n-gram of the block that occurs; the block's size bounds them
        counted = np.array([(r["gram"], r["docs"], r["apart"]) for r in gram_counts(slim, everything).collect()], np.int64).reshape(-1, 3)
        if not len(counted):
            continue
        counts = np.zeros((2, len(items.grams)), np.int64)
        counts[:, counted[:, 0]] = counted[:, 1:].T
        n_docs = slim.count() if n_docs is None else n_docs
        items.only_seeds(*counts, n_docs)
        shared = spark.sparkContext.broadcast(items)
        hits = slim.mapInArrow(_find(shared, min_score), HITS)
        scored = hits.repartition("id").mapInArrow(_align(shared), SCORED).filter(F.col("score") >= min_score)
        best = scored.groupBy("id", "item").agg(F.max(F.struct("score", F.negative("start").alias("s"), "end")).alias("x"))
        found = found.unionByName(best.select("id", "item", "x.score", F.negative("x.s").alias("start"), "x.end"))
    return found


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def op6_seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts from which ``op6_decontamination`` chooses its seeds: (gram, items, docs), for every n-gram of an item that is in a document."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.createDataFrame([], "gram string, item long, docs long")
    slim = docs.select(F.col("doc_id").alias("id"), "text")
    for rows in _blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text"):
        items = Items(rows, NGRAM)
        if len(items.grams):
            names = list(items.vocabulary)
            texts = [b" ".join(names[x] for x in items.tokens[items.item[k]][items.place[k] : items.place[k] + NGRAM]).decode() for k in items.first[:-1]]
            pairs = sorted({(g, int(items.item[k])) for g in range(len(texts)) for k in range(items.first[g], items.first[g + 1])})
            held = spark.createDataFrame([(g, texts[g], i) for g, i in pairs], "number long, gram string, item long")
            counted = gram_counts(slim, spark.sparkContext.broadcast(items))
            found = found.unionByName(held.join(counted, F.col("number") == counted["gram"]).select(held["gram"], "item", "docs"))
    return found.groupBy("gram").agg(F.count("*").alias("items"), F.max("docs").alias("docs"))


SQL = f"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
listed AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM texts WHERE text IS NOT NULL AND id IS NOT NULL),
grams AS (SELECT DISTINCT side, id, array_to_string(w[p : p + {NGRAM - 1}], ' ') AS gram FROM (SELECT side, id, w, unnest(generate_series(1, len(w) - {NGRAM - 1})) AS p FROM listed))
SELECT gram, count(*) FILTER (WHERE side = 'i') AS items, count(*) FILTER (WHERE side = 'd') AS docs
FROM grams GROUP BY gram HAVING count(*) FILTER (WHERE side = 'i') > 0 AND count(*) FILTER (WHERE side = 'd') > 0"""
