"""SimHash near-duplicates: fingerprints, a pivot distance table, verified links, components.

A document's fingerprint takes the majority of its shingle hashes at each of 64 bits. Distinct
fingerprints meet only under keys that any two within ``radius`` bits must share (of
``radius + 2`` blocks at least two agree exactly). There the pivot distance table decides: the
Hamming distances of each fingerprint to ``PIVOTS`` reference fingerprints are computed once, a
pair whose largest coordinate difference exceeds the radius is discarded by the triangle
inequality, and survivors are verified on the bits themselves. Pivot distances alone cannot deal
pairs out: distances between random fingerprints gather around 32, so cells of a pivot table hold
a large share of all rows.

Keys with more than ``HOT`` fingerprints are found first, by a combined count, and dealt out again
under finer keys (of seven blocks of the rest four must agree), whose groups have at most 2^17
distinct members by construction. Within a group only edges of a spanning forest leave a task.

Defined cases: null or empty texts have fingerprint zero and link like any other. Rows without an
id get their fingerprint, a null component, and link to nothing. Rows that repeat an id are each
returned. Empty tables give empty results. Input columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm.batches import as_bytes, batch, groups, out, slices
from duologue.llm.components import components
from duologue.llm.store import Scratch

SEED = 42
SHINGLE = 3
RADIUS = 3
PIVOTS = 16
HOT = 2048
#: Shingles whose hashes are in memory at once, for very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of ASCII-lower-cased UTF-8 text over word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(start), CHUNK):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(start[at : at + CHUNK], end[at : at + CHUNK])], np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start), bitorder="little").tobytes(), "little")


FINGERPRINTS, FINGERPRINTS_ARROW = out("id long, fp long")


def _fingerprints(shingle: int):
    def run(batches):
        for rows in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(rows.column(1))], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps)], schema=FINGERPRINTS_ARROW)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints(shingle), FINGERPRINTS)


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks over the given bit places."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _masks(radius: int) -> list[int]:
    return [a | b for a, b in combinations(_blocks(list(range(64)), radius + 2), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each mask: the masked bits and the mask's number, as one key."""
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks))))
    return fps.select(key.alias("x"), "fp", "rep").select("x.m", "x.k", "fp", "rep")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: pseudo-random and fixed, so that every task has the same table."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def forest(group: np.ndarray, fps: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links within groups. group: sorted, equal values stand together."""
    table, n = pivot_table(fps, refs), len(fps)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    left, step, a, b = np.arange(n), 1, [], []
    while len(left := left[left + step < n]) and len(left := left[group[left] == group[left + step]]):
        near = left
        for at in range(0, table.shape[1], 4):  # coordinate by coordinate, on what is left
            near = near[(np.abs(table[near, at : at + 4] - table[near + step, at : at + 4]) <= radius).all(axis=1)]
        near = near[root[near] != root[near + step]]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        for i in near.tolist():
            x, y = find(i), find(i + step)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(i)
                b.append(i + step)
        step += 1
    return np.array(a, np.int64), np.array(b, np.int64)


EDGES, EDGES_ARROW = out("a long, b long")


def _link(radius: int):
    def run(batches):
        refs = pivots()
        for table in groups(batches, "k"):
            table = table.combine_chunks()
            k, m = (table.column(c).to_numpy() for c in ("k", "m"))
            fps, reps = table.column("fp").to_numpy().astype(np.uint64), table.column("rep").to_numpy()
            new = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]
            a, b = forest(np.cumsum(new), fps, radius, refs)
            if len(a):
                yield batch(EDGES_ARROW, reps[a], reps[b])

    return run


def _dealt(keyed: DataFrame, radius: int) -> DataFrame:
    return keyed.select("k", "m", "fp", "rep").repartition("k", "m").sortWithinPartitions("k", "m").mapInArrow(_link(radius), EDGES)


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): edges that connect what links of at most ``radius`` differing bits connect. fps: distinct (fp, rep)."""
    scratch = scratch or Scratch(fps.sparkSession, "links")
    masks = _masks(radius)
    keyed = _keyed(fps, masks)
    crowded = scratch.keep(keyed.groupBy("m", "k").count().filter(F.col("count") > hot).select("m", "k"), "crowded")
    if crowded.isEmpty():
        return _dealt(keyed, radius)
    found = _dealt(keyed.join(crowded, ["m", "k"], "left_anti"), radius)
    # each crowded key is dealt out again under the finer masks of its own mask, all in one pass
    finer = []
    for mask in masks:
        blocks = _blocks([b for b in range(64) if not mask >> b & 1], 2 * radius + 1)
        finer.append([mask | sum(c) for c in combinations(blocks, radius + 1)])
    table = F.array(*(F.array(*(F.lit(_signed(x)) for x in row)) for row in finer))
    rest = keyed.join(crowded, ["m", "k"], "left_semi").select("m", "fp", "rep", F.posexplode(F.element_at(table, F.col("m") + 1)).alias("n", "mask"))
    again = rest.select((F.col("m") * len(finer[0]) + F.col("n")).alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp", "rep")
    return found.unionByName(_dealt(again, radius))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id that links reach from it."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = scratch.keep(prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    found = components(scratch.keep(links(distinct, radius, hot, scratch), "links"))
    classes = distinct.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("cfp"), F.coalesce("root", "rep").alias("component"))
    return prints.join(classes, (F.col("fp") == F.col("cfp")) & F.col("id").isNotNull(), "left").select("id", "fp", "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
