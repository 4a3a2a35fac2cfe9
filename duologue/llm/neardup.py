"""Near-duplicates by SimHash: keys of decided bits, a pivot distance table, shingle sets compared at the end.

At a Jaccard similarity of 0.8 on five-word shingles two SimHashes differ in 15 % of their bits, 9
of 64, more than any key of agreeing bits covers. But the votes behind the bits are known: the place with the
clearest majority of a block of ``PLACES`` stays the same place, with the same bit, in 40 % of the
blocks of such a pair, and in one of 256 of unrelated texts. A key is the clearest places and bits of
two neighbouring blocks; a SimHash of ``BLOCKS`` blocks has as many keys. Texts that share a key are
compared by the pivot distances of ``WORDS`` words of their SimHash, then by its bits
(``MEET_RADIUS``); what these links connect is a cluster. Votes that tie are told apart by smaller
votes of the set's 16 least shingles. A key with more than ``HOT`` classes puts them all in one
cluster, which loses no link. Inside a cluster the pivot table of 64-bit SimHash distances discards
pairs whose coordinates differ by more than ``RADIUS``, Hamming distance those beyond it, and the
shingle sets decide.

Documents with the same words are one class before anything is compared. Clusters of more than
``BLOCK`` classes are split into blocks: each block is compared with itself and with the cluster's
first ``LANDMARKS`` classes. The parts that these links join are then compared across every pair of
blocks, a task for each pair, wherever two classes are of different parts; so no pair of blocks
hides a link and no task holds more than two blocks. Classes of a cluster's largest part meet only
those of other parts, which costs nothing where one part is the whole cluster. The split loses no
link between classes of one cluster. The keys may: two documents at a similarity of 0.8 share one of
them with probability 0.997, at 0.85 with 0.9998; ``BLOCKS`` sets it.

Null and empty texts have no words and are copies of each other; fewer words than a shingle count
as one shingle. Rows without an id have no group. Rows that repeat an id share a group. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duologue.llm.batches import as_bytes, batch, groups, out, slices
from duologue.llm.components import components
from duologue.llm.simhash import EDGES, EDGES_ARROW, PIVOTS, pivot_table, pivots
from duologue.llm.store import Scratch

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of the SimHash that deals pairs out, and bit places in each.
BLOCKS, PLACES = 48, 128
#: Words of that SimHash which travel with a key, and bits in which those of similar sets may differ: 0.8 similar sets exceed it about once in a million pairs.
WORDS, MEET_RADIUS = 3, 54
HOT = 2048
#: Bits in which SimHashes of similar sets may differ; 0.8 similar sets exceed it about once in a million pairs.
RADIUS = 26
BLOCK, LANDMARKS = 2048, 16
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 1 << 63, BLOCKS * PLACES // 64, dtype=np.uint64) | np.uint64(1)
TIE_FACTORS = _RNG.integers(1, 1 << 63, BLOCKS * PLACES // 8, dtype=np.uint64) | np.uint64(1)
REFS = _RNG.integers(0, 1 << 63, (PIVOTS, WORDS), dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, (PIVOTS, WORDS), dtype=np.uint64)
_LOW = np.uint64(0x0101010101010101)

PRINTS, PRINTS_ARROW = out("id long, x long, y long, fp long, n long, shingles binary, wide array<long>, keys array<long>")


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles, ASCII letters lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: max(1, len(words) - n + 1)].tolist(), end[min(n, len(words)) - 1 :].tolist()
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(start, end)], np.uint64))


def _mixed(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A word for each hash and factor."""
    some = hashes[:, None] * factors
    some ^= some >> np.uint64(32)
    some *= np.uint64(0x9E3779B97F4A7C15)
    some ^= some >> np.uint64(29)
    return some


def votes(shingles: np.ndarray) -> np.ndarray:
    """The majority at each place of the SimHash of ``BLOCKS`` blocks, positive for ones; in 1/4096 of a vote, ties are told apart."""
    ones = np.zeros((8, len(FACTORS) * 8), np.int64)
    for at in range(0, len(shingles), 255):  # a byte a place holds the count
        some = _mixed(shingles[at : at + 255], FACTORS)
        for bit in range(8):
            ones[bit] += ((some >> np.uint64(bit)) & _LOW).sum(axis=0).view(np.uint8)
    least = shingles[:16]
    ties = _mixed(least, TIE_FACTORS).view(np.uint8).sum(axis=0, dtype=np.int64)
    return (2 * ones.ravel() - len(shingles)) * 4096 + 2 * ties - 255 * len(least)


def simhash_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the SimHash that are compared, and its keys: the clearest place and its bit of each two neighbouring blocks."""
    vote = votes(shingles)
    wide = np.packbits(vote[: 64 * WORDS] > 0, bitorder="little").view(np.uint64)
    vote = vote.reshape(BLOCKS, PLACES)
    place = np.abs(vote).argmax(axis=1)
    clear = 2 * place + (vote[np.arange(BLOCKS), place] > 0)
    return wide, (np.arange(BLOCKS) * 2 * PLACES + clear) * 2 * PLACES + np.roll(clear, -1)


def _prints(n: int):
    def run(batches):
        for rows in slices(batches):
            ids, columns = rows.column(0).to_pylist(), [[] for _ in PRINTS_ARROW]
            for i, text in zip(ids, as_bytes(rows.column(1))):
                if i is None:
                    continue
                digest = xxhash.xxh3_128_intdigest(b" ".join(text.lower().split()))
                s = shingle_set(text, n)
                ones = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
                fp = int.from_bytes(np.packbits(2 * ones > len(s), bitorder="little").tobytes(), "little")
                small = np.unique((s >> np.uint64(32)).astype(np.uint32))
                wide, keys = simhash_keys(s)
                row = (i, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), fp - (1 << 64) if fp >> 63 else fp, len(small), small.tobytes(), wide.view(np.int64), keys)
                for c, v in zip(columns, row):
                    c.append(v)
            yield batch(PRINTS_ARROW, *columns)

    return run


def meeting(key: np.ndarray, rep: np.ndarray, wide: np.ndarray, radius: int = MEET_RADIUS, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each row to the first one that SimHash links reach from it within its key. Equal keys stand together; a key of more than ``hot`` rows is linked to its first."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    first = np.repeat(starts, sizes)
    crowded = np.flatnonzero((np.repeat(sizes, sizes) > hot) & (first != np.arange(len(key))))
    some = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= hot), sizes))
    group, own, bits, root = first[some], rep[some], wide[some], np.arange(len(some))
    table = np.bitwise_count(bits[:, None] ^ REFS).sum(axis=2, dtype=np.int16)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    left, step = np.arange(len(some)), 1
    while len(left := left[left + step < len(some)]) and len(left := left[group[left] == group[left + step]]):
        near = left[root[left] != root[left + step]]
        for at in range(0, PIVOTS, 4):  # coordinate by coordinate, on what is left
            near = near[(np.abs(table[near, at : at + 4] - table[near + step, at : at + 4]) <= radius).all(axis=1)]
        near = near[np.bitwise_count(bits[near] ^ bits[near + step]).sum(axis=1) <= radius]
        for i in near.tolist():
            x, y = find(i), find(i + step)
            root[max(x, y)] = min(x, y)
        step += 1
    linked = np.flatnonzero(root != np.arange(len(some)))
    to = np.array([find(i) for i in linked.tolist()], np.int64)
    return np.r_[rep[crowded], own[linked]], np.r_[rep[first[crowded]], own[to]]


def _meet(radius: int, hot: int):
    """Edges among rows sorted by key and class, so that keys share most of them; of an open key no more than a batch beyond ``hot`` rows is held."""

    def run(batches):
        held = np.zeros((0, 2 + WORDS), np.int64)
        for now in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in now.columns], axis=1)])
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            done, held = rows[:cut], rows[cut:]
            if len(held) > hot + 1:
                # linked to its first row as it comes; the rows kept say that the key is crowded
                done, held = rows, held[: hot + 1]
            if len(done):
                a, b = meeting(done[:, 0], done[:, 1], done[:, 2:].view(np.uint64), radius, hot)
                if len(a):
                    yield batch(EDGES_ARROW, a, b)
        if len(held):
            a, b = meeting(held[:, 0], held[:, 1], held[:, 2:].view(np.uint64), radius, hot)
            if len(a):
                yield batch(EDGES_ARROW, a, b)

    return run


def similar(sets: list[np.ndarray], fps: np.ndarray, similarity: float, radius: int, parts: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``side``, of links between its two values and of different ``parts``."""
    m, refs = len(sets), pivots()
    sizes = np.array([len(s) for s in sets])
    vocabulary, numbers = np.unique(np.concatenate(sets), return_inverse=True) if m else (np.zeros(0), np.zeros(0, np.int64))
    starts = np.cumsum(sizes) - sizes
    table, root, mark, found = pivot_table(fps, refs), np.arange(m) if parts is None else parts.copy(), np.zeros(len(vocabulary), bool), []
    for i in range(m):
        ok = root != root[i]
        ok[: i + 1] = False
        if side is not None:
            ok &= side != side[i]
        ok &= (sizes >= similarity * sizes[i]) & (sizes * similarity <= sizes[i])
        near = np.flatnonzero(ok)
        near = near[(np.abs(table[near] - table[i]) <= radius).all(axis=1)]
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
        if not len(near):
            continue
        own = numbers[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        for j in near.tolist():
            if root[j] == root[i]:
                continue
            both = int(mark[numbers[starts[j] : starts[j] + sizes[j]]].sum())
            if both >= similarity * (sizes[i] + sizes[j] - both):
                found.append((i, j))
                root[root == root[j]] = root[i]
        mark[own] = False
    return found


def _compare(similarity: float, radius: int, across: bool):
    """Links inside each block, or across the two sides of a pair of blocks."""

    def run(batches):
        for table in groups(batches, "block"):
            table = table.combine_chunks()
            block, rep, fps = (table.column(c).to_numpy() for c in ("block", "rep", "fp"))
            parts, side = (table.column(c).to_numpy() for c in ("joined", "side")) if across else (None, None)
            data = table.column("shingles").to_pylist()
            bounds = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            a, b = [], []
            for lo, hi in zip(bounds, bounds[1:]):
                sets = [np.frombuffer(x, np.uint32) for x in data[lo:hi]]
                links = similar(sets, fps[lo:hi].astype(np.uint64), similarity, radius, *((parts[lo:hi], side[lo:hi]) if across else ()))
                a += [rep[lo + i] for i, _ in links]
                b += [rep[lo + j] for _, j in links]
            if a:
                yield batch(EDGES_ARROW, a, b)

    return run


def _across(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the pairs of blocks of large clusters in which classes of different parts may meet."""
    joined = components(edges).select(F.col("node").alias("rep"), F.col("root").alias("joined"))
    large = placed.filter("parts IS NOT NULL").join(joined, "rep", "left").withColumn("joined", F.coalesce("joined", "rep"))
    largest = large.groupBy("cluster", "joined").count().groupBy("cluster").agg(F.max_by("joined", F.struct("count", "joined")).alias("largest"))
    large = large.join(largest, "cluster").withColumn("outside", F.col("joined") != F.col("largest"))
    holds = large.filter("outside").select("cluster", F.col("part").alias("other"), F.lit(True).alias("holds")).distinct()
    meeting = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part <> other").join(holds, ["cluster", "other"], "left").filter("outside OR holds")
    return meeting.select(F.xxhash64("cluster", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "rep", "fp", "shingles", "joined", (F.col("part") < F.col("other")).cast("int").alias("side"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(id, group): for each id the smallest id that links of at least ``similarity`` reach from it, itself included."""
    scratch = Scratch(docs.sparkSession, "neardup")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = scratch.keep(slim.mapInArrow(_prints(shingle), PRINTS), "prints")
    same = scratch.keep(prints.groupBy("x", "y").agg(F.min("id").alias("rep")), "same")
    # a class is known by its smallest id; rows that repeat that id are one
    member = prints.select("id", "x", "y").join(same, ["x", "y"]).select("id", "rep")
    reps = prints.join(same.select(F.col("rep").alias("id"), F.col("x").alias("rx"), F.col("y").alias("ry")), "id").filter("x = rx AND y = ry AND n > 0").dropDuplicates(["id", "x", "y"])
    keyed = reps.select(F.explode("keys").alias("key"), F.col("id").alias("rep"), *(F.col("wide")[w].alias(f"w{w}") for w in range(WORDS)))
    met = keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_meet(MEET_RADIUS, hot), EDGES)
    # what a class met under its keys, at most one class a key, is tied to the least of it; keys agree on most of these edges
    met = met.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("met"))
    meets = met.select(F.explode(F.concat(F.array("a"), F.slice("met", 2, BLOCKS))).alias("a"), F.col("met")[0].alias("b"))
    clusters = scratch.keep(components(meets).select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "clusters")
    slimmer = reps.select(F.col("id").alias("rep"), "fp", "shingles").join(clusters, "rep")
    sizes = clusters.groupBy("cluster").count().filter(F.col("count") > block).select("cluster", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    large = scratch.keep(sizes, "large")
    placed = scratch.keep(slimmer.join(large, "cluster", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))), "placed")
    key = F.xxhash64("cluster", "part").alias("block")
    row = [key, "rep", "fp", "shingles"]
    members = placed.select(*row)
    split = not large.isEmpty()
    if split:
        # the first classes of each large cluster by id: at most LANDMARKS a cluster, sent to each of its blocks
        first = placed.filter("parts IS NOT NULL").groupBy("cluster").agg(F.min("rep").alias("rep"))
        least = placed.filter("parts IS NOT NULL").withColumn("slot", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(LANDMARKS))).groupBy("cluster", "slot").agg(F.min("rep").alias("rep")).select("cluster", "rep").unionByName(first).distinct()
        marks = placed.join(least, ["cluster", "rep"], "left_semi").withColumn("home", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part <> home")
        members = members.unionByName(marks.select(*row))
    compared = members.repartition("block").sortWithinPartitions("block").mapInArrow(_compare(similarity, radius, False), EDGES)
    edges = scratch.keep(compared, "compared")
    if split:
        more = _across(placed, edges).repartition("block").sortWithinPartitions("block").mapInArrow(_compare(similarity, radius, True), EDGES)
        edges = scratch.keep(edges.unionByName(more), "edges")
    # copies of an id under several texts tie their classes together
    ties = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    found = components(scratch.keep(edges.unionByName(ties), "links"))
    named = member.join(found, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("group"))
    return named.groupBy("id").agg(F.min("group").alias("group"))
