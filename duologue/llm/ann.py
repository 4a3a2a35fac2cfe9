"""Nearest neighbours by a forest of random-projection trees and one shared priority queue.

Equal vectors are one class with its smallest ids, so a vector that a third of all rows share is
indexed once. The depth of the trees follows the number of classes, so a leaf holds about ``LEAF``
of them at every size. The upper levels are median splits along differences of random pairs, fitted
on at most ``SAMPLE`` vectors. Below, where a leaf of the sample has few vectors, splits go through
their centre along directions that a level and tree share, so the model does not grow with the
table. Every class goes to one leaf of each tree. A query walks all trees through a single queue
ordered by its worst margin on the way, and visits the best ``probes`` leaves of the whole forest.
Members and visiting queries meet leaf by leaf, where candidates are ranked by exact inner products
in double precision; the best of a query's leaves are merged. A leaf that came out larger than
``CROWDED`` times ``LEAF`` is cut into parts, and its visitors go to all of them.

How many leaves to visit is measured, not guessed: for ``PILOTS`` queries the true neighbours are
found among all rows, and ``probes`` is the smallest number of visits that reaches ``RECALL`` of
them. A query whose leaves hold fewer candidates than asked for visits four times as many, again
until it has them or has seen every leaf.

Vectors that are null, zero, of another length than most (of equally frequent lengths the least), or hold null or non-finite components
take no part, as queries or candidates. Rows without an id take no part. Rows that repeat an id
with the same vector count once; an id with several vectors asks with each of them. Fewer than k candidates: all of them. Empty tables: empty result.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duologue.llm.batches import groups, out
from duologue.llm.store import Scratch

K = 20
TREES = 6
LEAF = 512
#: A leaf of more than so many times LEAF is cut into parts.
CROWDED = 8
SAMPLE = 16_384
PILOTS = 64
RECALL = 0.97
QUERY_EVERY = 20


class Forest:
    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        #: levels that the sample can fit, with about eight vectors below each of them
        self.fitted = min(self.depth, max(0, int(np.log2(max(1, len(sample) / 8)))))
        self.leaves, nodes, dim = 1 << self.depth, (1 << self.fitted) - 1, sample.shape[1]
        self.normals = np.zeros((trees, nodes, dim))
        self.offsets = np.zeros((trees, nodes))
        shared = rng.normal(size=(trees, self.depth - self.fitted, dim))
        self.shared = shared / np.linalg.norm(shared, axis=2, keepdims=True)
        #: where the centre of each fitted leaf lies along the shared directions
        self.centres = np.zeros((trees, nodes + 1, self.depth - self.fitted))
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for k in range(nodes):
                own = np.flatnonzero(at == k)
                pair = sample[rng.choice(own, 2, replace=False)] if len(own) > 1 else np.zeros((2, dim))
                w = pair[0] - pair[1]
                w = w if np.abs(w).max() > 0 else rng.normal(size=len(w))
                self.normals[t, k] = w / np.abs(w).max() / np.linalg.norm(w / np.abs(w).max())
                side = sample[own] @ self.normals[t, k]
                self.offsets[t, k] = np.median(side) if len(own) else 0
                at[own] = 2 * k + 1 + (side > self.offsets[t, k])
            along = sample @ self.shared[t].T
            for leaf_ in range(nodes + 1):
                own = at == leaf_ + nodes
                if own.any():
                    self.centres[t, leaf_] = along[own].mean(axis=0)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered over the whole forest."""
        found = np.empty((len(x), self.trees), np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.fitted):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.normals[t][at]) > self.offsets[t][at])
            at -= (1 << self.fitted) - 1
            sides = x @ self.shared[t].T > self.centres[t][at]
            for level in range(self.depth - self.fitted):
                at = 2 * at + sides[:, level]
            found[:, t] = t * self.leaves + at
        return found

    def visits(self, x: np.ndarray):
        """For each vector an iterator over all leaves in the order of the shared queue."""
        margins = np.einsum("ij,tkj->itk", x, self.normals) - self.offsets
        along = np.einsum("ij,tlj->itl", x, self.shared)
        for own, lower in zip(margins.tolist(), along):
            yield self._walk(own, lower)

    def _walk(self, own: list[list[float]], lower: np.ndarray):
        base, extra = (1 << self.fitted) - 1, self.depth - self.fitted
        queue: list[tuple[float, int, int, int]] = [(-np.inf, t, 0, 0) for t in range(self.trees)]  # margin, tree, level, node of the level
        while queue:
            worst, t, level, k = heapq.heappop(queue)
            if level == self.depth:
                yield t * self.leaves + k
                continue
            if level < self.fitted:
                m = own[t][(1 << level) - 1 + k]
            else:
                m = float(lower[t, level - self.fitted] - self.centres[t, k >> (level - self.fitted), level - self.fitted])
            heapq.heappush(queue, (max(worst, m), t, level + 1, 2 * k))
            heapq.heappush(queue, (max(worst, -m), t, level + 1, 2 * k + 1))


def probes_for(forest: Forest, queries: np.ndarray, found: list[list[np.ndarray]], recall: float) -> int:
    """Visits after which the queries have met ``recall`` of their neighbours. found: for each query its neighbours' leaves."""
    total = sum(map(len, found))
    open_ = [(walk, [set(x.tolist()) for x in f]) for walk, f in zip(forest.visits(queries), found)]
    met, visits = 0, 0
    while met < recall * total:
        visits += 1
        for walk, wanted in open_:
            leaf = next(walk, None)
            hit = [w for w in wanted if leaf in w]
            met += len(hit)
            for w in hit:
                wanted.remove(w)
    return max(1, visits)


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Vectors as they were given, single or double, in double precision."""
    data = b"".join(x for x in column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1).astype(np.float64, copy=False)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


PILOT, PILOT_ARROW = out("pilot int, cid long, score double, leaves binary")


def _pilot(shared, k: int):
    def run(batches):
        forest, queries, dtype = shared.value
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, forest.trees), np.int64))] * len(queries)
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dtype)
            scores, leaves = x @ queries.T, forest.place(x)
            for i in range(len(queries)):
                s, c, r = (np.concatenate([a, z]) for a, z in zip(held[i], (scores[:, i], ids, leaves)))
                best = _top(s, c, k)
                held[i] = s[best], c[best], r[best]
        if any(len(s) for s, _, _ in held):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), [len(s) for s, _, _ in held]), pa.int32()), pa.array(np.concatenate([c for _, c, _ in held])), pa.array(np.concatenate([s for s, _, _ in held])), pa.array([r.tobytes() for _, _, rs in held for r in rs], pa.binary())], schema=PILOT_ARROW)

    return run


COUNTED, COUNTED_ARROW = out("leaf long, n long")


def _count(shared):
    def run(batches):
        for b in batches:
            if b.num_rows:
                leaf, n = np.unique(shared.value[0].place(_matrix(b.column(1), shared.value[2])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], schema=COUNTED_ARROW)

    return run


ENTRIES, ENTRIES_ARROW = out("leaf long, kind int, cid long, vec binary")


def _index(shared):
    def run(batches):
        for b in batches:
            if b.num_rows:
                leaves = shared.value[0].place(_matrix(b.column(1), shared.value[2]))
                for t in range(leaves.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(leaves[:, t]), pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), b.column(1)], schema=ENTRIES_ARROW)

    return run


def _probe(shared, probes: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                orders = [list(islice(walk, probes)) for walk in shared.value[0].visits(_matrix(some.column(1), shared.value[2]))]
                take = pa.array(np.repeat(np.arange(len(orders)), [len(o) for o in orders]))
                leaf = pa.array([x for o in orders for x in o], pa.int64())
                yield pa.RecordBatch.from_arrays([leaf, pa.array(np.ones(len(leaf), np.int32)), some.column(0).take(take), some.column(1).take(take)], schema=ENTRIES_ARROW)

    return run


FOUND, FOUND_ARROW = out("query long, cids binary, scores binary")


def _rank(k: int, dtype: str):
    def run(batches):
        for table in groups(batches, "spot"):
            table = table.combine_chunks()
            leaf, kind, cid = (table.column(c).to_numpy() for c in ("spot", "kind", "cid"))
            vectors = table.column("vec").combine_chunks()
            for g in np.unique(leaf):
                own, asks = np.flatnonzero((leaf == g) & (kind == 0)), np.flatnonzero((leaf == g) & (kind == 1))
                if not len(own) or not len(asks):
                    continue
                members = _matrix(vectors.take(pa.array(own)), dtype)
                for at in range(0, len(asks), 512):
                    some = asks[at : at + 512]
                    scores = _matrix(vectors.take(pa.array(some)), dtype) @ members.T
                    best = [own[:0]] * len(some)
                    best = [_top(s, cid[own], k) for s in scores]
                    yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array([cid[own][i].tobytes() for i in best], pa.binary()), pa.array([s[i].tobytes() for s, i in zip(scores, best)], pa.binary())], schema=FOUND_ARROW)

    return run


MERGED, MERGED_ARROW = out("query long, cid long, score double")


def _merge(k: int):
    def run(batches):
        for table in groups(batches, "query"):
            table = table.combine_chunks()
            query, cids, scores = (table.column(c).to_pylist() for c in ("query", "cids", "scores"))
            bounds = [0, *(i for i in range(1, len(query)) if query[i] != query[i - 1]), len(query)]
            q, c, s = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                ids, first = np.unique(np.frombuffer(b"".join(cids[a:b]), np.int64), return_index=True)
                value = np.frombuffer(b"".join(scores[a:b]))[first]
                best = _top(value, ids, k)
                q += [query[a]] * len(best)
                c += ids[best].tolist()
                s += value[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], schema=MERGED_ARROW)

    return run


VECTORS, VECTORS_ARROW = out("id long, vec binary")


def _pack(dim: int, dtype: str):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, dim)
                x = x + 0.0  # one zero, so that equal vectors have equal bytes
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())], schema=VECTORS_ARROW)

    return run


def precision(table: DataFrame, vec_col: str) -> str:
    """How vectors travel: in single precision where they are given so, which loses nothing."""
    return "<f4" if table.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame | None:
    """(id, vec) of the rows that take part; vec holds the components' bytes."""
    v = F.col("v")
    some = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = some.filter(F.coalesce(sound, F.lit(False)))
    lengths = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return some.filter(F.size("v") == lengths[0]["n"]).mapInArrow(_pack(lengths[0]["n"], precision(table, vec_col)), VECTORS) if lengths else None


def nearest(table: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row where ``is_query`` (a column over ``id``) holds."""
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors(table, id_col, vec_col)
    schema = "query_id long, rank int, id long, score double"
    if rows is None:
        return spark.createDataFrame([], schema)
    rows = scratch.keep(rows.distinct(), "vectors")
    # the k + 1 smallest ids of a class of equal vectors are all that any query can ask for
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = scratch.keep(least.groupBy("vec").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    n = classes.count()
    sample = classes.select("cid", "vec").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    dtype = precision(table, vec_col)
    x = np.stack([np.frombuffer(r["vec"], dtype) for r in sample]).astype(np.float64)
    forest = Forest(x, n, trees, leaf)
    queries = x[:PILOTS]
    shared = spark.sparkContext.broadcast((forest, queries, dtype))
    slim = classes.select("cid", "vec")
    pilot = slim.mapInArrow(_pilot(shared, k + 1), PILOT)
    best = pilot.withColumn("n", F.row_number().over(Window.partitionBy("pilot").orderBy(F.desc("score"), "cid"))).filter(F.col("n") <= k + 1)
    near: list[list[np.ndarray]] = [[] for _ in queries]
    for r in best.select("pilot", "leaves").collect():  # PILOTS * (k + 1) rows at most
        near[r["pilot"]].append(np.frombuffer(r["leaves"], np.int64))
    probes, everything = probes_for(forest, queries, near, recall), forest.trees * forest.leaves
    asking = rows.filter(is_query(F.col("id"))).join(classes.select("vec", "cid"), "vec").select("id", "cid")
    asking = scratch.keep(asking, "asking")
    crowded = slim.mapInArrow(_count(shared), COUNTED).groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > CROWDED * leaf)
    crowded = scratch.keep(crowded.select("leaf", F.ceil(F.col("n") / (CROWDED * leaf)).cast("int").alias("parts")), "crowded")
    members = slim.mapInArrow(_index(shared), ENTRIES).join(crowded, "leaf", "left")
    members = members.select(F.xxhash64("leaf", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int")).alias("spot"), "kind", "cid", "vec")
    # all that a query can get: every candidate, its own class's ids included
    enough = min(k + 1, classes.select(F.sum(F.size("ids"))).first()[0])
    left, answered, turn = scratch.keep(asking.select("cid").distinct().join(slim, "cid"), "distinct"), None, 0
    while True:
        visits = left.mapInArrow(_probe(shared, min(probes, everything)), ENTRIES).join(crowded, "leaf", "left")
        part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        visits = visits.select("leaf", "kind", "cid", "vec", part).select(F.xxhash64("leaf", "part").alias("spot"), "kind", "cid", "vec")
        met = members.unionByName(visits) if turn == 0 else members.join(visits.select("spot").distinct(), "spot", "left_semi").unionByName(visits)
        ranked = met.repartition("spot").sortWithinPartitions("spot").mapInArrow(_rank(k + 1, dtype), FOUND)
        merged = ranked.repartition("query").sortWithinPartitions("query").mapInArrow(_merge(k + 1), MERGED)
        each = merged.join(classes.select("cid", "ids"), "cid").select("query", F.explode("ids").alias("id"), "score")
        lists = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.negative("score").alias("far"), "id"))).alias("found"))
        lists = scratch.keep(lists.select(F.col("query").alias("cid"), F.slice("found", 1, k + 1).alias("found")), f"lists-{turn}")
        whole = lists if probes >= everything else lists.filter(F.size("found") >= enough)
        answered = whole if answered is None else answered.unionByName(whole)
        if probes >= everything:
            break
        left = scratch.keep(left.join(whole.select("cid"), "cid", "left_anti"), f"left-{turn}")
        if left.isEmpty():
            break
        probes, turn = probes * 4, turn + 1
    lists = answered
    own = asking.join(lists, "cid").select("id", F.slice(F.filter("found", lambda y: y["id"] != F.col("id")), 1, k).alias("found"))
    answer = own.select(F.col("id").alias("query_id"), F.posexplode("found").alias("rank", "x"))
    return answer.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), F.negative("x.far").alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % QUERY_EVERY == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The exact neighbours. Where all vectors fit one leaf the operator finds just these; beyond, its recall is tested.
SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM sound q, sound c WHERE q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}"""
