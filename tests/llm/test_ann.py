import numpy as np

from duologue.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string")


def brute(rows, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ ok[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_odd_vectors_and_hot_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), "clash") for i in range(300)]
    rows += [(300 + i, rows[7][1], "same") for i in range(60)]
    rows += [(400, None, "x"), (420, [0.0] * 8, "x"), (440, [float("nan")] * 8, "x"), (460, [None] * 8, "x"), (480, [1.0] * 3, "x"), (500, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), rows[5], rows[20]]
    got = {}
    for r in ann.nearest(table(spark, rows), lambda i: i % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    expected = brute(rows, 20)
    assert set(got) == set(expected)
    hits = 0
    for q, e in expected.items():
        true = dict(brute(rows, 10_000)[q])
        ids, scores = [i for i, _ in got[q]], [s for _, s in got[q]]
        assert len(set(ids)) == 20 and q not in ids and np.allclose(scores, [true[i] for i in ids], atol=1e-12)
        assert sorted(zip([-round(s, 9) for s in scores], ids)) == list(zip([-round(s, 9) for s in scores], ids))
        hits += len({i for i, _ in e} & set(ids))
    assert hits >= 0.9 * 20 * len(expected)


def test_fewer_candidates_and_empty(spark):
    rows = [(0, [1.0] * 8, ""), (1, [2.0] + [0.0] * 7, ""), (2, [0.0, 3.0] + [0.0] * 6, "")]
    got = ann.nearest(table(spark, rows), lambda i: i % 20 == 0).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(2, 1), (1, 2)]
    assert ann.nearest(table(spark, rows).limit(0), lambda i: i % 20 == 0).count() == 0


def test_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {}
    for r in ann.nearest(e, lambda i: i % 20 == 0, leaf=32).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        hits += len(set([i for i in ids[np.lexsort((ids, -s))] if i != q][:20]) & found)
    assert hits / (20 * len(got)) >= 0.9


def neighbours(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


def test_trees_below_the_sample(spark, monkeypatch):
    """Far more leaves than the sample can fit: leaves stay small and recall holds."""
    monkeypatch.setattr(ann, "SAMPLE", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    forest = ann.Forest(x[:64].astype(float), len(x), leaf=32)
    assert forest.depth == 7 and forest.fitted == 3
    sizes = np.bincount(forest.place(x.astype(float)).ravel(), minlength=forest.trees * forest.leaves)
    assert sizes.sum() == 6 * 3000 and np.percentile(sizes[sizes > 0], 99) < 32 * 12
    walk = list(next(forest.visits(x[:1].astype(float))))
    assert sorted(walk) == list(range(forest.trees * forest.leaves)) and set(walk[: forest.trees]) & set(forest.place(x[:1].astype(float))[0].tolist())
    got = neighbours(ann.nearest(table(spark, [(i, v.tolist(), "") for i, v in enumerate(x)]), lambda i: i % 20 == 0, leaf=32))
    hits = 0
    for q, ids in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -s))[:20].tolist()) & set(ids))
    assert len(got) == 150 and hits >= 0.9 * 20 * 150


def test_crowded_leaves_are_cut_and_short_answers_widened(spark, monkeypatch):
    """Leaves cut into many parts give the same rows; all candidates come back where there are few."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) + (3 if i % 3 else 0)).astype(np.float32).tolist(), "") for i in range(400)]
    whole = neighbours(ann.nearest(table(spark, rows), lambda i: i % 20 == 0, leaf=40))
    monkeypatch.setattr(ann, "CROWDED", 0.25)
    assert neighbours(ann.nearest(table(spark, rows), lambda i: i % 20 == 0, leaf=40)) == whole
    few = neighbours(ann.nearest(table(spark, rows[:15]), lambda i: i % 5 == 0, leaf=2, recall=0.1))
    assert few.keys() == {0, 5, 10} and all(len(set(v)) == 14 for v in few.values())


def test_an_id_with_two_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0, 0.5, float(i)] + [1.0] * 3, "") for i in range(30)] + [(20, [9.0] * 8, "other")]
    got = ann.nearest(table(spark, rows), lambda i: i % 20 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 20} and all(r["id"] != r["query_id"] for r in got)
