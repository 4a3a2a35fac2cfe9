import random

import pytest
from builders import pairs, spans
from pyspark.sql import functions as F

from duologue.operators import intervals as iv


def test_set_operations(spark):
    s = lambda *p: spans(spark, *p)
    assert pairs(iv.normalize(s((1, 1), (2, 1), (3, 4)))) == [(3, 4)]
    assert pairs(iv.normalize(s((0, 1), (1, 2), (5, 6)))) == [(0, 2), (5, 6)]
    assert pairs(iv.merge_gaps(s((0, 1), (1.1, 2), (5, 6)), 0.2)) == [(0, 2), (5, 6)]
    assert len(pairs(iv.merge_gaps(s((0, 1), (1.2, 2)), 0.2))) == 1
    assert len(pairs(iv.merge_gaps(s((0, 1), (1.2, 2)), 0.19))) == 2
    assert pairs(iv.drop_short(s((0, 0.05), (1, 3)), 0.1)) == [(1, 3)]
    assert pairs(iv.pad(s((1, 2), (2.1, 3)), 0.1)) == [(0.9, 3.1)]
    assert pairs(iv.pad(s((0.05, 1)), 0.2, 0.0, 10.0)) == [(0, 1.2)]
    assert pairs(iv.clip(s((0, 5), (6, 8)), 1.0, 7.0)) == [(1, 5), (6, 7)]
    assert pairs(iv.union(s((0, 2)), s((1, 4), (6, 7)))) == [(0, 4), (6, 7)]
    assert pairs(iv.intersect(s((0, 4), (6, 10)), s((2, 7), (9, 12)))) == [(2, 4), (6, 7), (9, 10)]
    assert pairs(iv.subtract(s((0, 10)), s((1, 2), (4, 5), (9, 12)))) == [(0, 1), (2, 4), (5, 9)]
    assert pairs(iv.complement(s((2, 4)), s((0, 10)), ["session_id"])) == [(0, 2), (4, 10)]
    assert pairs(iv.gaps(s((0, 1), (2, 3), (5, 6)))) == [(1, 2), (3, 5)]


def test_accessors(spark):
    s = spans(spark, (1, 2))
    points = spark.createDataFrame([("s", "A", t) for t in (0.999, 1.0, 1.5, 2.0)], "session_id string, person string, t_s double")
    assert [r["inside"] for r in iv.contains(points, s).orderBy("t_s").collect()] == [False, True, True, False]
    assert iv.coverage(spans(spark, (0, 5)), 0.0, 10.0).first()["coverage"] == 0.5
    assert iv.overlap_duration(spans(spark, (0, 5)), spans(spark, (4, 20))).first()["overlap_s"] == 1.0
    total = iv.total(spans(spark, (0, 5), (6, 8))).first()
    assert (total["total_s"], total["n"], total["first_s"], total["last_s"]) == (7.0, 2, 0.0, 8.0)


def test_mask_round_trip(spark):
    s = spans(spark, (0.1, 0.3), (0.5, 0.6), (0.9, 1.0))
    frames = iv.to_frames(s, 10.0).withColumn("m", F.lit(True))
    assert pairs(iv.from_mask(frames, "m", 10.0)) == [(0.1, 0.3), (0.5, 0.6), (0.9, 1.0)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    make = lambda: [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 60) for _ in range(12))]
    x, y = make(), make()
    cells = lambda p: {t for a, b in p for t in range(a, b)}

    def runs(c):
        out = []
        for t in sorted(c):
            if out and out[-1][1] == t:
                out[-1][1] = t + 1
            else:
                out.append([t, t + 1])
        return [tuple(map(float, r)) for r in out]

    a, b = iv.normalize(spans(spark, *x)), iv.normalize(spans(spark, *y))
    assert pairs(iv.intersect(a, b)) == runs(cells(x) & cells(y))
    assert pairs(iv.subtract(a, b)) == runs(cells(x) - cells(y))
    assert pairs(iv.union(a, b)) == runs(cells(x) | cells(y))


def test_empty(spark):
    none, some = spans(spark, (0, 1)).limit(0), spans(spark, (0, 1))
    assert pairs(iv.normalize(none)) == [] and pairs(iv.intersect(none, some)) == [] and pairs(iv.subtract(some, none)) == [(0, 1)]
