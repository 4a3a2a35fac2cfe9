import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from duologue.llm import neardup, simhash
from duologue.llm.components import components

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_spark_hash_and_brute_force(spark, odd):
    texts = [r["text"] for r in odd.collect()]
    assert spark.range(1).selectExpr("xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


def test_odd_rows(odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert by[None][0]["component"] is None and by[None][0]["fp"] != 0
    assert {r["component"] for i in (2, 3, 4) for r in by[i]} == {2} and all(r["fp"] == 0 for i in (2, 3, 4) for r in by[i])
    assert [r["component"] for r in by[1]] == [1, 1]


def test_empty_table(odd):
    assert simhash.simhash_components(odd.limit(0)).count() == 0
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2048, 4])
def test_links_lose_nothing(spark, hot):
    """Chains and clusters of fingerprints, with crowded keys split or not."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(25):
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 5))):
                at ^= 1 << b
            fps.add(at)
    fps = sorted(fps)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    table = spark.createDataFrame(rows, "fp long, rep long")
    found = {r["node"]: r["root"] for r in components(simhash.links(table, hot=hot)).collect()}
    expected = brute_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {i: found.get(i, i) for i in range(len(fps))} == expected


def test_pivot_filter_keeps_near_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    t = np.abs(simhash.pivot_table(a, simhash.pivots()) - simhash.pivot_table(b, simhash.pivots()))
    assert t.max() <= 1


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(docs_of, block):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(4000)}" for _ in range(120)] for _ in range(4)]
    texts = []
    for words in base:
        for _ in range(9):
            copy = list(words)
            for k in rng.sample(range(120), rng.choice((0, 1, 2, 4, 8))):
                copy[k] = f"v{rng.randrange(4000)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one two", "One TWO", "one three"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]

    def linked(a, b):
        if not sets[a] or not sets[b]:
            return sets[a] == sets[b]
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    got = {r["id"]: r["group"] for r in neardup.near_duplicates(docs_of(*texts), block=block).collect()}
    assert got == brute_components(range(len(texts)), linked)
    ids = {r["id"] for r in neardup.near_duplicates(docs_of("a b c d e f", "a b c d e f")).collect()}
    assert ids == {0, 1}


def test_families_joined_by_one_pair_of_different_blocks(docs_of):
    """Two families of near copies, of which only the two originals are similar to each other."""
    first = [f"w{k}" for k in range(130)]
    second = [f"u{k}" if k in (4, 12) else w for k, w in enumerate(first)]

    def copies(words, mark):
        return [" ".join(f"{mark}{k}" if k == at else w for k, w in enumerate(words)) for at in range(20, 125, 2)]

    texts = [*copies(first, "a"), *copies(second, "b")]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in [*texts, " ".join(first), " ".join(second)])]
    n, close = len(texts) // 2, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    sides = [[*range(n), 2 * n], [*range(n, 2 * n), 2 * n + 1]]
    assert [(a, b) for a in sides[0] for b in sides[1] if close(a, b)] == [(2 * n, 2 * n + 1)]
    got = {r["id"]: r["group"] for r in neardup.near_duplicates(docs_of(*texts, " ".join(first), " ".join(second)), block=12).collect()}
    assert got == dict.fromkeys(range(2 * n + 2), 0)


def test_similar_sets_share_a_simhash_key():
    """Pairs of sets at 0.8: at most 0.4 % of them, as with the bands before, share no key or differ in more bits than may travel."""
    rng, missed = np.random.default_rng(5), 0
    for n in (5, 18, 90, 450):
        for _ in range(500):
            union, same = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)), round(0.8 * n)
            some = rng.permutation(union)
            half = same + (n - same) // 2
            (wide, keys), (other, others) = (neardup.simhash_keys(np.sort(x)) for x in (some[:half], np.r_[some[:same], some[half:]]))
            missed += not ((keys == others).any() and np.bitwise_count(wide ^ other).sum() <= neardup.MEET_RADIUS)
    assert missed <= 8


def test_keys_are_decided_bits_of_the_simhash():
    s = np.random.default_rng(6).integers(0, 1 << 63, 600, dtype=np.uint64)
    s.sort()
    ones = np.zeros((8, len(neardup.FACTORS) * 8), int)
    for h in s.tolist():
        words = neardup._mixed(np.array([h], np.uint64), neardup.FACTORS).view(np.uint8)[0]
        ones += words >> np.arange(8)[:, None] & 1
    clear = (2 * ones.ravel() - len(s)).reshape(neardup.BLOCKS, neardup.PLACES)
    wide, keys = neardup.simhash_keys(s)
    assert len(set(keys.tolist())) == neardup.BLOCKS
    for t, key in enumerate(keys.tolist()):
        for block, code in ((t, key // 256 % 256), ((t + 1) % neardup.BLOCKS, key % 256)):
            assert abs(clear[block, code // 2]) == abs(clear[block]).max() and (clear[block, code // 2] > 0) == code % 2
    bits = np.unpackbits(wide.view(np.uint8), bitorder="little")
    flat = clear.ravel()[: 64 * neardup.WORDS]
    assert (bits[flat != 0] == (flat[flat != 0] > 0)).all()


@pytest.mark.parametrize("hot", [2048, 5])
def test_rows_of_a_key_meet_within_the_radius(hot):
    """Edges among sorted rows, in batches of any cut, connect what brute force connects; a crowded key is one cluster."""
    rng = np.random.default_rng(8)
    bases = rng.integers(0, 1 << 63, (12, neardup.WORDS), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (60, 6)).astype(np.uint64)
    wide = bases[rng.integers(0, 12, 60)]
    for k in range(6):
        wide[:, k % neardup.WORDS] ^= flips[:, k]
    key = np.sort(rng.integers(0, 9, 60))
    rows = np.c_[key, np.arange(60), wide.view(np.int64)]
    near = lambda a, b: int(np.bitwise_count(wide[a] ^ wide[b]).sum()) <= 12
    crowd = np.bincount(key, minlength=9) > hot
    expected = brute_components(range(60), lambda a, b: key[a] == key[b] and (crowd[key[a]] or near(a, b)))
    assert 9 < len(set(expected.values())) < 60 or hot == 5 and crowd.any()
    names = ["key", "rep", *(f"w{w}" for w in range(neardup.WORDS))]
    for cut in (1, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[at : at + cut].T], names=names) for at in range(0, 60, cut)]
        edges = {(a, b) for out in neardup._meet(12, hot)(batches) for a, b in zip(*(c.to_pylist() for c in out.columns))}
        assert brute_components(range(60), lambda a, b: (a, b) in edges or (b, a) in edges) == expected


def test_a_crowded_key_loses_no_group(docs_of):
    words = [f"w{k}" for k in range(90)]
    texts = [" ".join(f"v{at}" if k == at else w for k, w in enumerate(words)) for at in range(5, 85, 4)] + ["quite another text of eight words here now"]
    for hot in (2048, 4):
        got = {r["id"]: r["group"] for r in neardup.near_duplicates(docs_of(*texts), hot=hot).collect()}
        assert got == {**dict.fromkeys(range(len(texts) - 1), 0), len(texts) - 1: len(texts) - 1}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 101: 100}


def test_texts_of_more_shingles_than_are_in_memory_at_once(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole


def test_near_duplicates_of_odd_rows(odd):
    """Null ids, empty texts, repeated rows and columns named like those inside: one group an id."""
    got = {r["id"]: r["group"] for r in neardup.near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6}
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
