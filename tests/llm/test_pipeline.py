import random
import zlib

import numpy as np

import corpus_pipeline
from duologue.llm.queries import QUERIES, SQL


def test_registry():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_keep_columns_and_clean_documents(spark, sf):
    from test_packing import ids_of

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and 0.7 * n < docs.count() <= n, name
    pieces = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in pieces} == set(kept)
    for r in pieces:
        own = ids_of(kept[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def brute_groups(rows, n=5, least=0.8):
    """doc_id -> smallest doc_id reachable over links of shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def fixture(spark, folder):
    """Documents with nulls, empty texts, ties, repeated rows, toxic ones, a repeated line, copies and leaks."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    footer = "All rights to this common footer line are held by nobody at all."
    item = " ".join(word() for _ in range(30))
    rows, toxic = [], set()
    for i in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(6)]
        if i % 6 == 0:
            toxic.add(i)
            lines[1] += " you idiot and moron"
            lines[3] = "what a stupid idiot"
        if i % 5 == 1:
            lines.insert(2, footer.upper() if i % 2 else f"  {footer}\t")
        if i % 10 == 3:
            lines.insert(4, item if i % 20 == 3 else " ".join(w if k % 7 else word() for k, w in enumerate(item.split())))
        rows.append([i, "\n".join(lines)])
    for i, source in enumerate((2, 2, 4, 8)):  # near copies, of each other too
        w = rows[source][1].split(" ")
        w[7 * i + 5] = word()
        rows.append([60 + i, " ".join(w)])
    rows += [[64, rows[5][1]], [65, None], [66, ""], [67, "   "], [68, "short one"], [69, "short one"], [None, "a row without an id"], rows[9], [70, "word " * 30_000]]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return toxic, footer, item


def test_each_stage_against_brute_force(spark, tmp_path):
    from test_lines_and_urls import KEYED, UPPER
    from test_packing import ids_of
    from test_text_search import brute_leaks

    folder = str(tmp_path)
    toxic, footer, item = fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    before = rows(docs)

    def staged(name, df):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    one = staged("one", stages["toxicity"](spark, docs, folder))
    assert one.columns == docs.columns and rows(one) == [r for r in before if r[0] not in toxic]

    two = staged("two", stages["line_dedup"](spark, one, folder))
    key = lambda line: KEYED.sub("", line).translate(UPPER)
    holders = {i for i, t in rows(one) if i is not None and any(key(x) == key(footer) for x in (t or "").split("\n"))}
    assert len(holders) >= 5
    kept = lambda i, t: "\n".join(x for x in (t or "").split("\n") if i is None or i == max(holders) or key(x) != key(footer))
    assert rows(two) == sorted(((i, kept(i, t)) for i, t in rows(one)), key=repr) and all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = staged("three", stages["near_dedup"](spark, two, folder))
    groups = brute_groups([r for r in rows(two) if r[0] is not None])
    assert rows(three) == sorted({r for r in rows(two) if r[0] is None or groups[r[0]] == r[0]}, key=repr) and len(set(groups.values())) < len(groups) - 5

    four = staged("four", stages["decontamination"](spark, three, folder))
    leaks = {i for i, _ in brute_leaks(rows(three), [(1, item)])}
    assert len(leaks) >= 4 and rows(four) == [r for r in rows(three) if r[0] not in leaks]

    five = stages["packing"](spark, four, folder).collect()
    assert sorted({r["doc_id"] for r in five}, key=repr) == sorted({i for i, _ in rows(four)}, key=repr)
    assert sum(r["length"] for r in five) == sum(len(ids_of(t)) for _, t in rows(four))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, five))


def test_stages_of_empty_tables(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
