import hashlib
import re

import pytest

from duologue.llm import linededup, urlfilter, warc

KEYED = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_lines(rows):
    key = lambda line: KEYED.sub("", line).translate(UPPER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_of(df):
    from pyspark.sql import functions as F

    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["h"]) for r in linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h")).collect()), key=repr)


def test_lines_against_brute_force(spark, docs_of):
    long_ = "This line is a common footer that holds over forty characters"
    odd_case = "  \t" + long_.upper() + " \r"
    texts = [f"{long_}\nown text {i}\n{odd_case if i % 2 else long_}" for i in range(7)] + ["É" * 39, "É" * 40, None, "", "\n\n", *["É" * 40] * 4, *["short"] * 9, *["four times only, though it is quite long enough"] * 4]
    df = docs_of(*texts)
    assert lines_of(df) == brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])


def test_lines_odd_rows(odd):
    assert lines_of(odd) == brute_lines([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = linededup.dedup_lines(odd)
    assert set(kept.columns) == set(odd.columns) | {"n_dropped"} and kept.count() == 8
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_small_filters_stay_exact(docs_of, monkeypatch):
    """Filters that are far too full, and keys that travel to many slices: the same rows."""
    texts = ["\n".join(f"line number {j} that is long enough to be looked at by the filter {j % (i + 3)}" for j in range(400)) for i in range(12)]
    df = docs_of(*texts)
    expected = brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])
    monkeypatch.setattr(linededup, "SLICE_BITS", 1 << 9)
    assert lines_of(df) == expected
    monkeypatch.setattr(linededup, "SLICE_BITS", 1 << 13)
    monkeypatch.setattr(linededup, "SLICE_KEYS", 100)
    monkeypatch.setattr(linededup, "BROADCAST_SLICES", 0)
    assert lines_of(df) == expected


def test_few_lines_are_suspected_however_many_slices(spark, docs_of, monkeypatch):
    """The share of single lines that are suspected stays small with the number of slices; repeated lines all are."""
    from duologue.llm.store import Scratch

    shared = [f"this is shared line number {k} of all the documents here" for k in range(3)]
    texts = ["\n".join([*shared, *(f"line {j} of document {i} stands nowhere else in the corpus" for j in range(60))]) for i in range(300)]
    slim = docs_of(*texts).selectExpr("doc_id AS id", "text")
    monkeypatch.setattr(linededup, "SLICE_KEYS", 1 << 10)
    monkeypatch.setattr(linededup, "SLICE_BITS", 1 << 14)
    counts = []
    for most in (1 << 10, 0):
        monkeypatch.setattr(linededup, "BROADCAST_SLICES", most)
        rows = linededup.suspected_lines(slim, Scratch(spark, "test")).collect()
        held = {linededup._digest(linededup.line_key(x)) for x in shared}
        assert sum(bytes(r["key"]) in held for r in rows) == 900
        counts.append(len(rows) - 900)
    assert max(counts) < 0.02 * 300 * 60, counts


URLS = [
    ("https://a.example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://EXAMPLE.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://x.com/FR/a", "x.com", "/FR/a", None, "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://example.org?x=/es/", "example.org", "", None, "allow"),
    ("http://cheap-pills.example.net/", "cheap-pills.example.net", "/", None, "block"),
    ("http://cheap-pills.example.org/", "cheap-pills.example.org", "/", "org/", "allow"),
    ("http://cheap-pillsx.example.net/", "cheap-pillsx.example.net", "/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/org/", "b:", "//c/org/", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "clash")], "page_id long, url string, host string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages).collect() if r["page_id"] == 0) + [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages).orderBy("page_id").collect() if r["page_id"]]
    assert got == [(0, *URLS[0][1:])] + [(i, *u[1:]) for i, u in enumerate(URLS)]
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0
    assert urlfilter.filter_urls(pages, rules=()).filter("verdict = 'allow'").count() == len(URLS) + 1
    with pytest.raises(ValueError):
        urlfilter.filter_urls(pages, rules=[urlfilter.Rule("x", "x", (), "block")])


def test_many_rules_as_literal_and_as_table(spark):
    """A hash table in the plan and a joined table of rules judge alike; both take any number of rules."""
    long_url = "http://x.example.net/" + "a/" * 20_000 + "casino"
    urls = [u[0] for u in URLS] + [long_url, "http://s77.test/p/q", "http://www.s4000.test/p/1", URLS[0][0], "http://a.b/zz", "http://casino-poker.net/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, token string")
    rules = [*urlfilter.DEFAULT_RULES, *(urlfilter.prefix_rule("block", f"s{i}.test/p/") for i in range(12_000))]
    rows = lambda limit: sorted(map(tuple, urlfilter.filter_urls(pages, rules=rules, limit=limit).collect()), key=repr)
    got = rows(8 << 20)
    assert got == rows(0) and len(got) == len(urls) + 1
    by_url = {r[1][:60]: r for r in got if r[1]}
    assert by_url["http://s77.test/p/q"][5] == "s77.test/p/" and by_url["http://www.s4000.test/p/1"][7] == "block"
    # words of equal length and tier: the last in order wins
    assert by_url["http://casino-poker.net/"][6] == "||casino^" and by_url[long_url[:60]][7] == "allow"
    equal = [urlfilter.host_word_rule("aaaa"), urlfilter.host_word_rule("bbbb")]
    one = urlfilter.filter_urls(spark.createDataFrame([(1, "http://aaaa.bbbb/")], "page_id long, url string"), rules=equal).first()
    assert one["pattern"] == "||bbbb^"


def test_urls_are_native(spark, sf):
    plan = urlfilter.op10_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def records(spark, *rows):
    return spark.createDataFrame([(i, u, t, k, e, lm, d, h) for i, u, t, k, e, lm, d, h in rows], "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")


def test_revisits(spark):
    r = records(
        spark,
        (1, "http://www.A.com/x/?b=2&a=1&utm_source=q#f", 10, "response", '"e1"', None, None, {"Content-Type": "text/html", "Content-Length": "9", "ETag": '"e1"', "X-A": "1"}),
        (2, "https://a.com:443/x?a=1&b=2", 20, "revisit", 'W/"e1"', None, None, {"ETAG": 'W/"e1"', "etag": 'W/"e1"', "Content-Length": "0", "Cache-Control": "no-cache"}),
        (3, "http://a.com/x?a=1&b=2", 30, "response", '"e2"', "Mon", None, None),
        (4, "http://a.com/x?a=1&b=2", 40, "revisit", '"e1"', None, None, {}),
        (5, "http://a.com/x?a=1&b=2", 40, "revisit", None, "Mon", None, {}),
        (6, "http://a.com/x?a=1&b=2", 5, "revisit", '"e1"', None, None, {}),
        (7, None, 50, "revisit", '"e1"', None, None, None),
        (8, "http://a.com/x?a=1&b=2", None, "revisit", '"e2"', None, None, {}),
        (9, "http://b.com/", 1, "response", None, None, "d", {}),
        (10, "http://b.com", 1, "revisit", None, None, "d", {}),
        (10, "http://b.com", 1, "revisit", None, None, "d", {}),
    )
    got = sorted((x["record_id"], x["base_id"], x["status"]) for x in warc.resolve_revisits(r).collect())
    assert got == [(2, 1, "resolved"), (4, 3, "mismatch"), (5, 3, "resolved"), (6, None, "missing"), (7, None, "missing"), (8, None, "missing"), (10, 9, "resolved"), (10, 9, "resolved")]
    merged = warc.resolve_revisits(r).filter("record_id = 2").first()["headers"]
    assert merged == {"content-type": "text/html", "content-length": "9", "x-a": "1", "etag": 'W/"e1"', "cache-control": "no-cache"}
    assert warc.resolve_revisits(r.limit(0)).count() == 0


def test_a_hot_url_is_split_and_still_right(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        rows = [(i, "http://hot.com/p", i, "response" if i % 37 == 0 else "revisit", '"e"', None, None, {}) for i in range(1, 3000)]
        got = {x["record_id"]: x["base_id"] for x in warc.resolve_revisits(records(spark, *rows).repartition(8)).collect()}
        assert got == {i: (i // 37 * 37 or None) for i in range(1, 3000) if i % 37}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_revisits_with_clashing_columns_and_very_long_urls(spark):
    from pyspark.sql import functions as F

    long_ = "http://a.com/" + "p/" * 20_000
    headers = {f"x-{k}": "v" * 50 for k in range(400)}
    r = records(spark, (1, long_, 1, "response", '"e"', None, None, headers), (2, long_, 2, "revisit", '"e"', None, None, {"ETag": '"e"'}), (None, long_, 3, "revisit", '"e"', None, None, None))
    clash = r.select("*", F.lit("c").alias("canonical_url"), F.lit(9).alias("base_id"), F.lit("c").alias("status"), F.lit("c").alias("part"))
    got = {x["record_id"]: x for x in warc.resolve_revisits(clash).collect()}
    assert got[2]["base_id"] == 1 and got[2]["status"] == "resolved" and len(got[2]["headers"]) == 401 and got[2]["canonical_url"].startswith("a.com/p/p/")
    assert got[None]["status"] == "missing"
