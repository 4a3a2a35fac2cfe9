import hashlib
import random

import numpy as np
import pytest

from duologue.llm import decontam, secrets, substring, toxicity
from duologue.llm.fmindex import BitVector, FMIndex, WaveletMatrix

# ---------------------------------------------------------------- substring dedup


def brute_substrings(rows, span=20):
    first, words = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}):
        words[i] = (t or "").encode().split()
        for p in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][p : p + span]), (i, p))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - span + 1):
            if first[tuple(w[p : p + span])] != (i, p):
                gone[p : p + span] = [True] * span
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def substrings_of(df):
    return [(r["id"], (r["n_words"], r["n_removed"], r["text"])) for r in substring.dedup_substrings(df).collect()]


def test_substrings_against_brute_force(docs_of):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(300)}"
    shared = [[word() for _ in range(n)] for n in (20, 25, 60, 19)]
    texts = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randrange(40))]]
        for s in rng.sample(shared, rng.randrange(3)):
            parts += [s[: rng.randrange(15, len(s) + 1)], [word() for _ in range(rng.randrange(6))]]
        texts.append(" ".join(sum(parts, [])))
    texts += ["a " * 70, "a b " * 40, "x y z " * 30, None, "", texts[3], texts[3]]
    df = docs_of(*texts)
    expected = brute_substrings([(r["doc_id"], r["text"]) for r in df.collect()])
    assert dict(substrings_of(df)) == expected


def test_substrings_odd_rows(odd):
    expected = brute_substrings([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = substrings_of(odd)
    assert len(got) == 8
    for i, x in got:
        assert i is None and x[1] == 0 or x == expected[i]
    assert substrings_of(odd.limit(0)) == []


def test_small_shards(docs_of, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    texts = ["common start " + " ".join(f"p{j}" for j in range(k, k + 45)) for k in range(0, 90, 7)]
    df = docs_of(*texts)
    assert dict(substrings_of(df)) == brute_substrings([(r["doc_id"], r["text"]) for r in df.collect()])


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    text = np.r_[rng.integers(1, 5, 500), 0]
    index = FMIndex(text, 5, 6)
    s = text.tolist()
    for _ in range(200):
        p = rng.integers(1, 5, rng.integers(1, 7)).tolist()
        lo, hi = np.array([0]), np.array([len(text)])
        for x in reversed(p):
            lo, hi = index.extend(np.array([x]), lo, hi)
        assert max(0, int(hi[0] - lo[0])) == sum(s[i : i + len(p)] == p for i in range(len(s)))
    bits = rng.integers(0, 2, 1000)
    at = np.arange(1001)
    assert (BitVector(bits).rank(at) == np.r_[0, np.cumsum(bits)]).all()
    at = np.array([0, 10, 100, 501])
    assert WaveletMatrix(text, 5).rank(np.full(4, 2), at).tolist() == [int((text[:a] == 2).sum()) for a in at]


def test_matching_statistics_of_texts_outside_the_index():
    """Streamed strings that the index does not hold: places whose longest match reaches the depth, and the earliest place of each."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        depth, sigma = int(rng.integers(2, 7)), int(rng.integers(3, 6))
        parts = [rng.integers(1, sigma, rng.integers(1, 60)).tolist() for _ in range(int(rng.integers(1, 6)))]
        text = np.array(sum([[*p, 0] for p in parts], []))
        index = FMIndex(text, sigma, depth)
        asked = [rng.integers(0, sigma, rng.integers(0, 50)).tolist() for _ in range(5)]
        flat = np.array(sum([[*a, 0] for a in asked], []), np.int64)
        ends = np.cumsum([len(a) + 1 for a in asked]) - 1
        begins = ends - np.array([len(a) for a in asked])
        got = {}
        for _, place, lo, hi in index.statistics(flat, begins, ends):
            first = index.first_place(lo, hi, np.full(len(place), -1))
            got |= dict(zip(place.tolist(), zip((hi - lo).tolist(), first.tolist())))
        expected, held = {}, text.tolist()
        for b, e in zip(begins.tolist(), ends.tolist()):
            for p in range(b, e - depth + 1):
                w = flat[p : p + depth].tolist()
                spots = [k for k in range(len(held) - depth + 1) if held[k : k + depth] == w] if 0 not in w else []
                if spots:
                    expected[p] = (len(spots), spots[0] if len(spots) > 1 else -1)
        assert got == expected


def test_memory_of_the_index():
    text = np.random.default_rng(2).integers(1, 1 << 15, 200_000)
    index = FMIndex(np.r_[text, 0], 1 << 15, 20)
    assert index.nbytes < 14 * 200_000


def test_a_frequent_gram_is_dealt_out_by_windows(docs_of, monkeypatch):
    """Near copies with edits of their own, far more than a shard takes."""
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for i in range(50):
        w = list(base)
        w[rng.randrange(60)] = f"e{i % 30}"
        texts.append(" ".join(w))
    df = docs_of(*texts)
    assert dict(substrings_of(df)) == brute_substrings([(r["doc_id"], r["text"]) for r in df.collect()])


def test_ids_repeated_under_two_texts_do_not_crash(spark):
    long_ = " ".join(f"s{k}" for k in range(30))
    df = spark.createDataFrame([(1, long_ + " one"), (1, "two " + long_), (2, long_)], "doc_id long, text string")
    got = substrings_of(df)
    assert sorted(i for i, _ in got) == [1, 1, 2] and (2, (30, 30, "")) in got


# ---------------------------------------------------------------- decontamination

ITEM = "the quick brown fox jumps over a lazy dog while seven grey owls watch from the old oak near our quiet river bank tonight"


def edited(share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{rng.randrange(99)}" for w in ITEM.split())


def test_leaks(spark, docs_of):
    filler = " ".join(f"f{i}" for i in range(200))
    texts = [f"{filler} {ITEM.upper()}! {filler}", f"{filler}\n{edited(0.12, 1)} {filler}", filler, "the quick brown fox jumps over nothing else " + filler, None, "", ITEM.replace(" ", ", "), *[f"{i} {ITEM} {i}" for i in range(30)]]
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "two words"), (None, ITEM)], "item_id long, text string")
    got = {(r["id"], r["item"]): r["score"] for r in decontam.contaminated(docs_of(*texts), items).collect()}
    assert set(got) == {(i, 7) for i in (0, 1, 6, *range(7, 37))} and got[0, 7] == pytest.approx(1.0) and 0.4 <= got[1, 7] < 1
    assert decontam.contaminated(docs_of("x").limit(0), items).count() == 0 and decontam.contaminated(docs_of("x"), items.limit(0)).count() == 0


def test_edited_leaks_in_many_documents(spark, docs_of):
    """An item known only as edited copies, and one that a few exact copies accompany."""
    filler, w = " ".join(f"f{i}" for i in range(200)), ITEM.split()
    copy = " ".join("new" if k % 6 == 5 else x for k, x in enumerate(w))
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    for exact in (0, 2):
        texts = [filler] * 20 + [f"{i} {copy} {i}" for i in range(40)] + [ITEM] * exact
        got = {r["id"] for r in decontam.contaminated(docs_of(*texts), items).collect()}
        assert got == set(range(20, 60 + exact)), exact


def test_a_phrase_of_many_items_is_no_seed(spark, docs_of):
    """Short items that share a phrase, and documents that hold only the phrase: no pair of them is looked at."""
    rows = [(i, f"which of the following is item{i} word{i} name{i} thing{i}") for i in range(3000)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = docs_of(*[f"x{i} which of the following is y{i}" for i in range(100)], rows[5][1], f"say {rows[7][1]} again")
    found = decontam.Items([(i, t.encode()) for i, t in rows], decontam.NGRAM)
    shared = spark.sparkContext.broadcast(found)
    counts = np.zeros((2, len(found.grams)), np.int64)
    for r in decontam.gram_counts(docs.selectExpr("doc_id AS id", "text"), shared).collect():
        counts[:, r["gram"]] = r["docs"], r["apart"]
    found.only_seeds(*counts, 102)
    hits = docs.selectExpr("doc_id AS id", "text").mapInArrow(decontam._find(spark.sparkContext.broadcast(found), decontam.MIN_SCORE), decontam.HITS)
    assert {(r["id"], r["item"]) for r in hits.collect()} == {(100, 5), (101, 7)}
    assert {(r["id"], r["item"]) for r in decontam.contaminated(docs, items).collect()} == {(100, 5), (101, 7)}


def test_repeated_items_and_items_of_common_phrases(spark, docs_of):
    """Items that many others repeat, and one whose every n-gram stands apart in many documents, are found."""
    phrases = ["at the end of the", "one of the most important", "in the middle of a"]
    texts = [f"a{i} {phrases[i % 3]} b{i}" for i in range(60)] + [" ".join(phrases), ITEM]
    items = spark.createDataFrame([(i, ITEM) for i in range(40)] + [(99, " ".join(phrases))], "item_id long, text string")
    got = {(r["id"], r["item"]) for r in decontam.contaminated(docs_of(*texts), items).collect() if r["score"] > 0.9}
    assert got == {(61, i) for i in range(40)} | {(60, 99)}


def brute_leaks(docs, items, min_score=decontam.MIN_SCORE):
    """Every document aligned as a whole with every item."""
    found = {}
    for i, text in docs:
        w = decontam.words((text or "").encode())
        for k, item in items:
            tokens = decontam.words((item or "").encode())
            if i is None or len(tokens) < decontam.NGRAM:
                continue
            number = {x: n for n, x in enumerate(dict.fromkeys(tokens))}
            score = brute_alignment([number[x] for x in tokens], [number.get(x, -1) for x in w])
            if score >= min_score:
                found[i, k] = round(score, 9)
    return found


def test_leaks_against_brute_force(spark, docs_of):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    texts = []
    for _ in range(80):
        parts = [word() for _ in range(rng.randrange(60))]
        for _, t in rng.sample(items, rng.randrange(3)):
            w = t.split()
            for _ in range(rng.randrange(1 + len(w) // 5)):  # replaced, dropped and added words
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[word()], [], [w[k], word()]])
            parts += [*w, *(word() for _ in range(rng.randrange(60)))]
        texts.append(" ".join(parts))
    docs = docs_of(*texts)
    got = {(r["id"], r["item"]): round(r["score"], 9) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], items) and len(got) > 40


def test_words_in_common_bound_alignment():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(0, 9, rng.integers(1, 25)), rng.integers(-1, 12, rng.integers(0, 40))
        assert decontam.align(a, b)[0] * len(a) <= decontam.in_common(a, b)


def test_leaks_odd_rows_and_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 10)
    items = spark.createDataFrame([(1, "plain words stand here one after another and end"), (2, ITEM)], "item_id long, text string")
    assert sorted((r["id"], r["item"]) for r in decontam.contaminated(odd, items).collect()) == [(1, 1)]


def brute_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(a))


def test_alignment_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(-1, 6, rng.integers(0, 40))
        score, start, end = decontam.align(a, b)
        assert score == pytest.approx(brute_alignment(a, b)) and 0 <= start <= end <= len(b)


# ---------------------------------------------------------------- toxicity


def labelled(spark, n=600):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{rng.randrange(800)}" for _ in range(40)]
        if toxic:
            for k in rng.sample(range(40), 3):
                words[k] = rng.choice(["grumblo" + rng.choice("abcdefgh"), "idiot", "stupid"])
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")


def test_toxicity_learns_stems_and_generalises(spark):
    docs, labels = labelled(spark)
    grammar, weights = toxicity.fitted(docs, labels)
    assert any(s.startswith("grum") for s in grammar.stems)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scored = toxicity.score_toxicity(docs, (grammar, weights)).withColumn("held", toxicity.fold(toxicity.F.col("id")) == 0).collect()
    held = [r for r in scored if r["held"]]
    assert held and sum((r["score"] >= 0.5) == truth[r["id"]] for r in held) / len(held) > 0.97
    kept = toxicity.without_toxic(docs, (grammar, weights))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["id"] for r in scored if r["score"] < 0.5}


def test_grammar_reads_clauses():
    g = toxicity.Grammar(["idiot"], ["grum"])
    kinds = lambda t: [toxicity.KINDS[k] for k, *_ in g.matches(t)]
    insult, threat = toxicity.INSULT, toxicity.THREAT
    assert kinds("You idiot.") == [(insult, False, False, True)] and kinds("an idiot of you") == [(insult, False, False, True)]
    assert kinds("this is not an idiot") == [(insult, True, False, False)]
    assert kinds("Mark said the dog is an idiot") == [(insult, False, True, False)]
    assert kinds("I will kill you") == [(threat, False, False, True)]
    assert kinds("GRUMbling. no. idiotic") == [(insult, False, False, False)]
    assert kinds("nothing here") == [] and kinds("") == []


def brute_reading(words, insulting, listed):
    """The kinds and weights of a clause's offences, by looking around each of them."""
    t, found, kept = toxicity, [], set()
    for i, w in enumerate(words):
        phrase = any(tuple(words[max(0, i + 1 - len(p)) : i + 1]) == p for p in t.PHRASES)
        if phrase or w in insulting or w in listed:
            found.append((i, t.INSULT, t.PHRASE if phrase else t.WORD_LEARNED if w in insulting else t.WORD_LISTED))
        elif w in t.HARMS:
            meant = any(x in t.INTENTS for x in words[max(0, i - t.INTENT_SCOPE) : i])
            found.append((i, t.THREAT if meant else t.HARM, t.INTENDED if meant else t.HARMFUL))
        kept |= {i} if found and found[-1][0] == i else set()
    plain = [None if i in kept else w for i, w in enumerate(words)]  # a word that ends a phrase is an offence and nothing else
    out = []
    for i, kind, weight in found:
        negated = any(x in t.NEGATIONS for x in plain[max(0, i - t.NEGATION_SCOPE) : i])
        reported = any(x in t.REPORTS for x in plain)
        aimed = any(x in t.TARGETS for x in plain[max(0, i - t.TARGET_SCOPE) : i + t.TARGET_SCOPE + 1])
        weights = [weight] + [w for flag, w in ((negated, t.NEGATED), (reported, t.REPORTED), (aimed, t.AIMED)) if flag]
        out.append(((kind, negated, reported, aimed), sorted(weights)))
    return out


def test_composed_machine_against_brute_force():
    rng = random.Random(12)
    grammar = toxicity.Grammar(["grumbler", "snark"], [])
    vocabulary = [*"a dog runs there grumbler snark idiot trash of piece waste space you they kill burn will gonna not never said wrote shut up go to hell your du".split()]
    read = 0
    for _ in range(4000):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))]
        got = [(toxicity.KINDS[k], sorted(w)) for k, w in grammar.read(words)]
        assert got == brute_reading(words, {"grumbler", "snark"}, set(toxicity.INSULTS)), words
        read += len(got)
    assert read > 4000


def test_phrases_threats_and_weights():
    g = toxicity.Grammar([], [])
    kinds = lambda t: [toxicity.KINDS[k] for k, *_ in g.matches(t)]
    insult, threat, harm = toxicity.INSULT, toxicity.THREAT, toxicity.HARM
    assert kinds("You waste of space.") == [(insult, False, False, True)] and kinds("a waste of time. space") == []
    assert kinds("they should burn") == [(threat, False, False, True)] and kinds("leaves burn") == [(harm, False, False, False)]
    assert kinds("Shut up, he said") == [(insult, False, True, True)] and kinds("I would never hurt you") == [(threat, True, False, True)]
    # weights add up along the path, so what is negated or reported weighs less than what is aimed
    weigh = lambda t: float(g.features(g.matches(t)) @ toxicity.PRIOR)
    assert weigh("he wrote that no dog is an idiot") < weigh("a dog is an idiot") < weigh("you are an idiot")
    text = "\u0130stanbul. You idiot."
    assert [text[a:b] for _, a, b, _ in g.matches(text)] == [" You idiot"]


def test_toxicity_odd_rows(spark, odd):
    model = toxicity.fitted(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == 8 and all(0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.without_toxic(odd, model).count() == 8 and toxicity.score_toxicity(odd.limit(0), model).count() == 0


# ---------------------------------------------------------------- secrets


def test_base_patterns():
    text = "password = \"abcd1234\" PASSWD:short token=tok.en/123+= x secret:secret:abcdefgh1 AKIAABCDEFGHIJKL AKIA123 " + "0123456789abcdef" * 2 + " deadbeef"
    kinds = [(k, text[a:b]) for k, a, b in secrets.base_spans(text)]
    assert kinds == [("assign", 'password = "abcd1234'), ("assign", "token=tok.en/123+="), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0123456789abcdef" * 2)]
    # a failing match is consumed: the second 'secret' of 'secret:secret:...' starts no match of its own
    assert secrets.base_spans("secret:secret:abcdefgh1") == []
    assert [s[0] for s in secrets.base_spans("é\u212aey api_key='aaaaaaaa' apiKEY:bbbbbbbb")] == ["assign", "assign"]


def test_novelty():
    novelty = secrets.Novelty()
    found = lambda t: [t[a:b] for _, a, b in secrets.novel_spans(t, secrets.base_spans(t), novelty)]
    assert found('the key is "q8Zt1Lw0PzX7rYb2NcV5mKd9" here') == ["q8Zt1Lw0PzX7rYb2NcV5mKd9"]
    assert found("the key is getElementById1getElementById") == [] and found("no context q8Zt1Lw0PzX7rYb2NcV5mKd9") == []
    assert found("password = q8Zt1Lw0PzX7rYb2NcV5mKd9") == []  # the pattern has it already


def test_novelty_of_values_behind_their_names():
    novelty = secrets.Novelty()
    found = lambda t: [t[a:b] for _, a, b in secrets.novel_spans(t, secrets.base_spans(t), novelty)]
    assert found("PRIVATE_KEY=9fJ2kLm4Qx7Zb3Tn8Wv1") == ["9fJ2kLm4Qx7Zb3Tn8Wv1"]
    assert found("see pwd=Zk29dLq83MxPw71b") == ["Zk29dLq83MxPw71b"] and found("https://x.org/a?signature=Ab83kd92LsQ01zPq7Vx&v=2") == ["Ab83kd92LsQ01zPq7Vx"]
    assert found("the key is q8Zt1Lw0PzX7=rYb2NcV5mKd9") == ["q8Zt1Lw0PzX7=rYb2NcV5mKd9"]  # parts too short to judge alone
    assert found("AUTH=q8Zt1Lw0PzX7rYb2NcV5mA==") == ["q8Zt1Lw0PzX7rYb2NcV5mA=="]
    assert found("PRIVATE_KEY=QxZbTnWvKjHgPdLs") == ["QxZbTnWvKjHgPdLs"] and found("pin of the key: 8305172946380517") == ["8305172946380517"]


def brute_base(text):
    """The base spans by scanning every place, without regular expressions."""
    spans, lower = [], "".join(c.lower() if c.isascii() else c for c in text)
    letters = lambda ok, i: next((k for k in range(i, len(text)) if text[k] not in ok), len(text))
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    value = upper + upper.lower() + digits + "+/_.=-"

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(name, i):
                k = i + len(name)
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                k = letters(" ", k)
                if text[k : k + 1] not in (":", "=") or k >= len(text):
                    continue
                k = letters(" ", k + 1)
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                if (e := letters(value, k)) > k:
                    return e, e - k >= 8
        return None

    def access(i):
        return (e, e - i >= 16) if text.startswith("AKIA", i) and (e := letters(upper + digits, i + 4)) > i + 4 else None

    def hexes(i):
        return (e, e - i >= 32) if (e := letters(digits + "abcdef", i)) > i else None

    for rank, (kind, read) in enumerate((("assign", assign), ("access", access), ("hex", hexes))):
        i = 0
        while i < len(text):
            if (hit := read(i)) is None:
                i += 1
                continue
            if hit[1]:
                spans.append((i, rank, hit[0], kind))
            i = hit[0]
    return [(k, a, b) for a, _, b, k in sorted(spans)]


def test_base_spans_against_brute_force():
    rng = random.Random(11)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "APIkey", "=", ":", " ", "  ", '"', "'", "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "x/+y", "-", "k\u212a"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert secrets.base_spans(text) == brute_base(text), text


def test_many_spans_in_one_text_take_linear_time():
    import time

    novelty, took = secrets.Novelty(), []
    for n in (2_000, 16_000):
        text = " ".join(f"password=abcdefgh{i:05d} key {'plainwords' * 2}" for i in range(n))
        began = time.perf_counter()
        base = secrets.base_spans(text)
        assert len(base) == n
        list(secrets.candidates(text, base))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 4 * took[0]


def test_words_of_the_corpus_prime_the_compressor(docs_of):
    rng = random.Random(5)
    name = "Quabbelwobbeltrill"
    texts = [f"{rng.random()} the session {name}{name} {rng.random()}" for _ in range(40)]
    key = "".join(rng.choice("abcdefghijkLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    copies = [f"copied text with the key {key} in it"] * 30
    docs = docs_of(*texts, *copies, None, "", f"key: {name}")
    words = secrets.learned_words(docs)
    assert name in words.split() and "copied" not in words.split()
    rows = {r["id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert len(rows) == 73 and all(rows[i] for i in range(40, 70)) and rows[72] == ""
    assert secrets.learned_words(docs.limit(0)) == ""


def test_novelty_finds_planted_keys_and_leaves_words():
    """Keys of five alphabets and identifiers built of words, planted beside sensitive words."""
    rng, novelty = random.Random(3), secrets.Novelty()
    words = "session request header value database manager handler factory update remove client server account holder index table".split()
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdefghjkmnpqrstvwxyz"]
    hit = false = 0
    for i in range(400):
        key = "".join(rng.choice(alphabets[i % 5]) for _ in range(rng.randrange(20, 44)))
        name = "".join(rng.choice(words).title() for _ in range(3))
        hit += any(text[a:b] == key for text in [f"the private credential is {key} , keep it"] for _, a, b in secrets.novel_spans(text, secrets.base_spans(text), novelty))
        text = f"the private credential of {' '.join(words)} is {name} , keep it"
        false += bool(secrets.novel_spans(text, secrets.base_spans(text), novelty))
    assert hit >= 0.98 * 400 and false <= 0.02 * 400, (hit, false)


def test_secrets_odd_rows(odd):
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == 8 and all(r["base"] == "" and r["spans"] == "" for r in rows)
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(rows[0]["base"].encode()).hexdigest()
    assert secrets.find_secrets(odd.limit(0)).count() == 0


def test_secret_in_a_very_long_text(docs_of):
    text = "word " * 200_000 + "token=abcdefgh12345 " + "word " * 200_000
    row = secrets.find_secrets(docs_of(text)).first()
    assert row["spans"] == "assign:1000000:1000019" and row["n_assign"] == 1
