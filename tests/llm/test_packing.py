import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duologue.llm import packing

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = packing.encoder(packing.tokenizer_paths())


def ids_of(text):
    return [*SLOW.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_tokenizer_file(text):
    assert FAST(text) == ids_of(text)[:-1]


def test_special_strings_and_long_runs():
    for text in ("a<|endoftext|>b", " " * 20000, "a" * 20000, "\n" * 500 + "x", "é" * 3000, "it's we'll I'd 123 4567"):
        assert FAST(text) == ids_of(text)[:-1]


def check(rows, texts, window=packing.WINDOW):
    ids = {i: ids_of(t) for i, t in texts}
    at = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * window + r["offset"] == at and r["offset"] + r["length"] <= window
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        at += r["length"]
    assert at == sum(len(ids[r]) for r in [r["doc_id"] for r in rows if r["start"] == 0])


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.digest(packing.pack(docs)).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in texts}
    check(rows, texts)


def test_odd_rows_and_small_windows(odd):
    rows = packing.digest(packing.pack(odd, window=16)).collect()
    texts = dict((r["doc_id"], r["text"]) for r in odd.collect())
    check(rows, texts.items(), 16)
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 2] == [1]
    assert len([r for r in rows if r["doc_id"] == 1 and r["start"] == 0]) == 2


def test_sequences_are_whole(docs_of):
    rng = random.Random(1)
    docs = docs_of(*(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(60))) for _ in range(40)))
    pieces = packing.pack(docs, window=32)
    seqs = packing.sequences(pieces, window=32).collect()
    sizes = sorted((r["sequence_id"], r["n_tokens"], len(r["ids"])) for r in seqs)
    assert all(n == 32 for _, n, _ in sizes[:-1]) and all(b == 128 for *_, b in sizes[:-1])
    assert sizes[-1][2] // 4 in (32, sizes[-1][1])
    stream = b"".join(r["ids"][: 4 * r["n_tokens"]] for r in sorted(seqs, key=lambda r: r["sequence_id"]))
    assert len(stream) == 4 * sum(len(ids_of(r["text"])) for r in docs.collect())


def test_empty(docs_of):
    assert packing.pack(docs_of("a").limit(0)).count() == 0
