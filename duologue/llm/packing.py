"""Concatenate-and-cut packing: token streams of all documents, end to end, cut into fixed windows.

Pass 1 tokenises once and writes a table of token ids together with each document's place inside
its scan partition. The partitions' token totals -- one number each -- are prefix-summed, which
gives every document its place in the one global stream. Pass 2 is map-only: a document is cut
where windows of ``window`` tokens end, and what crosses a boundary becomes a boundary record of
the next window. Every sequence but the last is full; no token is dropped or copied.

Ids are those of the tokenizer file read by the ``tokenizers`` library. The same vocabulary, read
as ranks by ``tiktoken``, gives the same ids several times faster and is used for texts without
special-token strings; the others go through ``tokenizers``.

Null and empty texts hold the end id alone. Rows that repeat an id are documents of their own. Rows without an id are packed too; their id
is null in the result. Empty tables give no pieces. Extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm.batches import as_texts, out, slices
from duologue.llm.store import Scratch

WINDOW = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Offsets are broadcast up to this many scan partitions (16 bytes each) and joined by shuffle beyond.
MAX_BROADCAST_PARTITIONS = 1_000_000


@functools.cache
def encoder(paths: tuple[str, str]) -> Encoder:
    """One encoder for a worker process, however many tasks it runs."""
    return Encoder(paths)


def tokenizer_paths(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(tokenizer), public_tokenizers.path(ranks)


class Encoder:
    """Token ids of whole texts, equal to those of the tokenizer file with add_special_tokens=False."""

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.slow = paths[0], None
        with open(paths[0], encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


TOKENS, TOKENS_ARROW = out("part int, place long, id long, n long, ids binary")


def _tokenise(paths: tuple[str, str], end_id: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, part, place = None, TaskContext.get().partitionId(), 0
        for rows in slices(batches):
            encode = encode or encoder(paths)
            places, counts, ids = [], [], []
            for text in as_texts(rows.column(1)):
                x = np.array([*encode(text), end_id], "<u4")
                # ids of this vocabulary fit in two bytes; wider vocabularies keep four
                places.append(place)
                counts.append(len(x))
                ids.append((x.astype("<u2") if x.max() < 65536 else x).tobytes())
                place += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), rows.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=TOKENS_ARROW)

    return run


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """A written table (part, place, id, n, ids): ids are little-endian, two or four bytes each by their length."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    return scratch.keep(slim.mapInArrow(_tokenise(paths or tokenizer_paths(), end_id), TOKENS), "tokens")


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """(part, base): the tokens before each partition. As many rows as the scan had partitions."""
    totals = tokens.groupBy("part").agg(F.max(F.col("place") + F.col("n")).alias("total")).collect()
    base, rows = 0, []
    for part, total in sorted((r["part"], r["total"]) for r in totals):
        rows.append((part, base))
        base += total
    offsets = tokens.sparkSession.createDataFrame(rows, "part int, base long")
    return F.broadcast(offsets) if len(rows) <= MAX_BROADCAST_PARTITIONS else offsets


PIECES, PIECES_ARROW = out("id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _cut(window: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            columns: list[list] = [[] for _ in PIECES_ARROW]
            for base, place, doc, n, ids in zip(*(c.to_pylist() for c in rows.columns)):
                x = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                at, start = base + place, 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    for c, v in zip(columns, (doc, start, length, n, sequence, offset, x[start : start + length].tobytes())):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES_ARROW)], schema=PIECES_ARROW)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, paths: tuple[str, str] | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids): ids as little-endian 32-bit values."""
    tokens = tokenise(docs, id_col, text_col, paths, end_id)
    placed = tokens.join(partition_offsets(tokens), "part").select("base", "place", "id", "n", "ids")
    return placed.mapInArrow(_cut(window), PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, doc_starts): whole padded sequences; a last one that ends at a power of two is left so."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "ids", "length"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    fill = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(window) - n).cast("int")
    padding = F.unhex(F.repeat(F.lit(int(pad).to_bytes(4, "little").hex()), fill))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return whole.select("sequence_id", n.alias("n_tokens"), F.concat(joined, padding).alias("ids"), F.transform("p", lambda x: x["id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("doc_starts"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
