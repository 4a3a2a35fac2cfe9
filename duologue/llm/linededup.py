"""Line deduplication with two Bloom filters.

Pass 1 reads the texts and sends the hash of each line key, once for each batch of documents, to the
slice of the filters that the hash belongs to. A slice holds about ``SLICE_KEYS`` keys, so there are
as many slices as the lines need, and each is filled by one task: a key that comes again is put into
the twice filter, and the once filter is forgotten. Pass 2 tests every key against the twice filter;
only suspected repeats are shuffled, as SHA-256 digests, for exact counting and for the choice of
the document that keeps the line. Up to ``BROADCAST_SLICES`` slices the twice filter travels to the
texts. Beyond that the keys travel to the slices; a key that comes twice in one batch is a suspect
for certain and skips the filter, so a line that a third of all documents hold floods no slice.
Both ways suspect alike, apart from chance hits, and the result is exact.

Null or empty texts: one empty line. Rows without an id hold no line for counting and keep all
theirs. Rows that repeat an id count as one document. Empty tables give empty results. The
result's ``n_lines`` and ``n_dropped`` replace input columns of those names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.llm.batches import as_texts, batch, out, slices
from duologue.llm.store import Scratch

SPACE = " \t\n\r\x0b\x0c"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
MIN_CHARS, MIN_DOCS = 40, 5
HASHES = 4
#: Keys of one slice, and bits of each of its two filters: 16 a key.
SLICE_KEYS, SLICE_BITS = 1 << 20, 1 << 24
#: Slices whose twice filters are broadcast, of 2 MB each; with more, keys are sent to them.
BROADCAST_SLICES = 16
#: Places of a task's memory of the keys it has sent, so that it sends frequent ones twice at most.
REMEMBERED = 1 << 17


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(UPPER) if not line.isascii() else line.strip(SPACE).lower()


def _keys(text: str, min_chars: int) -> set[str]:
    return {k for line in text.split("\n") if len(line) >= min_chars and len(k := line_key(line)) >= min_chars}


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit places for each 64-bit hash, by double hashing of the mixed hash."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    a, b = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def _hashes(keys) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)


class Filter:
    """A Bloom filter of fixed size."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, self.bits)
        return ((self.bytes[at >> 3] & np.left_shift(1, at & 7).astype(np.uint8)) != 0).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        at = _places(hashes, self.bits).ravel()
        np.bitwise_or.at(self.bytes, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def packed(self) -> bytes:
        return zlib.compress(self.bytes.tobytes(), 1)


def slices_for(keys: int) -> int:
    return max(1, -(-keys // SLICE_KEYS))


def _slice_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(1)) % np.uint64(n)).astype(np.int64)


SEEN, SEEN_ARROW = out("hash long, again boolean")


def _sight(min_chars: int):
    """Hashes of line keys: each once a batch, marked where it came again, and no more once that is known."""

    def run(batches):
        once, twice = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.uint64)
        for part in slices(batches):
            keys = [k for i, t in zip(part.column(0).to_pylist(), as_texts(part.column(1))) if i is not None for k in _keys(t, min_chars)]
            if not keys:
                continue
            hashes, times = np.unique(_hashes(keys), return_counts=True)
            at = (hashes % np.uint64(REMEMBERED)).astype(np.int64)
            again = (times > 1) | (once[at] == hashes)
            once[at] = hashes
            new = ~again | (twice[at] != hashes)
            twice[at[again]] = hashes[again]
            yield batch(SEEN_ARROW, hashes[new].view(np.int64), again[new])

    return run


FILTERS, FILTERS_ARROW = out("slice long, twice binary")


def _fill(bits: int):
    """The twice filter of each slice, from its hashes; rows are sorted by slice."""

    def run(batches):
        now, once, twice = None, None, None
        for b in batches:
            slice_, hashes, marked = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(slice_):
                if s != now:
                    if now is not None:
                        yield batch(FILTERS_ARROW, [now], [twice.packed()])
                    now, once, twice = int(s), Filter(bits), Filter(bits)
                own = slice_ == s
                some, first, times = np.unique(hashes[own], return_index=True, return_counts=True)
                again = (times > 1) | once.has(some)
                again |= np.isin(some, hashes[own & marked])
                twice.add(some[again])
                once.add(some)
        if now is not None:
            yield batch(FILTERS_ARROW, [now], [twice.packed()])

    return run


SUSPECTS, SUSPECTS_ARROW = out("key binary, id long")


def _digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()


def _suspect(filters_b, n: int, bits: int, min_chars: int):
    """Suspected (key, id), by the broadcast filters."""

    def run(batches):
        filters = [Filter(bits, zlib.decompress(f)) if f else None for f in filters_b.value]
        for part in slices(batches):
            rows = [(k, i) for i, t in zip(part.column(0).to_pylist(), as_texts(part.column(1))) if i is not None for k in _keys(t, min_chars)]
            if not rows:
                continue
            hashes = _hashes(k for k, _ in rows)
            slice_, seen = _slice_of(hashes, n), np.zeros(len(rows), bool)
            for s in np.unique(slice_):
                own = slice_ == s
                seen[own] = filters[s].has(hashes[own]) if filters[s] else False
            some = [rows[i] for i in np.flatnonzero(seen)]
            if some:
                yield batch(SUSPECTS_ARROW, [_digest(k) for k, _ in some], [i for _, i in some])

    return run


KEYED, KEYED_ARROW = out("slice long, hash long, key binary, id long, sure boolean")


def _keyed(n: int, min_chars: int):
    """Every line key with its slice; sure where it comes twice in one batch of documents."""

    def run(batches):
        for part in slices(batches):
            rows = [(k, i) for i, t in zip(part.column(0).to_pylist(), as_texts(part.column(1))) if i is not None for k in _keys(t, min_chars)]
            if rows:
                hashes = _hashes(k for k, _ in rows)
                _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
                yield batch(KEYED_ARROW, _slice_of(hashes, n), hashes.view(np.int64), [_digest(k) for k, _ in rows], [i for _, i in rows], times[which] > 1)

    return run


def _test(bits: int):
    """Suspected (key, id) of rows that are sorted by slice, each slice's filter first (its id is null)."""

    def run(batches):
        now, twice = None, None
        for b in batches:
            for part in slices([b], 4096):
                slice_, ids = part.column(0).to_numpy(), part.column(3)
                loads = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist()
                bounds = sorted({0, *loads, *(np.flatnonzero(slice_[1:] != slice_[:-1]) + 1).tolist(), len(slice_)})
                for lo, hi in zip(bounds, bounds[1:]):
                    if lo in loads:
                        now, twice = int(slice_[lo]), Filter(bits, zlib.decompress(part.column(2)[lo].as_py()))
                        lo += 1
                    if lo < hi and slice_[lo] == now:
                        seen = twice.has(part.column(1).slice(lo, hi - lo).to_numpy().view(np.uint64))
                        some = part.slice(lo, hi - lo).filter(pa.array(seen))
                        if some.num_rows:
                            yield pa.RecordBatch.from_arrays([some.column(2), some.column(3)], schema=SUSPECTS_ARROW)

    return run


def suspected_lines(slim: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, id) of the line keys that the twice filters hold. slim: (id, text)."""
    seen = scratch.keep(slim.mapInArrow(_sight(min_chars), SEEN), "seen")
    n = slices_for(seen.count())
    dealt = seen.select(F.pmod(F.shiftrightunsigned("hash", 1), F.lit(n)).alias("slice"), "hash", "again").repartition("slice").sortWithinPartitions("slice")
    filters = scratch.keep(dealt.mapInArrow(_fill(SLICE_BITS), FILTERS), "filters")
    scratch.drop("seen")
    if n <= BROADCAST_SLICES:
        # at most BROADCAST_SLICES filters of SLICE_BITS each
        packed = {r["slice"]: r["twice"] for r in filters.collect()}
        shared = slim.sparkSession.sparkContext.broadcast([packed.get(s) for s in range(n)])
        return slim.mapInArrow(_suspect(shared, n, SLICE_BITS, min_chars), SUSPECTS)
    keyed = scratch.keep(slim.mapInArrow(_keyed(n, min_chars), KEYED), "keyed")
    loads = filters.select("slice", F.lit(0).cast("long").alias("hash"), F.col("twice").alias("key"), F.lit(None).cast("long").alias("id"))
    meeting = loads.unionByName(keyed.filter("NOT sure").drop("sure")).repartition("slice").sortWithinPartitions("slice", F.col("id").asc_nulls_first())
    return meeting.mapInArrow(_test(SLICE_BITS), SUSPECTS).unionByName(keyed.filter("sure").select("key", "id"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, scratch: Scratch | None = None) -> DataFrame:
    """(id, keys): for each document the digests of the line keys it must drop."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    suspects = scratch.keep(suspected_lines(slim, scratch, min_chars), "suspects")
    scratch.drop("filters", "keyed")
    confirmed = suspects.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)
    # written, so that both sides of the join are plain exchanges and adaptive execution can split a hot line's rows among tasks
    confirmed = scratch.keep(confirmed, "confirmed")
    drops = suspects.join(confirmed, "key").filter(F.col("id") != F.col("keeper"))
    return drops.groupBy("id").agg(F.collect_set("key").alias("keys"))


def _apply(text_at: int, keys_at: int, schema: pa.Schema, min_chars: int):
    def run(batches):
        for part in slices(batches):
            texts, kept, n_lines, n_dropped = as_texts(part.column(text_at)), [], [], []
            for text, keys in zip(texts, part.column(keys_at).to_pylist()):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if keys:
                    gone = set(keys)
                    left = [x for x in lines if len(x) < min_chars or len(k := line_key(x)) < min_chars or _digest(k) not in gone]
                    n_dropped.append(len(lines) - len(left))
                    text = "\n".join(left)
                else:
                    n_dropped.append(0)
                kept.append(text)
            columns = [c for i, c in enumerate(part.columns) if i != keys_at]
            columns[text_at] = pa.array(kept, pa.string())
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without their repeated lines, with ``n_lines`` (before) and ``n_dropped``."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("id").alias("__lines_id"), F.col("keys").alias("__lines_keys"))
    docs = docs.select(*(F.col(f"`{c}`") for c in columns)).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    joined = docs.join(drops.hint("shuffle_hash"), F.col(f"`{id_col}`").cast("long") == F.col("__lines_id"), "left").drop("__lines_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    return joined.mapInArrow(_apply(columns.index(text_col), len(columns), [*columns, "n_lines", "n_dropped"], min_chars), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
