"""Helpers for Arrow-batched Python stages: bounded slices in, bounded batches out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of one Python-side slice, so that a batch of long texts is never all in Python objects at once.
SLICE = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def out(names_types: str) -> tuple[str, pa.Schema]:
    """A DDL schema and the Arrow schema that goes with it."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.strip().split(" ") for x in names_types.split(",")]
    return ", ".join(f"`{n}` {t}" for n, t in fields), pa.schema([(n, kinds[t]) for n, t in fields])


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, from batches that are sorted by the key.

    A table holds as many groups as its batch ended; only the last, open group is carried on.
    """
    held: list[pa.RecordBatch] = []
    for now in batches:
        if not now.num_rows:
            continue
        column = now.column(now.schema.get_field_index(key))
        last = column[now.num_rows - 1]
        cut = now.num_rows - 1
        # the first row of the last group, by bisection over the sorted keys
        lo, hi = 0, now.num_rows - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if column[mid].equals(last):
                hi = mid
            else:
                lo = mid + 1
        cut = lo
        if cut == 0 and held and held[-1].column(held[-1].schema.get_field_index(key))[held[-1].num_rows - 1].equals(last):
            held.append(now)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, now.slice(0, cut)])
        held = [now.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)
