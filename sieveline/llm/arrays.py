"""Rows that hold many values as packed arrays: what Spark moves is few rows of bytes, what Python works on are arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPARK = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def packed(rows: list[dict], schema: str, kinds: dict[str, str]) -> pa.RecordBatch:
    """Rows of numbers and arrays, these as bytes of the type that ``kinds`` names."""
    fields = [x.split() for x in schema.split(", ")]
    value = lambda r, n, t: np.asarray(r[n]).astype(kinds[n]).tobytes() if t == "binary" and r[n] is not None else r[n]
    return pa.RecordBatch.from_arrays([pa.array([value(r, n, t) for r in rows], SPARK[t]) for n, t in fields], [n for n, _ in fields])


def unpacked(batch: pa.RecordBatch, names: list[str], kinds: dict[str, str]) -> Iterator[dict]:
    """The rows of a batch, with arrays for what is packed."""
    columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
    for row in zip(*columns, strict=True):
        yield {n: np.frombuffer(x, kinds[n]) if isinstance(x, bytes) else x for n, x in zip(names, row, strict=True)}


def bucket_rows(batches: Iterator[pa.RecordBatch], names: list[str], kinds: dict[str, str]) -> Iterator[list[dict]]:
    """The rows of each value of the first column, by which they come sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in unpacked(batch, names, kinds):
            if held and row[names[0]] != held[0][names[0]]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def runs(sorted_values: np.ndarray) -> list[slice]:
    """The stretches of equal values."""
    if not len(sorted_values):
        return []
    cuts = [0, *(np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1).tolist(), len(sorted_values)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def in_buckets(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order by bucket; numbers of 16 bits are sorted by radix."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
