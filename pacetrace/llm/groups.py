"""Rows that Spark has dealt out and sorted by a key, taken key by key from the Arrow batches of one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise

FILTER_BITS = 1 << 22


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as it takes to differ from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose id may be in ``ids(id)``, and rows whose id surely is not: cheap pruning ahead of a join.

    The filter is a bitmap of ``FILTER_BITS`` hashed ids, 64 to a row, made by a native aggregate; it has at most
    ``FILTER_BITS / 64`` rows whatever the data, so it is broadcast.  Where very many ids fill it, it merely prunes less.
    """

    def word(c: Column) -> Column:
        return F.shiftright(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)), 6)

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))

    own = free_name(rows.columns, "word")
    bits = free_name([*rows.columns, own], "bits")
    some = materialise(ids.groupBy(word(F.col("id")).alias(own)).agg(F.bit_or(bit(F.col("id"))).alias(bits)))
    key = F.col(id_col).cast("long")
    met = rows.withColumn(own, word(key)).join(F.broadcast(some), own, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))
    return met.filter(hit).select(*(met[c] for c in rows.columns)), met.filter(~hit).select(*(met[c] for c in rows.columns))


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal non-null integer ``keys``; holds one batch and the run at hand."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column from the rows of a contiguous two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def binary_of(parts: list[np.ndarray]) -> pa.Array:
    """A binary column with the bytes of each array."""
    return pa.array([p.tobytes() for p in parts], pa.binary())
