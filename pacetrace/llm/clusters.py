"""Lloyd's clustering of integer vectors, sharded by dimension.

Vectors are cut into blocks of columns.  A task of a block holds that block's slice of every centroid and nothing of the
others: it gives exact partial distances, a shuffle adds the blocks and takes the nearest centroid, and each block then
updates its own slice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise, scratch_path

#: Vectors of a piece: what a task holds at once, and what the shuffle that adds distances deals out as one row.
PIECE = 2048
#: Largest component for which every distance of up to 2**20 dimensions fits a long.
LARGEST = 1 << 20


def _pieces(vectors: DataFrame, dims: int, block_dims: int) -> DataFrame:
    """``piece, block, n, ids, data``: the columns of a block of up to ``PIECE`` vectors; ids go with block 0."""
    cuts = [*range(0, dims, block_dims), dims]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                x = np.asarray(b.column(1).flatten()).reshape(-1, dims)
                out = [(part << 32 | made, k, len(x), np.ascontiguousarray(x[:, lo:hi]).tobytes()) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
                ids = [b.column(0).to_pylist()] + [None] * (len(out) - 1)
                piece, block, n, data = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece, pa.int64()), pa.array(block, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                    names=["piece", "block", "n", "ids", "data"],
                )
                made += 1

    return vectors.mapInArrow(run, "piece long, block int, n int, ids array<long>, data binary")


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; by matrix product in doubles where every term and sum is below 2**53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial distances of a piece's block to all centroids."""
    for b in batches:
        for piece, n, data, k, slices in zip(*(b.column(c).to_pylist() for c in ("piece", "n", "data", "k", "slices"))):
            d = squared_distances(_matrix(data, n), _matrix(slices, k))
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([n], pa.int32()), pa.array([d.tobytes()], pa.binary())], names=["piece", "n", "parts"])


def _nearest(group: pa.Table) -> pa.Table:
    """Of one piece: the blocks' partial distances added, the nearest centroid of each vector and its distance."""
    n = group.column("n")[0].as_py()
    total = sum(_matrix(p, n) for p in group.column("parts").to_pylist())
    to = total.argmin(axis=1)  # the first of equal ones
    near = total[np.arange(n), to]
    return pa.table({"piece": group.column("piece")[:1], "to": pa.array([to.astype(np.int32).tobytes()], pa.binary()), "near": pa.array([near.tobytes()], pa.binary())})


def _assign(pieces: DataFrame, slices: DataFrame) -> DataFrame:
    """``piece, to, near``; a group is the blocks of one piece, so its size has nothing to do with the number of rows."""
    parts = pieces.join(slices, "block").select("piece", "n", "data", "k", "slices").mapInArrow(_partial, "piece long, n int, parts binary")
    return parts.groupBy("piece").applyInArrow(_nearest, "piece long, to binary, near binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the sum of each column and the number of vectors of each (block, cluster), as rows of one column each."""
    held: dict[int, list] = {}
    for b in batches:
        for block, n, data, to, k in zip(*(b.column(c).to_pylist() for c in ("block", "n", "data", "to", "k"))):
            x, label = _matrix(data, n), np.frombuffer(to, np.int32)
            total, count = held.setdefault(block, [np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)])
            for c in np.unique(label):
                mine = label == c
                total[c] += x[mine].sum(axis=0)
                count[c] += mine.sum()
    for block, (total, count) in held.items():
        c, d = np.nonzero(np.repeat(count[:, None] > 0, total.shape[1], axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(c), block, np.int32)), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d]), pa.array(count[c])],
            names=["block", "cluster", "dim", "s", "c"],
        )


_SLICES = "block int, k int, slices binary"


def _update(old: pa.Table, sums: pa.Table) -> pa.Table:
    """A block's next slice from its old one and its sums; a centroid without vectors stays.  k times the block's columns."""
    k = old.column("k")[0].as_py()
    m = _matrix(old.column("slices")[0].as_py(), k).copy()
    c, d = (sums.column(x).to_numpy() for x in ("cluster", "dim"))
    m[c, d] = sums.column("s").to_numpy() // sums.column("c").to_numpy()
    return pa.table({"block": old.column("block"), "k": old.column("k"), "slices": pa.array([m.tobytes()], pa.binary())})


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, k, slices in zip(*(b.column(c).to_pylist() for c in ("block", "k", "slices"))):
            m = _matrix(slices, k)
            c, d = np.indices(m.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), block, np.int32)), pa.array(c), pa.array(d), pa.array(m.ravel())], names=["block", "cluster", "dim", "v"])


def floored(vec: Column, scale: float) -> Column:
    """Integer components ``floor(scale * x)`` with x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """``id, vec``: the vectors of ``dims`` components, none null or non-finite, as integers."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.filter(F.coalesce((F.size(vec) == dims) & ~bad, F.lit(False)))
    return good.select(F.col(id_col).cast("long").alias("id"), floored(vec, scale).alias("vec"))


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10,
    scale: float = 1024.0, seed: int = 3, block_dims: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """``id_col, cluster, distance`` per kept vector, and ``block, cluster, dim, v``: the final centroids by their slices.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; a component x becomes floor(scale * x).
    Centroids start as the k vectors of smallest lower-case hexadecimal sha256 of ``seed:id``, numbered in that order (rows
    that repeat an id: by their components; null ids last).  A round assigns every vector to the nearest centroid (ties: the
    smaller number) and replaces each centroid that has vectors by the floor of their mean; afterwards vectors are assigned
    once more.  All in integers, so the result doesn't depend on how rows are dealt.

    Method: Lloyd sharded by dimension.  The vectors are written once, cut in blocks of ``block_dims`` columns and bucketed by
    block and piece.  Each round joins the pieces of a block with that block's slice of the centroids, works out partial distances,
    adds them by piece in a shuffle and takes the minimum; the labels go back to the blocks, where every task sums its
    pieces and emits one row per cluster and column, which a partial aggregate adds up.  A cluster that holds most vectors
    is spread like any other.  Per round a vector shuffles 8 * k bytes per block and a label.

    Fewer than k vectors: as many centroids.  No vector: two empty tables.  A component beyond ``LARGEST`` raises
    ArithmeticError, since its distances might not fit a long.  Extra columns are ignored.
    """
    rows = materialise(kept_vectors(vectors, id_col, vec_col, dims, scale))
    top = rows.select(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    if top is not None and top > LARGEST:
        raise ArithmeticError(f"a component of {top} is beyond {LARGEST}")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), "vec").limit(k).collect()  # k vectors: a parameter, not the data
    spark = vectors.sparkSession
    centres = np.array([r.vec for r in first], np.int64).reshape(len(first), dims)
    cuts = [*range(0, dims, block_dims), dims]
    start = [(b, len(first), np.ascontiguousarray(centres[:, lo:hi]).tobytes()) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    slices = materialise(spark.createDataFrame(start, _SLICES))
    name = f"pacetrace_blocks_{uuid.uuid4().hex}"
    # Dealt by (block, piece) once and for all, so that labels come to the vectors and never the vectors to the labels.
    _pieces(rows, dims, block_dims).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "piece").option(
        "path", scratch_path(spark, "blocks")).saveAsTable(name)
    pieces = spark.table(name)
    blocks = F.explode(F.array(*(F.lit(b) for b in range(len(cuts) - 1)))).alias("block")
    for _ in range(rounds if first else 0):
        labels = _assign(pieces, slices).select("piece", "to", F.lit(len(first)).alias("k"), blocks)
        labelled = pieces.select("piece", "block", "n", "data").join(labels, ["block", "piece"])
        sums = labelled.mapInArrow(_sums, "block int, cluster int, dim int, s long, c long").groupBy("block", "cluster", "dim").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        slices = materialise(slices.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_update, _SLICES))
    near = _assign(pieces, slices)
    ids = pieces.filter("block = 0").select("piece", "ids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, to, d in zip(*(b.column(c).to_pylist() for c in ("ids", "to", "near"))):
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.frombuffer(to, np.int32)), pa.array(np.frombuffer(d, np.int64))], names=[id_col, "cluster", "distance"])

    found = materialise(ids.join(near, "piece").select("ids", "to", "near").mapInArrow(spread, f"`{id_col}` long, cluster int, distance long"))
    spark.sql(f"DROP TABLE {name}")  # its name; the files are scratch
    return found, slices.mapInArrow(_components, "block int, cluster int, dim int, v long")


def cluster_report(found: DataFrame, values: DataFrame, id_col: str = "vec_id", block_dims: int = 16) -> DataFrame:
    """``found`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of the components joined by commas)."""
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))).alias("inertia")  # over k rows
    at = (F.col("block") * block_dims + F.col("dim")).alias("at")
    # One row per component of a centroid, k * dims in all.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "v"))), lambda x: x["v"].cast("string")), ",")
    digest = values.groupBy("cluster").agg(F.sha2(joined, 256).alias("centroid_sha256"))
    facts = materialise(per.select("*", every).join(digest, "cluster"))
    return found.join(facts, "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
