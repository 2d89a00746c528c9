"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..functions.storage import materialise
from .components import components
from .groups import fixed_binary, sorted_runs

SLACK = 1e-6
BLOCK = 16384


def usable(vec: Column) -> Column:
    """True for a vector that is not null, not empty, and has only finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad, F.lit(False))


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed random rotation of ``dims`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Subspaces:
    """The blocks of a rotated space, their distance budgets, and the grid cells inside each block."""

    def __init__(self, dims: int, cosine: float, block_dims: int) -> None:
        self.turn = rotation(dims)
        self.cuts = list(range(0, dims, block_dims)) + [dims]
        if len(self.cuts) > 2 and self.cuts[-1] - self.cuts[-2] < block_dims:
            del self.cuts[-2]
        # Unit vectors of cosine c are sqrt(2 - 2c) apart; a block may use its share of dimensions of the square.
        self.budget = np.diff(self.cuts) / dims * max(2 - 2 * cosine, 0.0)
        self.radius = np.sqrt(self.budget) * (1 + SLACK) + SLACK

    def blocks(self) -> range:
        return range(len(self.budget))

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1)[:, None]) @ self.turn

    def owner(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The block of which each pair of rows uses least; the first of equal ones.  Summed component by component, so that a
        pair has the same owner in whatever company it is met."""
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for b in self.blocks():
            use = np.zeros(len(x))
            for j in range(self.cuts[b], self.cuts[b + 1]):
                apart = x[:, j].astype(np.float64) - y[:, j]
                use += apart * apart
            use /= self.budget[b]
            at[use < best] = b
            best = np.minimum(best, use)
        return at

    def cells(self, turned: np.ndarray, b: int) -> np.ndarray:
        """Two grid coordinates of each vector in block ``b``; cells are as wide as the block's radius."""
        first = turned[:, self.cuts[b] : self.cuts[b] + 2]
        at = np.floor((first + 1.0) / max(self.radius[b], 0.02)).astype(np.int64) + 1
        return at if at.shape[1] == 2 else np.column_stack([at, np.zeros_like(at)])


_AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))  # the half of a cell's neighbours that come after it


def _matrix(values: pa.Array, dims: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _turned(vectors: DataFrame, space: Subspaces, dims: int) -> DataFrame:
    """``id, copies, vec, turned``: with the rotated unit vector in single precision.

    A product of matrices can round a row differently in another place or company, so it is taken once and for all; cells,
    distances inside blocks and the block that counts a pair all go by these bits.
    """
    schema = StructType([StructField("id", LongType()), StructField("copies", LongType()), StructField("vec", BinaryType()), StructField("turned", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            raw = t.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            turned = space.turned(raw.astype(np.float64)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), fixed_binary(raw), fixed_binary(turned)], names=schema.names)

    return vectors.select("id", "copies", "vec").mapInArrow(run, schema)


def _rows(column: pa.Array | pa.ChunkedArray, dtype: np.dtype, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims)


def _cell_counts(vectors: DataFrame, space: Subspaces, dims: int) -> dict[tuple[int, int, int], int]:
    """Vectors per (block, cell).  Coordinates of unit vectors bound the cells to (2 / radius + 2)**2 a block."""
    schema = StructType([StructField(c, LongType()) for c in ("b", "x", "y", "c")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            turned = _rows(t.column(0), np.float32, dims).astype(np.float64)
            for b in space.blocks():
                at, c = np.unique(space.cells(turned, b), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), b)), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(c)], names=["b", "x", "y", "c"])

    rows = vectors.select("turned").mapInArrow(run, schema).groupBy("b", "x", "y").agg(F.sum("c").alias("c")).collect()
    return {(r.b, r.x, r.y): r.c for r in rows}


def _deal(vectors: DataFrame, space: Subspaces, dims: int) -> DataFrame:
    """Each vector once for every comparison of its cell, or of a cell just after it, that it takes part in.

    Cells of more than ``BLOCK`` vectors are compared part against part, so that no group grows with a hot cell.
    """
    counts = _cell_counts(vectors, space, dims)
    cells = sorted(counts)
    number = {c: i for i, c in enumerate(cells)}
    parts = {c: -(-counts[c] // BLOCK) for c in cells}
    schema = StructType([
        StructField("cell", IntegerType()), StructField("other", IntegerType()), StructField("i", IntegerType()), StructField("j", IntegerType()),
        StructField("right", IntegerType()), StructField("id", LongType()), StructField("copies", LongType()), StructField("vec", BinaryType()), StructField("turned", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ids, turned = t.column(0).to_numpy(), _rows(t.column(3), np.float32, dims).astype(np.float64)
            out = []
            for b in space.blocks():
                for row, (p, q) in enumerate(space.cells(turned, b).tolist()):
                    own = (b, p, q)
                    mine = (int(ids[row]) * 0x9E3779B1 >> 7) % parts[own]
                    k = number[own]
                    out += [(k, k, min(mine, o), max(mine, o), int(mine > o), row) for o in range(parts[own])]
                    for dp, dq in _AHEAD:
                        after, before = (b, p + dp, q + dq), (b, p - dp, q - dq)
                        if after in number:
                            out += [(k, number[after], mine, o, 0, row) for o in range(parts[after])]
                        if before in number:
                            out += [(number[before], k, o, mine, 1, row) for o in range(parts[before])]
            for a in range(0, len(out), 20_000):
                c, o, i, j, r, row = zip(*out[a : a + 20_000])
                whose = t.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in (c, o, i, j, r)), *whose.columns], names=schema.names)

    return vectors.select("id", "copies", "vec", "turned").mapInArrow(run, schema), {number[c]: c[0] for c in cells}


def _forest(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked vector to the smallest id of its component among the links ``x[k], y[k]``."""
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by_rank = ids[np.argsort(ids, kind="stable")]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        if (new == label).all():
            break
        label = new
    seen = np.unique(np.concatenate([x, y]))
    return ids[seen], by_rank[label[seen]]


def _links(dealt: DataFrame, block_of: dict[int, int], space: Subspaces, dims: int, cosine: float, dtype: np.dtype) -> DataFrame:
    """``a, b, w``: with ``b`` null, ``w`` copies linked to vector ``a``; else a tie between two vectors of a component."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("w", LongType())])
    keys = ["cell", "other", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, keys):
            b = block_of[t.column("cell")[0].as_py()]
            ids, copies, right = (t.column(c).to_numpy() for c in ("id", "copies", "right"))
            twin = t.column("cell")[0] == t.column("other")[0] and t.column("i")[0] == t.column("j")[0]
            x = _rows(t.column("vec"), dtype, dims).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            turned = _rows(t.column("turned"), np.float32, dims)
            part = turned[:, space.cuts[b] : space.cuts[b + 1]]
            square = (part * part).sum(axis=1)
            left, far = (np.arange(len(ids)),) * 2 if twin else (np.flatnonzero(right == 0), np.flatnonzero(right == 1))
            found_x, found_y = [], []
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                near = square[rows][:, None] + square[far][None, :] - 2 * (part[rows] @ part[far].T) <= (space.radius[b] + 1e-4) ** 2
                p, q = np.nonzero(near)
                p, q = rows[p], far[q]
                if twin:
                    p, q = p[p < q], q[p < q]
                for c in range(0, len(p), 200_000):
                    u, v = p[c : c + 200_000], q[c : c + 200_000]
                    u, v = np.where(ids[u] < ids[v], u, v), np.where(ids[u] < ids[v], v, u)
                    ok = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine
                    u, v = u[ok], v[ok]
                    if len(u) and len(space.budget) > 1:
                        # A pair close in several blocks counts in the one where it uses least of its budget.
                        owner = space.owner(turned[u], turned[v])
                        u, v = u[owner == b], v[owner == b]
                    found_x.append(u)
                    found_y.append(v)
            u, v = np.concatenate(found_x or [np.zeros(0, int)]), np.concatenate(found_y or [np.zeros(0, int)])
            if not len(u):
                continue
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, u, copies[v])
            np.add.at(total, v, copies[u])
            some = np.flatnonzero(total)
            a, c = _forest(ids, u, v)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), none, pa.array(total[some])], names=["a", "b", "w"])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "w"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def embedding_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, block_dims: int = 16
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col, n_links, component_id, kept``.

    Vectors are linked when their cosine, in double precision, is at least ``cosine`` (above 0).  Method: unit vectors are
    rotated and cut into blocks of ``block_dims`` dimensions; a linked pair must, in some block, be no farther apart than
    the block's share of the squared distance ``2 - 2 * cosine``.  Every block is joined by range on a grid as wide as its
    radius (a cell with itself and with half of its neighbours), in parts of ``BLOCK`` vectors; pairs within a block's
    radius are verified on the full vectors.  A pair counts only in the block where it uses least of its budget, so links
    need no de-duplication; a task emits link counts and a spanning forest, never the pairs.

    Equal vectors are one vector with a number of copies.  Vectors that are null, empty, zero, or hold null or non-finite
    components have no links; vectors of different length are never linked.  A null id has ``n_links`` 0, a null component
    and is kept.  Rows that repeat an id are separate vectors for ``n_links`` but one node of the component.  Extra columns
    are ignored; an empty table gives an empty table.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    good = rows.filter(usable(F.col("vec")) & F.exists("vec", lambda v: v != 0) & F.col("id").isNotNull())
    classes = materialise(good.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    # Which vector a row has: the longer side is dealt by vector, and Spark splits a vector that very many rows share.
    own = materialise(good.join(classes, "vec").select("id", "rep", "copies"))
    width = materialise(classes.select(F.size("vec").alias("d")).groupBy("d").count())
    dtype = np.dtype(np.float32 if dict(rows.dtypes)["vec"] == "array<float>" else np.float64)
    found = None
    for (dims,) in sorted(width.select("d").collect()):  # one pass for each length that vectors have
        space = Subspaces(dims, cosine, min(block_dims, dims))
        same = classes.filter(F.size("vec") == dims).select(F.col("rep").alias("id"), "copies", F.col("vec") if dtype == np.float32 else F.col("vec").cast("array<double>").alias("vec"))
        dealt, block_of = _deal(materialise(_turned(same, space, dims)), space, dims)
        part = materialise(_links(dealt, block_of, space, dims, cosine, dtype))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, w long")
    # `rep` is the smallest id with that vector, but two vectors can share it when ids repeat; links then add up.
    links = materialise(found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w")))
    tie = own.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    label = components(found.filter("b is not null").select("a", "b").unionByName(several))
    per = (
        own.join(links, "rep", "left")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("id")
        .agg(F.max(F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n"), F.min(F.coalesce("component", "rep")).alias("c"))
    )
    out = rows.select("id").join(per, "id", "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
