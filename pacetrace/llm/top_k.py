"""Exact top-k inner-product search with a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..functions.storage import materialise
from .embedding_duplicates import usable

LISTS = 4
ROWS_A_BLOCK = 4096
QUERIES_A_BLOCK = 1024
SPREAD = 32
NEVER = -(1 << 63)


def _pack(rows: DataFrame, dims: int, size: int, key: Column, blocks: int, tau: bool) -> DataFrame:
    """Blocks of about ``size`` rows, one row each: ``block, ids, values`` and with ``tau`` the cutoffs, as binary."""
    schema = StructType([StructField("block", IntegerType()), *(StructField(c, BinaryType()) for c in ("ids", "values", "tau"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            blk = t.column(0).to_numpy()
            values = t.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            order = np.argsort(blk, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(blk[order])) + 1):
                for a in range(0, len(own), size):
                    at = own[a : a + size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(blk[at[0]])], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (t.column(1).to_numpy()[at], values[at].astype("<i8"), t.column(3).to_numpy()[at]))],
                        names=schema.names,
                    )

    cut = F.coalesce(F.col("tau"), F.lit(NEVER)) if tau else F.lit(NEVER)
    return rows.select(key.cast("int").alias("block"), "id", "v", cut.cast("long").alias("tau")).mapInArrow(run, schema)


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``q`` and ``v``; through doubles where these are exact."""
    if len(q) and len(v) and float(np.abs(q).max()) * float(np.abs(v).max()) * max(q.shape[1], 1) < 2**52:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _scan(pairs: DataFrame, dims: int, k: int, threshold: bool) -> DataFrame:
    """``query_id, vec_id, score`` from every (query block, row block): at most ``k`` rows a query and block.

    Without ``threshold``, phase 1: in each of ``LISTS`` slices of the dimensions, the ``k`` rows of the highest partial
    scores; their full scores are the local list.  With it, phases 2 and 3: every row with a partial score of at least
    its share of the query's cutoff in some slice is collected, and only those rows' remaining slices are added up.
    """
    schema = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", LongType())])
    cuts = np.linspace(0, dims, min(LISTS, dims) + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for qi, qv, qt, vi, vv in zip(*(t.column(c) for c in range(5))):
                q_id, v_id = (np.frombuffer(x.as_buffer(), np.int64) for x in (qi, vi))
                q, v = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dims) for x in (qv, vv))
                tau = np.frombuffer(qt.as_buffer(), np.int64)
                out = []
                for a in range(0, len(q), 128):
                    rows = q[a : a + 128]
                    parts = [_product(rows[:, x:y], v[:, x:y]) for x, y in zip(cuts, cuts[1:])]
                    for r in range(len(rows)):
                        mine = [p[r] for p in parts]
                        other = v_id != q_id[a + r]
                        if threshold and tau[a + r] != NEVER:
                            # Scores of at least tau have a slice of at least tau / LISTS.
                            cut = -(-int(tau[a + r]) // len(mine))
                            at = np.flatnonzero(np.logical_or.reduce([m >= cut for m in mine]) & other)
                        elif threshold:
                            at = np.flatnonzero(other)
                        else:
                            at = np.flatnonzero(other)
                            at = at[np.unique(np.concatenate([_best(m[at], v_id[at], k) for m in mine]))]
                        score = np.sum([m[at] for m in mine], axis=0)
                        if threshold and tau[a + r] != NEVER:
                            at, score = at[score >= tau[a + r]], score[score >= tau[a + r]]
                        top = _best(score, v_id[at], k)
                        out.append((np.full(len(top), q_id[a + r]), v_id[at[top]], score[top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=schema.names)

    return pairs.mapInArrow(run, schema)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """The ``k`` rows of ``vectors`` of highest integer inner product with each row of ``queries``.

    Returns ``query_id, rank, vec_id, score``; ranks from 1, ties to the smaller id, a row never answers a query of its own
    id.  Components are ``floor(scale * x)``.  Method, three phases under one uniform threshold: the dimensions are cut into
    ``LISTS`` slices, and each block of rows lists the best partial scores of each slice; the k-th best full score of all
    lists is a safe cutoff; it goes back to the query, and a second pass collects all rows with a slice of at least the
    cutoff's share and resolves their full scores.  Queries travel in blocks of about ``QUERIES_A_BLOCK``; rows in
    blocks of ``ROWS_A_BLOCK``; a (query block, row block) pair is one row of an equi join, so neither side is broadcast.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without id; only vectors
    of the query's length answer it.  Fewer than ``k`` rows: all of them.  Rows that repeat an id are separate answers; of
    queries that repeat an id the smallest vector counts.  Empty tables give an empty table; extra columns are ignored.
    """

    def ints(df: DataFrame) -> DataFrame:
        good = df.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
        value = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return good.select(F.col(id_col).cast("long").alias("id"), value.alias("v"))

    rows, asked = ints(vectors), materialise(ints(queries).groupBy("id").agg(F.min("v").alias("v")))
    sizes = asked.groupBy(F.size("v").alias("d")).count().collect()  # one row for each length that queries have
    result = None
    for dims, n in sorted(tuple(s) for s in sizes):
        own = asked.filter(F.size("v") == dims)
        blocks = -(-n // QUERIES_A_BLOCK)
        spread = F.pmod(F.xxhash64("ids"), F.lit(SPREAD)).cast("int")
        packed = _pack(rows.filter(F.size("v") == dims), dims, ROWS_A_BLOCK, F.lit(0), 1, False)
        packed = materialise(packed.select(spread.alias("slot"), F.col("ids").alias("r_ids"), F.col("values").alias("r_values")))
        dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def met(q: DataFrame, tau: bool, dims=dims, blocks=blocks, dealt=dealt) -> DataFrame:
            key = F.pmod(F.xxhash64("id"), F.lit(blocks))
            q = q.repartition("id") if blocks == 1 else q.repartition(blocks, key)
            q = _pack(q, dims, QUERIES_A_BLOCK, key, blocks, tau).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
            return dealt.join(q, ["block", "slot"]).select("ids", "values", "tau", "r_ids", "r_values")

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        lists = _scan(met(own, False), dims, k, False)
        tau = lists.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("tau"))
        own = materialise(own.join(tau, "id", "left"))
        part = _scan(met(own, True), dims, k, True)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
