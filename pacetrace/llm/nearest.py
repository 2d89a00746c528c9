"""Approximate nearest neighbours by learned partitions: a classifier sends each query to its likeliest parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .embedding_duplicates import usable
from .groups import sorted_runs
from .routing import Router, fit

#: Distinct vectors that the partitions are learned from, and queries that the number of parts to search is set by.
SAMPLE, TRIAL = 8192, 256
#: Parts of the space; fewer where the sample has fewer than ``LEAST`` vectors a part.
PARTS, LEAST = 32, 64
#: Recall that the trial queries must reach.
RECALL = 0.95
#: Rows and queries of a block; a pair of blocks is what a task holds at once.
ROWS_A_BLOCK, QUERIES_A_BLOCK = 8192, 2048
#: Scores closer than this are told apart by the exact formula.
MARGIN = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two so that no square over- or underflows; cosines keep every bit."""
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -e[:, None])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, summed in the order of components whatever the shape."""
    x, y = scaled(x), scaled(y)
    xy, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for j in range(x.shape[1]):
        xy += x[:, j] * y[:, j]
        xx += x[:, j] * x[:, j]
        yy += y[:, j] * y[:, j]
    return xy / (np.sqrt(xx) * np.sqrt(yy))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _best(q: np.ndarray, r: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row number and exact score of each query's ``k`` best rows: by score, then smaller name."""
    near, row = [], []
    uq, ur = unit_rows(q), unit_rows(r)
    for at in range(0, len(q), 256):
        s = uq[at : at + 256] @ ur.T
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        i, j = np.nonzero(s >= least[:, None] - MARGIN)
        near.append(i + at)
        row.append(j)
    i, j = np.concatenate(near), np.concatenate(row)
    score = np.concatenate([cosines(q[i[a : a + 50_000]], r[j[a : a + 50_000]]) for a in range(0, len(i), 50_000)] or [np.zeros(0)])
    order = np.lexsort((names[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    keep = place < k
    return i[keep], j[keep], score[keep]


def _distinct(rows: DataFrame, least: int) -> DataFrame:
    """``vec, ids``: each distinct vector with its ``least`` smallest ids, which are all that an answer can need."""
    w = Window.partitionBy("vec").orderBy("id")
    some = rows.select("id", "vec").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= least)  # limited before the shuffle too
    return some.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])


def _indexed(classes: DataFrame, router: Router | None, dims: int) -> DataFrame:
    """``rep, ids, vec, part``: each vector in its likeliest part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.ranked(unit_rows(_matrix(b.column(2), dims)))[:, 0] if router else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], names=["rep", "ids", "vec", "part"])

    return classes.select("rep", "ids", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "rep long, ids array<long>, vec array<double>, part int")


def _drawn(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """The ``n`` vectors of smallest hash (all, if fewer), one row each; only about 4 n of them are sorted."""
    h, rows = F.xxhash64("vec", F.lit(seed)), vectors.count()
    cut = (1 << 63) - 1 if rows <= 4 * n else (4 * n << 64) // rows - (1 << 63)
    return np.array([r.vec for r in vectors.filter(h <= cut).orderBy(h, "vec").limit(n).select("vec").collect()], np.float64)


def _probes(index: DataFrame, trial: np.ndarray, router: Router, parts: int, dims: int, k: int, recall: float) -> int:
    """Parts to search so that the trial queries find ``recall`` of their true neighbours: one linear pass over the index.

    A task gives ``k`` rows a trial query, whatever it has read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rep, x, part = b.column(0).to_numpy(), _matrix(b.column(1), dims), b.column(2).to_numpy()
            i, j, s = _best(trial, x, rep, k + 1)
            other = (x[j] != trial[i]).any(axis=1)
            new = np.rec.fromarrays([i[other], s[other], rep[j[other]], part[j[other]]], names="q,s,rep,part")
            held = new if held is None else np.concatenate([held, new])
            held = held[np.lexsort((held["rep"], -held["s"], held["q"]))]
            held = held[np.arange(len(held)) - np.searchsorted(held["q"], held["q"], "left") < k]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[c].astype(t)) for c, t in (("q", np.int32), ("s", np.float64), ("rep", np.int64), ("part", np.int32))], names=["q", "s", "rep", "part"])

    first = Window.partitionBy("q").orderBy(F.desc("s"), "rep")
    near = index.select("rep", "vec", "part").mapInArrow(run, "q int, s double, rep long, part int")
    true = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select("q", "part").collect()  # TRIAL * k rows at most
    if not true:
        return parts
    rank = np.argsort(router.ranked(unit_rows(trial)), axis=1)
    place = np.sort([rank[r.q, r.part] for r in true])
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1


def _blocks(counts: dict[int, int], size: int) -> dict[int, int]:
    return {p: -(-n // size) for p, n in counts.items()}


def _search(index: DataFrame, asked: DataFrame, router: Router | None, probes: int, dims: int, k: int) -> DataFrame:
    """``query, score, ids``: the best rows of each (block of queries, block of rows) of the parts that a query is sent to."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = router.ranked(unit_rows(_matrix(b.column(1), dims)))[:, :probes] if router else np.zeros((b.num_rows, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["rep", "vec", "parts"])

    routed = asked.select("rep", "vec").mapInArrow(route, "rep long, vec array<double>, parts array<int>")
    sent = materialise(routed.select("rep", "vec", F.explode("parts").alias("part")))
    rows = {r.part: r.n for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # PARTS rows
    asks = {r.part: r.n for r in sent.groupBy("part").agg(F.count("*").alias("n")).collect()}
    row_blocks, ask_blocks = _blocks(rows, ROWS_A_BLOCK), _blocks(asks, QUERIES_A_BLOCK)

    def count(of: dict[int, int]):
        pairs = [F.lit(x) for kv in of.items() for x in kv]
        return F.coalesce(F.create_map(*pairs)[F.col("part")], F.lit(0)) if pairs else F.lit(0)

    def own(of: dict[int, int]):
        return F.pmod(F.xxhash64("rep"), F.greatest(count(of), F.lit(1))).cast("int")

    def all_of(of: dict[int, int]):
        return F.explode(F.sequence(F.lit(1), count(of)))

    right = index.filter(count(ask_blocks) > 0).withColumn("j", all_of(ask_blocks)).select(
        "part", own(row_blocks).alias("i"), (F.col("j") - 1).alias("j"), F.lit(1).alias("side"), "rep", "ids", "vec")
    left = sent.filter(count(row_blocks) > 0).withColumn("i", all_of(row_blocks)).select(
        "part", (F.col("i") - 1).alias("i"), own(ask_blocks).alias("j"), F.lit(0).alias("side"), "rep", F.lit(None).cast("array<long>").alias("ids"), "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["part", "i", "j"]):
            side, rep = t.column("side").to_numpy(), t.column("rep").to_numpy()
            x, at = _matrix(t.column("vec"), dims), np.flatnonzero(side == 1)
            asking = np.flatnonzero(side == 0)
            if not len(at) or not len(asking):
                continue
            i, j, s = _best(x[asking], x[at], rep[at], k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[asking][i]), pa.array(s), t.column("ids").combine_chunks().take(pa.array(at[j]))], names=["query", "score", "ids"])

    keys = ["part", "i", "j"]
    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(meet, "query long, score double, ids array<long>")


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, parts: int = PARTS,
    sample: int = SAMPLE, recall: float = RECALL, seed: int = 0,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the ``k`` rows of ``vectors`` of largest cosine that were found.

    A row is never its own neighbour (rows of the same id aren't).  ``score`` is the cosine of the original vectors in double
    precision; ties go to the smaller id.  All candidates, if there are fewer than ``k``.

    Method: ``sample`` distinct vectors, those of smallest hash, make a neighbour graph; it is cut into ``parts`` balanced
    parts with few edges between them, and a small network learns which parts a vector's neighbours are in.  Every row goes to
    its likeliest part.  Of the queries, ``TRIAL`` are searched exactly in one pass; they set how many parts a query is
    sent to, the least that finds ``recall`` of their neighbours.  Parts are cut in blocks of rows and of queries, so a part
    that holds most rows is spread; a task holds a pair of blocks.  All scores that can count are taken again by the exact
    formula, which sums in one order.  The bounded sample and the trial queries only fit the index; all rows are indexed, and
    all queries are answered.

    Equal vectors are searched once, as one vector with its ``k + 1`` smallest ids, and queries of equal vectors as one.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids; vectors of
    different length don't meet.  Rows that repeat an id with other vectors are candidates each; a repeated query id is asked
    with each of its vectors, and the best ``k`` distinct ids over them are its answer.  Extra columns are ignored; empty
    tables give an empty table.
    """
    def clean(df: DataFrame) -> DataFrame:
        vec = F.col(vec_col)
        return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(
            usable(vec) & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False)) & F.col(id_col).isNotNull())

    asked = materialise(clean(queries))
    classes = materialise(_distinct(clean(vectors), k + 1))
    # A number for each distinct vector that is asked with; written, so it stays.
    single = materialise(asked.select("vec").distinct().select("vec", F.monotonically_increasing_id().alias("rep")))
    found = None
    for (dims,) in sorted(single.select(F.size("vec")).distinct().collect()):  # one index for each length that queries have
        own = classes.filter(F.size("vec") == dims)
        ask = single.filter(F.size("vec") == dims).select("rep", F.col("vec").cast("array<double>").alias("vec"))
        drawn = _drawn(own, sample, seed)
        n = min(parts, 1 << max(0, (len(drawn) // LEAST).bit_length() - 1))
        router = fit(unit_rows(drawn), n, seed) if n > 1 else None
        index, probes = materialise(_indexed(own, router, dims)), 1
        if router:
            probes = _probes(index, _drawn(ask, TRIAL, seed + 1), router, n, dims, k, recall)
        part = materialise(_search(index, ask, router, probes, dims, k + 1))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    few = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("query", "score", F.explode("ids").alias("vec_id"))
    of = asked.join(single, "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("query")).distinct()
    pairs = of.join(few, "query").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
