"""Packing documents into fixed windows by minimum bin slack over the counts of their remaining lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions.storage import materialise
from .pretokens import CACHE_BYTES, encoder
from .workers import tidy


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, each at most ``counts`` times, whose sum comes closest to ``capacity`` from below.

    Bit ``s`` of a bitset says that a sum ``s`` can be reached; each length is added by doubling its multiples.  Going back
    through the bitsets gives how often each length is used.  Longer lengths come first and are preferred on the way back.
    """
    reach, mask = 1, (1 << (capacity + 1)) - 1
    history: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(step, left)
            history.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(history):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(number of windows, lengths in each)`` until every remaining length is placed.

    Each round opens a window with the longest length left and fills it with the least slack possible, then repeats that
    window as often as the counts allow.  A round uses up a length or a good part of it, so the plan is bounded by the
    number of distinct lengths, not by the number of documents.
    """
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = best_fill({k: v for k, v in rest.items() if v}, capacity - longest) if capacity > longest else {}
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def tokenised_pieces(
    docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int | None, cache_bytes: int = CACHE_BYTES
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, part, nth, ids``: each document cut every ``capacity`` ids, as 4-byte integers.

    ``nth`` numbers the pieces of one length within the task ``part`` that wrote them.
    """
    schema = StructType([
        StructField("doc_id", LongType()), StructField("start", LongType()), StructField("length", LongType()), StructField("doc_tokens", LongType()),
        StructField("part", LongType()), StructField("nth", LongType()), StructField("ids", BinaryType()),
    ])
    tail = [] if end_id is None else [end_id]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path, cache_bytes), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            names = b.column(0).to_pylist()
            for row, ids, ends in enc.texts(b.column(1)):
                out = []
                for i in range(len(ends) - 1):
                    own = np.concatenate([ids[ends[i] : ends[i + 1]], tail]).astype("<u4")
                    for s in range(0, len(own), capacity):
                        n = min(capacity, len(own) - s)
                        out.append((names[row + i], s, n, len(own), part, seen[n], own[s : s + n].tobytes()))
                        seen[n] += 1
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces(length, part, nth, ...)`` with ``sequence_id, offset``."""
    # Counts per (length, task); per length, at most ``capacity`` numbers go to the planner.
    per = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("c")))
    counts = {r.length: r.c for r in per.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    full = counts.pop(capacity, 0)
    plan = ([(full, {capacity: 1})] if full else []) + plan_windows(counts, capacity)
    slots, sequence, used = [], 0, {}
    for times, window in plan:
        offset = 0
        for length in sorted(window, reverse=True):
            n, first = window[length], used.get(length, 0)
            used[length] = first + times * n
            slots.append((length, first, used[length], n, sequence, offset))
            offset += n * length
        sequence += times
    slot = pieces.sparkSession.createDataFrame(slots, "length long, lo long, hi long, n long, base long, skip long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = materialise(per.select("length", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead")))
    rank = F.col("nth") + F.col("ahead")
    # The plan has a few thousand slots at most, bounded by the lengths there are and not by the documents.
    placed = pieces.join(ahead, ["length", "part"]).withColumn("rank", rank).join(F.broadcast(slot), "length").filter("rank >= lo and rank < hi")
    turn = F.col("rank") - F.col("lo")
    return placed.withColumn("sequence_id", F.col("base") + F.floor(turn / F.col("n")).cast("long")).withColumn(
        "offset", F.col("skip") + turn % F.col("n") * F.col("length")
    ).drop("rank", "ahead", "lo", "hi", "n", "base", "skip")


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int | None = 1,
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, sequence_id, offset``: every piece of every document and its place.

    A document's ids, with ``end_id`` after them, are cut every ``capacity`` ids; full pieces are sequences of their own.
    What remains of each document, shorter than ``capacity``, is placed whole by minimum bin slack (``plan_windows``) over
    the number of remainders of each length: at most ``capacity`` counts, whatever the corpus, so planning is bounded.
    Remainders of one length are numbered by their task and their place in it, so that a length that very many documents
    share is spread over tasks; the number gives window, slot and offset.

    Sequences are gapless from offset 0; ids run from 0 without holes.  A null or empty text has the end id only (with
    ``end_id`` None, no piece).  A null id is kept as null.  Rows that repeat an id are packed each for itself; extra columns
    are ignored; an empty table gives an empty table.  ``cache_bytes`` bounds what a worker's encoder keeps; no result
    depends on it.
    """
    pieces = materialise(tokenised_pieces(docs, path, id_col, text_col, capacity, end_id, cache_bytes))
    return place(pieces, capacity).drop("part", "nth")


def placements(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int | None = 1
) -> DataFrame:
    """As ``pack``, with ``ids_crc32`` of the ids of each piece in place of the ids, which then need no shuffle."""
    pieces = materialise(tokenised_pieces(docs, path, id_col, text_col, capacity, end_id))
    narrow = pieces.select("doc_id", "start", "length", "doc_tokens", "part", "nth", F.crc32("ids").alias("ids_crc32"))
    return place(narrow, capacity).drop("part", "nth")
