"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..functions.storage import materialise
from .components import components
from .groups import binary_of, fixed_binary, sorted_runs
from .textops import U64, mix, random_u64, text_shingles
from .workers import small_batches, tidy

BANDS, ROWS = 27, 7
BLOCK = 1024
_ROUND = random_u64(1024, 11)


def sketch(items: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes: the smallest (round, hash) that reached each bin.

    In each of the first ``bins`` rounds every item falls into a bin picked by that round's hash; in round ``bins + i``
    every item falls into bin ``i``, so that no bin stays empty whatever the size of the set.  Rounds stop once all bins
    are filled: about ``bins * ln(bins) / len(items)`` of them.
    """
    out = np.full(bins, np.iinfo(np.uint64).max, U64)
    at, step = 0, max(1, math.ceil(bins * math.log(bins) / len(items)))
    while at < 2 * bins:
        rounds = np.arange(at, min(2 * bins, at + step))
        h = mix(items[None, :] * _ROUND[rounds][:, None] + rounds[:, None].astype(U64))
        bin_of = np.where(rounds[:, None] < bins, (h & U64(0xFFFFFFFF)) % U64(bins), (rounds[:, None] - bins).astype(U64))
        np.minimum.at(out, bin_of.astype(np.int64).ravel(), ((h >> U64(10)) | (rounds[:, None].astype(U64) << U64(54))).ravel())
        at += len(rounds)
        if out.max() >> U64(54) < at:
            break
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Two bytes of each bin's value, enough to compare bins and to name bands."""
    return (mix(values) >> U64(48)).astype(np.uint16)


def _set_hashes(items: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set of shingles."""
    if not len(items):
        return 0, 0
    return int(mix(items + U64(7)).sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(mix(items ^ U64(0x5BD1E995))).view(np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int = 5, bins: int = BANDS * ROWS) -> DataFrame:
    """``id, n, s1, s2, sketch``: the number of distinct shingles, two hashes of the set, and its sketch (null when empty)."""
    schema = StructType(
        [StructField("id", LongType()), StructField("n", LongType()), StructField("s1", LongType()), StructField("s2", LongType()), StructField("sketch", BinaryType())]
    )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, sk = [], [], [], []
            for _, found, _ in text_shingles(b.column(1), size):
                items = np.unique(found)
                n.append(len(items))
                one, two = _set_hashes(items)
                s1.append(one)
                s2.append(two)
                sk.append(_narrow(sketch(items, bins)).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sk, pa.binary())],
                names=["id", "n", "s1", "s2", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``s1, s2, n, items``: the sorted distinct shingle hashes of ``docs(t)``, with what names the set."""
    schema = StructType([*(StructField(c, LongType()) for c in ("s1", "s2", "n")), StructField("items", BinaryType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(found) for _, found, _ in text_shingles(b.column(0), size)]
            named = np.array([(*_set_hashes(x), len(x)) for x in sets], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(named[:, k]) for k in range(3)), binary_of(sets)], names=["s1", "s2", "n", "items"])

    return docs.select("t").mapInArrow(run, schema)


def _alike(a: Column, b: Column, num: int, den: int) -> Column:
    """Sizes between which a similarity of ``num / den`` is possible."""
    return (F.least(a, b) * den) >= (F.greatest(a, b) * num)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``pairs(a, b)``, those whose full sets have ``den * common >= num * union``."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column(2), t.column(3))):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep[i] = den * common >= num * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, schema)


def _cross_pairs(members: DataFrame, num: int, den: int, best: bool, bands: int, rows: int) -> DataFrame:
    """Pairs of one bucket and different labels whose sketches allow a link.

    A bucket is compared in blocks of at most ``BLOCK`` members against each other, so that a hot one is many small groups;
    nothing but the pairs that pass is emitted, each only in the first band that its sketches share.  ``best``: for each
    member only the likeliest partner of a block pair.
    """
    floor = num / den - 4 * math.sqrt(num / den * (1 - num / den) / (bands * rows))
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("same", IntegerType())])
    count = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    count = materialise(count.select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    m = members.join(count, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    m = m.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "id", "n", "label", "sketch")
    m = m.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["bucket", "i", "j"]):
            ids, n, label, own = (t.column(c).to_numpy() for c in ("id", "n", "label", "own"))
            if (label == label[0]).all():
                continue
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(len(ids), bands * rows)
            twin, band = t.column("i")[0].as_py() == t.column("j")[0].as_py(), t.column("band")[0].as_py()
            out = []
            for x in range(len(ids)):
                ok = (label != label[x]) & (np.minimum(n, n[x]) * den >= np.maximum(n, n[x]) * num)
                ok &= (ids > ids[x]) if twin and not best else (own != own[x]) if not twin else True
                if not twin and not best:
                    ok &= own[x] < own
                y = np.flatnonzero(ok)
                if len(y):
                    same = (sk[y] == sk[x]).sum(axis=1)
                    good = same >= floor * bands * rows
                    y, same = y[good], same[good]
                    shared = (sk[y] == sk[x]).reshape(len(y), bands, rows).all(axis=2)
                    good = shared.argmax(axis=1) == band
                    y, same = y[good], same[good]
                    if best and len(y):
                        y, same = y[[same.argmax()]], same[[same.argmax()]]
                    out.extend((int(min(ids[x], ids[v])), int(max(ids[x], ids[v])), int(s)) for v, s in zip(y, same))
            if out:
                a, b, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int32())], names=["a", "b", "same"])

    pairs = m.mapInArrow(run, schema)
    if not best:
        return pairs.select("a", "b").distinct()
    pairs = materialise(pairs.distinct())
    ends = pairs.select(F.col("a").alias("node"), "a", "b", "same").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "same"))
    top = ends.groupBy("node").agg(F.max(F.struct("same", "a", "b")).alias("t"))
    return top.select("t.a", "t.b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, size: int = 5,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Documents are linked when ``den * common >= num * union`` holds for their sets of distinct ``size``-word shingles (words
    of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a shorter text is one shingle).  ``component_id`` is the smallest id
    reachable by links, ``kept`` marks the document that has it.

    Method: equal sets are one class, grouped by a 128-bit hash.  One document of each class is sketched
    (``sketch``); ``bands`` bands of ``rows`` bins put it into buckets, of which a pair at the threshold 0.85 shares one with
    a chance of 1 - 3e-5.  Links come in three rounds, each confirmed on the full sets: every document with the busiest
    member of its buckets; then, where a bucket still holds several components, every member with its likeliest partner in
    another component; then all pairs of such buckets in different components that the sketches allow.  Pairs inside a
    component are never formed, so a group of near copies costs about a pair per member.

    Null or empty text, and text of white space only: no shingles, linked with nothing.  A null id: ``component_id`` null and
    kept.  Rows that repeat an id are one document: where their texts differ, the one whose set has the smallest hash is
    linked, all get its component, and each row has the size of its own set.  Extra columns are ignored; the order and dealing
    of rows changes nothing.
    """
    small_batches(docs.sparkSession)  # a batch holds whole texts, or whole sets
    sig = materialise(signatures(docs, id_col, text_col, size, bands * rows))
    keys = ["s1", "s2", "n"]
    named = sig.filter("n > 0 and id is not null")
    several = named.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("low"), F.max(F.struct("s1", "s2")).alias("high"))
    several = materialise(several.filter("low <> high").select("id", "low"))
    named = named.join(several, "id", "left").filter(F.col("low").isNull() | (F.col("low") == F.struct("s1", "s2"))).drop("low")
    # From here on, a node is a class of equal sets, and ``id`` its number; ``first`` is one document that has it.
    reps = materialise(
        named.groupBy(*keys).agg(F.min(F.struct("id", "sketch")).alias("r"))
        .select(*keys, F.col("r.id").alias("first"), "r.sketch", F.monotonically_increasing_id().alias("id"))
    )
    width = 2 * rows
    band = F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(sketch, b * {width} + 1, {width})))")
    every = reps.select("id", "n", F.posexplode(band).alias("band", "bucket"))
    shared = materialise(every.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1"))
    members = materialise(every.join(shared, "bucket").select("bucket", "band", "id", "n", "c"))

    # Sets of the documents that share a bucket: everything that verification can ask for.
    busy = materialise(members.groupBy("id").agg(F.sum("c").alias("busy")))
    asked = materialise(reps.join(busy, "id").select("id", *keys, "first"))
    texts = docs.select(F.col(id_col).cast("long").alias("first"), F.col(text_col).cast("string").alias("t"))
    found = shingle_sets(texts.join(asked.select("first").distinct(), "first"), size)
    sets = materialise(found.join(asked.select("id", *keys), keys).select("id", "items").dropDuplicates(["id"]))

    # Round 1: the busiest member of a bucket is its hub; each document meets the busiest of its hubs.
    hub = materialise(
        members.join(busy, "id").groupBy("bucket").agg(F.max(F.struct("busy", (-F.col("id")).alias("neg"), "n")).alias("h"))
    )
    meet = members.select("bucket", "id", "n").join(hub, "bucket").filter((-F.col("h.neg") != F.col("id")) & _alike(F.col("n"), F.col("h.n"), num, den))
    first = materialise(
        meet.groupBy("id").agg(F.max("h").alias("h")).select(F.col("id").alias("a"), (-F.col("h.neg")).alias("b"))
    )
    links = materialise(verified(first, sets, num, den))
    for best in (True, False):
        label = components(links)
        labelled = members.select("bucket", "band", "id", "n").join(label.withColumnRenamed("node", "id"), "id", "left")
        labelled = labelled.select("bucket", "band", "id", "n", F.coalesce("component", "id").alias("label"))
        split = materialise(
            labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
        )
        left = materialise(labelled.join(split, "bucket").join(reps.select("id", "sketch"), "id"))
        more = materialise(verified(_cross_pairs(left, num, den, best, bands, rows), sets, num, den))
        links = links.unionByName(more)

    # Every component has its smallest document.
    node_of = materialise(named.select("id", *keys).distinct().join(reps.select(*keys, F.col("id").alias("node")), keys).select("id", "node"))
    label = components(links)
    placed = materialise(node_of.join(label, "node", "left").select("id", F.coalesce("component", "node").alias("group")).distinct())
    lowest = placed.groupBy("group").agg(F.min("id").alias("component"))
    of_id = placed.join(materialise(lowest), "group").select("id", "component")
    out = sig.select("id", "n").join(of_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
