"""Token ids in compressed binary files, written and read by Spark.

One file, all integers little-endian::

    magic "PTIDS001" | u32 header length | header, JSON | document table | frequency table | blocks

The header names the writing task and the file's number in it, the number of documents and ids, the sizes of the
two tables (zlib), and per block its offset, bytes, ids and CRC-32: a checkpoint from which it is decoded by itself.  The
document table holds id, null flag and number of ids of each document; the frequency table is shared by all blocks, which
are coded by ``ans``.  Files follow each other in the order of (task, file), documents in ascending id.  Bytes after the
last block, such as the line end that the text writer adds, are no part of the file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .ans import decode_block, decoding_tables, encode_block, shared_table
from .pretokens import encoder
from .workers import tidy

MAGIC = b"PTIDS001"
FILE_IDS = 4 << 20
BLOCK_IDS = 1 << 20


def _file(part: int, number: int, names: list[int | None], counts: list[int], ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    seen = np.bincount(ids, minlength=1)
    freq = shared_table(seen)
    table = decoding_tables(freq)
    docs = zlib.compress(
        np.array([0 if n is None else n for n in names], "<i8").tobytes() + np.array([n is None for n in names], np.uint8).tobytes() + np.array(counts, "<u8").tobytes()
    )
    packed_freq, blocks, index, at = zlib.compress(freq.astype("<u4").tobytes()), [], [], 0
    for a in range(0, len(ids), block_ids):
        own = ids[a : a + block_ids]
        data = encode_block(own.astype(np.int64), table[0], table[1])
        index.append([at, len(data), len(own), zlib.crc32(own.astype("<u4").tobytes())])
        blocks.append(data)
        at += len(data)
    header = json.dumps({"part": part, "file": number, "docs": len(names), "ids": len(ids), "tables": [len(docs), len(packed_freq)], "blocks": index}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, docs, packed_freq, *blocks])


def _header(data: memoryview) -> tuple[dict, int]:
    if bytes(data[:8]) != MAGIC:
        raise ValueError("not a file of token ids")
    (n,) = struct.unpack("<I", data[8:12])
    return json.loads(bytes(data[12 : 12 + n])), 12 + n


def _content(data: memoryview) -> tuple[dict, list[int | None], np.ndarray, np.ndarray]:
    """Header, document ids, ids per document, all ids."""
    head, at = _header(data)
    raw = zlib.decompress(data[at : at + head["tables"][0]])
    at += head["tables"][0]
    n = head["docs"]
    names, none, counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<u8", n, 9 * n)
    freq = np.frombuffer(zlib.decompress(data[at : at + head["tables"][1]]), "<u4")
    at += head["tables"][1]
    table, parts = decoding_tables(freq), []
    for begin, size, count, check in head["blocks"]:
        ids = decode_block(bytes(data[at + begin : at + begin + size]), count, *table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError(f"checksum of a block differs: task {head['part']}, file {head['file']}")
        parts.append(ids)
    return head, [None if z else v for v, z in zip(names.tolist(), none.tolist())], counts.astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_ids(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2,
    file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS,
) -> None:
    """Encode whole texts with the tokenizer file ``path`` and write them to ``folder`` in ascending ``id_col``.

    ``end_id`` follows each document.  Texts are dealt out by ranges of the id; a task closes a file at about ``file_ids``
    ids, so memory does not grow with its share.  A null or empty text has the end id only; null ids come first; rows
    that repeat an id are kept, in any order among themselves; extra columns are not written.
    """
    schema = StructType([StructField("image", BinaryType())])
    tail = [] if end_id is None else [end_id]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(path), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        counts: list[int] = []
        pieces: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            image = _file(part, number, names, counts, np.concatenate(pieces) if pieces else np.zeros(0, np.uint32), block_ids)
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], names=["image"])

        for b in batches:
            ids_of = b.column(0).to_pylist()
            for row, ids, ends in enc.texts(b.column(1)):
                for i in range(len(ends) - 1):
                    own = np.concatenate([ids[ends[i] : ends[i + 1]], tail]).astype(np.uint32)
                    names.append(ids_of[row + i])
                    counts.append(len(own))
                    pieces.append(own)
                    held += len(own)
                    if held >= file_ids:
                        yield close()
                        names, counts, pieces, held, number = [], [], [], 0, number + 1
        if names:
            yield close()

    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).repartitionByRange("id").sortWithinPartitions("id")
    # The text writer puts the bytes of a string out as they are, through any file system that Spark knows.
    images = dealt.mapInArrow(run, schema).select(F.col("image").cast("string").alias("value"))
    images.write.option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def read_ids(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, part, file, nth, within, n_tokens, ids``: every document of every file, ids as 4-byte integers.

    ``within`` counts the ids before it in its file, ``nth`` the documents.  Checksums of all blocks are verified.
    """
    schema = StructType([
        StructField(id_col, LongType()), StructField("part", IntegerType()), StructField("file", IntegerType()), StructField("nth", LongType()),
        StructField("within", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                head, names, counts, ids = _content(memoryview(data.as_buffer()))
                ends, raw = np.concatenate([[0], np.cumsum(counts)]), ids.astype("<u4")
                for a in range(0, len(names), 2000):
                    z = min(len(names), a + 2000)
                    n = z - a
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[a:z], pa.int64()), pa.array([head["part"]] * n, pa.int32()), pa.array([head["file"]] * n, pa.int32()), pa.array(np.arange(a, z)),
                            pa.array(ends[a:z]), pa.array(counts[a:z]), pa.array([raw[ends[i] : ends[i + 1]].tobytes() for i in range(a, z)], pa.binary()),
                        ],
                        names=schema.names,
                    )

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``part, file, before``: the ids in all files before each file, from the headers alone."""
    schema = StructType([StructField("part", IntegerType()), StructField("file", IntegerType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [_header(memoryview(d.as_buffer()))[0] for d in b.column(0)]
            cols = [[h["part"] for h in heads], [h["file"] for h in heads], [h["ids"] for h in heads]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.dataType.typeName() == "long" and pa.int64() or pa.int32()) for c, f in zip(cols, schema)], names=schema.names)

    files = spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.groupBy("part").agg(F.sum("n").alias("n"))  # one row a writing task
    tasks = tasks.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(earlier.partitionBy("part").orderBy("file")), F.lit(0))
    return files.select("part", "file", own.alias("own")).join(tasks, "part").select("part", "file", (F.col("base") + F.col("own")).alias("before"))
