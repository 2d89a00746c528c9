"""A streaming sink of versioned shard folders under one pointer: readers see all of a commit or nothing of it.

A micro-batch is written to a new folder; then one small file, ``CURRENT``, is replaced in a single rename (on an object
store: a single put) by one that also names that folder.  A writer killed before that leaves a folder that nobody reads, and the
replayed batch writes another; one killed after it finds its batch in the pointer and doesn't write again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

POINTER = "CURRENT"
NOTICE = "source_id string, flushed_to long, rows long"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Put ``text`` at ``path`` in one step: readers get the old text or the new."""
    conf, fs_api = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    new = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(fs_api, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs_api.FileContext.getFileContext(new.toUri(), conf).rename(new, _path(spark, path), how)


def pointer(spark: SparkSession, root: str) -> dict:
    """``versions``: the folders that count, and ``batch``: the last micro-batch among them."""
    if not _exists(spark, f"{root}/{POINTER}"):
        return {"versions": [], "batch": -1}
    return json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0])


def read_shards(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All committed frames; ``source_id`` is a partition of every version, so a filter on it reads those folders only."""
    versions = pointer(spark, root)["versions"]
    if not versions:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{root}/{v}") for v in versions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _write(frames: DataFrame, root: str, name: str) -> str:
    version = f"{name}-{uuid.uuid4().hex}"
    # A shard's rows lie together and in order; sources with many frames are spread over their shards.
    by = frames.repartition("source_id", "shard").sortWithinPartitions("source_id", "shard", "frame_id")
    by.write.partitionBy("source_id").option("compression", "snappy").parquet(f"{root}/{version}")
    return version


def shard_sink(root: str, after_write: Callable[[], None] = lambda: None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler that commits frames with their ``shard`` under ``root``, and then notes how far each source is
    written, as rows ``source_id, flushed_to, rows`` under ``root/notices``.  ``after_write`` runs between write and commit."""

    def handle(frames: DataFrame, batch_id: int) -> None:
        spark = frames.sparkSession
        now = pointer(spark, root)
        if batch_id > now["batch"]:
            version = _write(frames, root, f"v{batch_id:09d}")
            after_write()
            _replace(spark, f"{root}/{POINTER}", json.dumps({"versions": [*now["versions"], version], "batch": batch_id}))
        else:
            version = next((v for v in now["versions"] if v.startswith(f"v{batch_id:09d}-")), None)
        if version:
            written = spark.read.schema(frames.schema).parquet(f"{root}/{version}")
            done = written.groupBy("source_id").agg(F.max("frame_id").alias("flushed_to"), F.count(F.lit(1)).alias("rows"))
            done.write.mode("overwrite").parquet(f"{root}/notices/batch={batch_id}")

    return handle


def start_shard_sink(shards: DataFrame, root: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Commit the frames of ``shard_stream`` at every trigger; ``every=None`` drains what is there and stops."""
    writer = shards.writeStream.foreachBatch(shard_sink(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def flush_notices(spark: SparkSession, root: str) -> DataFrame:
    """The notices of a shard sink as a stream."""
    spark.createDataFrame([], NOTICE).write.mode("append").parquet(f"{root}/notices/batch=-1")  # the folder must be there
    return spark.readStream.schema(NOTICE).parquet(f"{root}/notices")


def merge_shards(spark: SparkSession, root: str, schema: StructType) -> None:
    """After a restart, or when versions have become many: one folder in place of all, by the same single step."""
    now = pointer(spark, root)
    if len(now["versions"]) > 1:
        merged = _write(read_shards(spark, root, schema), root, "merged")
        _replace(spark, f"{root}/{POINTER}", json.dumps({"versions": [merged], "batch": now["batch"]}))


def vacuum_shards(spark: SparkSession, root: str) -> int:
    """Delete the folders that the pointer doesn't name, when neither writer nor readers are at work; their number."""
    keep, top = set(pointer(spark, root)["versions"]), _path(spark, root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName() not in keep | {"notices"}]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
