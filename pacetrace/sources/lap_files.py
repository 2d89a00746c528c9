"""Files of single laps: written with the lap's own time in the Parquet footer, and footers read without the data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .sessions import STEM, reference_time

#: Fixed value: the footer key of a lap's recorded time.
TIME_KEY = "authoritative_lap_time_s"
FILES_A_TASK = 64


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_lap_files(frames: DataFrame, folder: str, by: list[str], name: str, time: str | None = None) -> DataFrame:
    """One file per group ``by`` (a lap, so some thousand rows), called by the column ``name``; returns the paths written.

    A positive number in the column ``time`` goes into the footer.  A task that is repeated writes the same file again.
    """
    keep = [c for c in frames.columns if c not in (name, time)]

    def write(lap: pa.Table) -> pa.Table:
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        to = f"{root}/{lap.column(name)[0].as_py()}"
        seconds = lap.column(time)[0].as_py() if time else None
        rows = lap.sort_by("frame_id").select(keep)
        rows = rows.replace_schema_metadata({TIME_KEY: repr(seconds)} if seconds and seconds > 0 else {})
        pq.write_table(rows, to, filesystem=fs, compression="snappy")
        return pa.table({"path": [to]})

    return frames.groupBy(*by).applyInArrow(write, "path string")


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _FooterReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet"))
        return [_Files(paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = _opened(self.folder)
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                meta = pq.read_metadata(f)
            values = {k.decode(): v.decode(errors="replace") for k, v in (meta.metadata or {}).items() if not k.startswith((b"ARROW:", b"org.apache.spark"))}
            yield path, meta.num_rows, values


class ParquetFooters(DataSource):
    """``spark.read.format("parquet_footers").load(folder)``: ``path, rows, metadata`` of every file, from footers alone."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return "path string, rows long, metadata map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FooterReader(self.options["path"])


def read_footers(spark: SparkSession, folder: str) -> DataFrame:
    """Path, row count and key-value metadata of the Parquet files below a folder, ``FILES_A_TASK`` files a task."""
    spark.dataSource.register(ParquetFooters)
    return spark.read.format("parquet_footers").load(folder)


def recorded_times(footers: DataFrame) -> DataFrame:
    """``session_id, authoritative_lap_time_s``: positive recorded times; anything else in the footer counts as none."""
    seconds = F.col("metadata").getItem(TIME_KEY).try_cast("double")
    stem = F.regexp_extract("path", STEM, 1)
    return footers.select(stem.alias("session_id"), F.when(seconds > 0, seconds).alias(TIME_KEY)).filter(F.col(TIME_KEY).isNotNull())


def file_times(footers: DataFrame) -> DataFrame:
    """``session_id, file_time_s``: the times in the names of lap files."""
    return footers.select(F.regexp_extract("path", STEM, 1).alias("session_id"), reference_time(F.col("path")).alias("file_time_s")).filter("file_time_s IS NOT NULL")
