"""Written intermediate tables.

A table that several later steps read is written once to the shared checkpoint folder and read back.  That cuts the
lineage, survives the loss of an executor, and gives Catalyst the exact size of the table, so that it broadcasts the table
only when it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.  Results are lazy and may read these
tables, so they stay until ``clear_scratch`` is called once the results have been used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, and only in local mode, one of its own.

    The folder made in local mode is removed when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="pacetrace-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path below the scratch folder, known to ``clear_scratch``."""
    path = f"{scratch_dir(spark).rstrip('/')}/pacetrace-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark(spark: SparkSession) -> int:
    """How many paths this session has taken below the scratch folder so far."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what this session has written to the scratch folder after the mark ``since``, but for the paths ``keep``.

    Results that still read what is deleted can't be used any more.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        if path not in keep:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    paths[since:] = [p for p in paths[since:] if p in keep]
