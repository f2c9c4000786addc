"""Where intermediate results live: the folder that all executors share.

On a cluster ``spark.checkpoint.dir`` names it.  Only where that setting is
absent in local mode (tests) a folder of this machine is taken; a cluster without
it is refused.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: Seconds between two collections of the driver's garbage, and when the last was.
RELEASE_S, _released = 5.0, [0.0]
#: The frames that ``cut`` returned, by identity, and their paths.
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpusmill-{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def cut(df: DataFrame, what: str = "cut", file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, with ``file_rows`` rows a file at most if given, and read it again.

    This cuts the lineage: a lost executor costs a re-read and not a
    recomputation, and later plans start from a scan with known columns.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    if time.monotonic() - _released[0] > RELEASE_S:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``cut`` has written for these, once nothing reads it any more."""
    for df in frames:
        held, path = _paths.pop(id(df), (lambda: None, ""))
        if held() is df:
            _delete(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


def release(spark: SparkSession, wait_s: float = 0.0) -> None:
    """Let executors delete the shuffle files that no plan refers to any more.

    Spark does so when the driver collects its garbage, which a driver with
    little to do may put off for half an hour.  With ``wait_s`` the last query's
    events are given time to pass, for until then they hold its plan.
    """
    time.sleep(wait_s)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released[0] = time.monotonic()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return
