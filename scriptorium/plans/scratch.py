"""Tables written to the folder that every executor shares.

Long plans cut their lineage here: the rows are written as Parquet below
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read and
never a recomputation of everything before it.  The setting is read from the
session; only where it is unset (local tests) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or one temporary folder per application in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local[app] = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    return _local[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends (see :func:`release`)."""
    path = f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(release, spark)
    _made[app].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`stored` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        _delete(spark, file.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application; called at exit, harmless after the session has stopped."""
    if spark.sparkContext._jsc is None:
        return
    for path in _made.pop(spark.sparkContext.applicationId, []):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone at exit
            return
