"""Written intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (local tests), one of our own, which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="promptloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _written.append((spark, folder))
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-run, and two readers don't compute
    ``df`` twice (``DataFrame.checkpoint`` runs its last stage twice). Files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clear() -> None:
    """Delete every table that ``materialise`` wrote; results that still read them become unreadable."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already
            pass
