"""Cutting the lineage of tables that several later stages read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if not path:
            shared_dir.own = path = "file://" + tempfile.mkdtemp(prefix="lapwing-")
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


_open: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at its end, once the results have gone to their sink."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _drop(spark, path)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, safe from lost executors, and a short plan for what follows. Removed at the end of the `scope` it is written in, else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lapwing-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    else:
        atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)
