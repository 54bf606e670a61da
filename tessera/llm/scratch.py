"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written. What its query has shuffled is of no use once the table is there; and rows
#: hold whole texts, so a worker's batches, of which several are in memory at a time, are kept small.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    # a side is broadcast if its file is small, or once its rows have been measured
    "spark.sql.autoBroadcastJoinThreshold": "262144",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "4194304",
}
_open = threading.local()  # paths of the tables written in each operator that is running


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if this machine is all there is (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def _settings(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a
    lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None):
        _open.paths[-1].append(path)
    with _settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(operator):
    """An operator whose result is written as a table, after which the tables it made on the way are
    deleted. The result itself goes when an operator around this one ends, or with the folder."""

    @wraps(operator)
    def run(*args, **kwargs):
        if not hasattr(_open, "paths"):
            _open.paths = []
        _open.paths.append([])
        spark = None
        try:
            out = operator(*args, **kwargs)
            spark = out.sparkSession
            made = _open.paths.pop()
            try:
                return materialize(out, operator.__name__)
            finally:
                _delete(spark, made)
        except BaseException:
            if spark is None:
                _delete(SparkSession.active(), _open.paths.pop())
            raise

    return run


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def packed(df: DataFrame) -> DataFrame:
    """df with each row as one column, row, so that columns of any name can stand beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
