"""Streams over the events table: the same logic as the batch queries, with bounded state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder, table


def event_stream(spark: SparkSession, sf_dir: str, watermark: str = "1 hour") -> DataFrame:
    """The events table as a stream with an event time; late rows beyond the watermark are dropped."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, for the table can be a folder or a single file, and a stream's plain path must be a folder
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def count_by_window(events: DataFrame, length: str) -> DataFrame:
    """Events by window and type, of a stream or a table."""
    return events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, mode: str, rocksdb: bool = False) -> DataFrame:
    """Everything that is there now, as a table that executors write in the folder they share with the
    driver (spark.checkpoint.dir). Each batch has a folder of its own, so one that is repeated replaces itself.
    rocksdb: state is kept by RocksDB, as operators with state of their own need."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/tessera/stream-{uuid.uuid4().hex}"
    written = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number if mode == 'append' else 0}")
        written.append(number)

    before = spark.conf.get(_PROVIDER)
    if rocksdb:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
        spark.conf.set(_PROVIDER, before)
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
