"""Starting streams over stored tables and driving them to the end of the available input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "2 minutes"


def prepare_streaming(spark: SparkSession) -> SparkSession:
    """Keep keyed state in RocksDB: it spills to disk and is saved incrementally with each batch."""
    prepare(spark).conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Messages of a topic with their position; needs Spark's Kafka package on the classpath."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.selectExpr("topic", "partition", "offset", "CAST(key AS STRING) AS key", "CAST(value AS STRING) AS payload")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append the stream's rows to a table until the available input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch to ``on_batch`` until the available input is used up."""
    query = (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_fresh(stream: DataFrame, name: str) -> DataFrame:
    """Run into a new table of the shared folder."""
    spark = stream.sparkSession
    return run_to_table(stream, shared_path(spark, name), shared_path(spark, f"{name}-checkpoint"))
