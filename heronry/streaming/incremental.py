"""Incremental batches as file streams (R1-R5, K3): new rows are scored once, appended, and never again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.joins import exclude


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def score_new(rows: DataFrame, report: str, key: str, scorer: Callable[[DataFrame], DataFrame], schema: StructType) -> None:
    """Score the rows that the report lacks, and append them; running it again adds nothing."""
    todo = exclude(rows.dropDuplicates([key]), read_or_empty(rows.sparkSession, report, schema), key)
    scorer(todo).select(*schema.fieldNames()).write.mode("append").parquet(report)


#: Keeps keyed state on disk, with a cache of fixed size in memory.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def _unseen(rows: DataFrame, key: str, within: tuple[str, str] | None) -> DataFrame:
    """The first row of each key, by state that the stream keeps; ``within`` (time column, delay) lets old keys go."""
    if within is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(*within).dropDuplicatesWithinWatermark([key])


def _start(rows: DataFrame, write, checkpoint: str):
    """Take what is there and stop. The state's store is chosen when a checkpoint is made, and stays."""
    spark = rows.sparkSession
    for name, value in STORE.items():
        spark.conf.set(name, value)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _put(report: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Each batch has a folder of its own, so one that is done again after a failure replaces itself; the stream's id, which
    its checkpoint keeps, tells batches of another stream apart."""

    def write(df: DataFrame, batch: int) -> None:
        stream = df.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        df.write.mode("overwrite").parquet(f"{report}/batch={stream}-{batch:06d}")

    return write


def read_report(spark: SparkSession, report: str, schema: StructType) -> DataFrame:
    """All rows that a stream has written."""
    return read_or_empty(spark, report, schema).select(*schema.fieldNames())


def score_stream(spark: SparkSession, source: str, source_schema: StructType, report: str, checkpoint: str, key: str, scorer: Callable[[DataFrame], DataFrame], schema: StructType, within: tuple[str, str] | None = None):
    """Rows of files that arrive under ``source`` are scored once for each key.

    The keys seen are the stream's state: a batch reads its own files and the state of its own keys, never the report."""
    rows = _unseen(spark.readStream.schema(source_schema).parquet(source), key, within)
    put = _put(report, checkpoint)
    return _start(rows, lambda df, batch: put(scorer(df).select(*schema.fieldNames()), batch), checkpoint)


def merge_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, offset: int, within: tuple[str, str] | None = None):
    """Worker shards merged under remapped keys; a shard that comes again adds nothing, by the same state."""
    rows = _unseen(spark.readStream.schema(schema).parquet(source).withColumn(key, F.col(key) + offset), key, within)
    return _start(rows, _put(target, checkpoint), checkpoint)


def enrich_missing(df: DataFrame, column: str, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Only rows whose column is null are enriched."""
    return df.where(F.col(column).isNotNull()).unionByName(enrich(df.where(F.col(column).isNull())))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Engine extension, not part of parity: event-time windows with a watermark; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
