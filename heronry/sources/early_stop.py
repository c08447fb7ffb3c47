"""A scan that stops early (R5, S2): only the files up to the one where a budget is met are read with their payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import id_bucket, sum_before
from .scratch import scratch


def scan_until(spark: SparkSession, paths: str | list[str], value: str, target, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files, in order of path and position, until the total of ``value`` over those that ``where`` lets pass
    reaches ``target``; the row that crosses it is kept, as ``sampling.take_budget`` does.

    A first pass reads ``value`` and the columns of ``where`` only, and totals them by file. Sums over the files before
    tell the file where the total is reached, and sums inside that one the row. The payload is then read by a plain
    filter on the files' names and the rows' numbers, of which the names are applied before a file is opened. Nulls of
    ``value`` count nothing. With no row at all, or a target that nothing reaches, all rows come."""
    paths = [paths] if isinstance(paths, str) else paths
    whole = spark.read.parquet(*paths)
    passing = whole if where is None else whole.where(where)
    where_at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    narrow = passing.select(F.coalesce(F.col(value), F.lit(0)).alias("__v"), *where_at)
    # the files' totals in order, numbered by ranges of their names: no task takes all
    path = scratch(spark, "totals")
    totals = narrow.groupBy("__file").agg(F.sum("__v").alias("__t"))
    totals.repartitionByRange("__file").withColumn("__range", F.spark_partition_id()).write.parquet(path)
    sums = sum_before(spark.read.parquet(path), "__t", F.col("__range"), ["__file"])
    out = passing.select(*(whole.columns if columns is None else columns), *where_at)
    found = sums.where((F.col("before") < target) & (F.col("before") + F.col("__t") >= target)).first()
    if found is not None:
        inside = sum_before(narrow.where(F.col("__file") == found["__file"]), "__v", id_bucket("__row"), ["__row"])
        last = inside.where(F.col("before") + found["before"] < target).agg(F.max("__row")).first()[0]
        # the scan leaves out files by this condition on their names
        out = out.where(F.col("_metadata.file_path") <= found["__file"]).where((F.col("__file") < found["__file"]) | (F.col("__row") <= last))
    elif target <= 0:
        out = out.limit(0)
    return out.drop("__file", "__row")
