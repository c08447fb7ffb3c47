"""Joins of the curation pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a dimension is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small(dim: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The dimension with a broadcast hint if the plan's statistics, an upper bound, say ``most`` bytes at most.

    Nothing is run for it; a dimension that only turns out small is left to the adaptive plan."""
    return F.broadcast(dim) if int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else dim


def lookup(df: DataFrame, dim: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join to a dimension."""
    return df.join(small(dim), on, "left")


def exclude(df: DataFrame, done: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key isn't in ``done``; duplicates of the left side stay."""
    return df.join(done.select(on).distinct(), on, "left_anti")


def existing(df: DataFrame, listing: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(listing.select(on).distinct(), on, "left_semi")


def with_results(df: DataFrame, results: DataFrame, on: str, order: str) -> DataFrame:
    """Rows with results, in the left side's order."""
    return df.join(results, on).orderBy(order)


def last_wins(df: DataFrame, key: str | list[str], seq: str | Column) -> DataFrame:
    """The last row of each key."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest))


def positional(left: DataFrame, right: DataFrame, key: str, left_list: str, right_list: str) -> DataFrame:
    """The i-th of one list with the i-th of the other; places without a right side are left out."""
    a = left.select(key, F.posexplode(left_list).alias("pos", "left_value"))
    b = right.select(key, F.posexplode(right_list).alias("pos", "right_value"))
    return a.join(b, [key, "pos"])


def at_length(vectors: DataFrame, n: str | Column) -> DataFrame:
    """Rows of a (voice, n_tokens, vec) table for utterances of n tokens."""
    return vectors.where(F.col("n_tokens") == n)


def dense_index(df: DataFrame, key: str, name: str = "speaker_index") -> DataFrame:
    """0-based index of each key by sorted order: ranges of the sorted keys are numbered apart, whatever they begin with."""
    from ..sources.scratch import scratch
    from .sampling import sequence_ids

    path, text = scratch(df.sparkSession, "keys"), F.col(key).cast("string")
    df.select(key).distinct().repartitionByRange(text).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    keys = sequence_ids(df.sparkSession.read.parquet(path), F.col("__range"), [text], name).drop("__range")
    return df.join(small(keys), key)


def paired(df: DataFrame, system: str, a: str, b: str, on: str, value: str) -> DataFrame:
    """Two systems' values for the same key, and b - a."""
    both = df.where(F.col(system).isin(a, b)).groupBy(on).agg(F.max(F.when(F.col(system) == a, F.col(value))).alias("a"), F.max(F.when(F.col(system) == b, F.col(value))).alias("b"))
    return both.where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def every_pair(dim: DataFrame, values: list[str], name: str) -> DataFrame:
    """Each row with each of a literal list's values; the list is part of the plan, so nothing is shuffled."""
    return dim.withColumn(name, F.explode(F.array(*map(F.lit, values))))
