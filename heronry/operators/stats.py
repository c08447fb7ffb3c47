"""Aggregations (A1-A16) and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def manifest_stats(df: DataFrame, *by: str, seconds: str = "duration_sec", speaker: str = "speaker_id", dataset: str = "dataset", extra: list[Column] | None = None) -> DataFrame:
    """A1: clips, hours, distinct speakers, sorted datasets."""
    return df.groupBy(*by).agg(
        F.count("*").alias("clips"), F.round(F.sum(seconds) / 3600, 2).alias("hours"), F.countDistinct(speaker).alias("speakers"), F.array_join(F.array_sort(F.collect_set(dataset)), ",").alias("datasets"), *(extra or [])
    )


def totals(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """A2: total, count and first position of each key."""
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.min(position).alias("first_pos"))


def top_keys(df: DataFrame, key: str, value: str, position: str, least, k: int) -> DataFrame:
    """A3, O2: keys with a total of ``least`` at least, the largest k; first seen wins ties."""
    return totals(df, key, value, position).where(F.col("total") >= least).orderBy(F.desc("total"), "first_pos").limit(k)


def argmax_rows(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """A4: the rows of the key with the largest total."""
    best = totals(df, key, value, position).orderBy(F.desc("total"), "first_pos").limit(1)
    return df.join(F.broadcast(best.select(key)), key, "left_semi")


def class_counts(df: DataFrame, c: str | Column, name: str = "class") -> DataFrame:
    """A5: frequency of classes, missing ones as "?"."""
    return df.groupBy(F.coalesce(col(c), F.lit("?")).alias(name)).agg(F.count("*").alias("n"))


def symbol_counts(df: DataFrame, symbols: Column, name: str = "symbol") -> DataFrame:
    """Histogram of the symbols of a list column."""
    return df.select(F.explode(symbols).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def symbol_documents(df: DataFrame, key: str, symbols: Column, name: str = "symbol") -> DataFrame:
    """In how many rows each symbol is found; the list is made distinct first, so no pair of key and symbol is shuffled."""
    return df.select(key, F.explode(F.array_distinct(symbols)).alias(name)).groupBy(name).agg(F.count("*").alias("n_docs"))


def means(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Means of several metrics."""
    return df.groupBy(key).agg(*(F.avg(v).alias(f"mean_{v}") for v in values), F.count("*").alias("n"))


def failure_rate(df: DataFrame, flags: Column) -> DataFrame:
    """A10: scored, failing and their share, of at least one row."""
    return df.agg(F.count("*").alias("scored"), F.count_if(F.size(flags) > 0).alias("failing")).withColumn("share", F.col("failing") / F.greatest("scored", F.lit(1)))


def ranked_by_mean(df: DataFrame, key: str, value: str, *ties: str, k: int | None = None) -> DataFrame:
    """O3: keys by their mean, then by the means of ``ties``, then by the key itself; ``k`` takes the first ones."""
    per = means(df, key, value, *ties).orderBy(f"mean_{value}", *(f"mean_{t}" for t in ties), key)
    return per if k is None else per.limit(k)


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows of an explicit order that tells all rows apart."""
    return df.orderBy(*order).limit(n)


def spread_two_level(df: DataFrame, outer: str, inner: str, value: str, least: int) -> DataFrame:
    """The standard deviation within each inner group of more than ``least`` rows, averaged over the outer one."""
    per = df.groupBy(outer, inner).agg(F.stddev_pop(value).alias("sd"), F.count("*").alias("n")).where(F.col("n") > least)
    return per.groupBy(outer).agg(F.avg("sd").alias("mean_sd"), F.count("*").alias("groups"))


def argmin(df: DataFrame, value: str, position: str) -> DataFrame:
    """The row with the smallest value; the earliest wins ties."""
    return df.orderBy(value, position).limit(1)


def length_stats(df: DataFrame, index: str, text: str) -> DataFrame:
    """A14."""
    return df.agg(F.max(index).alias("max_index"), F.max(F.length(text)).alias("max_length"), F.avg(F.length(text)).alias("avg_length"))


def signal_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Reductions over a signal in rows; the quantiles are exact, and a long signal's values are never in one task."""
    from .quantiles import quantiles

    v = F.col(value)
    sums = df.groupBy(key).agg(F.stddev_pop(v).alias("sd"), F.avg(v).alias("mean"), F.max(v).alias("top"), F.sqrt(F.avg(v * v)).alias("rms"))
    ranks = quantiles(df, key, value, 0.5, 0.95, 0.05).select(F.col(key).alias("__k"), F.col("q")[0].alias("med"), (F.col("q")[1] - F.col("q")[2]).alias("p90"))
    return sums.join(ranks, F.col(key).eqNullSafe(F.col("__k")), "left").select(key, "med", "sd", "p90", "mean", "top", "rms")


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """The median of each key."""
    from .quantiles import quantiles

    return quantiles(df, key, value, 0.5).select(key, F.col("q")[0].alias("median"), "n")
