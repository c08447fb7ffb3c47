"""Exact quantiles by refinement (A11, A16, M1): a key of any size is never gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .joins import small

#: Rows of a key that one task sorts; accuracy of the sketch that narrows larger keys.
ROWS, ACCURACY = 1 << 20, 10_000


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "ranges")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _refined(rows: DataFrame, sizes: DataFrame, fractions: list[float], most: int) -> DataFrame:
    """(k, q): quantiles of large keys, in order of ``fractions``."""
    p = F.posexplode(F.array(*map(F.lit, fractions))).alias("at", "p")
    ranks = sizes.select("k", "n", p).withColumn("rank", F.col("p") * (F.col("n") - 1))
    # the range that holds a rank: values from lo to hi, with so many below it and inside it
    ranges = _kept(ranks.select("k", "at", "rank", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), (F.col("n") + 1).alias("was")))
    done = None
    while True:
        # of a range that is still large, a sketch with a bounded error gives a narrower one that must hold the rank; one
        # that gets no narrower has few values that come often
        wide = (F.col("inside") > most) & (F.col("inside") < F.col("was")) & (F.col("lo").isNull() | (F.col("lo") < F.col("hi")))
        fine, large = ranges.where(~wide), ranges.where(wide)
        done = fine if done is None else done.union(fine)
        if large.isEmpty():
            break
        inside = rows.join(small(large), "k").where(F.col("lo").isNull() | F.col("v").between(F.col("lo"), F.col("hi")))
        place = (F.col("rank") - F.col("below")) / F.greatest(F.col("was") - 1, F.lit(1))
        margin = 3.0 / ACCURACY
        sketch = inside.groupBy("k", "at", "rank", "below", F.col("inside").alias("was")).agg(F.percentile_approx("v", [i / 1000 for i in range(1001)], ACCURACY).alias("grid"), F.min("v").alias("least"), F.max("v").alias("top"))
        step = lambda x: F.element_at("grid", F.greatest(F.lit(1), F.least(F.lit(1001), x.cast("int") + 1)))
        narrow = sketch.select(
            "k", "at", "rank", "was", F.when(place - margin > 0.001, step(F.floor((place - margin) * 1000))).otherwise(F.col("least")).alias("lo"), F.when(place + margin < 0.999, step(F.ceil((place + margin) * 1000))).otherwise(F.col("top")).alias("hi")
        )
        held = rows.join(small(_kept(narrow)), "k").groupBy("k", "at", "rank", "was", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"))
        ranges = _kept(held.select("k", "at", "rank", "lo", "hi", "below", "inside", "was"))
    done = _kept(done)
    # equal values are counted before they meet, so a task gets the distinct ones of a range
    values = rows.join(small(done), "k").where(F.col("v").between(F.col("lo"), F.col("hi")) | F.col("lo").isNull()).groupBy("k", "at", "rank", "below", "v").agg(F.count("*").alias("n"))
    end = F.col("below") + F.sum("n").over(Window.partitionBy("k", "at").orderBy("v"))
    ends = values.withColumn("end", end)
    first = lambda x: F.min(F.when(F.col("end") > x, F.col("v")))
    low, high = F.floor("rank"), F.ceil("rank")
    found = ends.groupBy("k", "at", "rank").agg(first(low).alias("a"), first(high).alias("b"))
    one = found.select("k", "at", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - low)).alias("q"))
    return one.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "q"))), lambda s: s["q"]).alias("q"))


def quantiles(df: DataFrame, key: str, value: str, *fractions: float, most: int = ROWS) -> DataFrame:
    """(key, n, q): the number of values of each key and an array of its exact quantiles, between two values by their distance.

    A key of ``most`` values or fewer, counted first, is an aggregate. Of a larger one a mergeable sketch narrows the
    range of values that holds a rank until it has ``most`` values or only one, the others are counted, and the range's
    values, equal ones counted beforehand, give the quantile. Nulls count nothing; a null key is a key."""
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most)
    exact = F.array(*(F.percentile("v", F.lit(float(f))) for f in fractions)).alias("q")
    if large.isEmpty():
        return rows.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("n"), exact)
    large = _kept(large.withColumn("none", F.col("k").isNull()))
    # a null key goes under a flag, so that joins find it
    code = [F.col("k").isNull().alias("none"), F.coalesce(F.col("k").cast("string"), F.lit("")).alias("s")]
    names = large.select("n", F.struct(*code).alias("k"))
    marked = rows.select(F.struct(*code).alias("k"), "v")
    heavy = _refined(marked.join(small(names.select("k")), "k", "left_semi"), names, list(map(float, fractions)), most)
    per = marked.join(small(names.select("k")), "k", "left_anti").groupBy("k").agg(F.count("*").alias("n"), exact).unionByName(names.join(heavy, "k"))
    back = F.when(~F.col("k.none"), F.col("k.s")).cast(df.schema[key].dataType).alias(key)
    return per.select(back, "n", "q")
