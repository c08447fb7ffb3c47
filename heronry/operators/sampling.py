"""Budgets, caps, deterministic shuffles and splits.

Running totals over a whole table use prefix sums on three levels: running sums inside buckets of the order, the sums
before each bucket in its bucket of buckets, and the sums before those. No task holds more than one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .joins import small

SEED = 1337
#: Buckets of an order: two hexadecimal digits of a hash at least.
DIGITS = 3
#: Numbered buckets in a bucket of buckets.
SUPER = 4096


def shuffle_key(*keys: str | Column, seed: int = SEED) -> Column:
    """O1: a hash to order by; the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def sum_before(df: DataFrame, value: str, bucket: Column, order: list, by: list[str] | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all rows that come earlier in (bucket, order), within the keys ``by``.

    ``bucket`` must rise with the order; orders must tell all rows apart."""
    by = by or []
    marked = df.withColumn("__b", bucket)
    numeric = not isinstance(marked.schema["__b"].dataType, StringType)
    totals = marked.groupBy(*by, "__b").agg(F.sum(value).alias("__t")).withColumn("__s", F.floor(F.col("__b") / SUPER) if numeric else F.substring("__b", 1, 1))
    # buckets of buckets: the last window sees one row for each of them
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    supers = totals.groupBy(*by, "__s").agg(F.sum("__t").alias("__t")).select(*by, "__s", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__p"))
    ahead = Window.partitionBy(*by, "__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    own = totals.select(*by, "__s", "__b", F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__q"))
    offsets = own.join(small(supers), [*by, "__s"]).select(*by, "__b", (F.col("__p") + F.col("__q")).alias("__o"))
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(small(offsets), [*by, "__b"])
    return out.withColumn(name, F.col("__i") + F.col("__o")).drop("__b", "__t", "__i", "__o")


def hash_bucket(key: str) -> Column:
    return F.substring(key, 1, DIGITS)


def id_bucket(key: str, width: int = 4096) -> Column:
    """Buckets of neighbouring ids."""
    return F.floor(F.col(key) / width)


def take_budget(df: DataFrame, value: str, target, bucket: Column, order: list) -> DataFrame:
    """Rows in order until the total reaches ``target``; the row that crosses it is kept."""
    return sum_before(df, value, bucket, order).where(F.col("before") < target).drop("before")


def take_capped(df: DataFrame, key: str, value: str, cap, target, bucket: Column, order: list) -> DataFrame:
    """Rows of a key until its total exceeds ``cap``, then the global budget over those."""
    own = sum_before(df, value, bucket, order, [key]).where(F.col("before") <= cap).drop("before")
    return take_budget(own, value, target, bucket, order)


def first_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; planned as a limit within groups before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def first_keys(df: DataFrame, key: str, order: str, keys: int, rows: int) -> DataFrame:
    """The first rows of the first-seen keys."""
    seen = df.groupBy(key).agg(F.min(order).alias("__first")).orderBy("__first").limit(keys)
    return first_n(df.join(F.broadcast(seen.select(key)), key, "left_semi"), key, [order], rows)


def sequence_ids(df: DataFrame, bucket: Column, order: list, name: str = "seq") -> DataFrame:
    """0-based position of each kept row."""
    return sum_before(df.withColumn("__one", F.lit(1)), "__one", bucket, order, name=name).drop("__one")


def ticket_key(preferred: Column, *keys: str) -> Column:
    """Preferred rows draw two tickets and keep the better one."""
    one, two = shuffle_key(*keys, F.lit(0)), shuffle_key(*keys, F.lit(1))
    return F.when(preferred, F.least(one, two)).otherwise(one)


def weighted_mix(df: DataFrame, weights: dict[str, float], total, preferred: Column, value: str = "duration_sec", key: str = "clip_id", dataset: str = "dataset") -> DataFrame:
    """W5 with W1 and U2: each dataset's share of the total, in ticket order."""
    shares = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    rows = df.withColumn("ticket", ticket_key(preferred, key)).withColumn("__share", F.try_element_at(shares, F.col(dataset))).where("__share > 0")
    out = sum_before(rows, value, hash_bucket("ticket"), ["ticket", key], [dataset])
    return out.where(F.col("before") < F.col("__share") * total).drop("before", "__share")


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by a partial aggregation rather than a sort of groups."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, *(F.col(f"r.{c}") for c in rest))


def split(df: DataFrame, val: int, key: str = "clip_id") -> DataFrame:
    """U4: the first ``val`` rows in shuffled order are "val", the others "train"."""
    rows = sequence_ids(df.withColumn("order_key", shuffle_key(key)), hash_bucket("order_key"), ["order_key", key], "pos")
    return rows.withColumn("split", F.when(F.col("pos") < val, "val").otherwise("train"))
