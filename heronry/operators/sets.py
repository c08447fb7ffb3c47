"""Set operations and idempotent merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_of_path

#: Added to the numbers of merged clips (fixed value).
OFFSET = 900_000


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_keyed(main: DataFrame, shard: DataFrame, key: str, offset: int = OFFSET) -> DataFrame:
    """The main rows and the shard's under remapped keys, where those aren't there yet; doing it twice adds nothing."""
    moved = shard.withColumn(key, F.col(key) + offset)
    return main.unionByName(moved.join(main.select(key), key, "left_anti"))


def remapped_path(path: str) -> object:
    """The path that a merged clip gets."""
    return F.concat(F.lit("wavs/"), F.lpad((number_of_path(path) + OFFSET).cast("string"), 6, "0"), F.lit(".wav"))
