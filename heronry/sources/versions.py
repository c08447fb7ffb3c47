"""Results that are whole at any time (K7): batches are written apart and published by a pointer that is replaced in one step.

A reader takes the batches that the pointer names, so it never sees a part of one, and a run that is killed at any point
goes on after the last batch that was published."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import put_text

POINTER = "CURRENT"
#: Batches after which they are rewritten as one.
COMPACT = 64


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def state(spark: SparkSession, path: str) -> dict:
    """What is published: ``batches`` (names of those done, in order) and ``folders`` that hold their rows."""
    at = _path(spark, f"{path}/{POINTER}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {"batches": [], "folders": []}
    return json.loads(spark.read.text(f"{path}/{POINTER}", wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, new: dict) -> None:
    """Replace the pointer in one step: readers see the old one or the new one."""
    draft = f"{path}/draft-{uuid.uuid4().hex}"
    put_text(spark, draft, json.dumps(new))
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(_path(spark, draft), _path(spark, f"{path}/{POINTER}"), options)


def add(rows: DataFrame, path: str, batch: str, compact: int = COMPACT, before_publish: Callable[[], None] = lambda: None) -> bool:
    """Write a batch and publish it; False, and nothing is done, if it was published before."""
    spark, now = rows.sparkSession, state(rows.sparkSession, path)
    if batch in now["batches"]:
        return False
    folder = f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    before_publish()
    now = {"batches": [*now["batches"], batch], "folders": [*now["folders"], folder]}
    if len(now["folders"]) > compact:
        one = f"rows-{uuid.uuid4().hex}"
        current(spark, path, rows.schema, now).write.parquet(f"{path}/{one}")
        now["folders"] = [one]
    publish(spark, path, now)
    return True


def current(spark: SparkSession, path: str, schema: StructType, at: dict | None = None) -> DataFrame:
    """The rows of the published batches."""
    folders = (state(spark, path) if at is None else at)["folders"]
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def run(rows: DataFrame, path: str, key: str, batches: int, work: Callable[[DataFrame], DataFrame], **options) -> int:
    """``rows`` in ``batches`` by a hash of their key, each worked on and published; those done before are skipped.
    Gives how many were done now. Rows fall into the same batch in every run."""
    done = set(state(rows.sparkSession, path)["batches"])
    todo = [b for b in range(batches) if str(b) not in done]
    return sum(add(work(rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)), path, str(b), **options) for b in todo)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete folders and drafts that no pointer names, as killed runs and rewrites leave; only while nothing else writes."""
    at, keep = _path(spark, path), {POINTER, *state(spark, path)["folders"]}
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in files.listStatus(at) if f.getPath().getName() not in keep and not f.getPath().getName().startswith(".")]
    return sum(bool(files.delete(p, True)) for p in gone)
