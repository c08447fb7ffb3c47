"""The driver's tables in the roles of the pipeline's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as a manifest: source speaks, lang is the dataset, 15 characters take a second.

    ``chars`` counts fifteenths of a second in whole numbers, so budgets are exact in every engine."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(q, "doc_id", "left").select(
        F.col("doc_id").alias("clip_id"), "text", F.col("source").alias("speaker_id"), F.col("lang").alias("dataset"), (F.col("n_chars") / 15.0).alias("duration_sec"), F.col("n_chars").alias("chars"), F.col("quality").cast("double").alias("quality_score")
    )


CLIPS_SQL = """clips AS (SELECT d.doc_id AS clip_id, d.text, d.source AS speaker_id, d.lang AS dataset, d.n_chars / 15.0::DOUBLE AS duration_sec,
    d.n_chars AS chars, l.quality::DOUBLE AS quality_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as signals: a user's values in order of time are the samples of a clip."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("clip"), (F.row_number().over(w) - 1).alias("pos"), "value")


SIGNAL_SQL = "signal AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events WHERE value IS NOT NULL)"
