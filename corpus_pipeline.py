"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

1. language ID: documents without letters, or in a language that the learned labels do not cover, go
2. SimHash near-dedup: of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) one document stays
3. suffix-array dedup: later copies of strings of 200 bytes are cut, the first one stays
4. benchmark decontamination: documents that hold an edited copy of a test item go
5. mixing: sources are taken by weight, a document at most twice

Every stage is written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import materialize, read_table, release, written
from heronry.llm.decontaminate import decontaminate
from heronry.llm.langid import fit, identify
from heronry.llm.mixing import mix
from heronry.llm.near_dup import dedup_simhash
from heronry.llm.suffix_dedup import dedup_substrings

#: Share of a document's four-byte grams that the training of the language model must have met.
LEAST_KNOWN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marks = ("__lang", "__score", "__known")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    named = identify(rows, fit(docs), *marks, inside="row")
    return named.where((F.col("__lang") != "und") & (F.col("__known") >= LEAST_KNOWN)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_simhash(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_substrings(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = written(spark)
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, before - (name != STAGES[0][0]), but=1)  # the stage's own tables and its predecessor's result
    return docs


#: Substring dedup, alignment and balanced sampling are not expressible in SQL.
ORACLE_SQL = None
