"""Mixing sources to target weights by balanced (cube) sampling.

A source's target asks for target / size copies of each of its documents: the whole part is taken as is, the
rest is an inclusion probability. The cube method's flight moves these probabilities along the null space of
the balancing constraints (document total and word total), always by a vector over three documents, until one
of them reaches 0 or 1; at most two documents stay open. Flights run in blocks of a source's documents, what
stays open flies again, so a source of any size needs a logarithmic number of short rounds and no task holds
more than a block. The last open documents of a source land by the choice nearest to its word total.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its own,
last in order; repeated rows each give a row and are taken equally often; a total of 0 words takes nothing; an empty table gives
an empty result. Ties in size or doc_id don't matter. Reruns agree: the random numbers come from the seed,
the source and the block. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Weights by position of the source, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and the most copies of a document.
SHARE, MOST = 1.5, 2.0
#: Documents of a flight, and open documents that land together.
BLOCK, LANDING = 2048, 14


def words(text: str | Column = "text") -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of sources in order: ``share`` of all sizes by weight, none above ``most`` times its size;
    the excess goes to the others by weight, until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in sorted(open_) if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = 0) -> np.ndarray:
    """Probabilities after the flight: both totals kept, at most two entries strictly between 0 and 1,
    besides the last ``leave`` open ones, which are not moved."""
    pi, eps = pi.tolist(), 1e-9
    size = size.tolist()
    queue = [i for i in range(len(pi)) if eps < pi[i] < 1 - eps]
    held: list[int] = []
    draws = iter(())
    for i in queue[: len(queue) - leave]:
        held.append(i)
        while len(held) == 3 or (len(held) == 2 and size[held[0]] == size[held[1]]):
            u = (1, -1)
            if len(held) == 3:
                a, b, c = (size[k] for k in held)
                u = (c - b, a - c, b - a)
                if not any(u):
                    u = (1, -1, 0)
            up = min(((1 - pi[k]) / x if x > 0 else -pi[k] / x) for k, x in zip(held, u) if x)
            down = min((pi[k] / x if x > 0 else (pi[k] - 1) / x) for k, x in zip(held, u) if x)
            r = next(draws, None)
            if r is None:
                draws = iter(rng.random(1024).tolist())
                r = next(draws)
            step = up if r * (up + down) < down else -down
            for k, x in zip(held, u):
                pi[k] += step * x
                if pi[k] < eps:
                    pi[k] = 0.0
                elif pi[k] > 1 - eps:
                    pi[k] = 1.0
            held = [k for k in held if 0 < pi[k] < 1]
    return np.array(pi)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round up to ``LANDING`` open probabilities so that the word total comes nearest; ties by document total."""
    n = len(pi)
    pick = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(pick @ size - (pi * size).sum())
    off_docs = np.abs(pick.sum(1) - pi.sum())
    return pick[np.lexsort((off_docs, off))[0]].astype(float)


def _fly(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_key", "size"], kind="stable").reset_index(drop=True)
        pi, size = pdf.pi.to_numpy(float), (pdf["size"] * pdf["m"]).to_numpy(float)
        whole = bool(pdf.whole_source.iloc[0]) or last
        if not whole or len(pdf) > LANDING:
            rng = np.random.default_rng([seed, int(key[1]), *(ord(c) for c in (key[0] or "\0"))])
            order = rng.permutation(len(pdf))
            pi[order] = flight(pi[order], size[order], rng, LANDING - 2 if whole else 0)
        if last:
            at = np.nonzero((pi > 0) & (pi < 1))[0]
            pi[at] = land(pi[at], size[at])
        return pdf.assign(pi=pi)

    return run


KEY = ["doc_key", "source", "size"]


def doc_key() -> Column:
    """A doc_id as text, empty for null: pandas would make a number with nulls a float."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key")


def _same(a: str, b: str) -> Column:
    on = F.lit(True)
    for c in KEY:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, doc_key, source, size) and the plan (doc_key, source, size, source_size, target, copies).

    Rows equal in all three columns are one unit of the plan: each of them is taken as often."""
    spark = docs.sparkSession
    base = materialize(docs.select("doc_id", doc_key(), "source", words().alias("size")), "sizes")
    units = base.groupBy(*KEY).agg(F.count("*").alias("m"))
    # one row a source, none of the documents: the targets depend on the sources' totals
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("n"), F.count_if(F.col("size") > 0).alias("c")).collect()
    per = sorted(((r["source"], r["n"], r["c"]) for r in totals), key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    goal = targets([n for _, n, _ in per], weights, share, most)
    # as an Arrow table: rows of Python objects would start a second set of workers in every executor
    sources, sizes, counts = zip(*per) if per else ((), (), ())
    columns = [pa.array(sources, pa.string()), pa.array(sizes, pa.int64()), pa.array([float(t) for t in goal], pa.float64()), pa.array([max(1, math.ceil(c / BLOCK)) for c in counts], pa.int64())]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, ["source", "source_size", "target", "blocks"]))
    rows = units.alias("b").join(table.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.target", "t.blocks")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("pi", F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0))
    rows = materialize(rows, "pi")
    names = [*KEY, "m", "pi", "whole_source", "block"]
    blocks = max([math.ceil(c / BLOCK) for _, _, c in per], default=1)
    fly = rows.where("pi > 0").withColumn("whole_source", F.col("blocks") == 1).withColumn("block", F.pmod(F.xxhash64("doc_key", "size"), "blocks"))
    done = None
    while True:
        last = blocks <= 1
        flown = materialize(fly.select(*names).groupBy("source", "block").applyInPandas(_fly(seed, last), "doc_key string, source string, size long, m long, pi double, whole_source boolean, block long"), "flown")
        settled = flown.where("pi = 0 or pi = 1").select(*KEY, "pi")
        done = settled if done is None else done.union(settled)
        if last:
            break
        blocks = math.ceil(2 * blocks / BLOCK)
        fly = flown.where("pi > 0 and pi < 1").withColumn("block", F.pmod(F.xxhash64("doc_key", "size", F.lit(blocks)), F.lit(blocks)))
    plan = rows.alias("r").join(done.alias("d"), _same("r", "d"), "left")
    copies = F.when(F.col("r.size") > 0, F.col("r.whole") + F.coalesce("d.pi", F.lit(0.0))).otherwise(0).cast("long")
    return base, plan.select("r.doc_key", "r.source", "r.size", "r.source_size", "r.target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the input's columns: every row as many times as the plan takes it."""
    _, plan = mix_plan(docs, **options)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc_key(), "source", words().alias("size"))
    d, p = rows.alias("d"), plan.where("copies > 0").alias("p")
    return d.join(p, _same("d", "p")).select("d.row", F.explode(F.sequence(F.lit(1), "p.copies"))).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    base, plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return base.alias("b").join(plan.alias("p"), _same("b", "p")).select("b.doc_id", "b.size", "p.source_size", "p.target", (F.col("p.copies") * F.col("b.size")).alias("taken"))
