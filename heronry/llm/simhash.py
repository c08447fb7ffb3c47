"""SimHash near-duplicate groups by a segment-popcount grid.

A fingerprint's 64 bits are cut into 32 segments of two bits; the vector of segment popcounts embeds it in
Z^32, where the Manhattan distance never exceeds the Hamming distance. Two fingerprints at three or fewer
differing bits therefore differ by at most one in one of the two halves of that vector, so a grid over each
half, probed at the own cell and at the cells one step up, meets every such pair. Hamming distance is then
verified exactly. Only distinct fingerprints are compared; copies share one.

Defined cases: a null text, an empty text and one of white space only have fingerprint zero and link like any
other; equal fingerprints always link; repeated rows each give a row; an empty table gives an empty result; rows with a
null doc_id link like any other and get their component's smallest doc_id, null where it has none. Other columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize, tidy

#: A grid cell whose join would compare more pairs than this is compared in blocks instead.
CELL_PAIRS = 1 << 14
#: Rows of a block on either side.
BLOCK = 1024


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of lower-cased (A-Z) bytes over word shingles, as an unsigned integer."""
    w = data.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    d = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if n == 1:
        return d(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    h = np.fromiter([d(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist())], np.uint64, n)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        total += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp the signed 64-bit view of each document's fingerprint."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", width, seed) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, fp long")


def _cell(half: Column) -> Column:
    """The sixteen two-bit popcounts of a 32-bit half, packed into two bits each."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks, as a spanning forest."""
    own, other = pdf[pdf.side == 0], pdf[pdf.side == 1]
    a, b = own.fp.to_numpy().view(np.uint64), other.fp.to_numpy().view(np.uint64)
    ids, inv = np.unique(np.concatenate((own.rep.to_numpy(), other.rep.to_numpy())), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 3 if len(a) and len(b) else np.zeros((0, 0), bool)
    i, j = np.nonzero(near)
    i, j = ia[i], ib[j]
    differ = i != j
    i, j = i[differ], j[differ]
    keep = forest(len(ids), i, j)
    return pd.DataFrame({"a": ids[i[keep]], "b": ids[j[keep]]}, dtype="int64")


def _heavy(own: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of too many pairs, with their own rows and arrivals; only those with both can hold a link."""
    sizes = right.groupBy(*keys).agg(F.count_if(~F.col("up")).alias("n_own"), F.count("*").alias("n_all"))
    return materialize(sizes.where(F.col("n_own") * F.col("n_all") > CELL_PAIRS), "cells")


def _joined(own: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Links inside cells, pair by pair."""
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 3) & (F.col("b.up") | (F.col("a.fp") < F.col("b.fp")))
    for x in same:
        near = x & near
    return own.alias("a").join(right.alias("b"), near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links between the representatives of distinct fingerprints (fp, rep) at 3 or fewer differing bits.

    A cell with many fingerprints is split by each quarter of the bits: three differing bits leave one quarter alike.
    Where a part is still large, its fingerprints are alike, and blocks of it give a spanning forest of their links in
    place of every pair."""
    halves = F.explode(F.array(*(F.struct(F.lit(h).alias("half"), _cell(F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF))).alias("cell")) for h in (0, 1)))).alias("g")
    own = fps.select("fp", "rep", halves).select("g.half", "g.cell", "fp", "rep")
    steps = F.array(*(F.when(F.shiftright("cell", 2 * j).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << (2 * j))) for j in range(16)))
    up = own.select("half", F.explode(steps).alias("cell"), "fp", "rep").where("cell is not null")
    right = own.withColumn("up", F.lit(False)).union(up.withColumn("up", F.lit(True)))
    keys, found = ["half", "cell"], None
    quarters = F.explode(F.array(*(F.struct(F.lit(q).alias("quarter"), F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)).alias("bits")) for q in range(4)))).alias("q")
    for last in (False, True):
        heavy = _heavy(own, right, keys)
        dense = not heavy.isEmpty()
        light = _joined(*((x.join(heavy, keys, "left_anti") if dense else x) for x in (own, right)), keys)
        found = light if found is None else found.union(light)
        if not dense:
            return found
        own, right = (x.join(heavy.select(*keys), keys) for x in (own, right))
        if not last:
            own, right = (x.select("*", quarters).select(*x.columns, "q.quarter", "q.bits") for x in (own, right))
            keys = [*keys, "quarter", "bits"]
    grid = heavy.select(*keys, F.ceil(F.col("n_own") / BLOCK).cast("int").alias("ka"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("kb"))
    left = own.join(grid, keys).select(*keys, F.pmod(F.hash("fp"), "ka").alias("x"), F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("y"), F.lit(0).alias("side"), "fp", "rep")
    arrive = right.join(grid, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("x"), F.pmod(F.hash("fp"), "kb").alias("y"), F.lit(1).alias("side"), "fp", "rep")
    blocks = left.union(arrive).groupBy(*keys, "x", "y").applyInPandas(_blocks, "a long, b long")
    return found.union(blocks)


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): every document with its fingerprint and its group's smallest doc_id.

    The nodes of the graph are fingerprints, so a row needs no doc_id to link others."""
    all_fps = materialize(fingerprints(docs, width), "fp")
    reps = materialize(all_fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "rep")
    cc = connected_components(links(reps.select("fp", F.col("fp").alias("rep"))))
    found = materialize(reps.join(cc, reps.fp == cc.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c")), "found")
    lows = found.groupBy("c").agg(F.min("low").alias("component_id"))
    return all_fps.join(found.join(lows, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
