"""Near-duplicate vectors by sorted projection passes.

Each pass orders the distinct vectors lexicographically by a concatenation of random-hyperplane bits and compares
every vector with the ``WINDOW`` next ones in that order. Vectors travel as bytes, one a component, with the norm of
what rounding lost: where that bound leaves no doubt a pair is a link at once, where it does the pair is verified
with the whole vectors in double precision. A block gives a spanning forest of its pairs, and the links of all passes
are united to components.

Links lie inside components, so they are counted there, exactly and in double precision: the vectors of a component
are compared in blocks of bounded size. What a window leaves out of a dense group is counted all the same; only a
group whose every connection was missed stays apart. Passes are as many as find a pair at the threshold, alone in its
group, with probability ``recall``; pairs at smaller angles are found far likelier.

Equal vectors are one class with a weight: they are compared once, and count as links of one another.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not
even with copies of themselves, and form their own component; vectors of different length do not link; repeated
rows count as vectors of their own; rows with a null vec_id link others and get their component's id; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize, tidy

#: Neighbours that a vector is compared with in a pass, and rows compared at once.
WINDOW, BLOCK = 512, 1024
#: Bits of an order's key.
BITS = 48
#: Vectors of a block when links are counted in a component, and rows of a sorted partition.
CELL, PART = 4096, 200_000


def plan_passes(n: int, threshold: float, recall: float) -> int:
    """Passes for n distinct vectors: two that share the bits that tell a window's rows from others meet in it."""
    bits = max(0, math.ceil(math.log2(max(1, n) / WINDOW)))
    if not bits:
        return 1
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((passes * BITS, dim))


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, v): the components as little-endian floats where they lose nothing by it, else doubles; v is null
    where the vector links with nothing."""

    def run(batches):
        for b in batches:
            out, dims = [], []
            for x in b.column(1):
                a = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    a = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    if not np.isfinite(a).all() or not a.any():
                        a = None
                dims.append(None if a is None else len(a))
                with np.errstate(over="ignore"):
                    out.append(None if a is None else a.astype("<f4").tobytes() if (a.astype("<f4") == a).all() else a.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])

    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, dim int, v binary")


def _unit(blobs, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    if len({len(x) for x in blobs}) == 1:
        a = np.frombuffer(b"".join(blobs), f"<f{len(blobs[0]) // dim}").reshape(-1, dim).astype(np.float64)
    else:
        a = np.stack([np.frombuffer(x, f"<f{len(x) // dim}").astype(np.float64) for x in blobs])
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def _rounded(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, norm of what is lost) of unit vectors."""
    scale = np.abs(a).max(1) / 127
    q = np.rint(a / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((a - q * scale[:, None]) ** 2).sum(1)) + 1e-12


SORTED = "pass int, dim int, key long, rep long, q binary, scale double, lost double"


def _expand(passes: int, seed: int):
    """A row for each vector and pass: its place in the order, and its bytes."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                c = b.slice(lo, 2048)
                v, rep, dims = c.column("v").to_pylist(), c.column("rep").to_numpy(), c.column("dim").to_numpy()
                for dim in np.unique(dims):
                    at = np.nonzero(dims == dim)[0]
                    a = _unit([v[i] for i in at], dim)
                    signs = (a @ _planes(dim, passes, seed).T > 0).reshape(len(at), passes, BITS)
                    keys = (signs * (1 << np.arange(BITS, dtype=np.int64))[::-1]).sum(2)
                    q, scale, lost = _rounded(a)
                    blobs = pa.array([x.tobytes() for x in q], pa.binary())
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(keys[:, p]), pa.array(rep[at]), blobs, pa.array(scale), pa.array(lost)],
                            ["pass", "dim", "key", "rep", "q", "scale", "lost"],
                        )

    return run


class _Rows:
    """Consecutive rows of one order."""

    def __init__(self, rep, q, scale, lost):
        self.rep, self.q, self.scale, self.lost = rep, q, scale, lost

    def __len__(self):
        return len(self.rep)

    def cut(self, lo: int, hi: int) -> "_Rows":
        return _Rows(self.rep[lo:hi], self.q[lo:hi], self.scale[lo:hi], self.lost[lo:hi])

    def __add__(self, o: "_Rows") -> "_Rows":
        return _Rows(*(np.concatenate((getattr(self, k), getattr(o, k))) for k in ("rep", "q", "scale", "lost")))

    def unit(self) -> np.ndarray:
        return self.q.astype(np.float32 if self.q.shape[1] <= 1024 else np.float64)


def _pairs(a: _Rows, lo: int, hi: int, threshold: float, near):
    """Links (a, b, sure) between rows [lo, hi) and the rows that ``near`` (i, j) tells to be compared, as forests."""
    x, y = a.cut(lo, hi), a
    cosine = (x.unit() @ y.unit().T).astype(np.float64) * x.scale[:, None] * y.scale[None, :]
    doubt = x.lost[:, None] * (1 + y.lost[None, :]) + y.lost[None, :] + 1e-9
    i, j = np.nonzero((cosine + doubt >= threshold) & near(np.arange(lo, hi)[:, None], np.arange(len(a))[None, :]))
    sure = cosine[i, j] - doubt[i, j] >= threshold
    i = i + lo
    order = np.argsort(~sure, kind="stable")
    i, j, sure = i[order], j[order], sure[order]
    # links without a doubt first: doubtful ones of rows that these join add nothing
    keep = forest(len(a), i, j)
    n_sure = int(sure.sum())
    doubtful = np.array([k for k in keep if k >= n_sure], np.int64)
    certain = np.array([k for k in keep if k < n_sure], np.int64)
    if len(doubtful):  # a doubtful one may fail: all of those between two trees of certain links are verified
        root = _roots(len(a), i[certain], j[certain])
        open_ = np.nonzero(~sure)[0]
        open_ = open_[root[i[open_]] != root[j[open_]]]
        doubtful = open_
    k = np.concatenate((certain, doubtful)).astype(np.int64)
    return a.rep[i[k]], a.rep[j[k]], sure[k]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's tree."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


FOUND = "a long, b long, sure boolean, edge int, side int, pass int, dim int, place long, q binary, scale double, lost double"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_()), ("edge", pa.int32()), ("side", pa.int32()), ("pass", pa.int32()), ("dim", pa.int32()), ("place", pa.int64()), ("q", pa.binary()), ("scale", pa.float64()), ("lost", pa.float64())])


def _links(a, b, sure):
    n = len(a)
    none = [pa.nulls(n, f.type) for f in list(_FOUND)[3:]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure), *none], schema=_FOUND)


def _edge(edge: int, side: int, p: int, dim: int, rows: _Rows):
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.rep), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, edge, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, dim, np.int32)),
         pa.array(np.arange(n)), pa.array([x.tobytes() for x in rows.q], pa.binary()), pa.array(rows.scale), pa.array(rows.lost)], schema=_FOUND,
    )


def _orders(batches):
    """(pass, dim, rows) for consecutive rows of one order, a batch at most."""
    for b in batches:
        p, d = b.column("pass").to_numpy(), b.column("dim").to_numpy()
        cut = np.nonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]))))[0] if b.num_rows else []
        for lo, hi in zip(cut, [*cut[1:], b.num_rows]):
            c = b.slice(lo, hi - lo)
            q = np.frombuffer(b"".join(c.column("q").to_pylist()), np.int8).reshape(hi - lo, -1)
            yield int(p[lo]), int(d[lo]), _Rows(c.column("rep").to_numpy(), q, c.column("scale").to_numpy(), c.column("lost").to_numpy())


def _windows(threshold: float):
    """Links in sorted partitions, and the rows at a partition's ends, which the neighbouring partitions' rows meet."""

    def run(batches):
        part = TaskContext.get().partitionId()
        near = lambda i, j: (j > i) & (j <= i + WINDOW)
        at, held, head = None, None, None

        def compare(last):
            nonlocal held
            while len(held) > (0 if last else BLOCK + WINDOW):
                yield _links(*_pairs(held.cut(0, BLOCK + WINDOW), 0, min(BLOCK, len(held)), threshold, near))
                if last and len(held) <= BLOCK:
                    break
                held = held.cut(BLOCK, len(held))

        for p, d, rows in _orders(batches):
            if at != (p, d):
                if at is not None:
                    yield _edge(part, 0, *at, held.cut(max(0, len(held) - WINDOW), len(held)))
                    yield from compare(True)
                at, held, fresh = (p, d), rows.cut(0, 0), True
            if fresh:
                yield _edge(part - 1, 1, p, d, rows.cut(0, WINDOW))
                fresh = False
            held = held + rows
            yield from compare(False)
        if at is not None:
            yield _edge(part, 0, *at, held.cut(max(0, len(held) - WINDOW), len(held)))
            yield from compare(True)

    return run


def grouped(batches, keys: list[str]):
    """(key, record batch) for each group of sorted batches; a group is held whole."""
    last, held = None, []
    for b in batches:
        cols = [b.column(k).to_pylist() for k in keys]
        names = list(zip(*cols))
        cut = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        for lo, hi in zip(cut, [*cut[1:], len(names)]):
            if names[lo] != last and held:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            last = names[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _across(threshold: float):
    """Links over the border of two partitions: rows (edge, pass, dim, side, place)."""

    def run(batches):
        for _, t in grouped(batches, ["edge", "pass", "dim"]):
            side = t["side"].to_numpy()
            n = int((side == 0).sum())
            if not n or n == len(side):
                continue
            q = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(len(side), -1)
            rows = _Rows(t["a"].to_numpy(), q, t["scale"].to_numpy(), t["lost"].to_numpy())
            a, b, sure = _pairs(rows, 0, n, threshold, lambda i, j: (j >= n) & (j <= i + WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], ["a", "b", "sure"])

    return run


def _verify(threshold: float):
    """The pairs (a, b, va, vb) of one length whose cosine is high enough in double precision."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            dims = b.column("dim").to_numpy()
            va, vb = b.column("va").to_pylist(), b.column("vb").to_pylist()
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                keep[at] = (_unit([va[i] for i in at], dim) * _unit([vb[i] for i in at], dim)).sum(1) >= threshold
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _count(threshold: float):
    """(rep, n): links, weights counted, between two blocks of a component or inside one."""

    def run(batches):
        for (_, lo, hi), t in grouped(batches, ["component", "lo", "hi"]):
            part, w, rep = t["part"].to_numpy(), t["w"].to_numpy(), t["rep"].to_numpy()
            a = _unit(t["v"].to_pylist(), int(t["dim"][0].as_py()))
            x, y = np.nonzero(part == lo)[0], np.nonzero(part == hi)[0]
            n = np.zeros(len(rep), np.int64)
            for s in range(0, len(x), 512):
                xs = x[s : s + 512]
                hit = a[xs] @ a[y].T >= threshold
                if lo == hi:
                    hit[np.arange(len(xs)), np.arange(s, s + len(xs))] = False
                n[xs] += hit @ w[y]
                if lo != hi:
                    n[y] += w[xs] @ hit
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n)], ["rep", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    named = classes(vectors, vec_id, embedding).withColumn("k", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v", "dim").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))))
    whole = materialize(named.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("low"), F.count("*").alias("w"), F.first("v").alias("v"), F.first("dim").alias("dim")).withColumn("rep", F.col("k.x")), "reps")
    rows = named.select("vec_id", "k")
    reps = whole.select("rep", "dim", "v")
    n = reps.count()
    passes = plan_passes(n, threshold, recall)
    order = ["pass", "dim", "key", "rep"]
    parts = max(1, math.ceil(n * passes / PART))
    placed = reps.mapInArrow(tidy(_expand(passes, seed)), SORTED).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialize(placed.mapInArrow(tidy(_windows(threshold)), FOUND), "windows")
    edges = found.where("edge is not null").drop("b", "sure").repartition("edge").sortWithinPartitions("edge", "pass", "dim", "side", "place")
    pairs = found.where("edge is null").select("a", "b", "sure").union(edges.mapInArrow(tidy(_across(threshold)), "a long, b long, sure boolean"))
    pairs = materialize(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure")), "pairs")
    a, b = reps.select(F.col("rep").alias("a"), F.col("v").alias("va"), "dim"), reps.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    verified = pairs.where("not sure").join(a, "a").join(b, "b").select("a", "b", "dim", "va", "vb").mapInArrow(tidy(_verify(threshold)), "a long, b long")
    cc = materialize(connected_components(pairs.where("sure").select("a", "b").union(verified)), "components")
    sizes = cc.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    members = whole.join(cc, F.col("rep") == F.col("node")).join(sizes, "component").select("component", "rep", "w", "v", "dim", "cells", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int").alias("part"))
    cells = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("lo", F.least("part", "o")).withColumn("hi", F.greatest("part", "o")).drop("o", "cells")
    keys = ["component", "lo", "hi"]
    counts = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_count(threshold)), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    per = whole.select("k", "rep", "low", "w").join(cc, F.col("rep") == F.col("node"), "left").join(counts, "rep", "left")
    per = materialize(per.select("k", "low", F.coalesce("component", "rep").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "links")
    lows = per.groupBy("c").agg(F.min("low").alias("component_id"))
    out = rows.join(per.join(lows, "c").select("k", "n_links", "component_id"), "k", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
