"""Helpers that the operators share: tables in the shared folder, connected components, union-find."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions without a setting, by application.
_own: dict[str, str] = {}
#: Tables written by each application, in order.
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, with the application's id.

    Where it is unset a local session gets a temporary one; a cluster's executors would not share that, so there it is
    an error."""
    path, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="heronry-")
        _own[app] = path
    return f"{path.rstrip('/')}/heronry/{app}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession) -> int:
    """How many tables this application has written; a mark for ``release``."""
    return len(_tables.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the tables written after the mark ``since``, besides the last ``but`` ones: their results are stored."""
    tables = _tables.get(spark.sparkContext.applicationId, [])
    end = len(tables) - but
    for path in tables[since:end]:
        _delete(spark, path)
    del tables[since:end]


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application wrote, archives included; call it once the results that read them are stored."""
    _delete(spark, shared_dir(spark))
    _tables.pop(spark.sparkContext.applicationId, None)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that what a step makes of one stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def lists(counts: np.ndarray, values: pa.Array | np.ndarray) -> pa.Array:
    """Values as lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def tidy(run: Callable) -> Callable:
    """A step over Arrow batches that gives its memory back at the end: workers live on, and keep what they freed."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return (row["n"], row["x"], row["s"])


#: Edges of a node that one task takes at expectation.
HUB = 1 << 16


def _salted(edges: DataFrame, name: str) -> DataFrame:
    """(u, m, k, salt): the smallest neighbour of every node, once for each of its k salts."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / HUB).cast("int").alias("k"))
    return materialize(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1))), name)


def _meet(edges: DataFrame, low: DataFrame) -> DataFrame:
    """(u, v, m) for every edge; edges of hubs are spread over the hub's salts."""
    hubs = low.where("k > 1")
    if hubs.isEmpty():
        return edges.join(low.select("u", "m"), "u").select("u", "v", "m")
    # a row a hub, at most 2 edges / HUB: small against the edges, and the plan of its joins goes by its size
    heads = materialize(hubs.where("salt = 0").select("u", "k"), "hubs")
    one = edges.join(heads.select("u"), "u", "left_anti").join(low.where("k = 1").select("u", "m"), "u").select("u", "v", "m")
    many = edges.join(heads, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("k")).cast("int"))
    return one.union(many.join(hubs.select("u", "salt", "m"), ["u", "salt"]).select("u", "v", "m"))


def row_key(text: str = "text") -> Column:
    """A column that tells rows of one doc_id (or of none) apart by 128 bits of their text; rows equal in both are alike."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))


#: Bits of a filter at most: 4 MB are broadcast, whatever the input's size. Bits a name below that, at least.
FILTER, SPARSE = 1 << 25, 16
#: Bits of one of its rows, as ``bitmap_construct_agg`` has them.
BITMAP = 1 << 15


def marked(rows: DataFrame, name: Column, wanted: DataFrame) -> DataFrame:
    """(row, maybe): ``maybe`` is false only for rows whose hash ``name`` is none of ``wanted`` (h).

    Those need no shuffle to be told from the wanted rows, so texts that a join would drop stay where they are. A bit
    stands for each name; where names are very many more rows pass, and the join that follows decides."""
    bits = min(FILTER, max(BITMAP, 1 << (SPARSE * wanted.count()).bit_length()))
    seat = lambda h: F.pmod(h, F.lit(bits))
    place = wanted.select(seat(F.col("h")).alias("s")).select(F.shiftright("s", 15).alias("bucket"), F.col("s").bitwiseAND(F.lit(BITMAP - 1)).alias("s"))
    table = materialize(place.groupBy("bucket").agg(F.bitmap_construct_agg("s").alias("bits")), "bits")
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), seat(name).alias("s")).withColumn("bucket", F.shiftright("s", 15))
    at = F.col("s").bitwiseAND(F.lit(BITMAP - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1
    return own.join(F.broadcast(table), "bucket", "left").select("row", F.coalesce(met, F.lit(False)).alias("maybe"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that lose in their group: ``found`` names each row (doc_id, key) with its group.

    The row with the smallest doc_id stays, a null one only where there is no other; of different texts of that doc_id
    the one with the smallest key, of rows equal in both the one with the smallest hash of all columns."""
    rows = materialize(found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n")), "rows")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = materialize(rows.groupBy("group").agg(F.min(own).alias("best"), F.count("*").alias("k")).where("k > 1").select("group", "best"), "best")
    lost = materialize(rows.join(best, "group").where(~own.eqNullSafe(F.col("best"))).select("doc_id", "key"), "lost")
    names = [F.col(f"d.`{c}`") for c in docs.columns]

    def without(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (row_key("d.text") == F.col("k.key"))
        rows = marked(left, F.xxhash64("doc_id", row_key()), keys.select(F.xxhash64("doc_id", "key").alias("h")))
        met = rows.where("maybe").select("row.*").alias("d").join(keys.alias("k"), same, how).select(*names)
        return met if how == "left_semi" else rows.where("not maybe").select("row.*").union(met)

    out = without(docs, lost, "left_anti")
    again = materialize(rows.where("n > 1").select("doc_id", "key"), "again")
    if again.isEmpty():
        return out
    one = without(out, again, "left_semi").groupBy("doc_id", row_key().alias("__key")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("__row"))
    return without(out, again, "left_anti").union(one.select("__row.*"))


#: Edges that one task brings to components by itself: some 60 MB of memory.
EDGES = 1 << 18


def _trees(whole: bool):
    """Edges (u, v) of a task as (node, smallest node reachable by them), ``EDGES`` at a time; ``whole`` gives roots too."""

    def stars(us, vs):
        ids, at = np.unique(np.concatenate([*us, *vs]), return_inverse=True)
        n = len(at) // 2
        parent = list(range(len(ids)))
        for i, j in zip(at[:n].tolist(), at[n:].tolist()):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            while parent[j] != j:
                parent[j] = parent[parent[j]]
                j = parent[j]
            parent[max(i, j)] = min(i, j)
        for i, p in enumerate(parent):  # a parent is never the larger one, so it is settled before
            parent[i] = parent[p]
        low = ids[np.array(parent, np.int64)]
        keep = np.ones(len(ids), bool) if whole else ids != low
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(low[keep])], ["u", "v"])

    def run(batches):
        us, vs, n = [], [], 0
        for b in pieces(batches, EDGES):
            if n and n + b.num_rows > EDGES:
                yield stars(us, vs)
                us, vs, n = [], [], 0
            us.append(b.column(0).to_numpy(zero_copy_only=False))
            vs.append(b.column(1).to_numpy(zero_copy_only=False))
            n += b.num_rows
        if n:
            yield stars(us, vs)

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node reachable.

    Each task first brings its own edges to stars, ``EDGES`` at a time, which keeps what they connect. Then alternating
    large-star and small-star steps move every neighbour to the smallest one known; the number of rounds grows with the
    logarithm of the longest path. As soon as ``EDGES`` edges or fewer are left, counted first, one task ends the work.
    The smallest neighbours are aggregated before the shuffle and written as a table, with a row for each of a hub's
    ``salts``: a hub's edges meet them in as many tasks. Each round is written to the shared folder. Empty in, empty out.
    """
    own = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v")
    cur = materialize(own.mapInArrow(tidy(_trees(False)), "u long, v long"), "cc")
    seen = _digest(cur)
    while seen[0] > EDGES:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _salted(both, "low")
        large = _meet(both.where("v > u"), low.select("u", F.least("u", "m").alias("m"), "k", "salt")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low2 = _salted(large, "low")
        small = _meet(large, low2).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.union(low2.where("salt = 0").select("u", F.col("m").alias("v"))).distinct()
        cur = materialize(nxt, "cc")
        now = _digest(cur)
        if now == seen:
            roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        seen = now
    return cur.coalesce(1).mapInArrow(tidy(_trees(True)), "node long, component long")


def forest(n: int, ii: np.ndarray, jj: np.ndarray) -> list[int]:
    """Positions of the links that join two trees when taken in order; the rest add nothing to components."""
    parent = list(range(n))
    keep = []
    for k, (i, j) in enumerate(zip(ii.tolist(), jj.tolist())):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    return keep
