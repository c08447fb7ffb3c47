"""SimHash near-dedup of documents: groups of five-word shingle sets with a Jaccard similarity of 0.8 or more.

SimHash alone can't hold that bound: at similarity 0.8 two 64-bit fingerprints differ by 10 bits on average, with a
long tail. So the segment-popcount grid of ``simhash`` gives the pairs at three bits or fewer, a prefix filter gives
all others - in any one order of shingles, two sets that are similar enough share a shingle among the first
n - ceil(0.8 n) + 1 of each - and every pair that meets is verified by the exact similarity. The order puts shingles
that are frequent in a sample last; it decides the work, not the result. Of the smaller set the shared shingle is
among fewer still, the first n - ceil(2 * 0.8 / 1.8 n) + 1, so a passage that many documents hold makes no pairs but
of those that it nearly fills. Pairs are taken in two steps: those of the
grid and each set with the smallest of those it meets at a shingle, then all pairs that are not in one component yet;
these are compared in blocks of sets by size, sketch and texts, and a pair that is joined by then is left out, so that a crowd
gives no more links than it has sets.

Texts are fetched only for pairs whose sketches (``SKETCH`` min-hashes of a byte) agree in ``AGREE`` places at least:
at similarity 0.8 a pair has fewer with a probability of 1e-9, unrelated ones never come near.

Defined cases: words are as in ``simhash``; a text of fewer words than five is one shingle; texts without words are
equal; rows with a null doc_id link like any other; of a group one row stays, see ``common.keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, keep_one, marked, materialize, pieces, row_key, tidy
from .decontaminate import grams
from .simhash import links
from .words import BASE, mix, word_hashes

WIDTH, SIMILARITY = 5, 0.8
CHUNK = 1 << 18
#: Shingles that a verifying task keeps of the sets that it met.
CACHED = 1 << 21
#: Of so many sets one is in the sample; shingles seen in so many of it are frequent, the first so many of these count.
SAMPLE, OFTEN, MOST = 16, 8, 200_000


def _texts(batches):
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            t = (t.as_py() or "").encode("utf-8", "replace")
            ids.append(i.as_py())
            texts.append(t)
            n += len(t)
            if n > CHUNK:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def shingles(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    of, h = word_hashes(texts)
    word = np.searchsorted(of, np.arange(len(texts) + 1))
    at, g = grams(h, of, width)
    cut = np.searchsorted(at, word)
    out = []
    for k in range(len(texts)):
        own = g[cut[k] : cut[k + 1]]
        if not len(own) and word[k] < word[k + 1]:
            x = np.zeros(1, np.uint64)
            for w in h[word[k] : word[k + 1]]:
                x = x * np.uint64(BASE) + w
            own = mix(x)
        out.append(np.unique(own))
    return out


def _digest(s: np.ndarray) -> int:
    return int(mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s)) if len(s) else 0], np.uint64)).view(np.int64)[0])


def _fingerprint(s: np.ndarray) -> int:
    """SimHash of a shingle set."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(s), 4096):
        total += np.unpackbits(s[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(s), bitorder="little").view(np.int64)[0])


#: What names a row.
ROW = pa.struct([("doc_id", pa.int64()), ("key", pa.struct([("a", pa.int64()), ("b", pa.int64())]))])


#: Min-hashes of a set's sketch, and how many of two similar sets agree.
SKETCH, AGREE = 128, 73
_ODD = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(s: np.ndarray) -> bytes:
    """A byte of each min-hash of a shingle set."""
    low = np.full(SKETCH, ~np.uint64(0))
    for k in range(0, len(s), 1024):
        np.minimum(low, np.multiply.outer(s[k : k + 1024], _ODD).min(0), out=low)
    return (mix(low) >> np.uint64(56)).astype(np.uint8).tobytes()


def _sets(width):
    """A row for each document: its name, its set's digest, fingerprint, size and sketch."""

    def run(batches):
        for ids, texts in _texts(batches):
            sets = shingles(texts, width)
            ints = [pa.array([f(s) for s in sets], pa.int64()) for f in (_digest, _fingerprint, len)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, ROW), *ints, pa.array([sketch(s) for s in sets], pa.binary())], ["r", "node", "fp", "n", "sk"])

    return run


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, node, fp, n, sk): a row for each document."""
    named = docs.select(F.struct("doc_id", row_key().alias("key")).alias("r"), "text")
    ids = named.mapInArrow(tidy(_sets(width)), "r struct<doc_id: long, key: struct<a: long, b: long>>, node long, fp long, n long, sk binary")
    return materialize(ids.select("r.doc_id", "r.key", "node", "fp", "n", "sk"), "nodes")


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for b in pieces(batches):
        texts = [pack.compress((t.as_py() or "").encode("utf-8", "replace")) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(texts, pa.binary())], ["a", "b", "text"])


def _fetched(nodes: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text): the packed text of one row of each set. Rows that ``marked`` leaves out are not shuffled."""
    one = ids.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("r"))
    one = materialize(one.select("node", "r.doc_id", "r.key"), "wanted")
    rows = marked(docs.select("doc_id", "text", row_key().alias("key")), F.xxhash64("doc_id", "key"), one.select(F.xxhash64("doc_id", "key").alias("h")))
    packed = rows.where("maybe").select("row.key.a", "row.key.b", "row.text").mapInArrow(tidy(_packed), "a long, b long, text binary")
    # equal keys are equal texts
    return packed.groupBy("a", "b").agg(F.first("text").alias("text")).join(one.select("node", "key.a", "key.b"), ["a", "b"]).select("node", "text")


def _sample(width):
    def run(batches):
        for _, texts in _texts(batches):
            for h in shingles(texts, width):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


def _prefixes(shared, width, similarity):
    def run(batches):
        keys, often = shared.value
        done: set[int] = set()  # copies that one task meets are sent once
        for _, texts in _texts(batches):
            for s in shingles(texts, width):
                node, size, h = _digest(s), len(s), s.view(np.int64)
                n = size - math.ceil(similarity * size - 1e-9) + 1
                if not size or node in done:
                    continue
                if len(done) < 1 << 20:
                    done.add(node)
                if len(keys):
                    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    h = h[np.lexsort((h, np.where(keys[k] == h, often[k], 0)))]
                short = np.arange(n) <= size - math.ceil(2 * similarity / (1 + similarity) * size - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(h[:n]), pa.array(np.full(n, node), pa.int64()), pa.array(short)], ["h", "node", "short"])

    return run


def _agree(batches):
    """The pairs whose sketches agree."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, SKETCH) for c in ("sa", "sb"))
        keep = pa.array((x == y).sum(1) >= AGREE)
        yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


#: Sets of a block; two blocks are compared by one task at once.
BLOCK = 2048


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _runs(batches):
    """(key, rows) of rows that come sorted by their first three columns."""
    key, rows = None, []
    for batch in pieces(batches, 1024):
        for *k, row in zip(*(x.to_pylist() for x in batch.columns[:3]), zip(*(x.to_pylist() for x in batch.columns[3:]))):
            if k != key:
                if key is not None:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if key is not None:
        yield key, rows


class _Sets:
    """Sets of two blocks as arrays: (node, component, size, side, sketch)."""

    def __init__(self, rows, one: bool, similarity: float):
        self.node, self.c, self.n, self.side = (np.array([r[k] for r in rows]) for k in range(4))
        self.sk = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, SKETCH)
        self.one, self.similarity = one, similarity

    def near(self, x: int, among: np.ndarray | None = None) -> np.ndarray:
        """Sets of other components, as large or larger, that could be similar to x by size and sketch."""
        fits = (self.c != self.c[x]) & (self.n >= self.n[x]) & (self.n[x] >= self.similarity * self.n - 1e-6)
        if among is not None:
            fits &= among
        if not self.one:
            fits &= self.side != self.side[x]
        y = np.flatnonzero(fits)
        return y[(self.sk[y] == self.sk[x]).sum(1) >= AGREE]


def _candidates(similarity):
    """(g, i, j, node): the sets of two blocks that share a shingle with one that they could be similar to."""

    def run(batches):
        for (g, i, j), rows in _runs(batches):
            sets, places = [r[1:6] for r in rows if not r[0]], [(r[6], r[1], r[7]) for r in rows if r[0]]
            if len({s[1] for s in sets}) < 2 or not places:
                continue
            at, held = {s[0]: k for k, s in enumerate(sets)}, {}
            for h, x, short in places:
                held.setdefault(h, []).append((at[x], short))
            meets = np.zeros((len(sets), len(sets)), bool)
            for members in held.values():
                every = np.array([k for k, _ in members])
                for k, short in members:
                    if short:
                        meets[k, every] = True
            all_, found = _Sets(sets, i == j, similarity), set()
            for x in np.flatnonzero(meets.any(1)).tolist():
                y = all_.near(x, meets[x])
                if len(y):
                    found.update(y.tolist(), (x,))
            if found:
                nodes = all_.node[sorted(found)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(nodes), v), t) for v, t in ((g, pa.int64()), (i, pa.int32()), (j, pa.int32()))), pa.array(nodes)], ["g", "i", "j", "node"])

    return run


def _meet(width, similarity):
    """Links (a, b) between the sets of two blocks, as many as join their components.

    A pair that is joined by then is not looked at; any other that could be similar by size and sketch is verified by its
    texts. So a crowd gives no more rows than it has sets."""

    def links_of(rows, one):
        all_ = _Sets(rows, one, similarity)
        label = np.unique(all_.c, return_inverse=True)[1].tolist()
        parent = list(range(len(rows)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        unpack, kept, size = zstandard.ZstdDecompressor(), {}, 0

        def of(k):
            nonlocal size
            if k not in kept:
                if size > CACHED:
                    kept.clear()
                    size = 0
                kept[k] = shingles([unpack.decompress(rows[k][5])], width)[0]
                size += len(kept[k])
            return kept[k]

        for x in range(len(rows)):
            for k in all_.near(x).tolist():
                p, q = root(label[x]), root(label[k])
                if p != q and _overlap(of(x), of(k)) >= similarity:
                    parent[max(p, q)] = min(p, q)
                    yield int(min(all_.node[x], all_.node[k])), int(max(all_.node[x], all_.node[k]))

    def run(batches):
        for (_, i, j), rows in _runs(batches):
            found = list(links_of(rows, i == j))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return run


def _apart(part: DataFrame, sets: DataFrame, docs: DataFrame, width: int, similarity: float, ids: DataFrame | None = None) -> DataFrame:
    """Links between sets of different components at a shingle, of ``part`` (h, node, short, c), that join these components.

    Of a shingle's sets only those count that are about as large as one of the short ones. Shingles with the same smallest
    component go together, so that a pair that meets at many is looked at once; their sets are dealt into blocks, and each
    two blocks to a task of their own. Texts are sent only of sets that could be similar to another by size and sketch."""
    sized = part.join(sets.select("node", "n"), "node")
    least, most = F.min(F.when(F.col("short"), F.col("n"))).alias("least"), F.max(F.when(F.col("short"), F.col("n"))).alias("most")
    windows = sized.groupBy("h").agg(least, most).where("least is not null")
    sized = materialize(sized.join(windows, "h").where((F.col("n") >= F.col("least")) & (F.col("n") * similarity <= F.col("most") + 1e-6)).select("h", "node", "short", "c", "n"), "sized")
    heads = sized.groupBy("h").agg(F.min("c").alias("g"), F.max("c").alias("y"), F.max("short").alias("any")).where("g != y and any").select("h", "g")
    places = materialize(sized.join(heads, "h").select("g", "h", "node", "short", "c", "n"), "places")
    members = materialize(places.select("g", "node", "c", "n").distinct(), "members")
    blocks = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    side = (F.col("own") > F.col("other")).cast("int").alias("side")

    def dealt(rows: DataFrame, *columns) -> DataFrame:
        rows = rows.join(blocks, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    whole = dealt(members.join(sets.select("node", "sk"), "node"), F.lit(0).alias("place"), "node", "c", "n", side, "sk", none("long", "h"), none("boolean", "short"))
    seats = dealt(places, F.lit(1).alias("place"), "node", none("long", "c"), none("long", "n"), none("int", "side"), none("binary", "sk"), "h", "short")
    rows = whole.union(seats).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "place")
    near = materialize(rows.mapInArrow(tidy(_candidates(similarity)), "g long, i int, j int, node long"), "near")
    texts = _fetched(near.select("node").distinct(), docs, _nodes(docs, width) if ids is None else ids).join(sets.select("node", "n", "sk"), "node")
    texts = materialize(texts.join(part.groupBy("node").agg(F.min("c").alias("c")), "node"), "texts")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sent = near.join(blocks, "g").select("g", "i", "j", "node", (block != F.col("i")).cast("int").alias("side")).join(texts, "node").select("g", "i", "j", "node", "c", "n", "side", "sk", "text")
    return materialize(sent.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(tidy(_meet(width, similarity)), "a long, b long"), "links")


def _similar(width, similarity):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        kept: dict[int, np.ndarray] = {}
        size = 0

        def shingles_of(node: int, packed) -> np.ndarray:
            nonlocal size
            if node not in kept:
                if size > CACHED:
                    kept.clear()
                    size = 0
                kept[node] = shingles([unpack.decompress(packed.as_py())], width)[0]
                size += len(kept[node])
            return kept[node]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                keep.append(_overlap(shingles_of(a, ta), shingles_of(b, tb)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return run


def _close(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that could be similar by size and sketch, as a table."""
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sk").alias(f"s{x}")) for x in ("a", "b"))
    sized = pairs.join(a, "a").join(b, "b").where((F.col("na") >= similarity * F.col("nb") - 1e-6) & (F.col("nb") >= similarity * F.col("na") - 1e-6))
    return materialize(sized.select("a", "b", "sa", "sb").mapInArrow(tidy(_agree), "a long, b long"), "near")


def _verified(near: DataFrame, docs: DataFrame, ids: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose similarity is high enough, as a table."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(_fetched(wanted, docs, ids), "texts")
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in ("a", "b"))
    whole = near.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    return materialize(whole.mapInArrow(tidy(_similar(width, similarity)), "a long, b long"), "links")


def near_dup_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, group): every row, named by its doc_id and ``row_key``, with the number of its group."""
    spark = docs.sparkSession
    pairs = docs.select("doc_id", "text")
    ids = _nodes(docs, width)
    sets = materialize(ids.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sk").alias("sk")), "sets")
    sample = pairs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(tidy(_sample(width)), "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    often = sorted((r["h"], r["count"]) for r in sample.orderBy(F.desc("count"), "h").limit(MOST).collect())
    shared = spark.sparkContext.broadcast((np.array([h for h, _ in often], np.int64), np.array([n for _, n in often], np.int64)))
    # one shuffle serves the aggregation and the join
    prefix = pairs.mapInArrow(tidy(_prefixes(shared, width, similarity)), "h long, node long, short boolean").repartition("h")
    met = prefix.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("short").alias("any")).where("low != high and any").select("h", "low")
    places = materialize(prefix.join(met.hint("shuffle_merge"), "h"), "places")
    reps = materialize(sets.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
    alike = sets.select("fp", "node").join(reps, "fp").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    grid = alike.union(links(reps).select(F.least("a", "b"), F.greatest("a", "b")))
    first = materialize(places.where("low != node").select(F.col("low").alias("a"), F.col("node").alias("b")).union(grid).distinct(), "first")
    linked = _verified(_close(first, sets, similarity), docs, ids, width, similarity)
    cc = materialize(connected_components(linked), "components")
    # what is still apart at a shingle
    part = materialize(places.select("h", "node", "short").distinct().join(cc, "node", "left").select("h", "node", "short", F.coalesce("component", "node").alias("c")), "places")
    apart = part.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("h")
    rest = _apart(part.join(apart, "h", "left_semi"), sets, docs, width, similarity, ids)
    if not rest.isEmpty():  # the components found stand for the links that made them
        cc = connected_components(cc.select(F.col("component").alias("a"), F.col("node").alias("b")).union(rest))
    return ids.select("doc_id", "key", "node").join(cc, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("group"))


def dedup_simhash(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies."""
    return keep_one(docs, near_dup_groups(docs, **options))
