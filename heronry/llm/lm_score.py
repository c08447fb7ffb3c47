"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

A document doesn't vouch for itself: c'(x) is the count of x in all other rows, the corpus count less the row's own.
S(w | v) = c'(v w) / c'(v) where another row holds the pair, else 0.4 c'(w) / N', where c'(v) counts the pairs that
start with v and N' the words of all other rows; a word that no other row holds counts as one. A row's first word is
scored c'(w) / N'. Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased; pairs do not
cross rows. A document's score is the sum of ln S over its words. ``scores_by_joins`` is the same for any order.

Both tables are partitioned by hash and met by the documents' exploded n-grams; what travels is packed: a batch
of documents sends each partition its distinct pairs once, with the documents that hold them. The partition of a
pair is its first word's, so c(v) is at hand; pairs that miss the table go on to the partitions of the word table.
Frequent words would make partitions uneven, so three tables of bounded size go to the executors first: words of
more than ``known_share`` of all (1 / known_share at most), those among them that would fill a partition, and pairs of
two words of more than ``hot_share`` (1 / hot_share^2 at most). Pairs that start with a word that would fill a
partition are spread by both words.

Defined cases: null, empty and blank texts have 0 words, score 0 and mean null; a single word is scored by its
share; rows of one doc_id (null too) count each and are scored together; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .words import mix, word_hashes

BACKOFF = 0.4
HOT_SHARE, KNOWN_SHARE = 1e-3, 2e-6
#: Words of a batch, and of a partition at expectation.
BATCH, PART = 1_500_000, 1_500_000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed; those of small numbers byte by byte, so that their zeros lie together. See unpack."""
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    body = (a.tobytes() if a.dtype.itemsize != 4 else a.view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(body))


def unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, np.uint32, len(kinds))
    at, out = 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        if width == 4:
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view(kind).ravel())
        else:
            out.append(np.frombuffer(data, kind, n, at))
        at += n * width
    return out


def _batches(batches):
    """Ids and whole texts of about BATCH words."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            t = (t.as_py() or "").encode("utf-8", "replace")
            ids.append(i.as_py())
            texts.append(t)
            n += len(t) + 20
            if n > 6 * BATCH:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    out, at, n = [], 0, 0
    for k, t in enumerate(texts):  # hashing needs some 50 bytes a byte of text
        n += len(t)
        if n > 1 << 18 or k == len(texts) - 1:
            of, h = word_hashes(texts[at : k + 1])
            out.append((of + at, h))
            at, n = k + 1, 0
    return np.concatenate([o for o, _ in out]), np.concatenate([h for _, h in out])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.nonzero(new)[0]


def _unigrams(batches):
    for _, texts in _batches(batches):
        h, n = np.unique(_words(texts)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["w", "n"])


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(h), -1, np.int64)
    k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[k] == h, k, -1)


def _hot_pairs(shared):
    """Counts of pairs of two hot words, as first * size + second by their numbers, and of pairs that start with a word that is
    spread, as -1 - its place."""

    def run(batches):
        (hot, number, size), total = shared.value, {}
        for _, texts in _batches(batches):
            of, h = _words(texts)
            k = _find(hot, h)
            inner = (of[1:] == of[:-1]) & (k[:-1] >= 0)
            a, b = k[:-1][inner], k[1:][inner]
            x, y = _numbers(number, a), _numbers(number, b)
            v, n = np.unique(np.concatenate((-1 - a, (x * size + y)[(x >= 0) & (y >= 0)])), return_counts=True)
            for x, c in zip(v.tolist(), n.tolist()):
                total[x] = total.get(x, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["p", "n"])

    return run


def _numbers(number: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers of the hot words among the spread ones, -1 for others."""
    return np.where(places >= 0, number[places], -1) if len(number) else np.full(len(places), -1, np.int64)


KINDS = (np.int64, np.bool_, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)
SENT = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("doc", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])


def _own(*keys: np.ndarray) -> np.ndarray:
    """How often each entry's combination of keys is found."""
    order = np.lexsort(keys)
    begin = _runs(*(k[order] for k in keys))
    n = np.diff(np.append(begin, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _explode(shared, parts: int):
    """Packed pairs for each partition, and a row for each document: its words and the score of its hot pairs."""

    def run(batches):
        t = shared.value
        hot, total = t["hot"], t["total"]
        for ids, texts in _batches(batches):
            known = np.array([i is not None for i in ids])
            keys = np.array([i or 0 for i in ids], np.int64)
            m = len(ids)
            of, h = _words(texts)
            k = _find(hot, h)
            first = np.concatenate(([True], of[1:] != of[:-1]))[: len(of)]
            v, w, d, kv, kw, inner = h[:-1], h[1:], of[1:], k[:-1], k[1:], ~first[1:]
            nv, nw = _numbers(t["number"], kv), _numbers(t["number"], kw)
            both = inner & (nv >= 0) & (nw >= 0)
            count = np.bincount(of, minlength=m)
            own_word = _own(h, of)  # of the word itself
            own_start = np.zeros(len(h), np.int64)  # pairs of the row that start with the word
            begins = np.nonzero(inner)[0]
            own_start[begins] = _own(v[begins], d[begins])
            at = np.nonzero(both)[0]
            j = _find(t["pairs"], nv[at] * t["numbered"] + nw[at])
            own_pair = _own(v[at], w[at], d[at])
            n = (t["pairs_n"][j] if len(at) else np.zeros(0, np.int64)) - own_pair
            others = np.maximum(total - count, 1)
            hit = np.log(np.maximum(n, 1) / np.maximum(t["hot_start"][kv[at]] - own_start[at], 1)) if len(at) else np.zeros(0)
            miss = np.log(BACKOFF * np.maximum(t["hot_n"][kw[at]] - own_word[at + 1], 1) / others[d[at]]) if len(at) else np.zeros(0)
            score = np.bincount(d[at], np.where(n > 0, hit, miss), m)
            yield pa.RecordBatch.from_arrays([pa.array(mix(keys.view(np.uint64)) % np.uint64(parts), pa.int32()), pa.nulls(m, pa.binary()), pa.array(ids, pa.int64()), pa.array(count), pa.array(score)], schema=SENT)
            # the first word of a text follows the word 0
            rest, begin = np.nonzero(inner & ~both)[0], np.nonzero(first)[0]
            a = np.concatenate((v[rest], np.zeros(len(begin), np.uint64)))
            b, doc = np.concatenate((w[rest], h[begin])), np.concatenate((d[rest], of[begin]))
            starts, words = np.concatenate((own_start[rest], np.zeros(len(begin), np.int64))), np.concatenate((own_word[rest + 1], own_word[begin]))
            spread = np.where(np.concatenate((kv[rest] >= 0, np.ones(len(begin), bool))), mix(a * np.uint64(3) + b), mix(a))
            part = (spread % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((doc, b, a, part))
            a, b, doc, part, starts, words = a[order], b[order], doc[order], part[order], starts[order], words[order]
            post = _runs(part, a, b, doc)
            times = np.diff(np.append(post, len(a)))
            a, b, doc, part, starts, words = a[post], b[post], doc[post], part[post], starts[post], words[post]
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                lo, hi = int(cut[p]), int(cut[p + 1])
                if lo == hi:
                    continue
                x, y = a[lo:hi], b[lo:hi]
                docs, local = np.unique(doc[lo:hi], return_inverse=True)
                pair, ctx = _runs(x, y), _runs(x)
                blob = pack(
                    keys[docs], known[docs], count[docs].astype(np.uint32), np.diff(x[ctx], prepend=np.uint64(0)), np.diff(np.append(np.searchsorted(pair, ctx), len(pair))).astype(np.uint32),
                    y[pair], np.diff(np.append(pair, hi - lo)).astype(np.uint32), local.astype(np.uint32), times[lo:hi].astype(np.uint32),
                    (starts[lo:hi] - times[lo:hi]).astype(np.int32).view(np.uint32), (words[lo:hi] - times[lo:hi]).astype(np.uint32),
                )
                yield pa.RecordBatch.from_pylist([{"part": p, "blob": blob}], schema=SENT)

    return run


JOINED = "w long, own long, doc long, n long, score double"


def _join(shared):
    """Counts a partition's pairs and scores them; a row for each document, and one for each word to look up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = shared.value
        plain = pdf[pdf.blob.isnull()]
        out = [pd.DataFrame({"w": mix(plain.doc.fillna(0).to_numpy(np.int64).view(np.uint64)).view(np.int64), "own": 0, "doc": plain.doc.astype("Int64"), "n": plain.n.astype("int64"), "score": plain.score})]
        # own: the row's own count of the word in the upper half, how often it is asked for in the lower one
        cols = [[] for _ in range(8)]
        for blob in pdf.blob[pdf.blob.notnull()]:
            ids, known, size, c, per_ctx, b, per_pair, local, times, starts, own = unpack(blob, KINDS)
            c, starts, own = np.cumsum(c, dtype=np.uint64), starts.view(np.int32) + times.astype(np.int64), own + times.astype(np.int64)
            for held, x in zip(cols, (np.repeat(np.repeat(c, per_ctx), per_pair), np.repeat(b, per_pair), ids[local], known[local], times, starts, own, size[local])):
                held.append(x)
        if cols[0]:
            ctx, nxt, doc, known, times, starts, own, size = map(np.concatenate, cols)
            cols.clear()
            order = np.lexsort((nxt, ctx))
            ctx, nxt, doc, known, times = ctx[order], nxt[order], doc[order], known[order], times[order].astype(np.int64)
            starts, own, others = starts[order].astype(np.int64), own[order].astype(np.int64), np.maximum(t["total"] - size[order].astype(np.int64), 1)
            pair, start = _runs(ctx, nxt), _runs(ctx)
            n_pair = np.repeat(np.add.reduceat(times, pair), np.diff(np.append(pair, len(ctx))))
            n_start = np.repeat(np.add.reduceat(times, start), np.diff(np.append(start, len(ctx))))
            kv = _find(t["hot"], ctx)
            if len(t["hot"]):
                n_start = np.where(kv >= 0, t["hot_start"][kv], n_start)
            opening = ctx == 0
            hit = (n_pair > times) & ~opening
            kw = _find(t["words"], nxt)
            s = np.where(hit, np.log(np.maximum(n_pair - times, 1) / np.maximum(n_start - starts, 1)), np.where(opening, 0.0, math.log(BACKOFF)) - np.log(others))
            if len(t["words"]):
                s = s + np.where(~hit & (kw >= 0), np.log(np.maximum(t["words_n"][kw] - own, 1)), 0.0)
            ask = ~hit & (kw < 0)
            s *= times
            # documents in order; the first word to look up carries the document's score, else a row of its own
            order = np.lexsort((nxt, ~ask, doc, known))
            doc, known, nxt, ask, times, s, own = doc[order], known[order], nxt[order], ask[order], times[order], s[order], own[order]
            begin = _runs(doc, known)
            total = np.add.reduceat(s, begin)
            row = ask.copy()
            row[begin] = True
            score = np.zeros(len(doc))
            score[begin] = total
            keep = np.nonzero(row)[0]
            w = np.where(ask, nxt, mix(doc.view(np.uint64)))[keep].view(np.int64)
            ids = pd.array(doc[keep], dtype="Int64")
            ids[~known[keep]] = pd.NA
            out.append(pd.DataFrame({"w": w, "own": np.where(ask, own << 32 | times, 0)[keep], "doc": ids, "n": 0, "score": score[keep]}))
        return pd.concat(out, ignore_index=True)

    return run


def lm_scores(docs: DataFrame, hot_share: float = HOT_SHARE, known_share: float = KNOWN_SHARE, part_words: int | None = None) -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) for every document, by word pairs."""
    spark, part_words = docs.sparkSession, part_words or PART
    pairs = docs.select("doc_id", "text")
    words = materialize(pairs.mapInArrow(tidy(_unigrams), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    spread_share = min(hot_share, max(part_words / max(total, 1), known_share))  # a word that would fill a partition is spread
    # at most 1 / known_share rows
    known = sorted((r["w"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in words.where(F.col("n") > known_share * total).collect())
    table = {"total": max(total, 1), "words": np.array([w for w, _ in known], np.uint64), "words_n": np.array([n for _, n in known], np.int64)}
    spread = table["words_n"] > spread_share * total
    table |= {"hot": table["words"][spread], "hot_n": table["words_n"][spread]}
    # of pairs only those of two hot words are gathered, whatever the corpus's size
    is_hot = table["hot_n"] > hot_share * total
    table |= {"number": np.where(is_hot, np.cumsum(is_hot) - 1, -1), "numbered": int(is_hot.sum())}
    sought = spark.sparkContext.broadcast((table["hot"], table["number"], table["numbered"]))
    # at most 1 / known_share + 1 / hot_share^2 rows
    got = pairs.mapInArrow(tidy(_hot_pairs(sought)), "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    table["hot_start"] = np.ones(len(table["hot"]), np.int64)
    for r in got:
        if r["p"] < 0:
            table["hot_start"][-1 - r["p"]] = r["n"]
    both = sorted((r["p"], r["n"]) for r in got if r["p"] >= 0)
    table |= {"pairs": np.array([p for p, _ in both], np.int64), "pairs_n": np.array([n for _, n in both], np.int64)}
    shared = spark.sparkContext.broadcast(table)
    parts = max(1, math.ceil(total / part_words))
    sent = pairs.mapInArrow(tidy(_explode(shared, parts)), "part int, blob binary, doc long, n long, score double")
    found = sent.groupBy("part").applyInPandas(_join(shared), JOINED)
    rare = words.where(F.col("n") <= known_share * total).select(F.col("w").alias("u"), F.col("n").alias("c"))
    scored = found.join(rare, F.col("w") == F.col("u"), "left")
    times = F.col("own").bitwiseAND(F.lit(0xFFFFFFFF))
    per = scored.groupBy("doc").agg(F.sum("n").alias("n_words"), F.sum(F.col("score") + F.when(times > 0, times * F.log(F.greatest(F.col("c") - F.shiftright("own", 32), F.lit(1)))).otherwise(0.0)).alias("log_score"))
    return per.select(F.col("doc").alias("doc_id"), "n_words", "log_score", (F.col("log_score") / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("mean_score"))


def _grams(order: int):
    """For every distinct n-gram ending of a row: hashes of the last 1 ... order words and of what stands before the
    last one, the row's own counts of both, and how often the whole is found."""

    def run(batches):
        for b in batches:
            for i, n, t in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                h = _words([(t or "").encode("utf-8", "replace")])[1]
                if not len(h):
                    continue
                ends = []  # ends[k][p]: the k + 1 words that end at p, 0 where the text is shorter
                for k in range(order):
                    g = h if not k else np.concatenate((np.zeros(k, np.uint64), mix(ends[k - 1][k - 1 : -1] * np.uint64(0x9E3779B97F4A7C15) + h[k:])[: len(h) - k] if len(h) > k else h[:0]))[: len(h)]
                    ends.append(g)
                own = [np.where(g != 0, _own(g), 0) for g in ends]
                lead = [np.concatenate((np.zeros(1, np.uint64), g[:-1])) for g in ends]
                # contexts: k words that another word follows
                lead_own = [np.where(x != 0, _own(np.where(x != 0, x, 0)), 0) for x in lead]
                key = np.stack(ends)
                first = np.unique(key, axis=1, return_index=True, return_counts=True)
                at, times = first[1], first[2]
                col = lambda xs, kind: pa.FixedSizeListArray.from_arrays(pa.array(np.stack(xs)[:, at].T.ravel().astype(kind)), order).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(at), pa.int64()), pa.array([n] * len(at), pa.int64()), pa.array(np.full(len(at), len(h), np.int64)), col([e.view(np.int64) for e in ends], np.int64), col(own, np.int64), col([x.view(np.int64) for x in lead], np.int64), col(lead_own, np.int64), pa.array(times.astype(np.int64))],
                    ["row", "doc_id", "size", "g", "o", "x", "xo", "times"],
                )

    return run


def scores_by_joins(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, log_score) by n-grams of any order, as plain joins: count tables of n-grams and of contexts, partitioned
    by hash, met by the exploded n-grams from the highest order down; what misses goes on to the next lower one."""
    named = materialize(docs.select(F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("row"), "doc_id", "text"), "rows")
    rows = named.mapInArrow(tidy(_grams(order)), "row long, doc_id long, size long, g array<long>, o array<long>, x array<long>, xo array<long>, times long")
    rows = materialize(rows, "grams")
    total = rows.agg(F.sum("times")).first()[0] or 0
    out, left = None, rows
    for k in range(order, 0, -1):
        i = k - 1
        table = rows.where(F.col("g")[i] != 0).groupBy(F.col("g")[i].alias("gram")).agg(F.sum("times").alias("n"))
        here = left.where(F.col("g")[i] != 0).join(table, F.col("g")[i] == F.col("gram"))
        n = F.col("n") - F.col("o")[i]
        # a text's first words have no longer context: no penalty for the orders they can't have
        steps = F.size(F.filter(F.slice("g", k + 1, order), lambda v: v != 0))
        if k > 1:
            starts = rows.where(F.col("x")[i - 1] != 0).groupBy(F.col("x")[i - 1].alias("context")).agg(F.sum("times").alias("m"))
            here = here.join(starts, F.col("x")[i - 1] == F.col("context"))
            value = n / F.greatest(F.col("m") - F.col("xo")[i - 1], F.lit(1))
            hit = n > 0
        else:
            value, hit = F.greatest(n, F.lit(1)) / F.greatest(F.lit(total) - F.col("size"), F.lit(1)), F.lit(True)
        scored = here.withColumn("hit", hit).withColumn("s", F.when(F.col("hit"), F.col("times") * (F.log(value) + steps * math.log(BACKOFF)))).select("row", "doc_id", "size", "g", "o", "x", "xo", "times", "hit", "s")
        scored = materialize(scored, "scored")
        part = scored.where("hit").groupBy("row", "doc_id").agg(F.sum("s").alias("s"))
        out = part if out is None else out.union(part)
        left = scored.where("not hit").drop("hit", "s").union(left.where(F.col("g")[i] == 0))
    per = out.groupBy("row", "doc_id").agg(F.sum("s").alias("log_score"))
    return named.select("row", "doc_id").join(per.select("row", "log_score"), "row", "left").select("doc_id", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_score", 9).alias("mean_score"))
