"""Ranked lexical search: postings grouped by exact impact, processed in descending order until bounds prove the top k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lists, materialize, pieces, read_table, tidy
from .words import LETTERS, word_hashes

#: Documents returned for an item.
TOP = 50
#: Terms of items, repeats over items included, that one pass over the documents looks for: 8 bytes each in a broadcast.
#: More items take more passes.
TERMS = 1 << 20
#: Postings, and documents, that a task scores at once: some 60 bytes of memory a posting.
POSTINGS, DOCS = 1 << 21, 1 << 18
#: Bytes of text that are read into terms at once; a longer text goes alone.
AT_ONCE = 4 << 20
#: Postings that are added between two looks at the bounds, at least.
STEP = 1 << 12
#: Tasks whose best documents one task of the last ranking takes.
MERGE = 256


def _some(batches, ids: int):
    """Lists of rows (the first ``ids`` columns, the text's bytes) of ``AT_ONCE`` bytes or one row."""
    rows, size = [], 0
    for batch in pieces(batches):
        for *left, text in zip(*(batch.column(k) for k in range(ids + 1))):
            text = text.as_buffer().to_pybytes() if text.is_valid else b""
            if rows and size + len(text) > AT_ONCE:
                yield rows
                rows, size = [], 0
            rows.append((*(x.as_py() for x in left), text))
            size += len(text)
    if rows:
        yield rows


def _item_terms(batches):
    """(item_id, its distinct terms as hashes)."""
    for rows in _some(batches, 1):
        index, hashes = word_hashes([t for _, t in rows], LETTERS)
        both = np.unique(np.rec.fromarrays([index, hashes]))
        counts = np.bincount(both.f0, minlength=len(rows))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), lists(counts, pa.array(both.f1.view(np.int64)))], ["item_id", "terms"])


def _postings(wanted):
    """(doc_id, number of terms, places of its terms among the sorted hashes ``wanted``, their occurrences)."""

    def run(batches):
        want = wanted.value
        for rows in _some(batches, 1):
            index, hashes = word_hashes([t for _, t in rows], LETTERS)
            sizes = np.bincount(index, minlength=len(rows))
            at = np.minimum(np.searchsorted(want, hashes), len(want) - 1)
            hit = want[at] == hashes
            both, times = np.unique(index[hit] * len(want) + at[hit], return_counts=True)
            counts = np.bincount(both // len(want), minlength=len(rows))
            columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array(sizes), lists(counts, pa.array((both % len(want)).astype(np.int32))), lists(counts, pa.array(times.astype(np.int32)))]
            held = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])
            yield held.filter(pa.array(sizes > 0))

    return run


def impacts(weights: np.ndarray, times: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score: by its weight, its occurrences and the document's number of terms."""
    if 50 * int(sizes.max(initial=0)) * n_docs < 1 << 63:
        m = 50 + 50 * sizes * n_docs // n_terms
    else:  # beyond 64 bits
        m = np.array([50 + 50 * int(n) * n_docs // n_terms for n in sizes], np.int64)
    return weights * (1_000_000_000 * times // (1000 * times + 20 * m))


class Block:
    """The postings of some documents: by document, and by term in groups of one exact impact, highest first."""

    def __init__(self, counts: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.docs, self.n_terms = len(counts), n_terms
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.terms, self.impact = terms, impact
        doc = np.repeat(np.arange(self.docs), counts)
        order = np.lexsort((-impact, terms))
        self.doc, by_term, by_impact = doc[order], terms[order], impact[order]
        new = np.ones(len(order), bool)
        new[1:] = (by_term[1:] != by_term[:-1]) | (by_impact[1:] != by_impact[:-1])
        start = np.flatnonzero(new)
        self.start, self.end = start, np.append(start[1:], len(order))
        self.group_impact = by_impact[start]
        self.groups = np.searchsorted(by_term[start], np.arange(n_terms + 1))  # of each term

    def _spread(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """All positions of some ranges."""
        sizes = ends - starts
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return np.arange(len(shift)) + shift

    def complete(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of a few documents, from their own lists of terms."""
        lo, hi = self.first[docs], self.first[docs + 1]
        at = self._spread(lo, hi)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), hi - lo), np.where(wanted[self.terms[at]], self.impact[at], 0))
        return out

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, whole scores, postings added): among them are all that are in the top k and at ``floor`` or more.

        Groups of the item's terms are added in descending order of impact. What is still to come can add at most the
        next group's impact for each term: R. With t the k-th highest sum so far (or ``floor``, scores found before), no
        document whose sum + R is below t is among the top k. If unseen documents are thereby out, and completing the
        documents left takes fewer steps than going on, the work stops and these are completed."""
        lo, hi = self.groups[terms], self.groups[terms + 1]
        own = self._spread(lo, hi)
        of = np.repeat(np.arange(len(terms)), hi - lo)
        order = np.argsort(-self.group_impact[own], kind="stable")
        own, of = own[order], of[order]
        ends = np.cumsum(self.end[own] - self.start[own])
        total = int(ends[-1]) if len(ends) else 0
        sums = np.zeros(self.docs, np.int64)
        done, added, step = 0, 0, max(STEP, total // 16)
        ahead = lo.copy()
        while done < len(own):
            upto = min(len(own), int(np.searchsorted(ends, added + step)) + 1)
            now = own[done:upto]
            sizes = self.end[now] - self.start[now]
            np.add.at(sums, self.doc[self._spread(self.start[now], self.end[now])], np.repeat(self.group_impact[now], sizes))
            ahead += np.bincount(of[done:upto], minlength=len(terms))
            done, added = upto, int(ends[upto - 1])
            if done == len(own):
                break
            rest = int(self.group_impact[np.minimum(ahead, len(self.group_impact) - 1)][ahead < hi].sum())
            least = max(floor, int(np.partition(sums, self.docs - k)[self.docs - k]) if self.docs >= k else 0)
            if rest < least:
                left = np.flatnonzero(sums + rest >= least)
                if int((self.first[left + 1] - self.first[left]).sum()) <= total - added:
                    wanted = np.zeros(self.n_terms, bool)
                    wanted[terms] = True
                    return left, self.complete(left, wanted), added
        found = np.flatnonzero(sums >= max(floor, 1))
        return found, sums[found], added


def best(scores: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones the smallest ids, null ones last."""
    left = np.flatnonzero(scores > 0)
    if len(left) > k:
        left = left[scores[left] >= np.partition(scores[left], len(left) - k)[len(left) - k]]
    return left[np.lexsort((ids[left], none[left], -scores[left]))[:k]]


def _search(shared, k: int):
    """Each task's best documents of every item. The scores found in one block bound the next."""

    def run(batches):
        items, weights, n_docs, n_terms = shared.value
        tops = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]

        def score(parts):
            counts, terms, times, sizes, none, ids = (np.concatenate(x) for x in zip(*parts))
            impact = impacts(weights[terms], times, np.repeat(sizes, counts), n_docs, n_terms)
            block = Block(counts, terms, impact, len(weights))
            for q, (_, wanted) in enumerate(items):
                had = tops[q]
                floor = int(had[0][-1]) if len(had[0]) == k else 0
                docs, scores, _ = block.search(wanted, k, floor)
                some = [np.concatenate(x) for x in zip(had, (scores, none[docs], ids[docs]))]
                keep = best(*some, k)
                tops[q] = tuple(x[keep] for x in some)

        parts, held, rows = [], 0, 0
        for b in pieces(batches, 4096):
            if parts and (held + len(b.column("terms").flatten()) > POSTINGS or rows + b.num_rows > DOCS):
                score(parts)
                parts, held, rows = [], 0, 0
            terms = b.column("terms").flatten().to_numpy()
            counts = b.column("terms").value_lengths().to_numpy()
            ids = b.column("doc_id")
            parts.append((counts, terms, b.column("times").flatten().to_numpy().astype(np.int64), b.column("n").to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()))
            held, rows = held + len(terms), rows + b.num_rows
        if parts:
            score(parts)
        for q, (scores, none, ids) in enumerate(tops):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array([items[q][0]] * len(scores), pa.int64()), pa.array(ids, mask=none), pa.array(scores)], ["q", "item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` (item_id, text) the k best rows of ``docs`` (doc_id, text).

    One pass over the documents keeps the terms that items hold, as a table in the shared folder; document frequencies
    and totals are counted from it. Its partitions are then searched apart: a task groups the postings of up to
    ``POSTINGS`` by exact impact and answers every item (``Block.search``), and the tasks' best are ranked together.
    The items of a pass hold ``TERMS`` terms; more items take more passes. Terms are told apart by 64-bit hashes: that
    a document's term is taken for a wrong one has a probability of some 1e-13 for a million of each.

    Every row is a document or an item of its own, whatever its id; of equal scores the smaller doc_id comes first, a
    null one last, rows equal in both in any order. Null texts, and texts without a term, match nothing. Texts are read
    whole. Other columns are ignored. Empty tables give an empty result."""
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    schema = "item_id long, rank int, doc_id long, score long"
    sought = materialize(items.mapInArrow(tidy(_item_terms), "item_id long, terms array<long>").where("size(terms) > 0"), "items")
    passes = math.ceil((sought.agg(F.sum(F.size("terms"))).first()[0] or 0) / TERMS)
    out = spark.createDataFrame([], schema)
    for p in range(passes):
        part = sought.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == p).collect()
        if not part:
            continue
        hashes = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in part]).view(np.uint64))
        index = materialize(docs.mapInArrow(tidy(_postings(spark.sparkContext.broadcast(hashes))), "doc_id long, n long, terms array<int>, times array<int>"), "index")
        # a document counts for each of its terms, and once under -1
        counts = index.select("n", F.explode(F.array_append("terms", -1)).alias("t")).groupBy("t").agg(F.count("*").alias("df"), F.sum("n").alias("n")).collect()
        totals = next((r for r in counts if r["t"] == -1), None)
        if totals is None:
            return out
        weights = np.zeros(len(hashes), np.int64)
        for r in counts:
            if r["t"] >= 0:
                weights[r["t"]] = math.floor(1000 * math.log((2 * totals["df"] + 2) / (2 * r["df"] + 1)))
        queries = [(r["item_id"], np.searchsorted(hashes, np.sort(np.array(r["terms"], np.int64).view(np.uint64)))) for r in part]
        shared = spark.sparkContext.broadcast((queries, weights, totals["df"], totals["n"]))
        found = index.where("size(terms) > 0").mapInArrow(tidy(_search(shared, k)), "q int, item_id long, doc_id long, score long")
        tasks = index.rdd.getNumPartitions()
        if tasks > MERGE:
            found = _ranked(found.withColumn("salt", F.spark_partition_id() % math.ceil(tasks / MERGE)), k, "q", "salt")
        out = out.union(_ranked(found, k, "q").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
