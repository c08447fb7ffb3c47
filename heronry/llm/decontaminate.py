"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment over words.

An alignment gives +2 for equal words, -1 for unequal ones and for gaps; a document's score is the best local
alignment's share of the full score of the item. Seeds are the rarest word of every window of ``SPREAD``
neighbouring words of an item, by counts over all documents, and all of its word pairs. No seed has to survive an
edit: places of a text are aligned where so many of an item's seeds lie that the threshold is in reach. With m of
n words matched, b neighbouring pairs of them unbroken, a score is m + b + 1 at most, and m is at most the words
that are no seeds plus the seeds that are there; so what reaches the threshold is always aligned. An alignment that
reaches T takes 3 n - T words of a text at most, so seeds are counted in overlapping windows of twice as many.

The items travel to the executors, in slices of at most ``SLICE`` words; a larger benchmark takes more passes.

Defined cases: words are runs of letters, digits and non-ASCII characters, lower-cased; null and empty texts
hold nothing; items of fewer than ``WHOLE`` words must be there as a whole, those of fewer than ``least`` are not looked for; repeated items are reported each, repeated
documents give a row each; a null doc_id is reported as null; ties go to the leftmost place; empty tables give an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy
from .words import LETTERS, mix, word_hashes

SEED_WORDS, SPREAD = 2, 4
#: Items of fewer words than ``WHOLE`` say little, so they are found as whole runs only; filtering leaves them out.
THRESHOLD, WHOLE = 0.5, 5
SLICE = 4_000_000
CHUNK = 1 << 18
#: Seeds found in texts that are counted at once, unless one text has more.
FOUND = 1 << 21

MATCH, MISS, GAP = 2, -1, -1


def grams(h: np.ndarray, of: np.ndarray, n: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of n-grams that lie in one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.nonzero(of[: len(of) - n + 1] == of[n - 1 :])[0]
    g = h[at]
    for k in range(1, n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    return at, mix(g)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of the item in the text; words [start, end)."""

    def best(a, b):
        ramp = np.arange(len(b) + 1)
        row, top, at = np.zeros(len(b) + 1, np.int64), 0, 0
        for w in a:
            new = np.zeros(len(b) + 1, np.int64)
            new[1:] = np.maximum(row[:-1] + np.where(b == w, MATCH, MISS), row[1:] + GAP)
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + ramp) - ramp  # gaps along the text cost one a word
            j = int(row.argmax())
            if row[j] > top:
                top, at = int(row[j]), j
        return top, at

    score, end = best(item, text)
    if not score:
        return 0, 0, 0
    _, back = best(item[::-1], text[:end][::-1])
    return score, end - back, end


def _chunks(batches, size=CHUNK):
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            t = (t.as_py() or "").lower().encode("utf-8", "replace")
            if not t:
                continue
            if texts and n + len(t) > size:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            n += len(t)
    if texts:
        yield ids, texts


class _Lookup:
    """Places of hashes in a sorted list, most misses told by one look at a bit."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[keys >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in keys) of what is found."""
        at = np.nonzero(self.bits[h >> np.uint64(44)])[0]
        k = np.searchsorted(self.keys, h[at])
        ok = k < len(self.keys)
        at, k = at[ok], k[ok]
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def _count(shared):
    def run(batches):
        find, total = _Lookup(shared.value), None
        for _, texts in _chunks(batches):
            of, h = word_hashes(texts, LETTERS)
            _, k = find(h)
            n = np.bincount(k, minlength=len(find.keys))
            total = n if total is None else total + n
        if total is not None:
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(find.keys[at].view(np.int64)), pa.array(total[at])], ["w", "n"])

    return run


def choose_seeds(counts: np.ndarray) -> np.ndarray:
    """Places of the rarest of every window of SPREAD neighbours; the leftmost of equals."""
    w = min(SPREAD, len(counts))
    return np.unique([i + int(np.argmin(counts[i : i + w])) for i in range(len(counts) - w + 1)]) if w else np.zeros(0, np.int64)


def _postings(h: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, where the seeds of each begin, and the seeds."""
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    return keys, np.append(first, len(h)), seed[order]


def _windows(d, p, seed, n_seeds, item_of, step, need):
    """(text, item, window) where enough of the item's seeds lie; windows are two steps long, one begins at every step."""
    item = item_of[seed]
    u = p // step[item]
    back = u > 0
    d, u, seed = np.concatenate((d, d[back])), np.concatenate((u, u[back] - 1)), np.concatenate((seed, seed[back]))
    if not len(d):
        return []
    per_text = int(u.max()) + 1
    key = np.unique((d * per_text + u) * n_seeds + seed)
    place, item = key // n_seeds, item_of[key % n_seeds]
    begin = np.nonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (item[1:] != item[:-1]))))[0]
    ok = begin[np.diff(np.append(begin, len(key))) >= need[item[begin]]]
    return sorted(zip((place[ok] // per_text).tolist(), item[ok].tolist(), (place[ok] % per_text).tolist()))


def _finder(plan):
    """A function that gives (text, item, score, start, end) for the items that each of some texts holds."""
    seeds, item_of, step, need, least_score, item_ids, words, begin = plan
    find = [(_Lookup(keys), first, seed) for keys, first, seed in seeds]

    def run(texts: list[bytes]):
        of, h = word_hashes(texts, LETTERS)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        found = []
        for n, (look, first, seed) in enumerate(find, 1):
            place, g = (np.arange(len(h)), h) if n == 1 else grams(h, of)
            at, k = look(g) if len(look.keys) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            found.append((place[at], k, first, seed))
        sizes = sum(np.bincount(of[p], first[k + 1] - first[k], len(texts)) for p, k, first, _ in found)
        part = (np.cumsum(sizes) // FOUND).astype(np.int64)
        regions = {}
        for lo, hi in zip(cut := np.unique(np.searchsorted(part, part)).tolist(), [*cut[1:], len(texts)]):
            at, seed = [], []
            for p, k, first, own in found:
                a, b = np.searchsorted(p, bounds[[lo, hi]])
                p, k = p[a:b], k[a:b]
                times = first[k + 1] - first[k]
                at.append(np.repeat(p, times))
                seed.append(own[np.arange(times.sum()) + np.repeat(first[k] - np.cumsum(times) + times, times)])
            at, seed = np.concatenate(at), np.concatenate(seed)
            for d, item, u in _windows(of[at], at - bounds[of[at]], seed, 2 * len(words), item_of, step, need):
                a, b = u * int(step[item]), (u + 2) * int(step[item])
                spans = regions.setdefault((d, item), [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        for (d, item), spans in sorted(regions.items()):
            words_of, text = words[begin[item] : begin[item + 1]], h[bounds[d] : bounds[d + 1]]
            top = (0, 0, 0)
            for a, b in spans:
                if 2 * np.isin(words_of, text[a:b]).sum() < least_score[item]:
                    continue
                score, s, e = align(words_of, text[a:b])
                if score > top[0]:
                    top = (score, a + s, a + e)
            share = top[0] / (MATCH * len(words_of))
            if top[0] >= least_score[item]:
                yield d, int(item_ids[item]), share, top[1], top[2]

    return run


def _match(shared):
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches):
        find = _finder(shared.value)
        for ids, texts in _chunks(batches):
            out = [(ids[d], *rest) for d, *rest in find(texts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def _clean(shared, at: int):
    """The rows whose text, the column at ``at``, holds no item."""

    def run(batches):
        find = _finder(shared.value)
        for b in pieces(batches):
            held = np.zeros(b.num_rows, bool)
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], ["i", "text"])
            for rows, texts in _chunks([numbered]):
                for d, *_ in find(texts):
                    held[rows[d]] = True
            yield b.filter(pa.array(~held)) if held.any() else b

    return run


RESULT = "doc_id long, item_id long, score double, start_word long, end_word long"


def _plans(docs: DataFrame, benchmark: DataFrame, threshold: float, least: int, slice_words: int):
    """What the executors need to find the items, one broadcast a slice of the benchmark."""
    spark = docs.sparkSession
    pairs = docs.select("doc_id", "text")
    words = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(words)).first()[0] or 0
    slices = max(1, -(-total // slice_words))
    for part in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).collect()  # at most about slice_words words
        rows = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows)
        if not rows:
            continue
        of, h = word_hashes([t.lower().encode("utf-8", "replace") for _, t in rows], LETTERS)
        begin = np.searchsorted(of, np.arange(len(rows) + 1))
        length = np.diff(begin)
        own = np.unique(h[(length >= least)[of]])
        counts = np.zeros(len(own), np.int64)
        if len(own):  # 16 bytes a different word of the items
            found = pairs.mapInArrow(tidy(_count(spark.sparkContext.broadcast(own))), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
            counts[np.searchsorted(own, found["w"].to_numpy().view(np.uint64))] = found["n"].to_numpy()
        share = np.where(length < WHOLE, 1.0, threshold).tolist()
        least_score = np.array([next(x for x in range(int(MATCH * n * s), MATCH * n + 2) if x > 0 and (x >= MATCH * n or x / (MATCH * n) >= s)) if n else 1 for n, s in zip(length.tolist(), share)])
        need, rare = np.zeros(len(rows), np.int64), []
        for i in np.nonzero(length >= least)[0].tolist():
            n, t = counts[np.searchsorted(own, h[begin[i] : begin[i + 1]])], int(least_score[i])
            chosen = choose_seeds(n)
            more = np.setdiff1d(np.argsort(n, kind="stable"), chosen, assume_unique=True)[: max(0, len(n) + 2 - t - len(chosen))]
            chosen = np.concatenate((chosen, more))  # so many that an alignment needs a seed
            need[i] = t - 1 - (len(n) - len(chosen))
            rare.append(begin[i] + chosen)
        rare = np.concatenate(rare) if rare else np.zeros(0, np.int64)
        place, g = grams(h, of)
        long_enough = (length >= least)[of[place]]
        place, g = place[long_enough], g[long_enough]
        # seed 2 j is word j of the items, 2 j + 1 the pair that begins there
        plan = ([_postings(h[rare], 2 * rare), _postings(g, 2 * place + 1)], np.repeat(of, 2), np.maximum(3 * length - least_score, 1), need, least_score, np.array([i for i, _ in rows], np.int64), h, begin)
        yield spark.sparkContext.broadcast(plan)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = 1, slice_words: int = SLICE) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): documents that hold an edited copy of an item."""
    pairs, out = docs.select("doc_id", "text"), None
    for plan in _plans(docs, benchmark, threshold, least, slice_words):
        part = pairs.mapInArrow(tidy(_match(plan)), RESULT)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = WHOLE, slice_words: int = SLICE) -> DataFrame:
    """The rows whose texts hold no benchmark item; every row is judged by its own text, whatever its doc_id."""
    out = docs
    for plan in _plans(docs, benchmark, threshold, least, slice_words):
        out = out.mapInArrow(tidy(_clean(plan, docs.columns.index("text"))), docs.schema)
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
