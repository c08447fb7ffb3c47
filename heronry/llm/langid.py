"""Language of words and documents by a linear-chain conditional random field.

Words are runs of letters. A word's features are its byte n-grams with the word boundary (two to four bytes, so
affixes are among them) and the word itself (the lexicon), hashed into tables of fixed size. Emission and
transition weights are learned together by gradient steps on the conditional likelihood, over sequences spliced
from passages of several languages, so that transitions know how rarely a writer switches. Forward-backward
gives each word's label probabilities in whole texts of any length; a document's language is the one with the
largest mean probability, which is its score.

The model is fitted on a bounded sample: per language ``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS`` characters
of each, those with the smallest hash of doc_id. Prediction reads every whole text.

Defined cases: a null text or one without letters is ``und`` with score 0; so is everything where nothing can be
learned (no labelled row); equal scores go to the smaller language; repeated rows get equal rows; a null doc_id
is never learned from and not held out; texts of any length go in pieces whose states are carried over; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import pieces, tidy

#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_CHARS, PASSAGES = 600, 1500, 5
#: log2 of the entries of the n-gram and word tables.
TABLE_BITS = 16
#: Characters that are labelled at once; a text of more than two of these goes in pieces.
CHUNK = 1 << 17
#: Steps of a sub-chain in forward-backward.
STEPS = 48

SPACE = 32
LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else SPACE for b in range(256))


class Features:
    """Words of a byte stream and the table entries of their features."""

    def __init__(self, data: bytes):
        x = np.frombuffer(b" " + data + b"    ", np.uint8)
        gap = x == SPACE
        edge = np.nonzero(gap[1:] != gap[:-1])[0] + 1
        self.start, self.end = edge[0::2], edge[1::2]  # the stream begins and ends with a space
        n = len(x) - 3
        a, b, c, d = (x[k : n + k].astype(np.uint32) for k in range(4))
        size = 1 << TABLE_BITS
        shift = np.uint32(32 - TABLE_BITS)
        two = a << np.uint32(8) | b
        three = (two << np.uint32(8) | c) * np.uint32(0x9E3779B1) >> shift
        four = ((two << np.uint32(16) | c << np.uint32(8) | d) * np.uint32(0x85EBCA6B)) >> shift
        self.grams = [two & np.uint32(size - 1), three + np.uint32(size), four + np.uint32(2 * size)]
        self.valid = [None, ~gap[1 : n + 1], ~(gap[1 : n + 1] | gap[2 : n + 2])]
        # a word's hash: a polynomial over its bytes, from prefix sums
        base = np.full(len(x) + 1, 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        power = np.multiply.accumulate(base)
        base[1:] = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        h = (total[self.end] - total[self.start]) * np.multiply.accumulate(base)[self.start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.word = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64) + 3 * size

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """[words, labels] sums of feature weights."""
        g = weights[self.grams[0]]
        for grams, valid in zip(self.grams[1:], self.valid[1:]):
            g += weights[grams] * valid[:, None]
        total = np.zeros((len(g) + 1, g.shape[1]))
        np.cumsum(g, axis=0, dtype=np.float64, out=total[1:])
        return total[self.end] - total[self.start - 1] + weights[self.word]

    def gradient(self, by_word: np.ndarray, entries: int) -> np.ndarray:
        """[entries, labels] sums of a value of each word over its features."""
        out = np.empty((entries, by_word.shape[1]))
        n = self.end - self.start + 1
        at = np.repeat(self.start - 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word = np.repeat(np.arange(len(n)), n)
        index = [self.grams[0][at]]
        of = [word]
        for grams, valid in zip(self.grams[1:], self.valid[1:]):
            ok = valid[at]
            index.append(grams[at[ok]])
            of.append(word[ok])
        index, of = np.concatenate([*index, self.word]), np.concatenate([*of, np.arange(len(n))])
        for k in range(by_word.shape[1]):
            out[:, k] = np.bincount(index, by_word[of, k], entries)
        return out


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, filtered: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Label probabilities of words by forward-backward; ``first`` marks words that begin a text.

    A piece of a longer text takes ``before``, the state after the words ahead of it, and ``after``, what the words
    behind it say of its last one.

    The chain of all texts is cut into sub-chains that are advanced together: their transfer matrices come first,
    then the states at the cuts, then the states inside. ``filtered``: also the probabilities given only the
    words up to each."""
    n, k = emission.shape
    if not n:
        return (emission, emission) if filtered else emission
    t = STEPS
    c = -(-n // t)
    e = np.ones((c * t, k))
    e[:n] = np.exp(emission - emission.max(1, keepdims=True)) + 1e-30
    if after is not None:
        e[n - 1] *= after
    e = e.reshape(c, t, k)
    new = np.ones(c * t, bool)
    new[:n] = first
    new = new.reshape(c, t)
    a, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    product = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    for i in range(t):
        nxt = (product.reshape(-1, k) @ a).reshape(c, k, k)
        if new[:, i].any():
            nxt = np.where(new[:, i, None, None], product.sum(2, keepdims=True) * s, nxt)
        product = nxt * e[:, i, None, :]
        product /= product.sum((1, 2), keepdims=True)
    into, out = np.empty((c, k)), np.empty((c, k))
    v = np.full(k, 1 / k) if before is None else before
    for i in range(c):
        into[i] = v
        v = v @ product[i]
        v /= v.sum()
    v = np.ones(k)
    for i in range(c - 1, -1, -1):
        out[i] = v
        v = product[i] @ v
        v /= v.sum()
    alpha = np.empty((t, c, k))
    v = into
    for i in range(t):
        v = np.where(new[:, i, None], s, v @ a) * e[:, i]
        v = v / v.sum(1, keepdims=True)
        alpha[i] = v
    forward = alpha.transpose(1, 0, 2).reshape(-1, k)[:n].copy() if filtered else None
    v = out
    for i in range(t - 1, -1, -1):
        alpha[i] *= v
        v = v * e[:, i]
        v = np.where(new[:, i, None], 1.0, v @ a.T)
        v = v / v.sum(1, keepdims=True)
    alpha /= alpha.sum(2, keepdims=True)
    p = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
    return (p, forward) if filtered else p


class Model:
    """Labels, feature weights, transitions and start weights."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((4 << TABLE_BITS, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], Features]:
        """(text of each word, probabilities [words, labels], bytes of the texts, features)."""
        data = [t.lower().encode("utf-8", "replace").translate(LETTERS) for t in texts]
        f = Features(b" ".join(data))
        ends = 1 + np.cumsum([len(d) + 1 for d in data])
        of = np.searchsorted(ends, f.start, "right")
        first = np.concatenate(([True], of[1:] != of[:-1]))[: len(of)]
        return of, marginals(f.emissions(self.weights), first, self.trans, self.start), data, f

    def long_words(self, data: bytes):
        """Probabilities of the words of one long text, piece by piece from its end, with the features of each piece.

        States are carried over the cuts, at spaces: forward in a first run that keeps one state a cut, backward in a
        second one. The result is that of the whole chain; memory grows with the piece and the number of cuts."""
        cuts = [0]
        while len(data) - cuts[-1] > CHUNK:
            at = data.rfind(b" ", cuts[-1] + 1, cuts[-1] + CHUNK)
            if at < 0:
                at = data.find(b" ", cuts[-1] + CHUNK)
            if at < 0:
                break
            cuts.append(at)
        cuts.append(len(data))
        parts = [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if data[lo:hi].strip()]
        states: list[np.ndarray | None] = [None]

        def emissions(lo, hi):
            f = Features(data[lo:hi])
            first = np.zeros(len(f.start), bool)
            first[0] = lo == parts[0][0]
            return f, f.emissions(self.weights), first

        for lo, hi in parts[:-1]:
            _, e, first = emissions(lo, hi)
            states.append(marginals(e, first, self.trans, self.start, True, before=states[-1])[1][-1])
        after = None
        for (lo, hi), before in zip(parts[::-1], states[::-1]):
            f, e, first = emissions(lo, hi)
            p, forward = marginals(e, first, self.trans, self.start, True, before=before, after=after)
            yield f, p
            head = np.exp(e[0] - e[0].max()) + 1e-30
            if len(e) == 1 and after is not None:
                head = head * after
            after = np.exp(self.trans - self.trans.max()) @ (head * (p[0] / np.maximum(forward[0], 1e-300)))
            after = after / after.max()

    def seen(self) -> np.ndarray:
        """Which table entries training met."""
        return self.weights.any(1)

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, share of the four-byte grams that training met) of each text."""
        data = [t.lower().encode("utf-8", "replace").translate(LETTERS) for t in texts]
        k = len(self.labels)
        total, n, met, all_ = np.zeros((len(texts), k)), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        seen = self.seen()

        def add(of, p, f, rows):
            for j in range(k):
                total[:, j] += np.bincount(of, p[:, j], len(texts))
            n[:] += np.bincount(of, minlength=len(texts))
            at = np.nonzero(f.valid[2])[0]
            text = rows(at)
            all_[:] += np.bincount(text, minlength=len(texts))
            met[:] += np.bincount(text, seen[f.grams[2][at]], len(texts))

        short = [i for i, d in enumerate(data) if len(d) <= 2 * CHUNK]
        if short:
            f = Features(b" ".join(data[i] for i in short))
            ends, index = 1 + np.cumsum([len(data[i]) + 1 for i in short]), np.array(short)
            of = np.searchsorted(ends, f.start, "right")
            first = np.concatenate(([True], of[1:] != of[:-1]))[: len(of)]
            p = marginals(f.emissions(self.weights), first, self.trans, self.start)
            if len(of):
                add(index[of], p, f, lambda at: index[np.minimum(np.searchsorted(ends, at, "right"), len(short) - 1)])
        for i, d in enumerate(data):
            if len(d) > 2 * CHUNK and d.strip():
                for f, p in self.long_words(d):
                    add(np.full(len(p), i), p, f, lambda at, i=i: np.full(len(at), i))
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        known = np.where(all_ > 0, met / np.maximum(all_, 1), 1.0)
        return [(self.labels[b], min(1.0, float(m[b])), float(s)) if c else ("und", 0.0, 0.0) for b, m, c, s in zip(best, mean, n, known)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(rows: list[tuple[str, str]], epochs: int = 4, seed: int = 5, rate: float = 0.3) -> Model | None:
    """A model from (text, label) rows; None without any."""
    labels = sorted({label for _, label in rows})
    if not labels:
        return None
    model, rng = Model(labels), np.random.default_rng(seed)
    k = len(labels)
    passages = []
    for text, label in rows:
        w = text.lower().encode("utf-8", "replace").translate(LETTERS).split()
        while w:
            n = int(rng.integers(10, 80))
            passages.append((b" ".join(w[:n]), labels.index(label)))
            w = w[n:]
    g2 = np.full(model.weights.shape, 1e-2)
    t2, s2 = np.full((k, k), 1e-2), np.full(k, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(passages))
        for at in range(0, len(order), 512):
            batch = [passages[i] for i in order[at : at + 512]]
            f = Features(b" ".join(p for p, _ in batch))
            y = np.repeat([label for _, label in batch], [p.count(b" ") + 1 for p, _ in batch])
            first = np.zeros(len(y), bool)
            first[::160] = True
            p, forward = marginals(f.emissions(model.weights), first, model.trans, model.start, filtered=True)
            if k == 1:  # a lone label has no gradient; what training met is marked all the same
                for grams, valid in zip(f.grams, f.valid):
                    model.weights[grams if valid is None else grams[valid]] = 1e-6
            inner = ~first[1:]
            joint = forward[:-1, :, None] * np.exp(model.trans)
            joint = (joint / joint.sum(1, keepdims=True) * p[1:, None, :])[inner].sum(0)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
            target = np.eye(k)[y]
            for w, acc, grad in (
                (model.weights, g2, f.gradient((target - p) / 16, len(model.weights))),
                (model.trans, t2, (seen - joint) / 16),
                (model.start, s2, (target - p)[first].sum(0) / 16),
            ):
                acc += grad * grad
                w += (rate * grad / np.sqrt(acc)).astype(w.dtype)
    return model


def passages(text: str) -> Column:
    """SAMPLE_CHARS characters of a text at most: PASSAGES stretches dealt evenly from its start to its end, without the words
    that their ends cut."""
    size, n = SAMPLE_CHARS // PASSAGES, F.length(text)
    whole = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda k: F.substring(text, (F.floor(k * (n - size) / (PASSAGES - 1)) + 1).cast("int"), F.lit(size)))
    parts = F.transform(whole, lambda x, k: F.regexp_replace(F.when(k > 0, F.regexp_replace(x, r"^\S*\s", "")).otherwise(x), r"\s\S*$", ""))
    return F.when(n <= SAMPLE_CHARS, F.col(text)).otherwise(F.array_join(parts, " "))


def fit(docs: DataFrame) -> Model | None:
    """Learns from documents with a language whose crc32(doc_id) mod 5 is not 0, within the sample's bounds."""
    pool = docs.where("lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "lang")
    # the smallest hashes lie under this share of the range, but for a vanishing chance: only those are shuffled
    share = pool.groupBy("lang").agg((F.lit(4.0 * SAMPLE_DOCS) / F.count("*")).alias("share"))
    near = pool.join(share, "lang").withColumn("h", F.xxhash64("doc_id")).where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "doc_id")
    ids = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE_DOCS).select("doc_id", "lang")
    # at most SAMPLE_DOCS rows a language
    rows = docs.where("text is not null").select("doc_id", "lang", passages("text").alias("text")).join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    got = sorted((r["doc_id"], r["text"], r["lang"]) for r in rows.collect())
    return train([(t, label) for _, t, label in got if has_letter(t)])


def identify(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score", known: str | None = None, inside: str | None = None) -> DataFrame:
    """The columns of docs, a language and its score: only the text is read for the prediction.

    Columns of docs that have these names are replaced. ``known`` adds the share of a text's four-byte grams that
    training met: low for a language that none of the labels stands for. ``inside`` names a struct column that holds
    the text, so that whole rows go to Python and back without a second copy of it."""
    # plain arrays of a fixed size; the class travels with the function
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.labels, model.weights, model.trans, model.start))
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (lang, score, known)))
    names = docs.columns
    at = names.index(inside or "text")

    def run(batches):
        m = None
        if shared.value is not None:
            m = Model(shared.value[0])
            m.weights, m.trans, m.start = shared.value[1:]
        for b in pieces(batches, 1024):
            texts = b.column(at).field("text") if inside else b.column(at)
            pred, held, size = [("und", 0.0, 0.0)] * b.num_rows, [], 0

            def flush():
                if m is not None and held:
                    for (i, _), r in zip(held, m.predict([t for _, t in held])):
                        pred[i] = r
                held.clear()

            for i, t in enumerate(texts):
                t = t.as_py()
                if has_letter(t):
                    held.append((i, t))
                    size += len(t)
                    if size > CHUNK:
                        flush()
                        size = 0
            flush()
            made = [pa.array([p[0] for p in pred], pa.string()), *(pa.array([p[k] for p in pred], pa.float64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made[: 3 if known else 2]], [*names, lang, score, *([known] if known else [])])

    out = StructType([*docs.schema.fields, StructField(lang, StringType()), *(StructField(c, DoubleType()) for c in (score, known) if c)])
    return docs.mapInArrow(tidy(run), out)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")
