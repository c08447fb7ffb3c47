"""Cross-tokenizer alignment: token intervals of two tokenizers joined in DuckDB, pair counts merged in Spark."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Callable
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lists, materialize, pieces, read_table, tidy

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text that are aligned at once; a longer text goes alone.
AT_ONCE = 4 << 20
#: Stretches that are encoded at once, and kept with their alignment by a task: some 400 bytes each.
SLICE, KEPT = 4096, 400_000
#: Memory of DuckDB in a task; beyond it DuckDB spills to the task's own temporary folder.
DUCK_MEMORY = "300MB"
#: Pairs with their counts that are broadcast at most, some 100 bytes each in an executor; more are joined by a shuffle.
BROADCAST = 1 << 20
#: Characters that no tokenizer takes for white space. A space between two of them parts a text into stretches.
SOLID = "!-~¡-ɏ"
PARTS = re.compile(f"(?<=[{SOLID}]) (?=[{SOLID}])")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer: ``encode`` gives the ids of stretches, ``data`` the bytes of each id.

    ``parts`` says that no token crosses from a solid character into a space after it: then a text's tokens are those of
    its stretches in a row, and a stretch that comes again is encoded and aligned once."""

    def __init__(self, encode: Callable, data: list[bytes], parts: bool):
        self.encode, self.data, self.parts = encode, data, parts
        self.sizes = np.array([len(x) for x in data], np.int64)


def byte_level(path: str) -> Side:
    """Byte-level BPE from a JSON file; a space goes before each stretch. Its pattern lets a space begin a match, never go on
    with one, so stretches are apart."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    data = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        data[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    with open(path) as f:
        plan = json.load(f)
    before = plan.get("pre_tokenizer") or {}
    parts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not plan.get("normalizer")
    return Side(lambda texts: [x.ids for x in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], data, parts)


def pieces_of(path: str) -> Side:
    """Pieces from a model file, which puts a space before a text itself. If no piece holds a space after another character,
    nothing can be merged over that border, and stretches are apart."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    data = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(model.id_to_piece, ids))]
    return Side(lambda texts: model.encode(texts, num_threads=1), data, not any(re.search(rb"[^ ] ", x) for x in data))


@cache
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once in a worker."""
    return byte_level(a_path), pieces_of(b_path)


#: Tables a and b: lo and hi are bytes in the joined stretches, s is the stretch. A token begins inside exactly one token of
#: the other side; those that begin with it are taken from the first join only. Groups are numbered by the common ends before.
PAIRS = """INSERT INTO links SELECT s, pair, count(*) AS links FROM (
    SELECT a.s, a.id * $width + b.id AS pair FROM a ASOF JOIN b ON a.lo >= b.lo
    UNION ALL SELECT a.s, a.id * $width + b.id FROM b JOIN a ON b.lo > a.lo AND b.lo < a.hi) GROUP BY s, pair"""
GROUPS = """WITH e AS (SELECT a.hi FROM a JOIN b ON a.hi = b.hi),
    x AS (SELECT s, lo, id, coalesce(sum(CASE WHEN e.hi IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM {side} LEFT JOIN e ON {side}.hi = e.hi)
    SELECT s, lo, id, g FROM x ORDER BY lo"""
OF_ROWS = """SELECT r, pair, sum(times * links)::BIGINT AS links FROM held JOIN links USING (s) GROUP BY r, pair ORDER BY r, pair"""


def encoded(side: Side, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each stretch, their ids in a row, which stretches the tokens give back byte for byte)."""
    counts, flat, same = [], [], []
    for lo in range(0, len(names), SLICE):
        whole = [(" " + t).encode() for t in names[lo : lo + SLICE]]
        ids = side.encode(names[lo : lo + SLICE])
        counts.append(np.array([len(x) for x in ids], np.int64))
        flat.append(np.array(list(chain.from_iterable(ids)), np.int64))
        ends = np.concatenate([[0], np.cumsum(side.sizes[flat[-1]])])[np.cumsum(counts[-1])]
        fine = np.diff(ends, prepend=0) == np.array([len(w) for w in whole])
        if not (fine.all() and b"".join(map(side.data.__getitem__, flat[-1].tolist())) == b"".join(whole)):
            fine = np.array([w == b"".join(map(side.data.__getitem__, x)) for w, x in zip(whole, ids)])
        same.append(fine)
    return tuple(np.concatenate(x) for x in (counts, flat, same))


def intervals(counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keep: np.ndarray, first: int) -> pa.Table:
    """The tokens of the kept stretches, numbered from ``first``, as a table."""
    held = np.repeat(keep, counts)
    s, ids = np.repeat(np.arange(len(counts)) + first, counts)[held], ids[held]
    hi = np.cumsum(sizes[ids])
    return pa.table({"s": s, "id": ids, "lo": hi - sizes[ids], "hi": hi})


def listed(tokens: list[dict], first: int, n: int) -> list[str]:
    """The groups of n stretches as ids: commas inside, a bar between the sides, semicolons between groups."""
    s, g, ids = (np.concatenate([t[c] for t in tokens]) for c in ("s", "g", "id"))
    side = np.repeat([0, 1], [len(t["s"]) for t in tokens])
    order = np.lexsort((side, g))  # stable: in order of bytes within a side
    s, g, ids, side = s[order], g[order], ids[order], side[order]
    after = np.where(g[1:] != g[:-1], 2, side[1:] != side[:-1])
    text = [x + y for x, y in zip(map(str, ids.tolist()), map(",|;".__getitem__, after.tolist()))]
    text += map(str, ids[-1:].tolist())
    ends = np.searchsorted(s, np.arange(first, first + n + 1)).tolist()
    return ["".join(text[lo:hi]).rstrip(";") for lo, hi in zip(ends[:-1], ends[1:])]


class Aligner:
    """Aligns texts in DuckDB. A stretch's alignment is kept for the texts to come, up to ``KEPT`` of them."""

    def __init__(self, duck, a: Side, b: Side):
        self.duck, self.a, self.b = duck, a, b
        self.clear()

    def clear(self) -> None:
        self.stretches: dict[str, int] = {}
        self.told: list[str] = []
        self.same = np.zeros(0, bool)
        self.each = {c: np.zeros(0, np.int64) for c in ("n_a", "n_b", "n_groups")}
        self.duck.execute("CREATE OR REPLACE TEMP TABLE links (s BIGINT, pair BIGINT, links BIGINT)")

    def learn(self, names: list[str]) -> None:
        """Align stretches that are new."""
        first, n = len(self.same), len(names)
        sides = [encoded(side, names) for side in (self.a, self.b)]
        # a stretch that loses something has no tokens, and no text has it
        same = sides[0][2] & sides[1][2]
        for name, side, (counts, ids, _) in zip("ab", (self.a, self.b), sides):
            self.duck.register(name, intervals(counts, ids, side.sizes, same, first))
        self.duck.execute(PAIRS, {"width": len(self.b.data)})
        tokens = [self.duck.execute(GROUPS.format(side=side)).fetchnumpy() for side in "ab"]
        heads = tokens[0]["g"] != np.append(-1, tokens[0]["g"][:-1])
        for c, s, of in (("n_a", tokens[0]["s"], None), ("n_b", tokens[1]["s"], None), ("n_groups", tokens[0]["s"], heads)):
            self.each[c] = np.append(self.each[c], np.bincount(s - first, of, n).astype(np.int64))
        self.told += listed(tokens, first, n)
        self.same = np.append(self.same, same)

    def align(self, texts: list[str | None]) -> dict:
        """Counts and digests of the texts, the distinct pairs of each with their links, and how many texts hold a pair."""
        if len(self.stretches) > KEPT:
            self.clear()
        known, n = self.stretches, len(texts)
        parts = PARTS.split if self.a.parts and self.b.parts else lambda t: [t]
        held = [[known.setdefault(x, len(known)) for x in parts(t)] if t else [] for t in texts]
        if len(known) > len(self.same):
            self.learn(list(islice(known, len(self.same), None)))
        if not self.same.all():
            held = [x if all(map(self.same.__getitem__, x)) else [] for x in held]
        flat = np.array(list(chain.from_iterable(held)), np.int64)
        rows = np.repeat(np.arange(n), [len(x) for x in held])
        both, times = np.unique(rows * max(len(known), 1) + flat, return_counts=True)
        self.duck.register("held", pa.table({"r": both // max(len(known), 1), "s": both % max(len(known), 1), "times": times}))
        pairs = self.duck.execute(OF_ROWS).fetchnumpy()
        out = {c: np.bincount(rows, of[flat], n).astype(np.int64) for c, of in self.each.items()}
        out["groups_sha256"] = [hashlib.sha256(";".join(map(self.told.__getitem__, x)).encode()).hexdigest() if x else "" for x in held]
        out["n_links"] = np.bincount(pairs["r"], pairs["links"], n).astype(np.int64)
        out |= {"sizes": np.bincount(pairs["r"], minlength=n), "pairs": pairs["pair"], "links": pairs["links"]}
        out["counted"] = np.unique(pairs["pair"], return_counts=True)
        return out


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: A row of a document holds its pairs and their links; a row without (text false) holds pairs and how many documents have them.
SCHEMA = "text boolean, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, pairs array<long>, links array<long>"


def _aligned(a_path: str, b_path: str):
    names = ["text", "doc_id", *COUNTS, "groups_sha256", "pairs", "links"]

    def run(batches):
        import duckdb

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = sides(a_path, b_path)
        spill = tempfile.mkdtemp()
        duck = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": spill, "preserve_insertion_order": False})
        aligner = Aligner(duck, a, b)

        def told(ids, texts):
            x = aligner.align(texts)
            n = len(ids)
            columns = [pa.array([True] * n), pa.array(ids, pa.int64()), *(pa.array(x[c]) for c in COUNTS), pa.array(x["groups_sha256"]), lists(x["sizes"], x["pairs"]), lists(x["sizes"], x["links"])]
            yield pa.RecordBatch.from_arrays(columns, names)
            pair, docs = x["counted"]
            columns = [pa.array([False]), *(pa.nulls(1, pa.int64()) for _ in ["doc_id", *COUNTS]), pa.nulls(1, pa.string()), *(lists(np.array([len(pair)]), v) for v in (pair, docs))]
            yield pa.RecordBatch.from_arrays(columns, names)

        try:
            ids, texts, size = [], [], 0
            for batch in pieces(batches):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    more = t.as_buffer().size if t.is_valid else 0
                    if texts and size + more > AT_ONCE:
                        yield from told(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(i)
                    texts.append(t.as_py())
                    size += more
            if texts:
                yield from told(ids, texts)
        finally:
            duck.close()
            shutil.rmtree(spill, ignore_errors=True)

    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Aligns the tokens that two tokenizers make of every row of ``docs`` (doc_id, text): one row each.

    n_a, n_b: tokens; n_groups: stretches between bytes where tokens of both end; n_links: pairs of tokens whose bytes
    overlap; groups_sha256: digest of all groups' ids in order. How many rows hold an id pair linked is counted over all
    rows: count_sum adds that count over a row's links, n_best is the number of links whose count is the highest of their
    first id. The tokenizers' files must lie at the same paths on every executor.

    Each task encodes and aligns ``AT_ONCE`` bytes of text in DuckDB (interval tables, ASOF and range joins, window sums)
    and gives its pairs with partial counts, which Spark adds up. A row's pairs are kept in a written table and joined to
    the counts, which are broadcast up to ``BROADCAST`` pairs, counted first, and joined by a shuffle beyond.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and an empty
    digest. Rows of equal or null doc_id are rows of their own, and count each. Other columns are ignored. A text goes
    whole to one task, with some 200 bytes of memory a word. An empty table gives an empty result."""
    found = docs.select("doc_id", "text").mapInArrow(tidy(_aligned(a_path, b_path)), SCHEMA)
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    rows, partial = found.where("text"), found.where("not text")
    width = len(sides(a_path, b_path)[1].data)
    counts = partial.select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("docs"))
    counts = materialize(counts, "counts")
    top = F.max("docs").over(Window.partitionBy(F.expr(f"pair div {width}")))
    counts = materialize(counts.select("pair", "docs", (F.col("docs") == top).alias("best")), "counts")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    joined = each.join(F.broadcast(counts) if counts.count() <= BROADCAST else counts, "pair")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("links")).alias("count_sum"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.join(sums, "row", "left").select("doc_id", *COUNTS, *zero, "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
