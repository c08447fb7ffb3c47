"""Exact substring deduplication over UTF-8 bytes by suffix order and longest previous factors.

Every string of ``length`` bytes has one anchor: the leftmost smallest hash among the short grams inside it,
which is a property of the string alone, so equal strings have their anchors at the same place. An occurrence
of an anchor stands for the run of strings that it is the anchor of (its context). Only hashes of anchors and
contexts are shuffled:

1. anchors that occur once hold no repeated string and are dropped;
2. contexts that occur more than once are repeated as a whole;
3. contexts that differ but share an anchor are compared byte by byte: bounded sets of them are put in suffix
   order (prefix doubling), where a suffix's previous smaller position with ``length`` bytes in common is an
   earlier match - the longest previous factor reaches the threshold - and its next smaller one the match of
   that one. Anchors with very many different contexts are settled by grouping their strings instead.

Documents come in order of doc_id. ``keep="first"`` removes bytes covered by a string that started earlier;
``keep="none"`` removes every copy. Strings are judged on the input, never on what is left.

Defined cases: null text counts as empty; texts shorter than ``length`` bytes keep everything; repeated rows
(equal doc_id and text) are copies of each other, so ``keep="none"`` removes both and ``keep="first"`` treats
them alike; a null doc_id is a document of its own text, and texts of one doc_id are told apart
by 87 bits of their hash; runs of one byte and periodic texts match themselves
at the next place; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import materialize, pieces, tidy

LENGTH, GRAM = 200, 32
#: Bytes that are hashed at once; a longer text goes in pieces.
CHUNK = 1 << 18
#: Anchors with more different contexts than this are settled by grouping their strings.
MANY = 4096


class Anchors:
    """Finds the anchors of chunks of texts."""

    def __init__(self, length: int = LENGTH):
        # an anchor stands for 251 strings at most
        self.length, self.gram = length, max(length - 250, min(GRAM, max(1, length // 2)))
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            inv = pow(self.base, -1, 1 << 64)
            out = []
            for b in (self.base, inv):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.power, self.inverse = out
        return self.power[:n], self.inverse[:n]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text index, start, strings, anchor hash, context hash) of texts of at least ``length`` bytes each."""
        data = b"".join(texts)
        x = np.frombuffer(data, np.uint8)
        n, k = len(x), self.gram
        power, inverse = self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        g = (total[k:] - total[:-k]) * inverse[: n - k + 1]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xC2B2AE3D27D4EB4F)
        mask = np.uint64((1 << n.bit_length()) - 1)
        v = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
        w = self.length - k + 1
        m = len(v) - w + 1
        pad = np.full(-len(v) % w, ~np.uint64(0), np.uint64)
        rows = np.concatenate((v, pad)).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & mask).astype(np.int64)
        ends = np.cumsum([len(t) for t in texts])
        across = np.zeros(n + 1, np.int8)
        across[ends - self.length + 1] += 1
        across[ends] -= 1
        starts = np.nonzero(np.cumsum(across[:m], dtype=np.int8) == 0)[0]
        at = at[starts]
        first = np.nonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(starts) != 1))))[0]
        count = np.diff(np.append(first, len(starts)))
        lo, anchor = starts[first], at[first]
        d, view = xxhash.xxh3_64_intdigest, memoryview(data)
        ctx = np.fromiter((d(view[a:b], s) for a, b, s in zip(lo.tolist(), (lo + count + self.length - 1).tolist(), (anchor - lo).tolist())), np.uint64, len(lo))
        doc = np.searchsorted(ends, lo, "right")
        return doc, lo - (ends - [len(t) for t in texts])[doc], count, g[anchor].view(np.int64), ctx.view(np.int64)


def tag():
    """Tells texts of one doc_id, or of none, apart: 64 bits here, 23 more travel beside the places."""
    return F.xxhash64("text").alias("tag")


def more_tag():
    return F.xxhash64(F.lit(1), F.col("text")).bitwiseAND(F.lit(0x7FFFFF)).cast("int").alias("more_tag")


def _occurrences(length: int):
    def run(batches):
        find = Anchors(length)

        def flush(held):
            doc, lo, count, g, c = find([h[1] for h in held])
            lo = lo + np.array([h[4] for h in held], np.int64)[doc]
            ids = pa.array([h[0] for h in held], pa.int64()).take(pa.array(doc))
            tags = np.array([h[2] for h in held], np.int64)[doc]
            q = np.array([h[3] for h in held], np.int64)[doc] << 39 | lo << 8 | count  # a context holds less than 256 strings
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), ids, pa.array(tags), pa.array(q)], ["g", "c", "doc", "tag", "q"])

        held, size = [], 0
        for b in batches:
            for i, t, k, m in zip(*b.columns):
                t = (t.as_py() or "").encode("utf-8", "replace")
                # a long text goes in pieces by where its strings start: an anchor is a property of the string alone
                for at in range(0, len(t) - length + 1, CHUNK):
                    piece = t[at : at + CHUNK + length - 1]
                    if held and size + len(piece) > CHUNK:
                        yield flush(held)
                        held, size = [], 0
                    held.append((i.as_py(), piece, k.as_py(), m.as_py(), at))
                    size += len(piece)
        if held:
            yield flush(held)

    return run


def suffix_classes(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes of the texts in suffix order: (text, start, class), equal strings in one class.

    Prefix doubling: ranks by 8, 16, 32 ... bytes, then two overlapping ranks give the order by ``length``.
    Within a class the order is the text order, so the entry before is the previous smaller position."""
    x = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes

    def inside(h):
        """Positions where h bytes fit in the text."""
        n = np.maximum(sizes - h + 1, 0)
        return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())

    h = 1
    rank = x.astype(np.int64)
    step = [2, 4]
    wide = np.zeros(len(x), np.uint64)
    if length >= 8:
        for k in range(8):
            wide[:-8] = (wide[:-8] << np.uint64(8)) | x[k : len(x) - 8 + k]
        pos = inside(8)
        rank = np.zeros(len(x), np.int64)
        rank[pos] = np.unique(wide[pos], return_inverse=True)[1]
        h, step = 8, []
    while h < length:
        shift = min(h, length - h)
        pos = inside(h + shift)
        key = rank[pos] * np.int64(len(x)) + rank[pos + shift] if h >= 8 else rank[pos] * np.int64(1 << 32) + rank[pos + shift]
        rank = np.zeros(len(x), np.int64)
        rank[pos] = np.unique(key, return_inverse=True)[1]
        h += shift
    pos = inside(length)
    order = pos[np.argsort(rank[pos], kind="stable")]
    text = np.searchsorted(begin, order, "right") - 1
    while len(text) and (sizes[text] == 0).any():  # empty texts share their place with the next one
        text = text + (sizes[text] == 0)
    return text, order - begin[text], rank[order]


def earlier_and_later(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an entry of the suffix order has an earlier match, and whether a later one."""
    same = cls[1:] == cls[:-1]
    return np.concatenate(([False], same))[: len(cls)], np.concatenate((same, [False]))[: len(cls)]


def _runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers: first, count."""
    first = np.nonzero(np.concatenate(([True], np.diff(start) != 1)))[0]
    return start[first], np.diff(np.append(first, len(start)))


RESOLVED = "doc long, tag long, more_tag int, p int, n int"


def _resolve(length: int, keep: str):
    """Runs of repeated strings among contexts (g, doc, tag, more_tag, p, b), sorted by (g, doc, tag, more_tag, p)."""

    def run(batches):
        def settle(rows):
            text, start, cls = suffix_classes([r[5] for r in rows], length)
            early, late = earlier_and_later(cls)
            hit = early if keep == "first" else early | late
            text, start = text[hit], start[hit]
            order = np.lexsort((start, text))
            text, start = text[order], start[order]
            cut = np.nonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(start) != 1))))[0] if len(text) else np.zeros(0, np.int64)
            n = np.diff(np.append(cut, len(text)))
            own = text[cut].tolist()
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in own], pa.int64()), pa.array([rows[i][2] for i in own], pa.int64()), pa.array([rows[i][3] for i in own], pa.int32()), pa.array([rows[i][4] + s for i, s in zip(own, start[cut].tolist())], pa.int32()), pa.array(n.astype(np.int32))], ["doc", "tag", "more_tag", "p", "n"])

        held, size = [], 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("g", "doc", "tag", "more_tag", "p", "b"))):
                if size > CHUNK and held[-1][0] != r[0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield settle(held)

    return run


def _strings(length: int):
    """A row for each string of a context: (g, s1, s2, doc, tag, more_tag, p)."""

    def run(batches):
        for b in batches:
            for g, doc, t, m, p, ctx in zip(*(b.column(c).to_pylist() for c in ("g", "doc", "tag", "more_tag", "p", "b"))):
                n = len(ctx) - length + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(ctx[i : i + length]) for i in range(n)), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int64)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([doc] * n, pa.int64()), pa.array(np.full(n, t, np.int64)), pa.array(np.full(n, m, np.int32)), pa.array(np.arange(p, p + n, dtype=np.int32))], ["g", "s1", "s2", "doc", "tag", "more_tag", "p"])

    return run


def _cover(n: int, starts, counts, length: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    starts = np.asarray(starts, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + np.asarray(counts, np.int64) + length - 1, n), -1)
    return np.cumsum(d[:-1]) > 0


def _finish(data: bytes, cover: np.ndarray | None) -> tuple[bytes, int, int]:
    """(what is left, removed bytes, removed runs)."""
    if cover is None or not cover.any():
        return data, 0, 0
    x = np.frombuffer(data, np.uint8)
    return x[~cover].tobytes(), int(cover.sum()), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())


def _text(data: bytes, cover: np.ndarray | None) -> str:
    """What is left as a text; characters that a cut goes through stay whole."""
    if cover is not None and cover.any():
        x = np.frombuffer(data, np.uint8)
        lead = np.nonzero((x & 0xC0) != 0x80)[0]
        char = np.searchsorted(lead, np.arange(len(x)), "right") - 1
        kept = np.zeros(len(lead), bool)
        np.logical_or.at(kept, char, ~cover)
        data = x[kept[char]].tobytes()
    return data.decode("utf-8", "replace")


def unpack(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _packed(extra: list[str]):
    """Texts as compressed bytes: half of what the shuffle would write of them. Null stays null."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches):
            data = [None if (t := x.as_py()) is None else z.compress(t.encode("utf-8", "replace")) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary()), b.column("tag"), b.column("more_tag"), *(b.column(c) for c in extra)], ["doc_id", "data", "tag", "more_tag", *extra])

    return run


SHIP = "array<struct<g: long, p: int, b: binary, many: boolean>>"
FIRST = f"doc_id long, tag long, more_tag int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, data binary, starts array<int>, counts array<int>, ship {SHIP}"


def _first_pass(length: int, texts: bool, extra: list[str]):
    """Finishes documents whose repeated strings are all known; the others pass on, with the contexts to compare."""

    def run(batches):
        for b in pieces(batches):
            out = []
            for i, packed, tg, mt, rows in zip(b.column("doc_id"), b.column("data"), b.column("tag"), b.column("more_tag"), b.column("rows")):
                packed = packed.as_py()
                data = unpack(packed)
                rows = rows.as_py() or []
                full = [(r["p"], r["n"]) for r in rows if r["full"]]
                starts, counts = [r[0] for r in full], [r[1] for r in full]
                ship = [{"g": r["g"], "p": r["p"], "b": data[r["p"] : r["p"] + r["n"] + length - 1], "many": r["many"]} for r in rows if r["ship"]]
                row = {"doc_id": i.as_py(), "tag": tg.as_py(), "more_tag": mt.as_py(), "n_bytes": len(data), "ship": ship}
                if any(r["open"] for r in rows):
                    row |= {"data": packed, "starts": starts, "counts": counts}
                else:
                    cover = _cover(len(data), starts, counts, length) if full else None
                    left, removed, spans = _finish(data, cover)
                    row |= {"n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest()}
                    if texts:
                        row["text"] = None if packed is None else _text(data, cover)
                out.append(row)
            own = pa.RecordBatch.from_pylist(out, schema=_FIRST_ARROW)
            yield pa.RecordBatch.from_arrays([*own.columns, *(b.column(c) for c in extra)], [*own.schema.names, *extra])

    return run


_FIRST_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("tag", pa.int64()), ("more_tag", pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("data", pa.binary()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ship", pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int32()), ("b", pa.binary()), ("many", pa.bool_())])))]
)
LAST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _last_pass(length: int, texts: bool, extra: list[str]):
    def run(batches):
        for b in pieces(batches):
            out = []
            for i, packed, starts, counts, more in zip(*(b.column(c) for c in ("doc_id", "data", "starts", "counts", "more"))):
                more, data = more.as_py() or [], unpack(packed.as_py())
                cover = _cover(len(data), starts.as_py() + [m["p"] for m in more], counts.as_py() + [m["n"] for m in more], length)
                left, removed, spans = _finish(data, cover)
                out.append((i.as_py(), len(data), removed, spans, hashlib.sha256(left).hexdigest(), _text(data, cover) if texts else None))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)), *(b.column(c) for c in extra)], [*names, *extra])

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, keep: str = "none", texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) for every row; text only with ``texts``, as are the
    other columns of ``docs``, under names that begin with x_."""
    others = [f for f in docs.schema.fields if texts and f.name not in ("doc_id", "text")]
    extra = [f"x_{f.name}" for f in others]
    quoted = [f"`{x}`" for x in extra]
    schema = lambda text: StructType([*StructType.fromDDL(text).fields, *(StructField(f"x_{f.name}", f.dataType) for f in others)])
    whole = docs.select("doc_id", "text", tag(), more_tag(), *(F.col(f"`{f.name}`").alias(f"x_{f.name}") for f in others))
    same = ("doc", "tag", "more_tag")  # what tells rows apart
    # rows equal in these have the same places: a set of them is gathered, and one copy of each context is compared
    repeated = not whole.groupBy("doc_id", "tag", "more_tag").count().where("count > 1").isEmpty()
    gathered = F.collect_set if repeated else F.collect_list
    occ = whole.select("doc_id", "text", "tag", "more_tag").mapInArrow(tidy(_occurrences(length)), "g long, c long, doc long, tag long, q long")
    # a table of its own: a join of two shuffles can split an anchor that very many documents share
    counted = whole.select("doc_id", "text", F.lit(0).alias("tag"), F.lit(0).alias("more_tag")).mapInArrow(tidy(_occurrences(length)), "g long, c long, doc long, tag long, q long")
    groups = materialize(counted.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "anchors")
    occ2 = materialize(occ.join(groups, "g"), "occ")
    classes = materialize(occ2.groupBy("g", "c").agg(F.count("*").alias("k"), F.min(F.struct("doc", "tag", "q")).alias("f")), "classes")
    different = classes.groupBy("g").agg((F.count("*") > 1).alias("multi"), (F.count("*") > MANY).alias("many"))
    rows = occ2.join(classes.join(different, "g"), ["g", "c"]).withColumn("own", F.struct("doc", "tag", "q").eqNullSafe(F.col("f")))
    if keep == "first":
        full, is_open = ~F.col("own"), F.col("own") & F.col("multi")
    else:
        full, is_open = F.col("k") > 1, (F.col("k") == 1) & F.col("multi")
    place = [F.shiftright("q", 39).cast("int").alias("more_tag"), F.shiftright("q", 8).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("p"), F.col("q").bitwiseAND(F.lit(0xFF)).cast("int").alias("n")]
    rows = rows.select("doc", "tag", *place, full.alias("full"), is_open.alias("open"), (F.col("own") & F.col("multi")).alias("ship"), "g", "many").where("full or ship")
    per = rows.groupBy(*same).agg(gathered(F.struct("p", "n", "full", "open", "ship", "g", "many")).alias("rows"))
    sent = whole.mapInArrow(tidy(_packed(extra)), schema("doc_id long, data binary, tag long, more_tag int"))
    mine = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag")) & (F.col(f"{a}.more_tag") == F.col(f"{b}.more_tag"))
    joined = sent.alias("s").join(per.alias("r"), mine("s", "r"), "left").select("s.doc_id", "s.data", "s.tag", "s.more_tag", "r.rows", *(f"s.{x}" for x in quoted))
    first = materialize(joined.mapInArrow(tidy(_first_pass(length, texts, extra)), schema(FIRST)), "pass1")
    ship = first.select(F.col("doc_id").alias("doc"), "tag", "more_tag", F.explode("ship").alias("s")).select("s.g", *same, "s.p", "s.b", "s.many")
    if repeated:
        ship = ship.dropDuplicates(["g", *same, "p"])
    few = ship.where("not many").drop("many").repartition("g").sortWithinPartitions("g", *same, "p").mapInArrow(tidy(_resolve(length, keep)), RESOLVED)
    strings = ship.where("many").drop("many").mapInArrow(tidy(_strings(length)), "g long, s1 long, s2 long, doc long, tag long, more_tag int, p int")
    found = strings.groupBy("g", "s1", "s2").agg(F.count("*").alias("k"), F.min(F.struct(*same, "p")).alias("f")).where("k > 1")
    again = strings.join(found, ["g", "s1", "s2"])
    if keep == "first":
        again = again.where(~F.struct(*same, "p").eqNullSafe(F.col("f")))
    resolved = few.union(again.select(*same, "p", F.lit(1).alias("n")))
    more = resolved.groupBy(*same).agg(F.collect_list(F.struct("p", "n")).alias("more"))
    pending = first.where("starts is not null").drop("ship").alias("s").join(more.alias("r"), mine("s", "r"), "left")
    last = pending.select("s.doc_id", "s.data", "s.starts", "s.counts", "r.more", *(f"s.{x}" for x in quoted)).mapInArrow(tidy(_last_pass(length, texts, extra)), schema(LAST))
    return first.where("starts is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *quoted).union(last)


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with later copies of strings of ``length`` bytes cut from their texts, the first one kept.

    ``n_chars`` follows the text where there is such a column; documents left without text stay, empty."""
    out = repeated_strings(docs, length, "first", texts=True)
    column = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        column["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(column.get(c, F.col(f"`x_{c}`")).alias(c) for c in docs.columns))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
