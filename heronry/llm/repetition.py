"""Quality rules by repetition: how many characters of a text lie inside duplicated n-grams and lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, tidy
from .words import BASE, mix, word_hashes

#: White space parts words, nothing else changes.
AS_IS = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b for b in range(256))
SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Words of an n-gram and the share of a text's word characters that duplicated n-grams of that length may cover, first
#: copies included. A short n-gram comes again by chance more often than a long one, so it is allowed more.
LIMITS = {5: 0.42, 6: 0.40, 7: 0.38, 8: 0.36, 9: 0.34, 10: 0.32}
#: Share of the characters in lines with a word that may lie in lines equal to an earlier one.
LINE_CHARS = 0.30
#: The base rule: fewest words, length of its windows, and percent of the words that may lie in repeated ones.
LEAST, WINDOW, PERCENT = 20, 8, 30
#: Bytes of text that are measured at once; a longer text goes alone.
AT_ONCE = 4 << 20


def duplicated(grams: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once."""
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(grams), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, grams)
    return twice[np.minimum(at, len(twice) - 1)] == grams


def covers(index: np.ndarray, hashes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, which words lie in an n-gram that its text holds twice or more) for ascending n.

    The hash rolls on from one length to the next: times the base, plus the next word. An n-gram can only be duplicated
    where the one a word shorter is, so the places looked at shrink with n. The text's number is mixed in, so that equal
    n-grams of different texts differ."""
    base, total = np.uint64(BASE), len(index)
    at, rolled, n = np.arange(total), mix(hashes + index.astype(np.uint64) * base), 1
    for want in lengths:
        while n < want:
            stays = at + n < total
            at, rolled = at[stays], rolled[stays]
            inside = index[at] == index[at + n]
            at, rolled = at[inside], rolled[inside]
            rolled = rolled * base + hashes[at + n]
            n += 1
        twice = duplicated(mix(rolled))
        at, rolled = at[twice], rolled[twice]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        yield n, np.cumsum(edge[:-1]) > 0


def lines_again(text: bytes, starts: np.ndarray) -> tuple[int, int, int]:
    """Of the lines with a word: those equal to an earlier one, all characters, and the characters in those that are equal
    to an earlier one. ``starts`` are the first bytes of the words."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    held = np.unique(np.searchsorted(ends, starts))
    lo = np.concatenate([[0], ends + 1])[held].tolist()
    hi = np.concatenate([ends, [len(text)]])[held].tolist()
    seen: set[bytes] = set()
    again = size = size_again = 0
    for a, b in zip(lo, hi):
        line = text[a:b]
        chars = len(line.decode())
        size += chars
        if line in seen:
            again += 1
            size_again += chars
        else:
            seen.add(line)
    return again, size, size_again


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of every text, and by n the characters inside duplicated n-grams."""
    n = len(texts)
    index, hashes, starts, chars = word_hashes(texts, AS_IS, lengths=True)
    total = lambda weights: np.bincount(index, weights, n).astype(np.int64)
    out = {"n_words": np.bincount(index, minlength=n).astype(np.int64), "word_chars": total(chars)}
    out["n_symbols"] = np.array([len(SYMBOLS.findall(t)) for t in texts], np.int64)
    cuts = np.searchsorted(index, np.arange(n + 1))
    rows = np.array([lines_again(t, starts[a:b]) for t, a, b in zip(texts, cuts[:-1], cuts[1:])], np.int64).reshape(n, 3)
    out |= {"n_dup_lines": rows[:, 0], "line_chars": rows[:, 1], "dup_line_chars": rows[:, 2]}
    for size, inside in covers(index, hashes, sorted({*LIMITS, WINDOW})):
        out[f"chars_{size}"] = total(chars * inside)
        if size == WINDOW:
            out["n_repeat_words"] = total(inside)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < LEAST) | (100 * m["n_repeat_words"] > PERCENT * m["n_words"])
    kept = ~failed & (m["dup_line_chars"] <= LINE_CHARS * m["line_chars"])
    for size, most in LIMITS.items():
        kept &= m[f"chars_{size}"] <= most * m["word_chars"]
    return failed, kept


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, " + ", ".join(f"chars_{n} long" for n in LIMITS)


def _rules(batches):
    def told(ids, texts):
        m = measure(texts)
        failed, kept = verdict(m)
        columns = [pa.array(ids, pa.int64()), *(pa.array(m[c]) for c in COUNTS), pa.array(failed), pa.array(kept), *(pa.array(m[f"chars_{n}"]) for n in LIMITS)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", *(f"chars_{n}" for n in LIMITS)])

    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            t = t.as_buffer().to_pybytes() if t.is_valid else b""
            if texts and size + len(t) > AT_ONCE:
                yield told(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            size += len(t)
    if texts:
        yield told(ids, texts)


def repetition(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text), whatever other columns it has.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed are plain counts and the base rule.
    chars_n is the number of characters of words inside n-grams (n words) that the text holds twice or more, the first
    copy included. kept is false if base_failed, if chars_n exceeds its share of word_chars for an n in ``LIMITS``, or
    if lines equal to an earlier one exceed ``LINES`` of the lines or ``LINE_CHARS`` of their bytes.

    One pass without a shuffle; rows of equal id are judged each by itself, a null id stays null. A null or empty text
    has no words: zeros, base_failed. A text of any length is taken whole (some 100 bytes of memory a word). An empty
    table gives an empty result."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_rules), SCHEMA)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read_table(spark, sf_dir, "documents"))
