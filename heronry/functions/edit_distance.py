"""Edit distance (T2) of many pairs at once: columns of 64 rows as bits of a word, over code points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import col

#: Bytes of the table of matches of a batch, and pairs in it at most.
TABLE, PAIRS = 32 << 20, 4096
_ONE = np.uint64(1)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without what both begin and end with, the shorter one first."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    k = int(other[0]) if len(other) else n
    a, b, n = a[k:], b[k:], n - k
    other = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    k = int(other[0]) if len(other) else n
    a, b = a[: len(a) - k], b[: len(b) - k]
    return (a, b) if len(a) <= len(b) else (b, a)


def _batch(pairs: list[tuple[np.ndarray, np.ndarray]], most: int | None) -> np.ndarray:
    """Distances of pairs, longest second text first. Bits of ``up`` and ``down`` say where a cell of the current column is one
    more or one less than the cell above it; ``add`` and ``cut`` carry the same between neighbouring cells of a row."""
    n, wide = len(pairs), max(len(a) for a, _ in pairs)
    words = -(-wide // 64)
    letters, codes = np.unique(np.concatenate([np.concatenate(p) for p in pairs]), return_inverse=True)
    match = np.zeros((len(letters), words, n), np.uint64)
    text, at = np.zeros((len(pairs[0][1]), n), np.int64), 0
    for k, (a, b) in enumerate(pairs):
        i = np.arange(len(a))
        np.bitwise_or.at(match, (codes[at : at + len(a)], i // 64, k), _ONE << (i % 64).astype(np.uint64))
        at += len(a)
        text[: len(b), k] = codes[at : at + len(b)]
        at += len(b)
    rows = np.array([len(a) for a, _ in pairs])
    columns = np.array([len(b) for _, b in pairs])
    last, bit = (rows - 1) // 64, ((rows - 1) % 64).astype(np.uint64)
    up, down, score = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64), rows.copy()
    which = np.arange(n)
    top = np.uint64(63)
    for j in range(len(text)):
        live = int(np.searchsorted(-columns, -j, "left"))  # texts with a j-th letter
        if most is not None and j % 64 == 0 and (score[:live] - (columns[:live] - j) > most).all():
            break
        letter, here = text[j, :live], which[:live]
        add, cut = np.ones(live, np.uint64), np.zeros(live, np.uint64)
        for w in range(words):
            same, u, d = match[letter, w, here], up[w, :live], down[w, :live]
            level = same | d
            same = same | cut
            flat = (((same & u) + u) ^ u) | same
            more, less = d | ~(flat | u), u & flat
            ends = last[:live] == w
            if ends.any():
                b = bit[:live]
                score[:live] += np.where(ends, ((more >> b) & _ONE).astype(np.int64) - ((less >> b) & _ONE).astype(np.int64), 0)
            more_out, less_out = more >> top, less >> top
            more, less = (more << _ONE) | add, (less << _ONE) | cut
            up[w, :live], down[w, :live] = less | ~(level | more), more & level
            add, cut = more_out, less_out
    return score


def distances(left: list[str], right: list[str], most: int | None = None) -> np.ndarray:
    """Edit distance of each pair. With ``most``, distances above it may come out as any number above it."""
    out = np.zeros(len(left), np.int64)
    todo = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x != y:
            a, b = _apart(_codes(x), _codes(y))
            if not len(a) or most is not None and len(b) - len(a) > most:
                out[i] = len(b)
            else:
                todo.append((-(-len(a) // 64), -len(b), i, a, b))
    todo.sort(key=lambda t: t[:3])
    lo = 0
    while lo < len(todo):
        # pairs of about as many words; as many as keep the table of matches small
        words, hi, letters = todo[lo][0], lo, 0
        while hi < len(todo) and hi - lo < PAIRS and todo[hi][0] <= words + words // 4:
            letters = max(letters, min(len(todo[hi][3]) + len(todo[hi][4]), 512))
            if hi > lo and (hi - lo + 1) * todo[hi][0] * letters * 8 > TABLE:
                break
            hi += 1
        part = sorted(todo[lo:hi], key=lambda t: t[1])
        score = _batch([(a, b) for _, _, _, a, b in part], most)
        for (_, _, i, _, _), s in zip(part, score.tolist()):
            out[i] = s if most is None else max(s, 0)
        lo = hi
    return out


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.zeros(len(a))
    out[known] = distances(a[known].tolist(), b[known].tolist())
    return pd.Series(np.where(known, out, np.nan)).astype("Int32")


def edit_distance(a: str | Column, b: str | Column) -> Column:
    """Insertions, deletions and replacements of code points that make one text the other; null if one is."""
    return _distance(col(a), col(b))
