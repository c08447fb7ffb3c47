"""Folds with running state over ordered lists (W11, W12): greedy merging of intervals and greedy text packing.

``intervals.merge`` is W11 for intervals in rows, whatever a key's size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, split_clauses, split_sentences


def merge_intervals(intervals: str | Column, longest, shortest) -> Column:
    """Extend an interval while it stays within ``longest`` from its start; keep those of ``shortest`` at least."""
    kind = "array<struct<s:double,e:double>>"
    xs = col(intervals).cast(kind)

    def add(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        fits = x["e"] - cur["s"] <= longest
        grown = F.struct(cur["s"].alias("s"), x["e"].alias("e"))
        closed = F.when(cur["e"] - cur["s"] >= shortest, F.concat(acc["out"], F.array(cur))).otherwise(acc["out"])
        return F.when(cur.isNull(), F.struct(acc["out"].alias("out"), x.alias("cur"))).when(fits, F.struct(acc["out"].alias("out"), grown.alias("cur"))).otherwise(F.struct(closed.alias("out"), x.alias("cur")))

    start = F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("struct<s:double,e:double>").alias("cur"))
    end = lambda acc: F.when(acc["cur"].isNotNull() & (acc["cur"]["e"] - acc["cur"]["s"] >= shortest), F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
    return F.aggregate(xs, start, add, end)


def _merged(longest: int, short: int):
    """Neighbours are joined where either is short and both fit."""

    @F.pandas_udf("array<string>")
    def run(parts: pd.Series) -> pd.Series:
        def one(xs):
            out, size = [], 0
            for x in [] if xs is None else xs:
                if out and (size < short or len(x) < short) and size + 1 + len(x) <= longest:
                    out[-1].append(x)
                    size += 1 + len(x)
                else:
                    out.append([x])
                    size = len(x)
            return [" ".join(x) for x in out]

        return parts.map(one)

    return run


def _packed(longest: int, least: int):
    """Of each merged piece's clauses: a piece of one is itself; clauses of an overlong one are gathered up to the limit. Only
    what a full buffer holds has no upper bound."""

    @F.pandas_udf("array<string>")
    def run(pieces: pd.Series) -> pd.Series:
        def gathered(clauses, out):
            buf = ""
            for c in clauses:
                if len(buf) + len(c) + 1 <= longest:
                    buf = (buf + " " + c).strip(" ")
                else:
                    if len(buf) >= least:
                        out.append(buf)
                    buf = c
            if least <= len(buf) <= longest:
                out.append(buf)

        def one(xs):
            out = []
            for x in [] if xs is None else xs:
                if x["whole"] is None:
                    gathered(x["clauses"], out)
                elif len(x["whole"]) >= least:
                    out.append(x["whole"])
            return out

        return pieces.map(one)

    return run


def split_line(text: str | Column, longest: int = 150, short: int = 25, least: int = 10) -> Column:
    """Pieces of a line; a line within the limit stays as it is. Each piece is looked at once, however long the line."""
    t = col(text)
    # trim by name alone would take each piece's place as the characters to cut
    parts = F.filter(F.transform(split_sentences(t), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    fits = lambda m: F.length(m) <= longest
    pieces = F.transform(_merged(longest, short)(parts), lambda m: F.struct(F.when(fits(m), m).alias("whole"), F.when(~fits(m), split_clauses(m)).alias("clauses")))
    return F.when(F.length(t) <= longest, F.array(t)).otherwise(_packed(longest, least)(pieces))
