"""Greedy merging of intervals over rows (W11), for keys of any size.

An interval is extended while its end stays within a length of its start, so all that a stretch of rows needs to know of
those before it is where the open interval began. What a stretch makes of that start is a step function: with its limits
ascending, the first row that ends beyond the limit begins the next interval, and from there the stretch alone decides.
Step functions of neighbouring stretches are composed in a tree, which gives every stretch its start, and the stretches
are then merged apart. A key's rows may thus lie in many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Rows of a stretch, and neighbouring functions that one task composes.
STRETCH, FAN = 1 << 16, 64


def _stretches(size: int):
    """Sorted rows (key, s, e) of a task as stretches of one key: (key, part, number, s, e)."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        key, held, n = None, [], 0

        def out():
            s, e = (pa.array([np.concatenate(x)]) for x in zip(*held))
            return pa.RecordBatch.from_arrays([key, pa.array([part], pa.int32()), pa.array([number], pa.int64()), s, e], ["key", "part", "number", "s", "e"])

        for b in batches:
            keys, s, e = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            ends = pc.run_end_encode(keys).run_ends.to_numpy() if len(keys) else []
            lo = 0
            for hi in ends:
                while lo < hi:
                    if held and (n == size or keys[lo] != key[0] and not (keys[lo].is_valid is key[0].is_valid is False)):
                        yield out()
                        number, held, n = number + 1, [], 0
                    key = keys.slice(lo, 1)
                    more = int(min(hi - lo, size - n))
                    held.append((s[lo : lo + more], e[lo : lo + more]))
                    lo, n = lo + more, n + more
        if held:
            yield out()

    return run


def _last_start(s: list, e: list, longest: float) -> list:
    """For each row, the start of the open interval at the end, if an interval begins there."""
    n, k = len(s), 0
    after = [n] * n
    for j in range(n):
        k = max(k, j + 1)
        while k < n and e[k] - s[j] <= longest:
            k += 1
        after[j] = k
    out = list(s)
    for j in range(n - 1, -1, -1):
        if after[j] < n:
            out[j] = out[after[j]]
    return out


def _steps(limits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of one result joined."""
    last = np.append(starts[1:] != starts[:-1], True)
    return limits[last], starts[last]


def step_function(s: np.ndarray, e: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(ends, starts): an open interval whose limit is below ``ends[i]``, not below the one before, leaves ``starts[i]`` open;
    beyond the last it stays open itself."""
    top = np.maximum.accumulate(e)
    rise = np.append(True, top[1:] > top[:-1])
    return _steps(top[rise], np.array(_last_start(s.tolist(), e.tolist(), longest))[rise])


def apply_steps(ends: np.ndarray, starts: np.ndarray, opened: np.ndarray, longest: float) -> np.ndarray:
    """The open intervals' starts after a stretch, by those before."""
    at = np.searchsorted(ends, opened + longest, "right")
    # the rule is a difference, which rounds otherwise than the sum
    for _ in range(2):
        at = at - ((at > 0) & (ends[np.maximum(at, 1) - 1] - opened > longest))
        at = at + ((at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] - opened <= longest))
    return np.where(at < len(ends), starts[np.minimum(at, len(ends) - 1)], opened)


def compose(first: tuple, second: tuple, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """First one stretch, then the next."""
    past = second[0] > first[0][-1]
    ends = np.concatenate([first[0], second[0][past]])
    return _steps(ends, np.concatenate([apply_steps(*second, first[1], longest), second[1][past]]))


def _pair(row, a: str = "ends", b: str = "starts"):
    return row.column(a)[0].values.to_numpy(), row.column(b)[0].values.to_numpy()


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _opened(stretches: DataFrame, places: DataFrame, kind: str, longest: float, fan: int) -> DataFrame:
    """(part, number, opened): where the interval that is open before each stretch began; of keys with several only."""

    def functions(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ends, starts = step_function(*_pair(row, "s", "e"), longest)
                first = pa.array([float(row.column("s")[0].values[0].as_py())])
                yield pa.RecordBatch.from_arrays([row.column("key"), row.column("place"), first, pa.array([ends]), pa.array([starts])], ["key", "i", "first", "ends", "starts"])

    schema = f"key {kind}, i long, first double, ends array<double>, starts array<double>"
    levels = [_kept(stretches.join(places.select("part", "number", "place"), ["part", "number"]).mapInArrow(functions, schema), "steps")]

    def members(table: pa.Table):
        table = table.sort_by("i")
        return [table.slice(k, 1).combine_chunks().to_batches()[0] for k in range(table.num_rows)]

    def composed(table: pa.Table) -> pa.Table:
        rows = members(table)
        out = _pair(rows[0])
        for r in rows[1:]:
            out = compose(out, _pair(r), longest)
        return pa.table([rows[0].column("key"), pa.array([rows[0].column("i")[0].as_py() // fan]), rows[0].column("first"), pa.array([out[0]]), pa.array([out[1]])], names=["key", "i", "first", "ends", "starts"])

    def entered(table: pa.Table) -> pa.Table:
        rows = members(table)
        opened, out = rows[0].column("opened")[0].as_py(), []
        for r in rows:
            out.append(opened)
            # nothing is open before a key's first stretch: its first row begins
            at = -np.inf if opened is None else opened
            opened = float(apply_steps(*_pair(r), np.array([at]), longest)[0])
        keys = pa.chunked_array([r.column("key") for r in rows])
        return pa.table([keys, pa.array([r.column("i")[0].as_py() for r in rows]), pa.array(out, pa.float64())], names=["key", "i", "opened"])

    group = F.floor(F.col("i") / fan)
    while levels[-1].where(F.col("i") >= fan).limit(1).count():
        levels.append(_kept(levels[-1].groupBy("key", group.alias("g")).applyInArrow(composed, schema), "steps"))
    opened = levels[-1].withColumn("opened", F.lit(None).cast("double")).groupBy("key").applyInArrow(entered, f"key {kind}, i long, opened double")
    for level in reversed(levels[:-1]):
        above = opened.select(F.col("key").alias("k"), F.col("i").alias("g"), "opened")
        joined = level.join(above, F.col("key").eqNullSafe(F.col("k")) & (group == F.col("g"))).drop("k")
        opened = joined.groupBy("key", "g").applyInArrow(entered, f"key {kind}, i long, opened double")
    return places.join(opened.select(F.col("key").alias("k"), F.col("i").alias("place"), "opened"), ["place"]).where(F.col("key").eqNullSafe(F.col("k"))).select("part", "number", "opened", "before", "ends_here")


def merge(df: DataFrame, key: str, start: str, end: str, longest: float, shortest: float, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """(key, s, e): each key's intervals in order of start and end, one taken into the open interval while its end stays
    within ``longest`` of that one's start; merged intervals of ``shortest`` at least are kept.

    Rows without a start or an end are left out; rows without a key are a key. A task holds ``stretch`` rows at a time."""
    rows = df.select(F.col(key).alias("key"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")).where("s is not null and e is not null")
    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.repartitionByRange("key", "s").sortWithinPartitions("key", "s", "e")
    stretches = _kept(ordered.mapInArrow(_stretches(stretch), f"key {kind}, part int, number long, s array<double>, e array<double>"), "stretches")
    w = Window.partitionBy("key").orderBy("part", "number")
    places = stretches.select("key", "part", "number", F.element_at("e", -1).alias("last")).withColumns({"place": F.row_number().over(w) - 1, "before": F.lag("last").over(w), "ends_here": F.lead("last").over(w).isNull()})
    places = _kept(places.withColumn("place", F.col("place").cast("long")).where("place > 0 or not ends_here"), "places")
    opened = _opened(stretches, places, kind, longest, fan)

    def merged(batches):
        for b in batches:
            at, starts, ends = [], [], []
            for k, (s, e, opened, before, last) in enumerate(zip(*(b.column(c).to_pylist() for c in ("s", "e", "opened", "before", "ends_here")))):
                cur, prior = opened, before
                for x, y in zip(s, e):
                    if cur is None:
                        cur = x
                    elif y - cur > longest:
                        if prior - cur >= shortest:
                            at.append(k)
                            starts.append(cur)
                            ends.append(prior)
                        cur = x
                    prior = y
                if last is not False and prior - cur >= shortest:
                    at.append(k)
                    starts.append(cur)
                    ends.append(prior)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(starts, pa.float64()), pa.array(ends, pa.float64())], [key, "s", "e"])

    return stretches.join(opened, ["part", "number"], "left").select("key", "s", "e", "opened", "before", "ends_here").mapInArrow(merged, f"`{key}` {kind}, s double, e double")
