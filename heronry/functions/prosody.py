"""Prosody of clips of any length (D2, M1, M2, W6, W8, W9): samples go in blocks, one kernel gives each block's frames."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..schemas import PROSODY
from ..sources.scratch import scratch

#: Samples of a pitch frame, of the stretch that is compared with its shifts, and between frames.
FRAME, WIDTH, HOP = 2048, 1024, 512
#: Pitch range that is searched, range that counts as voiced, and the deepest dip that an unvoiced frame may have.
SEARCH, VOICED, DIP = (60.0, 450.0), (60.0, 440.0), 0.1
#: Seconds of an energy frame; share of the loudest frame for speech, and for a peak; voiced frames at least.
ENERGY_SEC, SPEECH, PEAK, LEAST_VOICED = 0.03, 0.1, 0.25, 10
#: Share by which an energy must be above that of speech: sums of squares differ by less where levels are equal.
ROUNDING = 1e-12
#: Samples of a block.
BLOCK = 1 << 18
#: Frames whose transforms are made at once, samples of a run that are measured at once, and rows of frames in a batch.
AT_ONCE, TOGETHER, ROWS = 256, 1 << 16, 1 << 10


def fundamental(frames: np.ndarray, rate: float, lo: float = SEARCH[0], hi: float = SEARCH[1], dip: float = DIP) -> np.ndarray:
    """M2: the frequency of each row of ``frames`` by the cumulative mean normalised difference, nan where it is unvoiced.

    The shift is the first local minimum under ``dip``, set between samples by a parabola through the difference there. A frame
    without one (noise), or without energy, is unvoiced."""
    least, most = max(2, int(rate / hi)), min(int(np.ceil(rate / lo)), frames.shape[1] - WIDTH - 1)
    reach = WIDTH + most + 1  # no shift meets later samples
    size = min(k << max(0, (-(-reach // k) - 1).bit_length()) for k in (1, 3, 5, 9, 15, 25))
    out = np.full(len(frames), np.nan)
    for at in range(0, len(frames), AT_ONCE):
        x = frames[at : at + AT_ONCE, :reach]
        spectrum = np.fft.rfft(x, size)
        both = np.fft.irfft(spectrum * np.conj(np.fft.rfft(x[:, :WIDTH], size)), size)[:, : most + 2]
        power = np.cumsum(np.pad(x * x, ((0, 0), (1, 0))), axis=1)
        own = power[:, WIDTH : WIDTH + most + 2] - power[:, : most + 2]
        difference = np.maximum(own[:, :1] + own - 2 * both, 0)[:, 1:]  # of shifts 1, 2, ...
        total = np.cumsum(difference, axis=1)
        curve = difference * np.arange(1, most + 2) / np.maximum(total, 1e-300)
        band = slice(least - 1, most)
        trough = (curve[:, band] < dip) & (curve[:, band] <= curve[:, least - 2 : most - 1]) & (curve[:, band] < curve[:, least : most + 1])
        voiced = trough.any(1) & (own[:, 0] > 1e-12) & (total[:, -1] > 1e-12 * own[:, 0])
        rows = np.flatnonzero(voiced)
        k = trough[rows].argmax(1) + least - 1
        a, b, c = (difference[rows, k + d] for d in (-1, 0, 1))
        bend = a - 2 * b + c
        shift = np.where(np.abs(bend) > 1e-300, (a - c) / (2 * np.where(np.abs(bend) > 1e-300, bend, 1)), 0)
        out[at + rows] = rate / (k + 1 + np.clip(shift, -0.5, 0.5))
    return out


def blocks(df: DataFrame, key: str, samples: str | Column = "samples", rate: str | Column = "sr", size: int = BLOCK) -> DataFrame:
    """(clip, sr, n, start, head, x): whole clips in blocks of ``size`` samples with what the frames at their ends need of
    the neighbours; x begins ``head`` samples before the block's start."""
    x, margin = F.col(samples) if isinstance(samples, str) else samples, _margin(F.col("sr"))
    cut = df.select(F.col(key).alias("clip"), F.col(rate).cast("int").alias("sr") if isinstance(rate, str) else rate.cast("int").alias("sr"), x.alias("__x"))
    starts = cut.withColumn("n", F.size("__x").cast("long")).where("n > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))))
    head = F.least("start", margin)
    own = F.slice("__x", (F.col("start") - F.col("head") + 1).cast("int"), (F.col("head") + size + margin).cast("int"))
    return starts.withColumn("head", head).select("clip", "sr", "n", "start", F.lit(size).cast("long").alias("size"), "head", own.alias("x"))


def blocks_of_rows(df: DataFrame, key: str, pos: str, value: str, sr: int, size: int = BLOCK) -> DataFrame:
    """The same for samples in rows (clip, position from 0, value): a group is a block, however long its clip is."""
    margin = max(FRAME, 2 * int(ENERGY_SEC * sr))
    p = F.col(pos).cast("long")
    near = F.array_distinct(F.transform(F.array(p - margin, p, p + margin), lambda q: F.floor(q / size)))
    ends = df.groupBy(F.col(key).alias("clip")).agg((F.max(p) + 1).alias("n"))
    rows = df.select(F.col(key).alias("clip"), p.alias("p"), F.col(value).cast("double").alias("v"), F.explode(near).alias("b"))
    held = rows.groupBy("clip", "b").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("s")).join(ends, "clip").where((F.col("b") >= 0) & (F.col("b") * size < F.col("n")))
    start = F.col("b") * size
    return held.select("clip", F.lit(sr).alias("sr"), "n", start.alias("start"), F.lit(size).cast("long").alias("size"), (start - F.element_at("s", 1)["p"]).alias("head"), F.transform("s", lambda y: y["v"]).alias("x"))


def _margin(rate: Column) -> Column:
    return F.greatest(F.lit(FRAME).cast("long"), 2 * F.floor(ENERGY_SEC * rate))


def frames_of(x: np.ndarray, rate: int, n: int, start: int, size: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's frames in one pass: pitch by frame (nan: unvoiced), energy by frame, and which energies are above both
    neighbours. A frame belongs to the block that holds its middle (pitch) or its first sample (energy)."""
    end = min(start + size, n)
    # pitch: the clip is taken as silent before its start and after its end
    middles = np.arange(-(-start // HOP), -(-end // HOP)) * HOP
    if end == n and n % HOP == 0:
        middles = np.append(middles, n)
    base = start - head  # the clip's position of x[0]
    first = middles - FRAME // 2 - base
    left, right = max(0, -int(first.min(initial=0))), max(0, int(first.max(initial=0)) + FRAME - len(x))
    padded = np.pad(x, (left, right))
    pitch = fundamental(np.lib.stride_tricks.sliding_window_view(padded, FRAME)[first + left], rate) if len(first) else np.zeros(0)
    # energy: whole frames only, one more on either side for the comparison
    width = int(ENERGY_SEC * rate)
    lo, hi = -(-start // width), min(-(-end // width), n // width)
    if hi <= lo:
        return pitch, np.zeros(0), np.zeros(0, bool)
    a, b = max(lo - 1, 0), min(hi + 1, n // width)
    part = x[a * width - base : b * width - base]
    energy = np.sqrt((part.reshape(b - a, width) ** 2).mean(1))
    above = np.zeros(b - a, bool)
    above[1:-1] = (energy[1:-1] > energy[:-2]) & (energy[1:-1] > energy[2:])
    return pitch, energy[lo - a : hi - a], above[lo - a : hi - a]


class _Rows:
    """Rows of frames that leave in batches, each of ``ROWS`` at most; a row's frames in one list a column."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.fields, self.frames = names, kinds, [], []

    def add(self, fields: tuple, found: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.fields.append(fields)
        self.frames.append(found)
        if len(self.fields) >= ROWS:
            yield from self.flush()

    def flush(self):
        if not self.fields:
            return
        columns = [pa.array(c, kind) for c, kind in zip(zip(*self.fields), self.kinds)]
        for found, kind in zip(zip(*self.frames), (pa.float64(), pa.float64(), pa.bool_())):
            values = pa.array(np.concatenate(found), kind, from_pandas=True)  # nan is null
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values))
        self.fields, self.frames = [], []
        yield pa.RecordBatch.from_arrays(columns, [*self.names, "pitch", "energy", "above"])


def block_frames(parts: DataFrame) -> DataFrame:
    """(clip, sr, n, pitch, energy, above) of every block; a task holds one block of samples at a time."""
    kind = parts.schema["clip"].dataType.simpleString()

    def run(batches):
        rows = None
        for batch in batches:
            rows = rows or _Rows(["clip", "sr", "n"], [batch.schema.field("clip").type, pa.int32(), pa.int64()])
            for i in range(batch.num_rows):
                clip, sr, n, start, size, head = (batch.column(c)[i].as_py() for c in ("clip", "sr", "n", "start", "size", "head"))
                x = batch.column("x").slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
                yield from rows.add((clip, sr, n), frames_of(x, sr, n, start, size, head))
        if rows:
            yield from rows.flush()

    return parts.mapInArrow(run, f"clip {kind}, sr int, n long, pitch array<double>, energy array<double>, above array<boolean>")


class _Run:
    """Samples of one clip that follow one another in a task, from its first one on; what blocks need no more is let go."""

    def __init__(self, clip, first: int, sr: int, size: int):
        self.clip, self.first, self.sr, self.size = clip, first, sr, size
        self.margin = max(FRAME, 2 * int(ENERGY_SEC * sr))
        self.end, self.base, self.start, self.held = first, first, 0, []

    def add(self, x: np.ndarray, last: bool = False):
        """Frames of the blocks that are complete, once they are ``TOGETHER`` samples; of all that are left once the run has
        ended. Blocks that follow one another are measured as one."""
        self.end += len(x)
        if self.first:  # a piece from inside a clip: its frames need what another task holds
            return
        self.held.append(x)
        if not last and self.start + max(self.size, TOGETHER) + self.margin > self.end:
            return
        x = np.concatenate(self.held)
        while self.start < self.end if last else self.start + self.size + self.margin <= self.end:
            whole = max(min(self.end - self.margin - self.start, TOGETHER) // self.size, 1) * self.size
            if last and self.end - self.start <= max(self.size, TOGETHER):
                whole = self.end - self.start
            head = min(self.start, self.margin)
            until = min(self.start + whole + self.margin, self.end)
            yield frames_of(x[self.start - head - self.base : until - self.base], self.sr, until, self.start, whole, head)
            self.start += whole
        base = max(self.base, self.start - self.margin)
        self.held, self.base = [x[base - self.base :].copy()], base


def _run_frames(batches, sr: int, size: int):
    """(clip, sr, first, n, pitch, energy, above): frames of each run of rows, and a row with the run's ends. Frames count if
    the run turns out to be the whole clip."""
    run, rows, none = None, None, (np.zeros(0), np.zeros(0), np.zeros(0, bool))

    def closed(run):
        for found in run.add(none[0], last=True):
            yield from rows.add((run.clip, sr, None, None), found)
        yield from rows.add((run.clip, sr, run.first, run.end), none)

    for batch in batches:
        clip, p, v = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        rows = rows or _Rows(["clip", "sr", "first", "n"], [clip.type, pa.int32(), pa.int64(), pa.int64()])
        other = pc.not_equal(clip[1:], clip[:-1]).to_numpy(zero_copy_only=False) | (np.diff(p) != 1)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            key = clip[lo].as_py()
            if run is None or key != run.clip or p[lo] != run.end:
                if run is not None:
                    yield from closed(run)
                run = _Run(key, int(p[lo]), sr, size)
            for found in run.add(v[lo:hi]):
                yield from rows.add((key, sr, None, None), found)
    if run is not None:
        yield from closed(run)
        yield from rows.flush()


@contextlib.contextmanager
def _unweighed(spark, rows: DataFrame):
    """Spark weighs an Arrow batch after every row, most of what a row of three numbers costs; a batch of such rows is bounded
    by their number. Keys that are texts are still weighed."""
    name, narrow = "spark.sql.execution.arrow.maxBytesPerBatch", all(isinstance(f.dataType, NumericType) for f in rows.schema)
    had, most = spark.conf.get(name, None), int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not narrow or not 0 < most <= 1 << 20:
        yield
        return
    spark.conf.set(name, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(name, had) if had else spark.conf.unset(name)


def prosody_of_rows(df: DataFrame, key: str, pos: str, value: str, sr: int, size: int = BLOCK) -> DataFrame:
    """(clip, prosody) for samples in rows. A clip whose rows come together and in order is measured in the task that reads
    them, and no sample is shuffled; the rows of the others (cut by a split, out of order) go by ``blocks_of_rows``."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("clip"), F.col(pos).cast("long").alias("p"), F.col(value).cast("double").alias("v")).where("clip is not null and p is not null")
    kind = rows.schema["clip"].dataType.simpleString()
    path, left = scratch(spark, "runs"), scratch(spark, "apart")
    found = rows.mapInArrow(lambda batches: _run_frames(batches, sr, size), f"clip {kind}, sr int, first long, n long, pitch array<double>, energy array<double>, above array<boolean>")
    with _unweighed(spark, rows):
        found.write.parquet(path)
    kept = spark.read.parquet(path)
    runs = kept.where("first is not null").groupBy("clip").agg(F.count("*").alias("runs"), F.max("first").alias("first"))
    runs.where("runs > 1 or first > 0").select("clip").write.parquet(left)
    apart = spark.read.schema(f"clip {kind}").parquet(left)
    if apart.isEmpty():
        return _fields(kept)
    again = block_frames(blocks_of_rows(rows.join(apart, "clip", "left_semi"), "clip", "p", "v", sr, size))
    path = scratch(spark, "frames")
    again.write.parquet(path)
    return _fields(kept.join(apart, "clip", "left_anti").drop("first").unionByName(spark.read.parquet(path)))


def prosody(parts: DataFrame) -> DataFrame:
    """(clip, prosody): the eight fields of each clip of ``blocks``, null with fewer than ten voiced frames.

    The kernel runs once and its frames are kept as a table."""
    spark = parts.sparkSession
    path = scratch(spark, "frames")
    block_frames(parts).write.parquet(path)
    return _fields(spark.read.parquet(path))


def _fields(kept: DataFrame) -> DataFrame:
    """The fields from frames: partial sums, two passes for what depends on a clip's loudest frame or its median pitch."""
    loud = kept.select("clip", F.explode(F.arrays_zip("energy", "above")).alias("f")).select("clip", "f.energy", "f.above")
    top = loud.groupBy("clip").agg(F.max("energy").alias("top"), F.avg("energy").alias("energy_mean"), F.stddev_pop("energy").alias("energy_std"))
    peaks = loud.join(top.select("clip", "top"), "clip").groupBy("clip").agg(
        (1 - F.avg((F.col("energy") > SPEECH * (1 + ROUNDING) * F.col("top")).cast("double"))).alias("pause_ratio"), F.count_if(F.col("above") & (F.col("energy") / (F.col("top") + F.lit(1e-9)) > PEAK)).alias("peaks")
    )
    voiced = kept.select("clip", F.explode("pitch").alias("f0")).where((F.col("f0") > VOICED[0]) & (F.col("f0") < VOICED[1]))
    middle = voiced.groupBy("clip").agg(F.median("f0").alias("f0_mean"), F.count("*").alias("voiced")).where(F.col("voiced") >= LEAST_VOICED)
    st = voiced.join(middle, "clip").select("clip", (12 * F.log2(F.col("f0") / F.col("f0_mean"))).alias("st"))
    spread = st.groupBy("clip").agg(F.stddev_pop("st").alias("f0_std"), (F.percentile("st", F.lit(0.95)) - F.percentile("st", F.lit(0.05))).alias("f0_range"))
    length = kept.groupBy("clip").agg((F.max("n") / F.max("sr")).alias("duration"))
    rows = length.join(top, "clip", "left").join(peaks, "clip", "left").join(middle.drop("voiced"), "clip", "left").join(spread, "clip", "left")
    rows = rows.withColumn("speech_rate", F.col("peaks") / F.greatest(F.col("duration") * (1 - F.col("pause_ratio")), F.lit(0.1)))
    digits = {"f0_mean": 1, "f0_std": 2, "f0_range": 1, "energy_mean": 4, "energy_std": 4, "speech_rate": 2, "pause_ratio": 3, "duration": 2}
    fields = F.struct(*(F.bround(F.col(f), digits[f]).alias(f) for f in PROSODY.fieldNames()))
    return rows.select("clip", F.when(F.col("f0_mean").isNotNull() & F.col("top").isNotNull(), fields).alias("prosody"))
