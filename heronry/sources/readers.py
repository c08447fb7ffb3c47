"""Scans (S1-S14, P22). Every reader takes an explicit schema; nothing is inferred from the data."""

from __future__ import annotations

import io
import json
import struct
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import strip
from ..operators.gates import cast_or_drop
from ..schemas import MANIFEST, SPEAKERS_CSV
from . import flac
from .scratch import get_text


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSONL; blank lines are skipped, an empty prosody object is null."""
    df = spark.read.schema(MANIFEST).json(path)
    known = F.lit(False)
    for f in MANIFEST["prosody"].dataType.fields:
        known = known | F.col(f"prosody.{f.name}").isNotNull()
    return df.withColumn("prosody", F.when(known, F.col("prosody")))


def parquet_columns(spark: SparkSession, paths: str | list[str], needed: list[str], optional: dict[str, object] | None = None) -> DataFrame:
    """Pruned columns; optional ones that the files lack get a constant."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*needed, *(F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in (optional or {}).items()))


def payload_of_keys(spark: SparkSession, path: str, key: str, keys: list, columns: list[str]) -> DataFrame:
    """S3: payload of the rows with a key; the filter reaches the scan, so row groups without one are skipped."""
    return spark.read.parquet(path).where(F.col(key).isin(*keys)).select(key, *columns)


def speakers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pipe CSV with a header; rows whose numbers don't parse are dropped."""
    raw = spark.read.schema(SPEAKERS_CSV).option("sep", "|").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return cast_or_drop(raw, "duration", "dnsmos")


def piped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Headerless pipe text of three fields at least; a blank third one falls back to the second."""
    p = F.split("value", "[|]", -1)
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 3)
    return rows.select(F.col("p")[0].alias("rel_path"), F.col("p")[1].alias("raw_text"), F.coalesce(F.nullif(F.trim(F.col("p")[2]), F.lit("")), F.col("p")[1]).alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines, blanks dropped."""
    return spark.read.text(path).select(strip("value").alias("line")).where(F.length("line") > 0)


def lexicon(spark: SparkSession, path: str, custom: bool = False) -> DataFrame:
    """Word, IPA tokens and line order; comments, blanks and case are handled in the custom file only."""
    df = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    if custom:
        df = df.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    p = F.split("value", "\t")
    word = F.lower(p[0]) if custom else p[0]
    return df.where(F.size(p) >= 2).select(word.alias("word"), F.split(p[1], " ").alias("ipa"), "seq")


def config(path: str, spark: SparkSession | None = None) -> dict:
    """A small YAML or JSON config, on the driver; with a session from any store."""
    text = get_text(spark, path) if spark is not None else Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text)


def _plain_yaml(text: str) -> dict:
    """Nested maps of scalars and inline lists, which is all that mix configs hold."""
    root: dict = {}
    stack = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip()
        if not value:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
        else:
            try:
                stack[-1][1][key] = json.loads(value)
            except ValueError:
                stack[-1][1][key] = value.strip("'\"")
    return root


def json_lookup(spark: SparkSession, path: str, schema: str, key: str = "key") -> DataFrame:
    """A JSON object as rows of (key, value fields)."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", f"map<string,struct<{schema}>>"))).alias("e"))
    return rows.select(F.col("e.key").alias(key), "e.value.*")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """S11."""
    return spark.createDataFrame(rows, schema)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as (path, length), in path order; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")


def _wave(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, channels x samples in [-1, 1]) of a WAV of whole numbers of 8, 16, 24 or 32 bits, or floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no wave file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        part = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, width = struct.unpack("<HHIIHH", part[:16])
            form = (int.from_bytes(part[24:26], "little") if kind == 0xFFFE else kind, channels, rate, width)
        elif name == b"data":
            break
        at += 8 + size + size % 2
    else:
        raise ValueError("no samples")
    if form is None or form[1] < 1 or form[2] < 1:
        raise ValueError("no format")
    kind, channels, rate, width = form
    part = part[: len(part) // (channels * width // 8 or 1) * (channels * width // 8)]
    if (kind, width) == (3, 32) or (kind, width) == (3, 64):
        x = np.frombuffer(part, f"<f{width // 8}").astype(float)
    elif (kind, width) == (1, 8):
        x = (np.frombuffer(part, np.uint8) - 128.0) / 128
    elif kind == 1 and width in (16, 24, 32):
        low = np.zeros((len(part) // (width // 8), 4), np.uint8)
        low[:, 4 - width // 8 :] = np.frombuffer(part, np.uint8).reshape(-1, width // 8)
        x = low.view("<i4")[:, 0] / 2.0**31
    else:
        raise ValueError("an unknown kind of samples")
    return rate, x.reshape(-1, channels).T


def decoded(data: bytes, mix: str = "mean") -> tuple[int, np.ndarray] | None:
    """Rate and samples in [-1, 1] of WAV or FLAC bytes; their channels' mean or the first one; None if they can't be read."""
    try:
        rate, x = flac.decode(data) if data[:4] == flac.MAGIC else _wave(data)
    except (ValueError, struct.error):
        return None
    return rate, (x.mean(0) if mix == "mean" else x[0])


def pcm16(data: bytes, mix: str = "mean") -> tuple[int, np.ndarray] | None:
    """The same of a 16-bit WAV alone."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return decoded(data, mix) if w.getsampwidth() == 2 else None
    except (wave.Error, EOFError):
        return None


_AUDIO = StructType([StructField("sr", IntegerType()), StructField("samples", ArrayType(DoubleType()))])
#: Samples after which decoded clips are handed on.
SAMPLES = 1 << 18


def decode_audio(df: DataFrame, content: str = "content", mix: str = "mean") -> DataFrame:
    """Adds ``audio`` (sr, samples), null where the bytes can't be decoded; rejects can be kept aside.

    Samples leave a task in batches of ``SAMPLES`` or one clip, however many clips come in one."""

    whole = StructType([*df.schema.fields, StructField("audio", _AUDIO)])
    return df.mapInArrow(lambda batches: _with_audio(batches, content, mix), whole)


def _with_audio(batches: Iterator[pa.RecordBatch], content: str, mix: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, held, rows = 0, 0, []
        for k, data in enumerate(batch.column(content)):
            rows.append(decoded(data.as_py(), mix) if data.is_valid else None)
            held += len(rows[-1][1]) if rows[-1] else 0
            if held >= SAMPLES or k == batch.num_rows - 1:
                own = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, _audio(rows)], [*own.schema.names, "audio"])
                first, held, rows = k + 1, 0, []


def _audio(rows: list[tuple[int, np.ndarray] | None]) -> pa.Array:
    missing = [r is None for r in rows]
    ends = np.cumsum([0, *(len(r[1]) if r else 0 for r in rows)]).astype(np.int32)
    samples = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0), *(r[1] for r in rows if r)]))
    return pa.StructArray.from_arrays([pa.array([r[0] if r else None for r in rows], pa.int32()), samples], ["sr", "samples"], mask=pa.array(missing))


def set_aside(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, rejects); a bad row never fails its batch. Unknown counts as bad."""
    fine = F.coalesce(~bad, F.lit(False))
    return df.where(fine), df.where(~fine)
