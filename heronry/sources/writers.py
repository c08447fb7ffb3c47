"""Sinks (K1-K10)."""

from __future__ import annotations

import io
import json
import uuid
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .scratch import put_text


def write_manifest(df: DataFrame, path: str) -> None:
    """K1: JSONL with nulls written; an empty ``extra`` is dropped."""
    rows = df
    if "extra" in df.columns:
        rows = df.withColumn("extra", F.when(F.size("extra") > 0, F.col("extra")))
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    if "extra" in df.columns:
        text = F.regexp_replace(text, r',"extra":null(?=\}$)|"extra":null,', "")
    rows.select(text.alias("value")).write.text(path)


def write_piped(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K2, K3: pipe CSV with a header; ``mode="append"`` for reports."""
    df.write.mode(mode).option("sep", "|").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_filelist(df: DataFrame, columns: list[str], path: str, files: int | None = None) -> None:
    """K4: headerless lists; ``files`` of 1 for trainers that want one file."""
    out = df.select(F.concat_ws("|", *columns).alias("value"))
    (out.coalesce(files) if files else out).write.text(path)


def write_lookup(df: DataFrame, key: str, value: str, path: str, most: int = 100_000) -> None:
    """K5: a small lookup as one JSON document; a larger one than ``most`` rows is refused."""
    rows = df.select(key, value).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no lookup")
    plain = {r[0]: r[1].asDict() if isinstance(r[1], Row) else r[1] for r in rows}
    put_text(df.sparkSession, path, json.dumps(plain, ensure_ascii=False, indent=1))


def rewrite(df: DataFrame, path: str) -> str:
    """K6: an enriched table beside the one it was read from, for the caller to swap in; Spark can't overwrite what it reads."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(new)
    return new


def write_by_key(df: DataFrame, key: str, line: str, path: str) -> None:
    """K8: one folder a key."""
    df.select(key, F.col(line).alias("value")).write.partitionBy(key).text(path)


def wav_bytes(samples: str | Column, sr: int = 24000, pad_ms: int = 200) -> Column:
    """K9: mono 16-bit WAV content with a tail of silence, as a binary column for any binary sink."""

    def one(a):
        y = np.concatenate((a.astype(float), np.zeros(int(sr * pad_ms / 1000))))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(sr)
            w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    return _contents(one)(F.col(samples) if isinstance(samples, str) else samples)


def _contents(one):
    """A function from the samples of a clip to its bytes, as one over a column; samples stay in Arrow's memory."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return pa.array((one(a.values.to_numpy(zero_copy_only=False)) if a.is_valid else None for a in x), pa.binary())

    return run


def flac_bytes(samples: str | Column, sr: int = 24000, width: int = 16) -> Column:
    """Mono lossless content, as a binary column; samples are clipped to [-1, 1] and cut to ``width`` bits toward zero."""
    from . import flac

    top = (1 << (width - 1)) - 1
    run = _contents(lambda a: flac.encode((np.clip(a.astype(float), -1, 1) * top).astype(np.int64)[None], sr, width))
    return run(F.col(samples) if isinstance(samples, str) else samples)


def write_failures(df: DataFrame, path: str) -> None:
    """A line for each failed clip (audio, flags, cer, dnsmos)."""
    df.select(F.format_string("%s  [%s] cer=%s mos=%s", "audio", "flags", "cer", "dnsmos").alias("value")).write.text(path)
