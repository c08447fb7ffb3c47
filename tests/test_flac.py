import io
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest

from heronry.sources import flac, readers
from heronry.sources.flac import _bits, _codes


def signal(n, channels, width, seed=1):
    rng = np.random.default_rng(seed)
    top = 1 << (width - 1)
    x = np.sin(np.arange(n) / 11) * top * 0.7 + rng.normal(size=(channels, n)) * top * 0.01
    return x.astype(int).clip(-top, top - 1)


@pytest.mark.parametrize("width", [8, 16, 24])
@pytest.mark.parametrize("predict", [0, 1, 8, 32])
@pytest.mark.parametrize("joint", [None, 8, 9, 10])
def test_round_trip(width, predict, joint):
    for n in (1, 2, 5, 100, 4096, 6000):
        x = signal(n, 2 if joint else 1 + n % 2, width)
        rate, y = flac.decode(flac.encode(x, 24000, width, predict=predict, joint=joint))
        assert rate == 24000 and (np.round(y * (1 << (width - 1))).astype(int) == x).all()


def test_loud_silent_and_many_blocks():
    x = np.array([[32767, -32768] * 50 + [0] * 100 + [7] * 40])
    for block in (16, 33, 4096):
        assert (flac.decode(flac.encode(x, 8000, 16, block))[1] * 32768 == x).all()
    long = signal(16 * 300, 1, 16)
    assert (flac.decode(flac.encode(long, 8000, 16, 16))[1] * 32768 == long).all()


def clip_of(body: str, n: int, width: int = 16) -> bytes:
    """A clip of one frame whose subframe is given as bits."""
    info = _bits(n, 16) * 2 + _bits(0, 48) + _bits(8000, 20) + _bits(0, 3) + _bits(width - 1, 5) + _bits(n, 36) + _bits(0, 128)
    head = bytes([0xFF, 0xF8, 0x70, flac.WIDTHS.index(width) << 1, 0]) + (n - 1).to_bytes(2, "big")
    data = int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big")
    frame = head + bytes([flac.crc8(head)]) + data
    return flac.MAGIC + b"\x04\x00\x00\x02ab" + b"\x80\x00\x00\x22" + int(info, 2).to_bytes(34, "big") + frame + flac.crc16(frame).to_bytes(2, "big")


def test_partitions_escapes_wasted_bits_and_plain_samples():
    x = signal(64, 1, 16)[0]
    # four partitions, the third one plain numbers of 18 bits
    left = np.diff(x, 1)
    parts = [left[:15], left[15:31], left[31:47], left[47:]]
    coded = [_bits(9, 4) + _codes(p, 9) for p in parts]
    coded[2] = _bits(15, 4) + _bits(18, 5) + "".join(_bits(int(v), 18) for v in parts[2])
    fixed = "0" + _bits(9, 6) + "0" + _bits(int(x[0]), 16) + "00" + _bits(2, 4) + "".join(coded)
    assert (flac.decode(clip_of(fixed, 64))[1][0] * 32768 == x).all()
    # two bits wasted: plain samples of 14 bits
    plain = "0" + _bits(1, 6) + "1" + "01" + "".join(_bits(int(v) >> 2, 14) for v in x)
    assert (flac.decode(clip_of(plain, 64))[1][0] * 32768 == x >> 2 << 2).all()


def test_broken_clips_are_refused():
    data = flac.encode(signal(3000, 1, 16), 24000, block=1000)
    for at in range(42, len(data), 97):  # any changed byte of a frame
        with pytest.raises(flac.Broken):
            flac.decode(data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1 :])
    for cut in (0, 3, 10, 41, 60, len(data) - 1, len(data) // 2):
        assert readers.decoded(data[:cut]) is None
    rng = np.random.default_rng(3)
    for _ in range(200):
        assert readers.decoded(flac.MAGIC + rng.bytes(120)) is None
        assert readers.decoded(b"RIFF" + rng.bytes(80)) is None


def wave_of(data: bytes, kind: int, channels: int, rate: int, width: int, extensible: bool = False) -> bytes:
    size = channels * width // 8
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * size, size, width)
    if extensible:
        form += struct.pack("<HHIH", 22, width, 0, kind) + b"\x00" * 14
    chunk = lambda name, part: name + struct.pack("<I", len(part)) + part + b"\x00" * (len(part) % 2)
    whole = b"WAVE" + chunk(b"fmt ", form) + chunk(b"LIST", b"odd") + chunk(b"data", data)
    return b"RIFF" + struct.pack("<I", len(whole)) + whole


def test_waves_of_all_widths():
    x = np.array([0.5, -0.25, 0.0, -1.0])
    for extensible in (False, True):
        for width in (16, 24, 32):
            data = b"".join(int(v * (1 << (width - 1))).to_bytes(width // 8, "little", signed=True) for v in x)
            rate, got = readers.decoded(wave_of(data, 1, 1, 8000, width, extensible))
            assert rate == 8000 and (got == x).all()
            assert (readers.decoded(wave_of(data, 1, 2, 8000, width, extensible))[1] == [0.125, -0.5]).all()
            assert (readers.decoded(wave_of(data, 1, 2, 8000, width, extensible), "first")[1] == [0.5, 0.0]).all()
    for width in (32, 64):
        assert (readers.decoded(wave_of(x.astype(f"<f{width // 8}").tobytes(), 3, 1, 8000, width))[1] == x).all()
    assert (readers.decoded(wave_of(bytes([192, 96, 128, 0]), 1, 1, 8000, 8))[1] == x).all()
    assert readers.decoded(wave_of(b"1234", 7, 1, 8000, 8)) is None and readers.decoded(wave_of(b"12", 1, 0, 8000, 16)) is None


def test_sixteen_bits_as_before():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[100, 300], [0, -2]], "<i2").tobytes())
    for read in (readers.pcm16, readers.decoded):
        assert read(out.getvalue())[0] == 8000 and (read(out.getvalue())[1] * 32768 == [200, -1]).all()


def test_decode_audio(spark):
    clip = flac.encode(signal(100, 1, 16), 16000)
    rows = [("a", clip), ("b", clip[:-1]), ("c", None), ("d", b""), ("e", wave_of(b"\x00\x40", 1, 1, 8000, 16))]
    got = {r["k"]: r["audio"] for r in readers.decode_audio(spark.createDataFrame(rows, "k string, content binary")).collect()}
    assert {k for k, v in got.items() if v is None} == {"b", "c", "d"} and got["a"]["sr"] == 16000 and len(got["a"]["samples"]) == 100 and got["e"]["samples"] == [0.5]


def test_decoded_clips_leave_in_small_batches():
    clip = wave_of(np.arange(50_000, dtype="<i2").tobytes(), 1, 1, 8000, 16)
    rows = pa.RecordBatch.from_pydict({"k": list(range(60)), "content": [None if k % 7 == 0 else clip for k in range(60)]})
    got = list(readers._with_audio(iter([rows]), "content", "mean"))
    sizes = [sum(len(a["samples"]) for a in b.column("audio").to_pylist() if a) for b in got]
    assert [k for b in got for k in b.column("k").to_pylist()] == list(range(60)) and sum(sizes) == 51 * 50_000
    assert max(sizes) < readers.SAMPLES + 50_000 and len(got) > 5


def test_every_changed_clip_is_set_aside(spark, tmp_path):
    """Clips whose changed byte holds the new value already."""
    from heronry.plans.queries import QUERIES

    rng, rows = np.random.default_rng(5), []
    while len(rows) < 4:
        x = rng.normal(size=64).astype(np.float32) / 4
        data = flac.encode((x.astype(float) * ((1 << 23) - 1)).astype(np.int64)[None], 100, 24)
        if data[-9] == 0x55:
            rows.append((10 * len(rows), x.tolist()))
    rows.append((1, rows[0][1]))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["flac_round_trip"](spark, f"file://{tmp_path}").toPandas()
    assert set(got.vec_id) == {1} and len(got) == 64
