"""The lossless audio format (S13): an own decoder of its frames, and a plain encoder for clips that the engine writes.

A frame stands for itself: its checksums tell a broken one, and a clip that holds one is refused as a whole. Residuals are
Rice codes: where each ends depends on the one before, so the ends are found one by one from a table of the next set bit,
and all values are read from them at once."""

from __future__ import annotations

import numpy as np

MAGIC = b"fLaC"
#: Fixed values of the format: block sizes, rates and sample widths by their codes.
RATES = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
WIDTHS = [0, 8, 12, 0, 16, 20, 24, 32]


class Broken(ValueError):
    """Bytes that are no whole clip."""


def _crc_table(polynomial: int, bits: int) -> list[int]:
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b]
    return c


class Bits:
    """Reads numbers off a stretch of bytes."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.whole, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0
        self.following: list[int] | None = None

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise Broken("a number goes beyond the end")
        self.at += n
        return self.whole >> (self.size - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        end = self.next_set()[self.at] if self.at < self.size else self.size
        if end >= self.size:
            raise Broken("a code goes beyond the end")
        n, self.at = end - self.at, end + 1
        return n

    def next_set(self) -> list[int]:
        """For each bit, where the next set one is."""
        if self.following is None:
            at = np.where(self.bits, np.arange(self.size), self.size)
            self.following = np.minimum.accumulate(at[::-1])[::-1].tolist()
        return self.following

    def numbers(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Numbers of one width at many places."""
        out = np.zeros(len(starts), np.int64)
        for k in range(width):
            out = out << 1 | self.bits[starts + k]
        return out

    def many(self, n: int, width: int) -> np.ndarray:
        """The next n signed numbers of a width."""
        if self.at + n * width > self.size:
            raise Broken("samples go beyond the end")
        out = self.numbers(self.at + width * np.arange(n), width)
        self.at += n * width
        return out - ((out >> (width - 1)) << width) if width else out

    def rice(self, n: int, low: int) -> np.ndarray:
        """The next n signed numbers in Rice codes with ``low`` low bits."""
        following, at, ends, size = self.next_set(), self.at, [], self.size
        for _ in range(n):
            if at >= size:
                raise Broken("a code goes beyond the end")
            end = following[at]
            ends.append(end)
            at = end + 1 + low
        if at > size or n and ends[-1] >= size:
            raise Broken("a code goes beyond the end")
        ends = np.array(ends, np.int64)
        starts = np.append(self.at, ends[:-1] + 1 + low)[:n]
        self.at = at
        v = (ends - starts) << low | self.numbers(ends + 1, low)
        return v >> 1 ^ -(v & 1)


def _residual(bits: Bits, n: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or n % parts or n // parts < order:
        raise Broken("partitions that don't fit")
    width, out = 4 + method, []
    for k in range(parts):
        size, low = n // parts - (order if k == 0 else 0), bits.take(width)
        out.append(bits.many(size, bits.take(5)) if low == (1 << width) - 1 else bits.rice(size, low))
    return np.concatenate(out)


def _subframe(bits: Bits, n: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise Broken("no subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        width -= wasted
    if width <= 0:
        raise Broken("no sample is left")
    if kind == 0:
        x = np.full(n, bits.signed(width), np.int64)
    elif kind == 1:
        x = bits.many(n, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = bits.many(order, width)
        x = np.concatenate([first, _residual(bits, n, order)])
        # sums of differences, each from the last difference of its order among the first samples
        for k in range(order - 1, -1, -1):
            x[order:] = np.cumsum(x[order:]) + np.diff(first, k)[-1]
    elif kind >= 32:
        order = kind - 31
        first = bits.many(order, width)
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise Broken("no prediction")
        weights = [bits.signed(precision) for _ in range(order)][::-1]
        left = _residual(bits, n, order).tolist()
        out = first.tolist()
        for k, r in enumerate(left):
            out.append(r + (sum(map(int.__mul__, weights, out[k : k + order])) >> shift))
        x = np.array(out, np.int64)
    else:
        raise Broken("an unknown subframe")
    return x << wasted


def _frame(data: bytes, at: int, rate: int, width: int) -> tuple[np.ndarray, int, int]:
    """(channels x samples, rate, first byte after the frame)."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Broken("no frame")
    size_code, rate_code, channels, width_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    k = 5 + max(0, 8 - (head[4] ^ 0xFF).bit_length() - 1)  # the coded number has as many bytes as its first one says
    if size_code in (6, 7):
        n = int.from_bytes(head[k : k + size_code - 5], "big") + 1
        k += size_code - 5
    else:
        n = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8) if size_code >= 8 else 0
    if rate_code >= 12:
        rate, k = (int.from_bytes(head[k : k + 1 + (rate_code > 12)], "big") * (1000, 1, 10, 0)[rate_code - 12], k + 1 + (rate_code > 12))
    else:
        rate = RATES[rate_code] or rate
    width = WIDTHS[width_code] or width
    if not n or channels > 10 or k >= len(head) or crc8(head[:k]) != head[k]:
        raise Broken("a broken frame header")
    count = channels + 1 if channels < 8 else 2
    most = at + k + 1 + count * (n * (width + 1) // 8 + 64) + 2
    bits = Bits(data[at + k + 1 : most])
    sides = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(channels, (0,) * count)
    x = [_subframe(bits, n, width + more) for more in sides]
    end = at + k + 1 + -(-bits.at // 8)
    if len(data) < end + 2 or crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise Broken("a broken frame")
    if channels == 8:
        x[1] = x[0] - x[1]
    elif channels == 9:
        x[0] = x[0] + x[1]
    elif channels == 10:
        both = x[0] << 1 | x[1] & 1
        x = [(both + x[1]) >> 1, (both - x[1]) >> 1]
    return np.stack(x), rate, end + 2


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, channels x samples in [-1, 1]); ``Broken`` if any frame is."""
    if data[:4] != MAGIC:
        raise Broken("no clip")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(data):
            raise Broken("no frames")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + size > len(data) or kind == 0 and size < 34:
            raise Broken("a description that ends early")
        if kind == 0:
            info = int.from_bytes(data[at + 14 : at + 22], "big")
        at += 4 + size
    if info is None:
        raise Broken("no stream description")
    rate, width, total = info >> 44, (info >> 36 & 31) + 1, info & (1 << 36) - 1
    parts = []
    while at < len(data):
        x, rate, at = _frame(data, at, rate, width)
        parts.append(x)
    if not rate or not parts and total:
        raise Broken("no frames")
    out = np.concatenate(parts, axis=1) if parts else np.zeros(((info >> 41 & 7) + 1, 0), np.int64)
    if total and out.shape[1] != total:
        raise Broken("frames are missing")
    return rate, out / (1 << (width - 1))


def _codes(values: np.ndarray, low: int) -> str:
    v = np.where(values >= 0, 2 * values, -2 * values - 1).tolist()
    return "".join("0" * (x >> low) + "1" + (format(x & (1 << low) - 1, f"0{low}b") if low else "") for x in v)


def _bits(v: int, n: int) -> str:
    return format(v & (1 << n) - 1, f"0{n}b") if n else ""


def encode(channels: np.ndarray, rate: int, width: int = 16, block: int = 4096, predict: int = 0, joint: int | None = None) -> bytes:
    """A clip (channels x whole numbers of ``width`` bits), with fixed prediction of the best order, or a linear one of
    ``predict`` samples. Two channels may go as one and the difference: ``joint`` 8, 9 or 10 (left, right or the middle)."""
    channels = np.asarray(channels, np.int64)
    count, total = channels.shape
    info = _bits(block, 16) * 2 + _bits(0, 48) + _bits(rate, 20) + _bits(count - 1, 3) + _bits(width - 1, 5) + _bits(total, 36) + _bits(0, 128)
    out = [MAGIC, b"\x80\x00\x00\x22", int(info, 2).to_bytes(34, "big")]
    for number, lo in enumerate(range(0, total, block)):
        part = channels[:, lo : lo + block]
        n = part.shape[1]
        coded = bytes([number]) if number < 128 else chr(number).encode("utf-8", "surrogatepass")
        head = bytes([0xFF, 0xF8, 0x70, (count - 1 if joint is None else joint) << 4 | WIDTHS.index(width) << 1]) + coded + (n - 1).to_bytes(2, "big")
        sides = [(x, width) for x in part]
        if joint is not None:
            difference = (part[0] - part[1], width + 1)
            sides = {8: [(part[0], width), difference], 9: [difference, (part[1], width)], 10: [(part[0] + part[1] >> 1, width), difference]}[joint]
        body = "".join(_coded(x, w, predict) for x, w in sides)
        frame = head + bytes([crc8(head)]) + int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big")
        out.append(frame + crc16(frame).to_bytes(2, "big"))
    return b"".join(out)


def _coded(x: np.ndarray, width: int, predict: int) -> str:
    n = len(x)
    if (x == x[0]).all():
        return "0" + _bits(0, 6) + "0" + _bits(int(x[0]), width)
    if predict and n > 4 * predict:
        rows = np.lib.stride_tricks.sliding_window_view(x[:-1], predict)
        best = np.linalg.lstsq(rows.astype(float), x[predict:].astype(float), rcond=None)[0]
        weights = np.clip(np.round(best * 512), -2047, 2047).astype(np.int64)
        left = x[predict:] - (rows @ weights >> 9)
        head = _bits(31 + predict, 6) + "0" + "".join(_bits(int(v), width) for v in x[:predict]) + _bits(11, 4) + _bits(9, 5) + "".join(_bits(int(w), 12) for w in weights[::-1])
    else:
        predict = min(range(min(5, n)), key=lambda k: np.abs(np.diff(x, k)).sum() + k)
        left = np.diff(x, predict)
        head = _bits(8 + predict, 6) + "0" + "".join(_bits(int(v), width) for v in x[:predict])
    low = max(0, int(np.log2(np.abs(left).mean() + 1e-9) + 1)) if len(left) else 0
    return "0" + head + "01" + "0000" + _bits(min(low, 30), 5) + _codes(left, min(low, 30))
