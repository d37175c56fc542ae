"""Vectorised kernels over the UTF-8 bytes of many texts at once.

A block is a concatenation of whole texts with their offsets. All functions work on numpy arrays, so the
cost a byte is a few array passes and memory is bounded by the block (``BLOCK`` bytes, or one longer text).
Two kinds of hashes: ``Sums`` are polynomials modulo 2**64, quick for all q-grams but with collisions that
texts can be made for, so they only deal out work; ``content`` and ``grams`` mix every eight bytes (or every
value) with its place, and stand for the content itself, two of them for 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a pass over them holds some dozens of bytes for each.
BLOCK = 1 << 19

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: Two independent random codes for every byte value.
CODES = _rng.integers(1, 2**64, size=(2, 256), dtype=np.uint64)
_BASES = [(0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5)]
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        row = np.full(size, base, _U)
        row[0] = 1
        have = np.cumprod(row, dtype=_U)
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


#: Odd constants of the independent content hashes, and what a place is worth.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACE = (_U(0xD1342543DE82EF95), _U(0xAF251AF3B0F025B5))
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)


def expand(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, first + 1, ... of n values each, the place of each among its own, and where each run begins."""
    begin = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(begin, n)
    return np.repeat(first, n) + place, place, begin


def _folded(x: np.ndarray, place: np.ndarray, begin: np.ndarray, n: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    x = mix(mix(x ^ _U(SEEDS[which])) + (place.astype(_U) + _U(1)) * _PLACE[which])
    out = np.zeros(len(n), _U)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(x, begin[some])
    return mix(out + size.astype(_U) * _U(SEEDS[1 - which]))


def content(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each segment, eight bytes a step."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    n = (size + 7) >> 3
    _, place, begin = expand(starts, n)
    at = np.repeat(starts, n) + 8 * place
    x = eight[at] & _KEEP[np.minimum(np.repeat(ends, n) - at, 8)]
    return _folded(x, place, begin, n, size, which)


def sequences(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the values of each segment."""
    n = ends - starts
    at, place, begin = expand(starts, n)
    return _folded(values[at], place, begin, n, n, which)


def grams(values: np.ndarray, q: int, which: int = 0) -> np.ndarray:
    """Hashes of all q consecutive values, by start: pairs, pairs of pairs and so on, then those that make up q."""
    step = _U(SEEDS[which])
    out, have, power, size = None, 0, values, 1
    while True:
        if q & size:
            n = len(values) - have - size + 1
            if n <= 0:
                return np.zeros(0, _U)
            out = power[:n].copy() if out is None else mix(out[:n] * step + power[have : have + n] + _PLACE[which])
            have += size
        size *= 2
        if size > q:
            return out
        half = size // 2
        power = mix(power[:-half] * step + power[half:]) if len(power) > half else power[:0]


class Sums:
    """Prefix sums of ``values[i] * base**i``; ``of(a, b)`` hashes the values from a to b."""

    def __init__(self, values: np.ndarray, which: int = 0, level: int = 0):
        base = _BASES[which][level]
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:], dtype=_U)
        self.back = _inverse(base)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * powers(self.back, len(self.sums))[a])

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all q-grams, by start."""
        n = len(self.sums) - q
        if n <= 0:
            return np.zeros(0, _U)
        return mix((self.sums[q:] - self.sums[:-q]) * powers(self.back, n))


class Block:
    """Whole texts: ``buf`` their bytes, text i is ``buf[offs[i]:offs[i+1]]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def words(self, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text (and the end) its first word."""
        n = len(self.buf)
        edge = np.zeros(n + 2, np.int8)
        inside = table[self.buf]
        edge[1 : n + 1] = inside
        step = np.diff(edge)  # step[i]: before byte i
        starts, ends = step == 1, step == -1
        for cut in (self.offs[(self.offs > 0) & (self.offs < n)],):
            both = cut[inside[cut] & inside[cut - 1]]  # a word may not span two texts
            starts[both] = True
            ends[both] = True
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
        return starts, ends, np.searchsorted(starts, self.offs)

    def points(self) -> np.ndarray:
        """Code points before each byte and the end."""
        out = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=out[1:])
        return out


def block_of(texts: list[str | bytes | None]) -> Block:
    raw = [b"" if t is None else t.encode() if isinstance(t, str) else t for t in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) for t in raw], out=offs[1:])
    return Block(np.frombuffer(b"".join(raw), np.uint8), offs)


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK) -> Iterator[tuple[Block, int, int]]:
    """Blocks of a batch with the rows they cover; nulls are empty texts. No text is copied."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield Block(buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]), at, to
        at = to


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = w - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x
