"""Count-min sketch: partition sketches are merged by cell, then broadcast as bits."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows, and log2 of cells a row, at least and at most: at least four cells a hash that is expected, until the
#: bits that are broadcast have 32 MB. Beyond that the sketch lets more through, and exact grouping does the rest.
DEPTH, LEAST, MOST = 2, 25, 27
#: log2 of cells that travel together.
PIECE = 19
#: Hashes that a task holds before it hands on a sketch of them.
HELD = 1 << 21
_MULT = np.array([0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB], np.uint64)


def bits_for(expected: int) -> int:
    return min(MOST, max(LEAST, (4 * expected).bit_length()))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _MULT[row]) >> np.uint64(64 - bits)


def _partial(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A sketch of the hashes, non-empty pieces only: the cells with a count, each with whether that is over 1."""
    h = np.concatenate(held)
    ids, data = [], []
    for row in range(DEPTH):
        own = np.sort(cells(h, row, bits))
        first = np.ones(len(own), bool)
        first[1:] = own[1:] != own[:-1]
        at = np.flatnonzero(first)
        own, over = own[at], np.diff(np.append(at, len(own))) > 1
        marked = ((own & np.uint64((1 << PIECE) - 1)).astype(np.uint32) << np.uint32(1)) | over
        cut = np.searchsorted(own, np.arange((1 << (bits - PIECE)) + 1, dtype=np.uint64) << np.uint64(PIECE))
        for piece in np.flatnonzero(np.diff(cut)).tolist():
            ids.append((row << (bits - PIECE)) + piece)
            data.append(zlib.compress(np.diff(marked[cut[piece] : cut[piece + 1]], prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["piece", "data"])


def merged(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: int) -> np.ndarray:
    """Bits ``[row, cell // 8]`` of the cells whose merged count is 2 or more.

    Counts stop at 2. A hash that occurs twice has 2 in both of its cells, so none is lost; others may
    collide. Every task sends the non-empty pieces of its own sketches; a piece is merged in one task.
    """
    bits = bits_for(expected)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for h in hashes(batch):
                held.append(h)
                n += len(h)
                if n > HELD:
                    yield _partial(held, bits)
                    held, n = [], 0
        if held:
            yield _partial(held, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(total >= 2).tobytes(), 1)], pa.binary())], ["piece", "data"])

        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if piece != now:
                    if now is not None:
                        yield out()
                    now, total = piece, np.zeros(1 << PIECE, np.uint8)
                marked = np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32), dtype=np.uint32)
                cell = marked >> 1
                total[cell] = np.minimum(total[cell] + 1 + (marked & 1), 2)
        if now is not None:
            yield out()

    parts = docs.mapInArrow(partial, "piece int, data binary")
    n = DEPTH << (bits - PIECE)
    done = parts.repartition(min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, data binary")
    out = np.zeros((DEPTH, 1 << (bits - 3)), np.uint8)
    for piece, data in done.collect():  # at most 32 MB
        row, at = divmod(piece, 1 << (bits - PIECE))
        out[row, at << (PIECE - 3) : (at + 1) << (PIECE - 3)] = np.frombuffer(zlib.decompress(bytes(data)), np.uint8)
    return out


def repeated(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is estimated to occur twice or more."""
    out = np.ones(len(h), bool)
    size = bits.shape[1].bit_length() + 2
    for row in range(DEPTH):
        c = cells(h, row, size)
        out &= (bits[row, c >> np.uint64(3)] >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out
