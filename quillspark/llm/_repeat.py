"""Repeated windows of fixed length, found through regions that the text itself delimits.

Every window of L units (words or bytes) holds L-q+1 grams of q units; the one with the least hash (leftmost
of equals) is the window's anchor. The choice depends on the window's content alone, so equal windows have
equal anchors at the same offset. Consecutive windows of one anchor form a region; a text of n units has
about 2n/(L-q+2) of them. Regions are what is shuffled: a row for each, instead of one for each window.

1. A count-min sketch of the anchors (merged from partition sketches) drops regions whose anchor is
   estimated to occur once: a window has its region's anchor, so the estimate never falls short of the
   window's count and no repeated window is lost.
2. Regions with equal anchor and content (128 bits) are counted (partial aggregation bounds hot ones). A
   region that occurs twice repeats all its windows. Regions with over a thousandth of all rows are under a
   thousand; these are broadcast and their rows spread by place, so no task has one alone.
3. Only where an anchor has several different regions, of which some occur once, are windows compared
   one by one, among one representative of each: ``inner`` says which.

Rows are known by (doc_id, hash of the text): repeated rows and null ids are handled as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from ._scratch import materialize
from ._text import CODES, WORD, Block, Sums, blocks, content, expand, grams, sequences, sliding_min

_LOW = np.uint64((1 << 31) - 1)
REGION = "doc_id long, th long, anchor long, region long, region2 long, a int, b int"
#: Regions with more than one in so many rows are hot.
SHARE = 1000


class Units:
    """What is compared: ``first`` has each text's first unit."""

    def __init__(self, block: Block, words: bool):
        self.block, self.words = block, words
        if words:
            self.starts, self.ends, self.first = block.words(WORD)
            self.n = len(self.starts)
            self.known: dict[int, np.ndarray] = {}
        else:
            self.first, self.n = block.offs, len(block.buf)

    def values(self, which: int) -> np.ndarray:
        """A hash of each word."""
        if which not in self.known:
            self.known[which] = content(self.block.buf, self.starts, self.ends, which)
        return self.known[which]

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all q units in a row, which only have to be equal for equal units."""
        return grams(self.values(0), q) if self.words else Sums(CODES[0][self.block.buf]).grams(q)

    def content(self, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
        """A hash of the units from a to b, as they are."""
        return sequences(self.values(which), a, b, which) if self.words else content(self.block.buf, a, b, which)

    def windows(self, length: int, which: int) -> np.ndarray:
        """Hashes of all windows of words, as they are."""
        return grams(self.values(which), length, which)


def regions(units: Units, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Anchor hashes, first and last window starts of all regions, in units of the block."""
    none = np.zeros(0, np.int64)
    if units.n < length:
        return none.astype(np.uint64), none, none
    every = units.grams(q)
    least = sliding_min((every & ~_LOW) | np.arange(len(every), dtype=np.uint64), length - q + 1)
    till = np.repeat(units.first[1:], np.diff(units.first))[: len(least)]
    start = np.flatnonzero(np.arange(length, length + len(least)) <= till)
    if not len(start):
        return none.astype(np.uint64), none, none
    at = (least[start] & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1
    return every[at[a]], start[a], start[b]


def anchors_of(units: Units, a: np.ndarray, length: int, q: int) -> np.ndarray:
    """Where the anchors of the windows that start at ``a`` lie, as ``regions`` has them."""
    every = units.grams(q)
    rank = np.append((every & ~_LOW) | np.arange(len(every), dtype=np.uint64), np.uint64(2**64 - 1))
    ends = np.column_stack([a, a + length - q + 1]).ravel()
    return (np.minimum.reduceat(rank, ends)[::2] & _LOW).astype(np.int64)


def spans(docs: DataFrame, length: int, q: int, words: bool, inner: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``doc_id, th, spans array<struct<a, b>>``: first and last starts of repeated windows, relative to the text.

    docs: doc_id, text, th. inner: from ``doc_id, th, text, need array<struct<anchor, n, m, a, b>>`` (texts with
    regions to compare; n: their number, m: regions of the anchor), and the same without the text, to rows
    ``doc_id, th, a, b`` of repeated windows in regions with n = 1.
    """

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block, _, _ in blocks(batch):
            h, _, _ = regions(Units(block, words), length, q)
            if len(h):
                yield h

    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    units_at_most = total / (4 if words else 1)  # words are longer as a rule; only the sketch's size depends on it
    sketch = _sketch.merged(docs.select("text"), anchors, int(2 * units_at_most / (length - q + 2)))
    bits = docs.sparkSession.sparkContext.broadcast(sketch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, _ in blocks(batch):
                units = Units(block, words)
                h, a, b = regions(units, length, q)
                keep = _sketch.repeated(bits.value, h) if len(h) else np.zeros(0, bool)
                if not keep.any():
                    continue
                h, a, b = h[keep], a[keep], b[keep]
                whole = [pa.array(units.content(a, b + length, which).view(np.int64)) for which in (0, 1)]
                text = np.searchsorted(units.first, a, "right") - 1
                row = pa.array(text + at)
                base = units.first[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")).take(row), batch.column(batch.schema.get_field_index("th")).take(row), pa.array(h.view(np.int64)), *whole, pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))],
                    ["doc_id", "th", "anchor", "region", "region2", "a", "b"],
                )

    found = materialize(docs.mapInArrow(rows, REGION))
    key = ["anchor", "region", "region2"]
    classes = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "a", "b")).alias("r"))
    classes = materialize(classes)
    most = (classes.agg(F.sum("n")).head()[0] or 0) // SHARE + 1
    hot = F.broadcast(classes.where(F.col("n") > most).select(*key, F.lit(True).alias("hot")))  # under SHARE rows
    cold = classes.where((F.col("n") > 1) & (F.col("n") <= most)).select(*key, F.lit(True).alias("cold"))
    place = ["doc_id", "th", "a", "b"]
    # both joins give a row for each region found; hot ones, known already, are spread by their place
    marked = found.join(hot, key, "left").withColumn("region", F.when(F.col("hot"), F.xxhash64(*place)).otherwise(F.col("region")))
    whole = marked.join(cold, key, "left").where("hot or cold").select(*place)
    per_anchor = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    need = classes.join(per_anchor, "anchor").select("r.doc_id", "r.th", F.struct("anchor", "n", "m", "r.a", "r.b").alias("x"))
    need = materialize(need.groupBy("doc_id", "th").agg(F.collect_list("x").alias("need")))
    part = inner(keyed_join(docs, need, "inner"), need)
    return whole.unionByName(part).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def keyed_join(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """On (doc_id, th), null ids included."""
    o = other.withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
    return docs.join(o, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")), how).drop("_doc_id", "_th")


def lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and values of a list column (nulls: empty)."""
    n = np.array(column.value_lengths().fill_null(0), np.int64)
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    return offs, column.flatten()


def field(values: pa.StructArray, name: str) -> np.ndarray:
    return values.field(name).to_numpy(zero_copy_only=False)


def starts_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of a..b for each pair, and the pair each comes from."""
    n = b - a + 1
    return expand(a, n)[0], np.repeat(np.arange(len(a)), n)


def covered(size: int, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` units lie in a window that starts in one of the spans."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, np.minimum(b + length, size), -1)
    return np.cumsum(step[:-1]) > 0
