"""Exact removal of repeated byte strings by suffix arrays (operator 8).

Strings that may repeat are cut out as regions that the text itself delimits (``_repeat``), so equal strings
meet in one shard whichever documents they come from. A shard concatenates its regions, sorts all suffixes by
induced sorting and computes permuted common prefixes; neighbours that agree over the length are repeats.

Regions that are equal as a whole (by 128 bits of their content) are counted before; where others share their
anchor, one of each goes into a shard. An anchor with more than ``HOT`` different regions is split: their
windows are cut into cells by the anchor's offset, and a cell goes to the shard that its core names, the bytes
that all its windows share. A region has at most ``CELLS`` + 2 cells, so the bytes sorted stay in proportion to
the input however many anchors are hot. Within a shard, cells whose core no other region has are left out.

Defined results: null and empty texts have no bytes; texts shorter than the length lose nothing; a repeated
row counts as another text; an empty table gives an empty result; other columns are ignored. The kept bytes
may not be valid UTF-8 (a cut may fall within a code point), so they are returned as a digest or as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeat
from ._suffix import permuted_lcp, suffix_array
from ._text import CODES, SEEDS, Sums, blocks, expand, mix
from .substring_dedup import _keyed

#: Bytes of a repeated string, and of the grams that may anchor it.
LENGTH, GRAM = 200, 48
#: Different regions of one anchor that may lie in one shard; more are split by content.
HOT = 500
#: A region's windows lie in about so many cells.
CELLS = 8
#: Bytes of a shard, as planned.
SHARD = 2 << 20


def width(length: int, gram: int) -> int:
    """How many neighbouring offsets to the anchor make a cell."""
    return max(1, (length - gram) // CELLS)


def cells(a: np.ndarray, b: np.ndarray, p: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    """Starts a..b by cells of ``wide`` offsets to the anchor at p: first and last starts, cell, pair.

    Equal windows have their anchor at the same offset, so they lie in the same cell.
    """
    least, most = (p - b) // wide, (p - a) // wide
    n = most - least + 1
    _, place, _ = expand(least, n)
    pair = np.repeat(np.arange(len(a)), n)
    cell = most[pair] - place
    core = p[pair] - cell * wide
    return np.maximum(a[pair], core - wide + 1), np.minimum(b[pair], core), cell, pair


def cores(sums: Sums, p: np.ndarray, cell: np.ndarray, wide: int, length: int) -> np.ndarray:
    """A hash of what all windows of a cell share, and of the cell; p: anchors."""
    core = p - cell * wide
    return mix(sums.of(core, core + length - wide + 1) + cell.astype(np.uint64) * np.uint64(SEEDS[0]))


def _cut(length: int, gram: int, shards: int, most: int):
    """Regions, as bytes, with the shard they go to and their anchor's place in them."""
    wide = width(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, need = _repeat.lists(batch.column(batch.schema.get_field_index("need")))
            for block, at, to in blocks(batch):
                own = need.slice(offs[at], offs[to] - offs[at])
                if not len(own):
                    continue
                text = np.repeat(np.arange(at, to), np.diff(offs[at : to + 1]))
                base = block.offs[text - at]
                a, b = base + _repeat.field(own, "a"), base + _repeat.field(own, "b")
                n, hot = _repeat.field(own, "n"), _repeat.field(own, "m") > most
                p = _repeat.anchors_of(_repeat.Units(block, False), a, length, gram)
                shard = _repeat.field(own, "anchor").view(np.uint64) % np.uint64(shards)
                if hot.any():
                    lo, hi, cell, pair = cells(a[hot], b[hot], p[hot], wide)
                    own_p = p[hot][pair]
                    by_core = cores(Sums(CODES[1][block.buf], 1), own_p, cell, wide, length) % np.uint64(shards)
                    a, b, p, n, shard, text, base = (np.concatenate([x[~hot], y]) for x, y in ((a, lo), (b, hi), (p, own_p), (n, n[hot][pair]), (shard, by_core), (text, text[hot][pair]), (base, base[hot][pair])))
                buf = block.buf.tobytes()
                data = [buf[x:y] for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)]
                for i in range(0, len(data), 5000):
                    j = slice(i, i + 5000)
                    row = pa.array(text[j])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(batch.schema.get_field_index("doc_id")).take(row), batch.column(batch.schema.get_field_index("th")).take(row), pa.array(shard[j].astype(np.int32)), pa.array(n[j]), pa.array((a - base)[j].astype(np.int32)), pa.array((p - a)[j].astype(np.int32)), pa.array(data[j], pa.binary())],
                        ["doc_id", "th", "shard", "n", "a", "p", "data"],
                    )

    return run


def repeats_in(parts: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, start) of all strings of the length that occur twice or more, in parts with n = 1.

    A part with n > 1 stands for n equal ones.
    """
    sizes = np.array([len(p) for p in parts])
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes + 1, out=first[1:])
    t = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no byte of UTF-8
    sa = suffix_array(t)
    plcp = permuted_lcp(t, sa, length)
    end = np.repeat(first[1:] - 1, sizes + 1)
    valid = np.arange(len(t)) + length <= end
    order = sa[valid[sa]]  # equal strings are neighbours here, as no valid suffix reaches a separator
    joined = np.zeros(len(order), bool)
    if len(order) > 1:
        rank = np.empty(len(t), np.int64)
        rank[sa] = np.arange(len(t))
        lcp = plcp[sa]
        # between two valid neighbours the least common prefix of all places passed counts
        at = rank[order]
        least = np.minimum.reduceat(lcp, at[:-1] + 1) if len(at) > 1 else np.zeros(0)
        spans_ok = at[1:] == at[:-1] + 1
        joined[1:] = np.where(spans_ok, lcp[at[1:]], least) >= length
    group = np.cumsum(~joined) - 1
    part = np.searchsorted(first, order, "right") - 1
    total = np.bincount(group, weights=n[part]) if len(group) else np.zeros(0)
    hit = (total[group] > 1) & (n[part] == 1) if len(group) else np.zeros(0, bool)
    return part[hit], (order - first[part])[hit]


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, n: np.ndarray, wide: int, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts, by part, whose core another part has too and one of these parts has n = 1; their hashes."""
    lo, hi, cell, part = cells(a, b, p, wide)
    key = np.zeros(len(lo), np.uint64)
    cuts = np.unique(np.searchsorted(lo, np.arange(0, len(t) + SHARD, SHARD)))
    for i, j in zip(cuts, cuts[1:], strict=False):  # sums of some bytes at a time
        x, y = lo[i], hi[j - 1] + length
        key[i:j] = cores(Sums(CODES[1][t[x:y]], 1), p[part[i:j]] - x, cell[i:j], wide, length)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    single = np.bincount(which, weights=n[part] == 1) > 0
    keep = ((count > 1) & single)[which]
    return lo[keep], hi[keep], part[keep], key[keep]


def repeats_among(parts: list[bytes], n: np.ndarray, p: np.ndarray, length: int, gram: int, most: int = 4 * SHARD) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeats_in``, for parts with their anchors at p; those without a partner are not sorted.

    Windows that are equal share the core of their cell; the others are left out. What is still above ``most``
    bytes (tens of thousands of parts with one core) is compared a string at a time, by its bytes.
    """
    sizes = np.array([len(x) for x in parts], np.int64)
    first = np.cumsum(sizes) - sizes
    data = b"".join(parts)
    t = np.frombuffer(data, np.uint8)
    a, b, p = first, first + sizes - length, first + p
    lo, hi, part, _ = _shared(t, a, b, p, n, width(length, gram), length)
    if not len(lo):
        return part, lo
    new = np.ones(len(lo), bool)
    new[1:] = (part[1:] != part[:-1]) | (lo[1:] != hi[:-1] + 1)
    at = np.flatnonzero(new)
    lo, hi, part = lo[at], hi[np.append(at[1:], len(hi)) - 1], part[at]
    if int((hi - lo).sum()) + len(lo) * length <= most:
        run, s = repeats_in([data[x:y] for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)], n[part], length)
        return part[run], (lo - first[part])[run] + s
    s, _, run, key = _shared(t, lo, hi, p[part], n[part], 1, length)
    part = part[run]
    order = np.argsort(key, kind="stable")
    hit = np.zeros(len(s), bool)
    for same in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        by: dict[bytes, list[int]] = {}
        for i, x in zip(same.tolist(), s[same].tolist(), strict=True):
            by.setdefault(data[x : x + length], []).append(i)
        for members in by.values():
            hit[members] = len(members) > 1
    hit &= n[part] == 1
    return part[hit], (s - first[part])[hit]


def _shards(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard; one shard is held at a time."""
        now, rows = None, []

        def out():
            t = pa.Table.from_batches(rows)
            part, s = repeats_among(t["data"].to_pylist(), t["n"].to_numpy(), t["p"].to_numpy(), length, gram)
            a = t["a"].to_numpy()[part] + s
            row = pa.array(part)
            for b in pa.table({"doc_id": t["doc_id"].take(row), "th": t["th"].take(row), "a": pa.array(a.astype(np.int32)), "b": pa.array(a.astype(np.int32))}).to_batches():
                yield b

        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if shard[i] != now and rows:
                    yield from out()
                    rows = []
                now = shard[i]
                rows.append(batch.slice(i, j - i))
        if rows:
            yield from out()

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    def inner(texts: DataFrame, need: DataFrame) -> DataFrame:
        conf = texts.sparkSession.conf
        cut_in = "if(x.m > %d, 1 + (x.b - x.a) div %d, 1)" % (hot, width(length, gram))
        size = need.select(F.expr("aggregate(need, 0L, (s, x) -> s + x.b - x.a + 1 + %d * %s)" % (length, cut_in)).alias("s")).agg(F.sum("s")).head()[0] or 0
        shards = max(1, -(-size // SHARD))
        cut = texts.mapInArrow(_cut(length, gram, shards, hot), "doc_id long, th long, shard int, n long, a int, p int, data binary")
        dealt = cut.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), shards), "shard").sortWithinPartitions("shard")
        return dealt.mapInArrow(_shards(length, gram), "doc_id long, th long, a int, b int")

    return _repeat.spans(keyed, length, gram, False, inner)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and the kept bytes as ``kept``) for each row of docs."""
    gram = gram or max(1, min(GRAM, length // 2))
    keyed = _keyed(docs)
    joined = _repeat.keyed_join(keyed, repeated_spans(keyed, length, gram), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, spans = _repeat.lists(batch.column(batch.schema.get_field_index("spans")))
            a, b = _repeat.field(spans, "a").astype(np.int64), _repeat.field(spans, "b").astype(np.int64)
            n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
            for block, at, to in blocks(batch):
                for i in range(at, to):
                    data = block.buf[block.offs[i - at] : block.offs[i - at + 1]]
                    gone = runs = 0
                    left = data
                    if offs[i] < offs[i + 1]:
                        out = _repeat.covered(len(data), a[offs[i] : offs[i + 1]], b[offs[i] : offs[i + 1]], length)
                        gone, runs = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                        left = data[~out]
                    left = left.tobytes()
                    n_bytes.append(len(data))
                    n_removed.append(gone)
                    n_spans.append(runs)
                    digests.append(hashlib.sha256(left).hexdigest())
                    if with_bytes:
                        kept.append(left)
            columns = [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if with_bytes else columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
