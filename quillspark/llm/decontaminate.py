"""Benchmark decontamination by one Aho-Corasick automaton (operator 9).

The patterns are the windows of WINDOW consecutive words of every item (an item with fewer words is one
window). The automaton reads two signs for each word of an item, whatever its length; a document is normalised
the same way, its other words all have the same two signs, and it is scanned once; ends of matches are word
positions, which map back to offsets in the original text.

The automaton is built in each worker from the broadcast items, ``PART`` bytes of them at most. Items of more
bytes in all are cut into overlapping pieces and dealt to several automata by hash; the scans are chained in one
stage, so no size is beyond reach and nothing larger than about PART is broadcast or collected.

Defined results: a null or empty text has no words and no hits; an item without words has no window; an item
with a null id hits words but is not listed; repeated items count once; repeated documents count each; an
empty benchmark hits nothing; other columns of docs are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Words of a window.
WINDOW = 10
#: Bytes of items in one automaton; so few that their words are fewer than BASE * BASE.
PART = 2 << 20
#: Signs that come first and signs that come second in a word; the two sets are apart, so words are met whole.
BASE = 1024
#: Windows of a piece of an item.
PIECE = 4096

#: Lower-cases A-Z and blanks what is outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` then.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalised(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Words(dict):
    """The two signs of each word; words of no item share theirs."""

    def __missing__(self, word: bytes) -> str:
        return "\0\0"


class Found:
    """The automaton, and for each pattern its number of words and the items that have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.signs = Words()
        self.names = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.names)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        owners: list[list[int]] = []
        lengths: list[int] = []
        for item, text in items:
            words = normalised(text or "")
            for w in words:
                if w not in self.signs:
                    first, second = divmod(len(self.signs), BASE)
                    self.signs[w] = chr(1 + second) + chr(1 + BASE + first)
            line = "".join(map(self.signs.__getitem__, words))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                key = line[2 * i : 2 * (i + window)]
                at = self.automaton.get(key, -1)
                if at < 0:
                    self.automaton.add_word(key, at := len(owners))
                    owners.append([])
                    lengths.append(len(key) // 2)
                if item is not None:
                    owners[at].append(number[item])
        self.first = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([i for own in owners for i in own], np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.any = bool(owners)
        if owners:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit words as (first, past the last), in order of their ends, and the items found."""
        line = "".join(map(self.signs.__getitem__, words))
        spans, which = [], set()
        for end, at in self.automaton.iter(line):
            last = (end + 1) // 2
            spans.append((last - int(self.lengths[at]), last))
            which.add(at)
        items = {self.names[i] for at in which for i in self.owners[self.first[at] : self.first[at + 1]].tolist()}
        return spans, items


_built: dict[tuple, Found] = {}


def automaton(items: list[tuple[str | None, str | None]], window: int) -> Found:
    key = (window, hash(tuple(items)))
    if key not in _built:
        _built.clear()
        _built[key] = Found(items, window)
    return _built[key]


def _pieces(window: int):
    """Items in overlapping pieces of at most PIECE windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normalised(text or "")
                cut = [b" ".join(words[i : i + PIECE + window - 1]) for i in range(0, max(1, len(words) - window + 1), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array([c.decode() for c in cut], pa.string())], ["item", "text"])

    return run


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """docs with ``_spans array<struct<a, b>>`` (hit words of the normalised text) and ``_items array<string>``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(_pieces(window), "item string, text string").distinct()
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 1)).head()[0] or 0) // part))
    out = docs.withColumns({"_spans": F.array().cast("array<struct<a:int,b:int>>"), "_items": F.array().cast("array<string>")})
    if parts > 1:
        items = items.withColumn("_part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    for i in range(parts):
        own = items.where(F.col("_part") == i).select("item", "text") if parts > 1 else items
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast([tuple(r) for r in own.collect()]), window), out.schema)
    return out


def _scan(items, window: int):
    span_type = pa.list_(pa.struct([pa.field("a", pa.int32()), pa.field("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(items.value, window)
        for batch in batches:
            if not found.any:
                yield batch
                continue
            spans, ids = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                raw = text.as_py()
                if not raw:
                    continue
                own, which = found.hits(normalised(raw))
                if own:
                    spans[i] = [*spans[i], *({"a": a, "b": b} for a, b in own)]
                    ids[i] = sorted({*ids[i], *which})
            columns = [*batch.columns[:-2], pa.array(spans, span_type), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans`` for each row of docs.

    hit_spans: start:end in code points of the original text, end exclusive, for each run of hit words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, n_items, digest, places = [], [], [], [], []
            spans, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for text, own, items in zip(batch.column(1), spans, ids, strict=True):
                raw = (text.as_py() or "").encode()
                words = len(raw.translate(_TABLE).split())
                hit, runs = 0, []
                if own:
                    mask = np.zeros(words + 1, np.int8)
                    for x in own:
                        mask[x["a"] : x["b"]] = 1
                    hit = int(mask.sum())
                    at = [m.span() for m in _WORD.finditer(raw)]
                    step = np.diff(mask, prepend=0)
                    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
                        start = len(raw[: at[a][0]].decode())
                        runs.append(f"{start}:{start + len(raw[at[a][0] : at[b - 1][1]].decode())}")
                n_words.append(words)
                n_hit.append(hit)
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
                places.append(",".join(runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(places, pa.string())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scanned(docs, benchmark, window).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans string")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, unchanged."""
    names = docs.columns
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))
    return scanned(plain, benchmark, window).where(F.size("_spans") == 0).drop("_spans", "_items").toDF(*names)
