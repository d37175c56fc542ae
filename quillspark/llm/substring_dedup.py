"""Substring dedup by a count-min prefilter (operator 10).

Merged partition sketches overestimate how often windows occur; a second pass groups exactly, by 128 bits of
their content, only those estimated repeated, losing none (see ``_repeat``).

Defined results: null and empty texts have no words; texts of fewer words than a window lose nothing; a
repeated row counts as another text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeat
from ._scratch import materialize
from ._text import blocks

#: Words of a window, and of the grams that may anchor it.
WINDOW, GRAM = 35, 16


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, need = _repeat.lists(batch.column(batch.schema.get_field_index("need")))
            for block, at, to in blocks(batch):
                units = _repeat.Units(block, True)
                one, two = units.windows(length, 0), units.windows(length, 1)
                part = slice(offs[at], offs[to])
                own = need.slice(part.start, part.stop - part.start)
                text = np.repeat(np.arange(at, to), np.diff(offs[at : to + 1]))
                a, b = _repeat.field(own, "a").astype(np.int64), _repeat.field(own, "b").astype(np.int64)
                s, pair = _repeat.starts_of(a, b)
                if not len(s):
                    continue
                place = s + units.first[text[pair] - at]
                row = pa.array(text[pair])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")).take(row), batch.column(batch.schema.get_field_index("th")).take(row), pa.array(one[place].view(np.int64)), pa.array(two[place].view(np.int64)), pa.array(_repeat.field(own, "n")[pair]), pa.array(s.astype(np.int32))],
                    ["doc_id", "th", "window", "window2", "n", "s"],
                )

    return run


def repeated_spans(keyed: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def inner(texts: DataFrame, need: DataFrame) -> DataFrame:
        windows = materialize(texts.mapInArrow(_windows(length), "doc_id long, th long, window long, window2 long, n long, s int"))
        again = windows.groupBy("window", "window2").agg(F.sum("n").alias("t"), F.min("n").alias("least")).where("t > 1 and least = 1").select("window", "window2")
        return windows.where("n = 1").join(again, ["window", "window2"]).select("doc_id", "th", F.col("s").alias("a"), F.col("s").alias("b"))

    return _repeat.spans(keyed, length, gram, True, inner)


def remove_repeats(docs: DataFrame, length: int = WINDOW, gram: int | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and the kept words as ``text``) for each row of docs."""
    gram = gram or max(1, min(GRAM, length // 2))
    keyed = _keyed(docs)
    joined = _repeat.keyed_join(keyed, repeated_spans(keyed, length, gram), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, spans = _repeat.lists(batch.column(batch.schema.get_field_index("spans")))
            a, b = _repeat.field(spans, "a").astype(np.int64), _repeat.field(spans, "b").astype(np.int64)
            n_words, n_removed, digests, kept = [], [], [], []
            for block, at, to in blocks(batch):
                for i in range(at, to):
                    words = block.text(i - at).split()
                    n = len(words)
                    gone = 0
                    if offs[i] < offs[i + 1]:
                        out = _repeat.covered(n, a[offs[i] : offs[i + 1]], b[offs[i] : offs[i + 1]], length)
                        gone = int(out.sum())
                        words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                    left = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(gone)
                    digests.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(left.decode())
            columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if with_text else columns, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
