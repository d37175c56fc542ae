"""Mixing sources to target weights by Pfair scheduling (operator 3).

A source's documents form blocks of BLOCK documents. Ideally all sources run at once, each at its weight's share
of the weights of those that still have blocks; block i of a source is released in the slot where its ideal run
begins and due by the end of the slot where that ends. One block runs a slot, the earliest deadline first. Then
at every slot a source has run less than one block more or less than its ideal run, however long the input is.
Weights are taken as fractions, so nothing is rounded. When a source has ideally run out, a new phase begins.

Every source is scheduled by its own weight, however many there are. One task schedules all blocks; it holds
the counts by source and streams the slots, which are joined by bucket. Documents are ranked within buckets of
their source by a hash of the id, so a source that holds most rows is dealt over many tasks.

Scheduling takes some microseconds a block; where a table has very many documents, take larger blocks.

Defined results: every row gets a place; a null source is a source; ties and repeated rows are ranked in some
order among themselves; a given weight that is not positive is an error; an empty table gives an empty result;
other columns, of any name, are kept by ``mixed``.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16
#: Slots of a batch that the scheduling task hands on.
BATCH = 1 << 16
#: Rows of a bucket, as planned, and the most buckets.
BUCKET, BUCKETS = 4096, 1 << 16


def exact_slots(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, slot, phase) in order of slots, from the exact weights."""
    names = sorted(s for s, b in blocks.items() if b > 0)
    parts = [Fraction(weights[s]) for s in names]
    scale = math.lcm(*(x.denominator for x in parts))
    w = [x.numerator * (scale // x.denominator) for x in parts]
    n = [blocks[s] for s in names]
    # sources run out at these ideal times n / w; until then slots = done + time * rate
    out = sorted((Fraction(b, x), b, x) for b, x in zip(n, w, strict=True))
    ends, done, rate = [], [0], [sum(w)]
    for end, same in itertools.groupby(out, key=lambda e: e[0]):
        same = list(same)
        ends.append(end)
        done.append(done[-1] + sum(e[1] for e in same))
        rate.append(rate[-1] - sum(e[2] for e in same))
    near = [float(e) for e in ends]
    begins = [math.ceil(d + e * r) for e, d, r in zip(ends, done, rate, strict=False)]

    def bounds(i: int, x: int) -> tuple[int, int]:
        """The slot, rounded down and up, at which a source of weight x has ideally run i blocks."""
        k = bisect_left(near, i / x)
        while k and ends[k - 1].numerator * x >= i * ends[k - 1].denominator:
            k -= 1
        while ends[k].numerator * x < i * ends[k].denominator:
            k += 1
        whole, part = divmod(i * rate[k], x)
        return done[k] + whole, done[k] + whole + (part > 0)

    coming = [(0, j, 0) for j in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    phase = 0
    for t in range(sum(n)):
        while coming and coming[0][0] <= t:
            _, j, i = coming[0]
            after, due = bounds(i + 1, w[j])
            heapq.heappush(ready, (due, j, i))
            if i + 1 < n[j]:
                heapq.heapreplace(coming, (after, j, i + 1))
            else:
                heapq.heappop(coming)
        while begins[phase] <= t:
            phase += 1
        _, j, i = heapq.heappop(ready)
        yield names[j], i, t, phase


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block: int = BLOCK) -> DataFrame:
    """docs with ``mix_phase, mix_block, mix_slot, mix_position`` (sort by it to read the mixture).

    weights: by source, positive; without, a source's share of documents to the power ``temperature``.
    """
    given = {("n" if s is None else f"s{s}"): w for s, w in (weights or {}).items()}
    if any(not w > 0 for w in given.values()):
        raise ValueError("weights must be positive")
    names = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "source", "text") else f"c{i}" for i, c in enumerate(names)))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    total = plain.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {g: k for batch in batches for g, k in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        share = {g: given.get(g) or (k / total) ** temperature for g, k in n.items()}
        for part in itertools.batched(exact_slots({g: -(-k // block) for g, k in n.items()}, share), BATCH):
            columns = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["_g", "mix_block", "mix_slot", "mix_phase"])

    buckets = max(1, min(BUCKETS, -(-total // BUCKET)))
    # where there is a text, rows without an id, or of one id, are dealt by it
    rows = plain.withColumns({"_g": key, "_h": F.xxhash64("doc_id", *(["text"] if "text" in names else []))})
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n_b"))
    slots = sizes.groupBy("_g").agg(F.sum("_n_b").alias("_n")).repartition(1).mapInArrow(run, "_g string, mix_block long, mix_slot long, mix_phase int")
    before = sizes.withColumn("_before", F.sum("_n_b").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_n_b"))
    # a bucket's slots travel with the bucket, so rows are dealt once
    own = before.withColumn("mix_block", F.explode(F.sequence(F.floor(F.col("_before") / block), F.floor((F.col("_before") + F.col("_n_b") - 1) / block)))).join(slots, ["_g", "mix_block"])
    own = own.groupBy("_g", "_b").agg(F.first("_before").alias("_before"), F.sort_array(F.collect_list(F.struct("mix_block", "mix_slot", "mix_phase"))).alias("_slots"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", "doc_id")) - 1).join(own, ["_g", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_r"))
    placed = ranked.withColumn("_slot", F.col("_slots")[(F.floor(F.col("_rank") / block) - F.floor(F.col("_before") / block)).cast("int")]).select("*", "_slot.*")
    placed = placed.withColumn("mix_position", F.col("mix_slot") * block + F.col("_rank") % block)
    added = ["mix_phase", "mix_block", "mix_slot", "mix_position"]
    return placed.select(*plain.columns, *added).toDF(*names, *added)


def places(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, mix_phase, mix_block, mix_slot, mix_position`` for each row of docs."""
    return mixed(docs.select("doc_id", "source"), **options)
