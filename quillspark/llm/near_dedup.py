"""Near-duplicate documents by bottom-k sketches (operator 4).

A document's set is its distinct word shingles. One hash function orders all shingles; a sketch keeps the
least hashes: K of them for every document, WIDE for those that others may be like. Documents with equal sets
(128 bits of their content) form a class and go on as one.

* Inverted lists of retained values generate overlaps. Two sets with similarity 0.8 share at least ``SHARED``
  (``WIDE_SHARED``) of the least values of their union but for a chance under 5e-10, so each class enters only
  the lists of its rarest values, all but that many: passages that many documents share open no long lists.
* First every class meets one hub: the class of its lists with the most common values. What is linked joins
  one component. Then only pairs of different components are made, from the smaller components of a list of
  the wide sketches to the others, and only where they can be similar: they must meet early enough in both
  orders of rarity to leave room for the overlap. First each meets a few others of its lists, which joins most
  that can be joined; then it meets all that are still apart, long lists in salted pieces. So a large group of
  copies costs about its size.
* The sketch of the union estimates the similarity and filters, with the same bound.
* The full sets confirm: links have exact intersection and union sizes.

Defined results: null and empty texts have no shingles and link with nothing; texts with fewer words than a
shingle have one; a null doc_id takes part as a row, and the component's id is the least id that is not null;
repeated rows fall in one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import drop, materialize
from ._text import LOWER, WORD, Block, blocks, content, grams, sequences
from .components import components

#: Values of a sketch; values that a similar pair shares, but for a chance of P(Bin(32, 0.8) < 10) < 4e-10.
K, SHARED = 32, 10
#: The same of the wide sketches: P(Bin(1024, 0.8) < 738) < 5e-10. Sets of up to 819 are in them whole.
WIDE, WIDE_SHARED = 1024, 738
#: Members of a list that meet in one piece, where all meet.
PIECE = 512
#: Links have at least this many hundredths of the union in common.
PERCENT = 80
#: Others in a list that a class meets, round by round, before it meets all that are still in other components.
MATES = (8, 32)


def shingle_sets(block: Block, size: int) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its shingles, ascending."""
    low = LOWER[block.buf]
    starts, ends, first = Block(low, block.offs).words(WORD)
    words = content(low, starts, ends)
    every = grams(words, size).view(np.int64)
    n = np.diff(first)
    short = sequences(words, first[:-1], np.where((n > 0) & (n < size), first[1:], first[:-1])).view(np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        else:
            yield short[i : i + (b > a)]


def _identities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """128 bits of each set's content."""
    ends = np.cumsum([len(s) for s in sets])
    every = np.concatenate(sets).view(np.uint64) if sets else np.zeros(0, np.uint64)
    starts = np.append(0, ends[:-1]) if sets else np.zeros(0, np.int64)
    return [sequences(every, starts, ends, which).view(np.int64) for which in (0, 1)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, th, n, h1, h2, sketch`` a row; th is the row's hash of the text, h1 and h2 the set's identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, to in blocks(batch):
                own = list(shingle_sets(block, size))
                h1, h2 = _identities(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array([len(s) for s in own], pa.int64()), pa.array(h1), pa.array(h2), _lists([s[:K] for s in own])],
                    ["doc_id", "th", "n", "h1", "h2", "sketch"],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, h1 long, h2 long, sketch array<long>")


def _inverted(classes: DataFrame) -> DataFrame:
    """``v, class, n, score``: the lists that each class enters; score: how common its values are in all."""
    entries = classes.select("class", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    common = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = entries.join(common, "v").groupBy("class", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("x"))
    # t values at least are shared by a similar pair; the rarest k - t + 1 hold one of them; k - size(x) of those are in no other sketch
    t = F.when(F.col("n") * 5 <= K * 4, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(SHARED))
    mine = mine.withColumn("take", (F.size("x") - t + 1).cast("int")).where("take > 0")
    score = F.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + e["df"])
    return mine.select("class", "n", score.alias("score"), F.explode(F.slice("x", F.lit(1), F.col("take"))).alias("e")).select("e.v", "class", "n", "score")


def _near_sizes(a: str, b: str) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar, after the estimate by the sketch of their union."""
    one = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("all", F.array_sort(F.array_union("sa", "sb")))
    shared = F.size(F.array_intersect(F.slice("all", 1, K), F.array_intersect("sa", "sb")))
    whole = F.greatest("na", "nb") <= K
    passed = both.where(F.when(whole, F.size(F.array_intersect("sa", "sb")) * 100 >= F.size("all") * PERCENT).otherwise(shared >= SHARED)).select("a", "b", "na", "nb")
    full = passed.join(sets.select(F.col("class").alias("a"), F.col("values").alias("va")), "a").join(sets.select(F.col("class").alias("b"), F.col("values").alias("vb")), "b")
    inter = F.size(F.array_intersect("va", "vb"))
    return full.where(inter * 100 >= (F.col("na") + F.col("nb") - inter) * PERCENT).select("a", "b")


def _pairs(rare: DataFrame, mates: int | None) -> DataFrame:
    """Pairs ``a, b`` of classes in different parts that may be similar, each once.

    All members of a list but those of its commonest part meet all others, in pieces of the list; with mates,
    only the about ``mates`` others that a hash deals to the same bucket of the list, so the work is linear.
    """
    sizes = rare.groupBy("value", "part").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    main = sizes.groupBy("value").agg(F.max(F.struct("c", "part")).alias("main"), F.min("n").alias("least"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("size")).where("parts > 1").select("value", F.col("main.part").alias("main"), "least", "size")
    pieces = F.ceil(F.col("size") / (mates or PIECE)).cast("int")
    dealt = F.pmod(F.xxhash64("class", "value", F.lit(mates or 0)), pieces).cast("int")
    both = rare.join(main, "value")
    left = both.where("part <> main and most >= least").select("value", (dealt if mates else F.explode(F.sequence(F.lit(0), pieces - 1))).alias("bucket"), F.col("class").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"), F.col("most").alias("ma"))
    right = both.select("value", dealt.alias("bucket"), F.col("class").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"), F.col("most").alias("mb"), (F.col("part") == F.col("main")).alias("is_main"))
    met = left.join(right, ["value", "bucket"]).where((F.col("nb") <= F.col("ma")) & (F.col("na") <= F.col("mb")) & (F.col("pa") != F.col("pb")) & (F.col("is_main") | (F.col("a") > F.col("b"))) & _near_sizes("na", "nb"))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _wide_lists(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """``value, class, n, most``: the lists of the wide sketches that each class enters.

    place: how many rarer values the class retains, shared or not. A similar pair first meets in a list where
    both have room for its overlap: most is the largest set that there is still room for.
    """
    own = open_.select("class", "n").distinct().join(sets, "class").select("class", "n", F.explode(F.slice("values", 1, WIDE)).alias("value"))
    common = own.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = own.join(common, "value").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("x"))  # WIDE values at most
    kept = F.least("n", F.lit(WIDE))
    whole = F.col("n") * 100 <= WIDE * PERCENT  # then the sketches of all similar sets are the sets
    t = F.when(whole, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(WIDE_SHARED))
    lone = kept - F.size("x")
    mine = mine.select("class", "n", "x", lone.alias("lone"), whole.alias("whole"), (kept - t + 1 - lone).cast("int").alias("take")).where("take > 0")
    placed = mine.select("class", "n", "lone", "whole", F.posexplode(F.slice("x", F.lit(1), F.col("take"))).alias("i", "e"))
    # of two whole sets of n and m, similarity needs (n + m) * 80 / 180 in common, all of them from here on
    most = F.when(F.col("whole"), F.floor((F.col("n") - F.col("lone") - F.col("i")) * (100 + PERCENT) / PERCENT) - F.col("n")).otherwise(F.floor(F.col("n") * 100 / PERCENT))
    return placed.select("e.value", "class", "n", most.alias("most")).where(F.col("most") * 100 >= F.col("n") * PERCENT)


def _with_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))


def _full_sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """``class, values`` of the chosen ``class, doc_id, th, h1, h2``."""
    who = chosen.select("class", F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "h1", "h2")
    texts = docs.join(who, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("class", "h1", "h2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for block, at, to in blocks(batch):
                own = list(shingle_sets(block, size))
                a, b = _identities(own)
                same = np.flatnonzero((a == h1[at:to]) & (b == h2[at:to]))  # others with that id and hash of text
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at).take(pa.array(same)), _lists([own[i] for i in same])], ["class", "values"])

    return texts.mapInArrow(run, "class long, values array<long>").dropDuplicates(["class"])


def decided(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, th, n_shingles, component_id`` for each row of docs (doc_id, text, th)."""
    rows = materialize(sketches(docs, size))
    same = rows.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(same.select(F.monotonically_increasing_id().alias("class"), "h1", "h2", "r.doc_id", "r.th", "least", "n", "sketch"))
    entries = materialize(_inverted(classes))
    sets = materialize(_full_sets(docs, classes.join(entries.select("class").distinct(), "class", "left_semi"), size))

    hubs = entries.groupBy("v").agg(F.max(F.struct("score", "class", "n")).alias("hub"))
    met = entries.join(hubs, "v").where((F.col("hub.class") != F.col("class")) & _near_sizes("n", "hub.n")).select("class", F.col("hub.class").alias("hub"), F.col("hub.score").alias("score"))
    met = met.groupBy("class", "hub").agg(F.count(F.lit(1)).alias("c"), F.first("score").alias("score")).groupBy("class").agg(F.max(F.struct("c", "score", "hub")).alias("best"))
    tried = [materialize(met.select(F.greatest("class", "best.hub").alias("a"), F.least("class", "best.hub").alias("b")).distinct())]
    links = [materialize(_confirmed(tried[0], classes, sets))]
    label = materialize(components(links[0]))

    placed = entries.join(label, entries["class"] == label["node"], "left").select("v", "class", "n", F.coalesce("component", "class").alias("part"))
    several = placed.groupBy("v").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("v")
    rare = materialize(_wide_lists(placed.join(several, "v"), sets))
    drop(entries)
    for mates in (*MATES, None):
        rest = _pairs(rare.join(label, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("component", "class")), mates)
        for t in tried:
            rest = rest.join(t, ["a", "b"], "left_anti")
        tried.append(materialize(rest))
        links.append(materialize(_confirmed(tried[-1], classes, sets)))
        drop(label)
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        label = materialize(components(found))
    drop(rare, sets, *tried, *links)
    known = classes.join(label, F.col("class") == F.col("node"), "left").select("h1", "h2", "least", F.coalesce("component", "class").alias("component"))
    known = materialize(known)
    drop(classes, label)
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(ids, "component").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component_id")
    out = rows.join(named, (F.col("n") > 0) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of docs (doc_id, text).

    size: words of a shingle. kept: the document stands for its component.
    """
    out = decided(_with_hash(docs), size)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def unique_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of docs that stand for their component, unchanged; of rows with equal id and text, one.

    Rows without an id stand for themselves; of those with equal texts one stays too.
    """
    names = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names))).withColumn("_th", F.xxhash64(F.col("text").cast("string")))
    rows = decided(_with_hash(docs), size).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialize(rows.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_kept")).agg(F.count(F.lit(1)).alias("_n")))
    out = plain.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_kept")))
    if kept.where("_n > 1").head(1):  # else there is nothing to drop
        out = out.where("_n = 1").unionByName(out.where("_n > 1").dropDuplicates(["_id", "_kept"]))
    return out.drop("_th", "_id", "_kept", "_n").toDF(*names)
