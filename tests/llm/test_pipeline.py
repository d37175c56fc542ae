"""Operator 3 and the stages of the pipeline against brute force; queries with SQL."""

import random
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, near_dedup, pii, queries


def test_mixed(spark, docs_of, odd):
    sources = ["hot"] * 700 + ["b"] * 90 + ["c"] * 20 + [None] * 5
    docs = docs_of([f"t{i}" for i in range(len(sources))], sources=sources)
    rows = mixing.mixed(docs, {"hot": 2, "b": 1, "c": 1, None: 1}, block=4).collect()
    assert len(rows) == len(sources) and len({r.mix_position for r in rows}) == len(rows)
    first = {}
    for r in rows:
        first.setdefault((r.source, r.mix_block), set()).add(r.mix_slot)
    assert all(len(x) == 1 for x in first.values())
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).columns[: len(odd.columns)] == odd.columns


def deviation(order, blocks, weights):
    """The most blocks that a source is off its exact share, over all slots; order: the source of each slot."""
    total = {s: Fraction(weights[s]) for s in blocks}
    ideal, ran, worst = dict.fromkeys(blocks, Fraction(0)), dict.fromkeys(blocks, 0), 0
    for s in order:
        left = Fraction(1)
        while left:
            live = [x for x in blocks if ideal[x] < blocks[x]]
            rate = sum(total[x] for x in live)
            step = min(left, *((blocks[x] - ideal[x]) * rate / total[x] for x in live))
            for x in live:
                ideal[x] += step * total[x] / rate
            left -= step
        ran[s] += 1
        worst = max(worst, *(abs(ran[x] - ideal[x]) for x in blocks))
    return worst


def test_exact_weights():
    rng = random.Random(2)
    for _ in range(20):
        blocks = {f"s{i}": rng.randint(1, 40) for i in range(rng.randint(1, 9))}
        weights = {s: rng.choice([rng.random() + 1e-3, 1, 0.25]) for s in blocks}
        got = list(mixing.exact_slots(blocks, weights))
        assert [t for _, _, t, _ in got] == list(range(sum(blocks.values())))
        assert all([i for x, i, _, _ in got if x == s] == list(range(b)) for s, b in blocks.items())
        assert deviation([s for s, *_ in got], blocks, weights) < 1
        assert [p for *_, p in got] == sorted(p for *_, p in got)


def test_deviation_does_not_grow(spark):
    # weights far from n/1024, one of them under 1/1024, and one block a row
    weights = {"big": (1 / 3) ** 0.5, "tiny": 0.0005, **{f"s{i}": (2 / 57) ** 0.5 for i in range(19)}}
    n = {"big": 4000, "tiny": 20, **{f"s{i}": 1300 for i in range(19)}}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s in n for _ in range(n[s]))], "doc_id long, source string")
    rows = sorted(mixing.places(docs, weights=weights, block=1).select("mix_slot", "mix_phase", "source").collect())
    assert [r.mix_slot for r in rows] == list(range(sum(n.values())))
    ran, total = dict.fromkeys(n, 0), sum(weights.values())
    for t, r in enumerate(rows):
        if r.mix_phase or t + 1 >= len(rows):
            break
        ran[r.source] += 1
        assert all(abs(c - (t + 1) * weights[s] / total) < 1.000001 for s, c in ran.items())
    assert t > 15_000


def test_placement_against_the_schedule(docs_of):
    rng = random.Random(7)
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(300)]
    weights = {"a": 0.0001, "b": 2.0, "c": 1.0, None: 0.5}
    rows = mixing.mixed(docs_of([f"t{i}" for i in range(300)], sources=sources), weights, block=4).collect()
    sizes = {s: sources.count(s) for s in set(sources)}
    key = {s: "n" if s is None else f"s{s}" for s in sizes}
    slots = {(g, i): t for g, i, t, _ in mixing.exact_slots({key[s]: -(-n // 4) for s, n in sizes.items()}, {key[s]: w for s, w in weights.items()})}
    held = {}
    for r in rows:
        assert r.mix_slot == slots[key[r.source], r.mix_block] and r.mix_position // 4 == r.mix_slot
        held.setdefault((r.source, r.mix_block), []).append(r.mix_position)
    for s, n in sizes.items():  # full blocks, but for the last
        assert [len(held[s, i]) for i in range(-(-n // 4))] == [4] * (n // 4) + [n % 4] * (n % 4 > 0)
    with pytest.raises(ValueError, match="positive"):
        mixing.mixed(docs_of(["x"]), {"s": 0})


def test_extra_columns_of_working_names(docs_of):
    docs = docs_of(["x", "y", None], [1, None, None], ["a", "b", None]).withColumns({c: F.lit(i) for i, c in enumerate(("_h", "_g", "_b", "_n", "_r", "_slot", "_before", "c0"))})
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 3 and {r[5:13] for r in rows} == {tuple(range(8))}


def test_every_source_keeps_its_weight(spark):
    n = {f"s{i}": 40 if i < 280 else 20 for i in range(320)}
    weights = {s: 3.0 if i >= 280 else 1.0 for i, s in enumerate(n)}  # the rarest sources weigh most
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s in n for _ in range(n[s]))], "doc_id long, source string")
    rows = sorted(mixing.places(docs, weights=weights, block=1).select("mix_slot", "mix_phase", "source").collect())
    assert [r.mix_slot for r in rows] == list(range(sum(n.values())))
    ran, total = dict.fromkeys(n, 0), sum(weights.values())
    first = [r.source for r in rows if r.mix_phase == 0]
    assert len(first) > 2500
    for t, s in enumerate(first):
        ran[s] += 1
        if t % 50 == 0:
            assert all(abs(c - (t + 1) * weights[x] / total) < 1.000001 for x, c in ran.items())


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("small")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return str(out)


def test_stages(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    good = pipeline.good(spark, docs, small)
    kept = {r.doc_id for r in queries.op2_quality_classifier(spark, small).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    one = pipeline.unique(spark, docs.union(docs.limit(5)), small)
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect())
    clean = pipeline.unseen(spark, docs, small)
    dirty = {r.doc_id for r in queries.op9_decontamination(spark, small).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - dirty
    safe = pipeline.private(spark, docs, small)
    left = pii.report(safe).agg(F.sum("n_email"), F.sum("n_ip"), F.sum("n_card"), F.sum("n_phone")).head()
    assert safe.columns == docs.columns and sum(left) == 0
    mixed = pipeline.mixture(spark, docs, small)
    assert mixed.count() == docs.count()


def test_whole_pipeline(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, small).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) == len({r.mix_position for r in rows})


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        c = sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(*c).collect()))) == sorted(map(repr, con.sql(sql).select(*c).fetchall()))
