"""Operators 4, 8 and 10 against brute force; suffix arrays, components and sketches alone."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from .conftest import corpus

from quillspark.llm import _repeat, near_dedup, substring_dedup, suffix_dedup
from quillspark.llm._suffix import permuted_lcp, suffix_array
from quillspark.llm._text import SPACE, WORD, block_of, sliding_min
from quillspark.llm.components import components


def brute_windows(units, length):
    """Which units of each text lie in a window that starts twice or more."""
    count = Counter(u[i : i + length] for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        hit = np.zeros(len(u), bool)
        for i in range(len(u) - length + 1):
            if count[u[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_substring_words(docs_of, seed):
    texts = corpus(random.Random(seed))
    units = [tuple(t.split()) for t in texts]
    for length in (35, 5):
        hits = brute_windows(units, length)
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs_of(texts), length, with_text=True).collect()}
        for i, (u, h) in enumerate(zip(units, hits, strict=True)):
            left = " ".join(w for w, x in zip(u, h, strict=True) if not x)
            assert (got[i].n_words, got[i].n_removed, got[i].text, got[i].kept_sha256) == (len(u), h.sum(), left, hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("hot", [500, 1])
def test_suffix_bytes(docs_of, monkeypatch, hot):
    texts = [*corpus(random.Random(3), 80), "é" * 150, "aé" * 90]
    raw = [t.encode() for t in texts]
    spans = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda k, n, g: spans(k, n, g, hot))
    for length in (200, 20):
        hits = brute_windows(raw, length)
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(texts), length, with_bytes=True).collect()}
        for i, (u, h) in enumerate(zip(raw, hits, strict=True)):
            assert (got[i].n_bytes, got[i].n_removed) == (len(u), h.sum())
            assert got[i].n_spans == (np.diff(np.concatenate([[0], h.astype(int)])) == 1).sum()
            assert bytes(got[i].kept) == np.frombuffer(u, np.uint8)[~h].tobytes()


@pytest.mark.parametrize("share", [1000, 1, 8])
def test_copies_pass_joins_that_keep_the_number_of_rows(docs_of, monkeypatch, share):
    """hot and other regions came from two readings of the regions, one by a semi join that only hot rows passed."""
    monkeypatch.setattr(_repeat, "SHARE", share)  # all repeated regions are hot, none, or some
    texts = [*corpus(random.Random(11), 40), *corpus(random.Random(12), 1) * 30, *["x y " * 100] * 5]
    raw = [t.encode() for t in texts]
    out = suffix_dedup.remove_repeats(docs_of(texts))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan
    got = {r.doc_id: r.n_removed for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == [h.sum() for h in brute_windows(raw, 200)]


@pytest.mark.parametrize("length", [200, 20])
def test_hot_anchors_are_cut_in_proportion(length):
    """regions of a hot anchor went to the shards a window at a time, 200 bytes for each."""
    gram = min(48, length // 2)
    block = block_of(corpus(random.Random(5), 60))
    units = _repeat.Units(block, False)
    h, a, b = _repeat.regions(units, length, gram)
    need = [{"anchor": int(x), "n": 1, "m": 10, "a": int(y), "b": int(z)} for x, y, z in zip(h.view(np.int64), a, b, strict=True)]
    fields = pa.list_(pa.struct([("anchor", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))
    text = "".join(block.text(i).decode() for i in range(len(block)))
    batch = pa.record_batch({"doc_id": pa.array([1]), "th": pa.array([1]), "text": pa.array([text]), "need": pa.array([need], fields)})
    rows = pa.Table.from_batches(suffix_dedup._cut(length, gram, 4, 1)([batch])).to_pylist()
    starts = sorted(r["a"] + i for r in rows for i in range(len(r["data"]) - length + 1))
    assert starts == [s for x, y in zip(a.tolist(), b.tolist(), strict=True) for s in range(x, y + 1)]
    whole = int((b - a + length).sum())
    assert sum(len(r["data"]) for r in rows) <= (suffix_dedup.CELLS + 2) * whole and len(rows) <= (suffix_dedup.CELLS + 2) * len(a)
    assert length < 200 or sum(len(r["data"]) for r in rows) < 5 * whole


@pytest.mark.parametrize(("seed", "length"), [(6, 200), (7, 200), (8, 50), (9, 20)])
def test_parts_without_partners_are_not_sorted(monkeypatch, seed, length):
    gram = min(48, length // 2)
    block = block_of(corpus(random.Random(seed), 60))
    units = _repeat.Units(block, False)
    _, a, b = _repeat.regions(units, length, gram)
    p = _repeat.anchors_of(units, a, length, gram) - a
    parts = [block.buf[x : y + length].tobytes() for x, y in zip(a, b, strict=True)]
    n = np.array([1 + (i % 5 == 0) for i in range(len(parts))])
    count = Counter()
    for part, k in zip(parts, n.tolist(), strict=True):
        count.update({part[i : i + length]: k for i in range(len(part) - length + 1)})
    expected = {(i, s) for i, part in enumerate(parts) if n[i] == 1 for s in range(len(part) - length + 1) if count[part[s : s + length]] > 1}
    given, real = [], suffix_dedup.repeats_in
    monkeypatch.setattr(suffix_dedup, "repeats_in", lambda x, *rest: given.append(sum(map(len, x))) or real(x, *rest))
    for most in (1 << 23, 0):
        got = suffix_dedup.repeats_among(parts, n, p, length, gram, most)
        assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == expected and expected
    assert len(given) == 1 and given[0] < sum(map(len, parts))


def brute_components(texts, size):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_near_duplicates(docs_of, seed, size):
    rng = random.Random(seed)
    texts = corpus(rng, 150)
    base = [f"b{i}" for i in range(120)]  # copies at all distances from one text
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [f"x{rng.randint(0, 5)}"], [copy[k], "y"]])
        texts.append(" ".join(copy))
    expected = brute_components(texts, size)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(texts), size).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(expected)]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(120):
        b = bytes(rng.choice(b"abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(1, 60)))
        t = np.frombuffer(b, np.uint8)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        plcp = permuted_lcp(t, sa, 9)
        for x, y in zip(sa, sa[1:], strict=False):
            n = 0
            while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert plcp[y] == min(n, 9)


def test_kernels():
    block = block_of(["ab cd", None, "", " x y ", "tail"])
    starts, ends, first = block.words(WORD)
    assert [block.buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "x y", "tail"]
    assert first.tolist() == [0, 2, 2, 2, 3, 4] and SPACE.sum() == 6
    x = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 7, 16, 50):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_odd_rows(spark, odd):
    n = odd.count()
    words = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).collect()}
    assert words[5].n_removed == words[6].n_removed == 60_000 and words[0].n_words == words[2].n_words == 0
    assert suffix_dedup.remove_repeats(odd).count() == n
    near = near_dedup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in near}
    assert len(near) == n and by[6].component_id == 5 and not by[6].kept
    assert by[0].kept and by[0].n_shingles == 0 and by[1].component_id == 1 and by[None].kept
    one = near_dedup.unique_documents(odd)
    assert one.columns == odd.columns
    kept = sorted(one.select("doc_id", "_h", "_th", "n", "class", "c0").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in kept] == [0, 1, 2, 3, 4, 5, 7, 8, None] and {r[1:] for r in kept} == {(2, 4, 5, 6, "x")}


def doubling(k):
    out = "a"
    for _ in range(k):
        out += out.translate({97: 98, 98: 97})
    return out


def test_words_that_polynomials_confuse(docs_of):
    x = doubling(11)
    y = x.translate({97: 98, 98: 97})
    got = near_dedup.near_duplicates(docs_of([x, y, x])).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 1, 0]
    head = " ".join(f"w{i}" for i in range(34))
    got = substring_dedup.remove_repeats(docs_of([f"{head} {x}", f"{head} {y}", f"v {head} {x}"])).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [35, 0, 35]
    got = suffix_dedup.remove_repeats(docs_of([x[:256], y[:256], "c" + x[:256]]), 256).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [256, 0, 256]


def test_empty(spark, odd):
    none = odd.limit(0)
    for f in (substring_dedup.remove_repeats, suffix_dedup.remove_repeats, near_dedup.near_duplicates):
        assert f(none).count() == 0
