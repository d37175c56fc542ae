import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, repeated rows, a null id, clashing extra columns."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [None, "", " \n\t ", "a", "a b c", long, long, "same words here " * 20, "same words here " * 20, "e@x.org " + "é" * 50, "null id text"]
    df = docs_of(texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, 8, None])
    return df.withColumns({"_score": F.lit(1), "c0": F.lit("x"), "_h": F.lit(2), "score": F.lit(3), "_th": F.lit(4), "n": F.lit(5), "class": F.lit(6)})


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(pairs):
        return spark.createDataFrame([(i, q, 0) for i, q in pairs], "doc_id long, quality int, toxic int")

    return make


def corpus(rng, n=120):
    """Documents with exact copies, near copies, shared passages and short ones."""
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            text = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 10, 50, 120]))]
            if kind > 0.8:
                text.insert(rng.randint(0, len(text)), passage)
            out.append(" ".join(text))
    return out
