import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # clashing names: columns that operators also make
        T.StructField("fp", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType()),
        T.StructField("spans", T.StringType()), T.StructField("score", T.StringType()), T.StructField("ids", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = langs or [None] * len(texts)
        rows = [(i, t, g, None, None, 1, "x", "x", "x", "x", "x") for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture(scope="session")
def words():
    """A reproducible source of word sequences."""
    import random

    rng = random.Random(11)
    syllables = ["an", "ter", "ou", "lin", "sh", "wen", "dor", "ka", "mi", "sul", "pra", "et"]
    vocab = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    return lambda n, seed=0: " ".join(random.Random(seed).choices(vocab, k=n))
