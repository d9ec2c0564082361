"""Text model on Spark: relational TF-IDF, vocabulary top-k, linear scoring
as a join, logistic-regression training and scoring.

TF-IDF follows the vectoriser configuration (1-2-grams, accents stripped,
sub-linear tf ``1 + ln tf``, smoothed idf ``ln((1+n)/(1+df)) + 1``, L2 norm,
``max_features`` by corpus frequency).  MLlib's ``IDF`` uses another formula
and has no sub-linear tf, so weights are computed relationally:

* vocabulary: term totals and document frequencies combined batch by batch
  (numbered words in Arrow), then the top k (a bounded
  ``TakeOrderedAndProject``); the vocabulary (k rows) is the only broadcast;
* ``(doc, term)`` counts of vocabulary terms only;
* the L2 norm: a window per document (documents are bounded by their length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark.functions.numeric import r4
from modspark.functions.text import word_bigrams_joined, word_tokens

MAX_FEATURES = 10000
MAX_VOCABULARY = 2_000_000
TASK_BYTES = 8 << 20  # of input files, for a task that counts the terms of documents
BATCH_TOKENS, BATCH_ROWS = 2_000_000, 100_000  # counted, given back at a time in Python


def _grams(text: F.Column, ngram_max: int = 2) -> F.Column:
    toks = word_tokens(text)
    return F.concat(toks, word_bigrams_joined(toks)) if ngram_max >= 2 else toks


def _batch_counts(tokens: pa.ListArray) -> pa.RecordBatch:
    """(term, freq, doc_freq) of the 1- and 2-grams of some documents.  Words
    are numbered, a gram is a number too, and one sort of (gram, document)
    gives both counts; only grams that differ become text."""
    words = tokens.flatten().dictionary_encode()
    ids, doc = words.indices.to_numpy().astype(np.int64), pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    n, docs = len(words.dictionary), len(tokens)
    pair = np.flatnonzero(doc[:-1] == doc[1:])
    key = np.concatenate([ids * docs + doc, (n + ids[pair] * n + ids[pair + 1]) * docs + doc[pair]])
    key.sort()
    gram = key // max(docs, 1)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    freq = np.diff(first, append=len(gram))
    doc_freq = np.add.reduceat(np.diff(key, prepend=-1) != 0, first, dtype=np.int64) if len(first) else freq
    gram = gram[first]
    one, two = gram[gram < n], gram[gram >= n] - n
    joined = pc.binary_join_element_wise(words.dictionary.take(pa.array(two // max(n, 1))), words.dictionary.take(pa.array(two % max(n, 1))), " ")
    term = pa.concat_arrays([words.dictionary.take(pa.array(one)).cast(pa.string()), joined.cast(pa.string())])
    return pa.RecordBatch.from_arrays([term, pa.array(freq, pa.int64()), pa.array(doc_freq, pa.int64())], names=["term", "freq", "doc_freq"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ``BATCH_TOKENS`` tokens at a time (or of one longer document)."""
    for b in batches:
        tokens = b.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(tokens):
            done = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, done + BATCH_TOKENS, "right")), start + 1)
            counts = _batch_counts(tokens.slice(start, end - start))
            for k in range(0, counts.num_rows, BATCH_ROWS):
                yield counts.slice(k, BATCH_ROWS)
            start = end


def vocabulary(docs: DataFrame, k: int = MAX_FEATURES, text_col: str = "text") -> DataFrame:
    """T5: the ``k`` most frequent 1- and 2-grams of ``docs`` (ties by term),
    with document frequency; ``index`` is the term's position in sorted order.

    Documents stay where they are and are read once: every row is a document,
    so term totals and document frequencies are counted together, batch by
    batch, and added up by term."""
    if k > MAX_VOCABULARY:
        raise ValueError(f"k is at most {MAX_VOCABULARY}: the vocabulary is sent to every executor")
    from modspark.operators.partitioning import spread

    d = spread(docs.select(F.col(text_col).alias("_text")))
    counts = d.select(word_tokens(F.col("_text")).alias("t")).mapInArrow(_term_counts, "term string, freq long, doc_freq long")
    freq = counts.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("doc_freq").alias("doc_freq"))
    top = freq.orderBy(F.col("freq").desc(), F.col("term").asc()).limit(k)
    # k rows: ordering them in one task is bounded by the vocabulary size
    return top.withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def tfidf(docs: DataFrame, vocab: DataFrame, n_docs, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """M1: ``(doc_id, term, index, weight)`` of the vocabulary terms, L2
    normalised per document.  ``n_docs`` is the number of fitted documents
    (a Column or a number); ``vocab`` comes from :func:`vocabulary`.

    The raw text is hash-partitioned by id once (it is smaller than the rows
    that it expands into), into as many partitions as the input has ``TASK_BYTES``
    so that no task's counts and sort grow with the input; terms outside the
    vocabulary are dropped right after the explode, and counts and norms need
    no further shuffle."""
    from modspark.operators.partitioning import sized
    n = n_docs if isinstance(n_docs, F.Column) else F.lit(float(n_docs))
    v = F.broadcast(vocab.select(F.col("term").alias("_t"), "index", "doc_freq"))
    d = sized(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), TASK_BYTES, "doc_id")
    ex = d.select("doc_id", F.explode(_grams(F.col("_text"))).alias("term"))
    hits = ex.join(v, ex["term"] == F.col("_t")).drop("_t")
    tf = hits.groupBy("doc_id", "term", "index", "doc_freq").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("doc_freq"))) + F.lit(1.0)
    j = tf.withColumn("_w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * idf)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return j.select("doc_id", "term", "index", (F.col("_w") / norm).alias("weight"))


def fit_tfidf(train_docs: DataFrame, text_col: str = "text", k: int = MAX_FEATURES):
    """Fit on the training documents: returns ``(vocab, n_docs)``.  ``vocab``
    is written to the checkpoint folder so later jobs reuse it instead of
    recomputing the corpus statistics."""
    return vocabulary(train_docs, k, text_col).checkpoint(eager=True), train_docs.count()


def linear_score(
    weights: DataFrame, coef: DataFrame, intercept: float, docs: DataFrame, id_col: str = "doc_id",
    with_p: bool = False,
) -> DataFrame:
    """J5 + M3: ``p = sigmoid(b + sum_t coef_t * w_dt)`` per document, with
    label toxic/clean at ``p > .5`` and confidence = risk = p (4 dp); the
    unrounded ``p`` too if ``with_p``.
    ``coef (term, coef)`` is a model parameter; its size is not bounded
    here, so AQE chooses broadcast or sort-merge from its runtime size."""
    c = coef.select("term", "coef")
    z = weights.join(c, "term").groupBy("doc_id").agg(F.sum(F.col("coef") * F.col("weight")).alias("_z"))
    d = docs.select(F.col(id_col).alias("doc_id")).join(z, "doc_id", "left")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(intercept)) + F.coalesce(F.col("_z"), F.lit(0.0)))))
    d = d.withColumn("p", p)
    return d.select(
        "doc_id",
        r4(F.col("p")).alias("risk_score"),
        r4(F.col("p")).alias("confidence"),
        F.when(F.col("p") > F.lit(0.5), F.lit("toxic")).otherwise(F.lit("clean")).alias("label"),
        *(["p"] if with_p else []),
    )


# ---------------------------------------------------------------------------
# Logistic regression on the TF-IDF vectors (MLlib)
# ---------------------------------------------------------------------------


def to_vectors(weights: DataFrame, size: int, docs: DataFrame | None = None) -> DataFrame:
    """``(doc_id, features)`` sparse vectors; documents of ``docs`` without
    any vocabulary term get an empty vector.  The entries of one document are
    bounded by its length; the per-row step only packs sorted arrays into a
    vector (no model work in Python), in Arrow batches (Spark has no
    built-in sparse-vector constructor)."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    pack = F.udf(lambda idx, val: SparseVector(size, idx or [], val or []), VectorUDT(), useArrow=True)
    per_doc = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("_e"))
    if docs is not None:
        per_doc = docs.select("doc_id").join(per_doc, "doc_id", "left")
    return per_doc.select(
        "doc_id",
        pack(F.transform("_e", lambda e: e["index"]), F.transform("_e", lambda e: e["weight"])).alias("features"),
    )


def train_logistic(
    train: DataFrame, c: float = 1.0, max_iter: int = 1000, label: str = "label", tol: float = 1e-4, n: int | None = None
):
    """M2: L2 logistic regression equivalent to ``C``: ``regParam = 1/(C n)``,
    no standardisation, intercept not penalised; stopping tolerance 1e-4 as
    in the original configuration (MLlib's own default is 1e-6).  Each
    iteration is one distributed gradient pass (tree aggregation)."""
    from pyspark.ml.classification import LogisticRegression

    n = train.count() if n is None else n
    lr = LogisticRegression(
        featuresCol="features",
        labelCol=label,
        maxIter=max_iter,
        regParam=1.0 / (c * max(n, 1)),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        tol=tol,
    )
    return lr.fit(train)
