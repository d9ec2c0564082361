"""Plug-in seams for user models (Arrow batches via ``mapInPandas``).

* U1 text scorer: ``fn(Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]``;
  input columns ``text_key, text``; output ``text_key`` + the six label
  scores.  It runs once per **distinct** text: duplicates (which may be a
  large share of a table) are collapsed by a map-side-combined aggregate on
  the text hash, and the scores are joined back (AQE splits a hot text on
  the row side).
* U2 reviewer: same shape over ``(content_id, prompt)`` giving
  ``(content_id, raw)``.  It sees only queued rows; ``partitions`` bounds the
  number of concurrent reviewer calls, and the responses are checkpointed
  to the shared folder before use so a recomputation never calls the
  reviewer twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.functions.numeric import r4
from modspark.operators.text_scores import text_risk
from modspark.schemas import TEXT_LABELS

TEXT_SCORES_SCHEMA = "text_key string, " + ", ".join(f"{c} double" for c in TEXT_LABELS)
RESPONSES_SCHEMA = "content_id string, raw string"


def text_key(text) -> F.Column:
    return F.sha2(text, 256)


def apply_text_scorer(
    df: DataFrame,
    fn: Callable[[Iterator], Iterator],
    text_col: str = "text",
) -> DataFrame:
    """Add the six (4 dp) scores and ``text_risk_score`` from ``fn``."""
    keyed = df.withColumn("_tk", text_key(F.col(text_col)))
    distinct = keyed.groupBy("_tk").agg(F.first(text_col).alias("text")).withColumnRenamed("_tk", "text_key")
    scores = distinct.select("text_key", "text").mapInPandas(fn, TEXT_SCORES_SCHEMA)
    scores = scores.select("text_key", *[r4(F.col(c)).alias(c) for c in TEXT_LABELS])
    out = keyed.join(scores, keyed["_tk"] == scores["text_key"], "left").drop("_tk", "text_key")
    return out.withColumn("text_risk_score", text_risk({c: F.col(c) for c in TEXT_LABELS}))


def review_responses(
    queue: DataFrame,
    fn: Callable[[Iterator], Iterator],
    partitions: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """Raw responses of the reviewer for the queued prompts.

    ``partitions`` bounds how many reviewer calls run at a time (a service's
    rate limit); without it the queue is dealt over the session's shuffle
    partitions."""
    q = queue.select("content_id", "prompt")
    n = partitions or int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resp = q.repartition(n, "content_id").mapInPandas(fn, RESPONSES_SCHEMA)
    return resp.checkpoint(eager=True) if checkpoint else resp
