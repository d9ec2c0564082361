"""Multi-label text scores (six labels), the weighted text risk and the
any-of label.

The default scorer is a weighted lexicon ``(term, category, weight)``: the
score of a category is ``least(1, sum of the weights of the hits)``.  A
lexicon is a model parameter, not data: its terms are hash sets in the plan
and every row is scored in its own partition (no shuffle, no join).  User
models plug in through ``operators.plugins.apply_text_scorer`` instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.functions.numeric import r4
from modspark.schemas import CORPUS_LABELS, TEXT_LABELS, TEXT_RISK_WEIGHTS

# What parts the words of the lexicon scorer.
NON_WORD = r"[^\p{L}\p{N}_]+"


def lexicon_frame(spark: SparkSession, entries: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(entries, "term string, category string, weight double")


def text_risk(scores: dict[str, Column]) -> Column:
    """Weighted text risk of already-rounded label scores, rounded (fixed term order)."""
    acc = None
    for name in TEXT_LABELS:
        term = scores[name] * F.lit(TEXT_RISK_WEIGHTS[name])
        acc = term if acc is None else acc + term
    return r4(acc)


def term_key(term: str) -> str:
    """A lexicon term as the words it stands for: lower-cased, cut where texts
    are cut, joined by one space ('Kill yourself' -> 'kill yourself', "don't"
    -> 'don t').  A term without a word can never be found and is an error."""
    words = [w for w in re.split(r"[\W]+", term.lower()) if w]
    if not words:
        raise ValueError(f"lexicon term without a word: {term!r}")
    return " ".join(words)


def _hits(text: Column, keys: set[str]) -> Column:
    """The words and phrases of the lower-cased text that are lexicon terms:
    the text is cut at non-word characters once; a word, and where the lexicon
    has phrases of n words each n words in a row, is looked up in a hash set,
    whatever the number of terms.  Every occurrence is a hit."""
    tokens = F.split(F.lower(text), NON_WORD)
    by_length: dict[int, list[str]] = {}
    for k in sorted(keys):
        by_length.setdefault(k.count(" ") + 1, []).append(k)
    if not by_length:
        return F.array().cast("array<string>")
    if set(by_length) == {1}:
        return F.filter(tokens, lambda t: t.isin(by_length[1]))

    def of_length(words: Column, n: int, terms: list[str]) -> Column:
        return F.filter(words if n == 1 else _runs(words, n, terms), lambda t: t.isin(terms))

    def found(words: Column) -> Column:
        return F.concat(*[of_length(words, n, terms) for n, terms in sorted(by_length.items())])

    # cutting leaves '' at the ends of a text; the words are a lambda's
    # variable, so that they are cut once however often they are used
    return F.transform(F.array(F.filter(tokens, lambda t: t != F.lit(""))), found)[0]


def _runs(words: Column, n: int, terms: list[str]) -> Column:
    """The ``n`` words in a row that start with a first word of a term, NULL at
    other words (most of a text, for which nothing is put together).  A run
    past the end is shorter and equals no term."""
    first = sorted({t.split(" ", 1)[0] for t in terms})
    return F.transform(words, lambda t, i: F.when(t.isin(first), F.array_join(F.slice(words, i + 1, n), " ")))


def _weight_of(weights: dict[str, float]) -> Callable[[Column], Column]:
    """A token's weight; terms of equal weight share one hash-set lookup."""
    groups: dict[float, list[str]] = {}
    for term, w in sorted(weights.items()):
        groups.setdefault(w, []).append(term)

    def weight(t: Column) -> Column:
        expr = F.when(F.lit(False), F.lit(0.0))
        for w, terms in groups.items():
            expr = expr.when(t.isin(terms), F.lit(w))
        return expr.otherwise(F.lit(0.0))

    return weight


def lexicon_scores(
    df: DataFrame, lexicon: DataFrame | list[tuple[str, str, float]], text_col: str = "text"
) -> DataFrame:
    """Add the six label scores and ``text_risk_score`` to every row of ``df``.

    ``lexicon`` is a ``(term, category, weight)`` table, or its entries when
    the caller holds them already (no job to read them back); terms are words
    or phrases in any case (``term_key``), weights of equal ones add up; either way every
    row is scored in place, so row ids play no part: repeated or NULL ids,
    and any number of terms, give the same scores.  Rows whose text is not
    scoreable score zero; callers that must not score them filter first
    (``validate.accepted``).
    """
    from modspark.operators.partitioning import computed_once, spread

    df = spread(df)
    if isinstance(lexicon, DataFrame):
        lexicon = lexicon.select("term", "category", "weight").collect()  # a model parameter, not data
    by_cat: dict[str, dict[str, float]] = {c: {} for c in TEXT_LABELS}
    for term, cat, w in lexicon:
        if cat in by_cat:
            key = term_key(str(term))
            by_cat[cat][key] = by_cat[cat].get(key, 0.0) + float(w)
    # a NULL text has no hits (not a NULL total: least(1, NULL) would be 1)
    hits = F.coalesce(_hits(F.col(text_col), {t for c in by_cat.values() for t in c}), F.array().cast("array<string>"))
    cols = {}
    for cat in TEXT_LABELS:
        weights = by_cat[cat]
        if weights:
            weight = _weight_of(weights)
            total = F.aggregate(F.col("_hits"), F.lit(0.0), lambda acc, t: acc + weight(t))
        else:
            total = F.lit(0.0)
        cols[cat] = r4(F.least(F.lit(1.0), total))
    out = computed_once(df.withColumn("_hits", hits), cols).drop("_hits")
    return out.withColumn("text_risk_score", text_risk({c: F.col(c) for c in TEXT_LABELS}))


def text_scores_struct(prefix: str = "") -> Column:
    """Pack the flat score columns into the ``text_scores`` struct."""
    return F.struct(
        *[F.col(prefix + c).alias(c) for c in TEXT_LABELS],
        F.col(prefix + "text_risk_score").alias("risk_score"),
    )


def any_label(df: DataFrame, label_cols: list[str] | None = None, out: str = "label") -> DataFrame:
    """``label = (sum of the label columns) > 0`` as 0/1."""
    cols = label_cols or CORPUS_LABELS
    total = None
    for c in cols:
        v = F.coalesce(F.col(c), F.lit(0))
        total = v if total is None else total + v
    return df.withColumn(out, (total > 0).cast("int"))
