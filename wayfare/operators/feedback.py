"""Sentiment of feedback texts by a word lexicon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels with their polarity limits, in testing order. The first
# match wins, so "hate" is reached by relabelling only.
VERY_GOOD, GOOD, NORMAL, BAD, HATE = "very good", "good", "normal", "bad", "hate"
VERY_GOOD_ABOVE = 0.5

# A label stays when its count exceeds this ratio of the biggest
# label, else the texts of its condition take the next label down.
RELABEL = (
    (VERY_GOOD, 0.1, GOOD),
    (GOOD, 0.2, NORMAL),
    (NORMAL, 0.6, BAD),
    (BAD, 0.1, HATE),
)


def polarity(feedback: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys..., polarity``: mean polarity of the lexicon words in each text.

    Texts without a known word get 0, NULL texts NULL. Words meet the lexicon
    row by row and are summed per text on the map side; the shuffle carries
    keys and two numbers, never the text.
    """
    words = F.split(F.lower(text), r"[^\p{L}]+")
    exploded = feedback.select(*keys, F.explode_outer(words).alias("word"), F.col(text).isNull().alias("missing"))
    scored = exploded.join(lexicon.select("word", F.col("polarity").alias("weight")), "word", "left")
    totals = scored.groupBy(*keys).agg(
        F.sum("weight").alias("weight"), F.count("weight").alias("known"), F.bool_or("missing").alias("missing")
    )
    mean = F.when(F.col("known") == 0, F.lit(0.0)).otherwise(F.col("weight").cast("double") / F.col("known"))
    return totals.select(*keys, F.when(~F.col("missing"), mean).alias("polarity"))


def label(score: str | Column = "polarity") -> Column:
    """Label of a polarity; NULL is ``normal``."""
    return _choose(score, VERY_GOOD, GOOD, NORMAL, BAD)


def labelled(scores: DataFrame) -> DataFrame:
    return scores.withColumn("sentiment_label", label())


def label_counts(labels: DataFrame) -> DataFrame:
    """``sentiment_label, count``, biggest first."""
    counts = labels.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("sentiment_label"))


def recalibrated(scores: DataFrame) -> DataFrame:
    """Relabel by each label's share of the biggest label.

    The shares are one row of at most five counts, read as a scalar subquery.
    A label that does not occur has share 0.
    """
    counts = labelled(scores).groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("count"))
    biggest = F.max("count")
    kept = [
        (F.coalesce(F.max(F.when(F.col("sentiment_label") == name, F.col("count"))), F.lit(0)) / biggest > ratio).alias(
            name
        )
        for name, ratio, _ in RELABEL
    ]
    keeps = counts.agg(F.struct(*kept).alias("keeps")).scalar()
    names = [F.when(keeps[name], F.lit(name)).otherwise(F.lit(lower)) for name, _, lower in RELABEL]
    return scores.withColumn("sentiment_label", _choose("polarity", *names))


def _choose(score: str | Column, very_good: str | Column, good: str | Column, normal: str | Column, bad: str | Column):
    score = F.col(score) if isinstance(score, str) else score
    very_good, good, normal, bad = [
        F.lit(name) if isinstance(name, str) else name for name in (very_good, good, normal, bad)
    ]
    return (
        F.when(score > VERY_GOOD_ABOVE, very_good)
        .when(score > 0, good)
        .when(score == 0, normal)
        .when(score < 0, bad)
        .otherwise(F.lit(NORMAL))
    )
