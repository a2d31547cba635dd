"""Feedback texts with their sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.feedback import polarity, recalibrated


def feedback_report(
    feedback: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("text",), text: str = "text"
) -> DataFrame:
    """Every feedback row with ``polarity`` and the recalibrated ``sentiment_label``.

    ``keys`` identify a text. Feedback without an id is keyed by the text
    itself: equal texts are then scored once, and each row still counts for
    the label shares.
    """
    unscored = feedback.select(text).distinct() if list(keys) == [text] else feedback
    scores = polarity(unscored, lexicon, keys, text)
    same = [F.col(f"f.{key}").eqNullSafe(F.col(f"s.{key}")) for key in keys]
    rated = feedback.alias("f").join(scores.alias("s"), same, "left").select("f.*", "s.polarity")
    return recalibrated(rated)
