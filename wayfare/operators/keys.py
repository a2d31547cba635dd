"""Grouping keys shared by the operators, and keys that hold many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION = ["user_id", "session_number"]
# The user of the events, and the visit they belong to.
VISIT = ["user_id", "visit_id"]

# A key is hot when it holds more than one part in so many of all rows. There
# are fewer hot keys than that, whatever the data.
HOT_PARTS = 256


def hot_keys(rows: DataFrame, keys: Sequence[str], parts: int = HOT_PARTS) -> DataFrame:
    """The keys, without NULL, that hold more than one in ``parts`` of ``rows``: fewer than ``parts`` rows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    return counts.dropna(subset=list(keys)).filter(F.col("_rows") * parts > total).select(*keys)


def with_hot_keys(rows: DataFrame, members: DataFrame, keys: Sequence[str], parts: int = HOT_PARTS) -> DataFrame:
    """``rows`` with ``_member``: for hot keys whether they are among ``members`` (distinct keys), NULL for others.

    The look-up is broadcast, as its size is bounded by ``parts``; hot rows are not shuffled.
    """
    listed = members.withColumn("_member", F.lit(True))
    known = hot_keys(rows, keys, parts).join(listed, list(keys), "left").withColumn("_member", F.coalesce("_member", F.lit(False)))
    return rows.join(F.broadcast(known), list(keys), "left")
