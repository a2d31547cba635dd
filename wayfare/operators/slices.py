"""Time slices that hold a bounded share of all rows.

A slice is a fixed span of time of one key, and one task orders it. Where a slice
holds more than one part in ``parts`` of all rows, it is cut by count: its rows are
counted by millisecond, and a new piece begins whenever another such share is full.
Only the borders of such slices are looked up. They are fewer than twice ``parts``
in all, whatever the data, so they are broadcast and the rows are not shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.times import SLICE_SECONDS, epoch_millis, slice_of
from wayfare.operators.keys import HOT_PARTS, hot_keys


def with_slices(
    rows: DataFrame, keys: Sequence[str], slice_seconds: int = SLICE_SECONDS, parts: int | None = None
) -> DataFrame:
    """``rows`` (with ``created``) with ``slice``, spread by keys and slice. Slices of a key are ordered as time is.

    ``parts`` is by default twice the number of shuffle partitions, 256 at least.
    Many rows of one key in one millisecond stay together, as do rows without a key
    or time.
    """
    if parts is None:
        parts = max(HOT_PARTS, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wide = rows.withColumn("wide", slice_of("created", slice_seconds))
    full = [*keys, "wide"]
    # Which borders a row has passed is its piece; rows of other slices have none.
    borders = _borders(wide.select(*keys, "wide", "created"), full, parts)
    passed = F.size(F.filter("borders", lambda border: border <= epoch_millis("created")))
    piece = F.when(F.col("borders").isNotNull(), passed).otherwise(0)
    cut = wide.join(F.broadcast(borders), full, "left").withColumn("slice", F.struct("wide", piece.alias("piece")))
    # Rows often come from a join on the key, whose partitioning would satisfy a window
    # by key and slice as well and leave a busy key in one task; so a shuffle is asked for.
    return cut.select(*rows.columns, "slice").repartition(*keys, "slice")


def _borders(wide: DataFrame, full: Sequence[str], parts: int) -> DataFrame:
    """The slices with more than their share, and the times at which a new piece of them begins."""
    hot = wide.join(F.broadcast(hot_keys(wide, full, parts)), list(full), "left_semi")
    cells = hot.groupBy(*full, epoch_millis("created").alias("at")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy(*full).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = wide.agg(F.count(F.lit(1))).scalar()
    pieces = cells.withColumn("piece", F.floor(before * F.lit(parts) / total))
    begun = pieces.groupBy(*full, "piece").agg(F.min("at").alias("at")).filter(F.col("piece") > 0)
    return begun.groupBy(*full).agg(F.sort_array(F.collect_list("at")).alias("borders"))
