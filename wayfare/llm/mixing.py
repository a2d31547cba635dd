"""Mixing sources to target weights by nested hash thresholds.

Sizes are summed by source and hash bucket; the bucket in which a source's
budget runs out is the only one that is split further, level by level. The
outcome is one threshold per source, so that rows are taken by a filter, without
a sort. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.llm.common import WORD_CLASS, written

#: Hash: the first 36 bits of md5 of the id as text, read 12 bits at a time.
LEVELS = 3
BITS = 12
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def hashed(column: str = "doc_id") -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of every source in ``sizes`` (source, size).

    Sharing by weight with a ceiling per source has one fixed point: with sources
    ordered by ceiling over weight, the first ones stop at their ceilings and the
    rest share what remains. The windows run over one row per source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = W.partitionBy()
    by_ratio = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    behind = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    leveled = (
        sums.withColumn("weight", weight)
        .withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(behind))
        .withColumn("stopped", F.col("ceiling") <= F.col("weight") * F.col("level"))
    )
    # The first source that keeps below its ceiling sets the level of all behind it.
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("ceiling") / F.col("weight"), "level"))).over(every)["level"]
    return leveled.withColumn("rest", level).select(
        "source", "source_size", F.when(F.col("stopped") | F.col("rest").isNull(), F.col("ceiling")).otherwise(F.least("ceiling", F.col("weight") * F.col("rest"))).alias("target")
    )


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, copies, edge: rows with hash below ``edge`` are taken once more than ``copies``."""
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST).cast("long"))
    state = targets.withColumn("copies", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long")).select(
        "source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("edge")
    )
    for level in range(LEVELS):
        width = 1 << (BITS * (LEVELS - 1 - level))
        span = width << BITS
        cells = _with_source(rows, state.select("source", "edge")).filter((F.col("hash") >= F.col("edge")) & (F.col("hash") < F.col("edge") + span))
        sums = cells.groupBy("source", F.floor(F.col("hash") / width).alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        fits = (
            _with_source(sums.withColumn("running", running), state.select("source", "left"))
            .groupBy("source")
            .agg(
                F.coalesce(F.max(F.when(F.col("running") <= F.col("left"), F.col("running"))), F.lit(0)).alias("used"),
                F.min(F.when(F.col("running") > F.col("left"), F.col("bucket"))).alias("boundary"),
                F.min(F.when(F.col("running") > F.col("left"), F.col("running"))).alias("over"),
            )
        )
        # Rows of one hash go together; the last level takes them if that comes nearer.
        last = level == LEVELS - 1
        more = (F.col("over") - F.col("left") < F.col("left") - F.col("used")).cast("long") if last else F.lit(0)
        state = written(
            _with_source(state, fits, "left")
            .withColumn("edge", F.coalesce((F.col("boundary") + more) * width, F.when(F.col("used").isNull(), F.col("edge")).otherwise(F.col("edge") + span)))
            .withColumn("left", F.when(F.col("boundary").isNull(), 0.0).otherwise(F.col("left") - F.col("used")))
            .select("source", "source_size", "target", "copies", "left", "edge")
        )
    return state.drop("left")


def _with_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, NULL meeting NULL; ``right`` has one row per source."""
    right = right.withColumnRenamed("source", "_mixed_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_mixed_source")), how).drop("_mixed_source")


def _copies(rows: DataFrame, edges: DataFrame) -> DataFrame:
    joined = _with_source(rows, edges)
    more = F.when(F.col("hash") < F.col("edge"), 1).otherwise(0)
    return joined.withColumn("copies", F.least(F.col("copies") + more, F.lit(MOST)).cast("long")).drop("edge")


def _measured(documents: DataFrame) -> DataFrame:
    return written(documents.select("doc_id", "source", n_words().alias("size"), hashed().alias("hash")))


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, source, hash, size, source_size, target and taken (words, repeats counted) of every row.

    Needs doc_id, text and source; other columns are ignored. NULL and empty
    texts have size 0 and are taken as their hash says, with 0 words; NULL sources
    are one source, the last; a source of size 0 has target 0. Rows with one id
    (NULL included) share a hash and a fate. No rows give none. A source's words
    miss its target by half of the row at its threshold at most.
    """
    rows = _measured(documents)
    taken = _copies(rows, thresholds(rows, source_targets(rows)))
    return taken.withColumn("taken", F.col("size") * F.col("copies"))


def taken_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the mix takes, once each, with ``copies`` (1 or 2).

    The thresholds need sizes alone; texts are only filtered. Edge cases as in ``mix``.
    """
    rows = _measured(documents)
    edges = thresholds(rows, source_targets(rows)).select("source", "copies", "edge")
    found = _copies(documents.drop("hash", "copies", "edge").withColumn("hash", hashed()), edges)
    return found.filter(F.col("copies") > 0).select(*(c for c in documents.columns if c not in ("hash", "copies", "edge")), "copies")
