"""Page sets that occur together in sessions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.keys import SESSION


def transactions(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Item sets of the given sessions; a session without pages holds one blank item."""
    found = sessions.select(*SESSION).join(items, SESSION, "left")
    return found.select(F.coalesce("items", F.array(F.lit(""))).alias("items"))


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.01) -> DataFrame:
    """``items, size, freq, support`` of all item sets with enough support.

    ``items`` is sorted; most frequent sets come first. NULL items and repeats in a
    basket do not count.

    Equal baskets are counted first, and everything else works on distinct baskets
    with their counts, in two passes. A set with enough support in all baskets has
    it in those of some task, so the sets found task by task are all that can
    qualify; the second pass counts these exactly. Nothing runs before the result
    is read. Small tasks make many candidates, so leave their size to Spark.
    """
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    equal = baskets.select(items.alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("baskets"))
    # A set is counted in the baskets that hold its last item. The outer explode adds no
    # test on the items, which would reach the sessions and keep Spark from working them out once.
    candidates = _candidates(equal, min_support).distinct()
    hooked = candidates.select(F.col("items").alias("found"), F.element_at("items", -1).alias("hook"))
    holding = equal.select("items", "baskets", F.explode_outer("items").alias("hook")).join(hooked, "hook")
    counted = (
        holding.filter(F.size(F.array_except("found", "items")) == 0)
        .groupBy("found")
        .agg(F.sum("baskets").alias("freq"))
    )
    total = equal.agg(F.sum("baskets")).scalar()
    return (
        counted.select(
            F.col("found").alias("items"), F.size("found").alias("size"), "freq", (F.col("freq") / total).alias("support")
        )
        .filter(F.col("support") >= min_support)
        .orderBy(F.col("support").desc(), F.col("items"))
    )


def _candidates(equal: DataFrame, min_support: float) -> DataFrame:
    """``items``: the sets with enough support among the baskets of a task."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counts = [], []
        for batch in batches:
            sets += batch.column("items").to_pylist()
            counts += batch.column("baskets").to_pylist()
        found = []
        for one in supported(sets, np.array(counts, np.int64), min_support * (1 - 1e-9) * sum(counts)):
            found.append(one)
            if len(found) == 10_000:
                yield pa.RecordBatch.from_pydict({"items": pa.array(found, pa.list_(pa.string()))})
                found = []
        yield pa.RecordBatch.from_pydict({"items": pa.array(found, pa.list_(pa.string()))})

    return equal.mapInArrow(mine, "items array<string>")


def supported(sets: Sequence[Sequence[str]], counts: np.ndarray, least: float) -> Iterator[list[str]]:
    """All item sets that the baskets ``sets``, each there ``counts`` times, hold ``least`` times or more, in item order.

    Depth first; a set carries the numbers of the baskets that hold it.
    """
    holders: dict[str, list[int]] = {}
    for number, items in enumerate(sets):
        for item in items:
            holders.setdefault(item, []).append(number)
    singles = [(item, np.array(numbers)) for item, numbers in sorted(holders.items())]
    open_sets = [([], [(item, numbers) for item, numbers in singles if counts[numbers].sum() >= least])]
    while open_sets:
        prefix, more = open_sets.pop()
        for at, (item, numbers) in enumerate(more):
            grown = [*prefix, item]
            yield grown
            both = ((other, np.intersect1d(numbers, held, assume_unique=True)) for other, held in more[at + 1 :])
            wider = [(other, held) for other, held in both if counts[held].sum() >= least]
            if wider:
                open_sets.append((grown, wider))
