"""Best-converting groups of sessions, and the sessions in and outside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.operators.filters import converted
from wayfare.operators.keys import with_hot_keys
from wayfare.session import use_checkpoint_dir

GROUP_KEYS = ("funnel_id", "session_number", "offer_category_id", "offer_id")


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, worked out once and read back from the shared folder by everything built on them."""
    use_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def top_groups(sessions: DataFrame, share: float = 0.2, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """The groups with most redirects, as many as ``share`` of the session count.

    Groups with a missing key do not count. Equal sums go by key order. The groups
    are worked out once and read by every step of the selection; nothing is counted
    on the driver.
    """
    counted = (F.sum("redirected").alias("redirected"), F.count(F.lit(1)).alias("sessions"))
    every = kept(sessions.groupBy(*keys).agg(*counted))
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return _first(every, complete, share, keys).select(*keys, "redirected")


def _first(every: DataFrame, complete: Column, share: float, keys: Sequence[str]) -> DataFrame:
    """The first complete groups by sum (descending) and keys, up to and with the last one that is wanted.

    The last wanted group is found key by key: how many groups have each value,
    how many lie ahead of it, and which value holds the place looked for. Only that
    value is looked into further, so a step counts one block and sorts its distinct
    values: bit lengths of the sums, then the sums of one length, then one key after
    the other. Nothing sorts all groups.
    """
    digit = F.length(F.bin("redirected")).alias("digit")
    groups = every.filter(complete).select(*keys, "redirected", digit, (-F.col("redirected")).alias("behind"))
    found = _bit_length(every.select(digit, "sessions", complete.alias("complete")), share)
    passed = ["digit"]
    for key in ("behind", *keys):
        # One row by construction: the values passed so far, and how many groups are still to come.
        inside = groups.join(F.broadcast(found), passed)
        cells = inside.groupBy(*passed, "left", key).agg(F.count(F.lit(1)).alias("groups"))
        upto = F.sum("groups").over(W.partitionBy(*passed).orderBy(key))
        ahead = cells.withColumn("left", F.col("left") - (upto - F.col("groups")))
        found = ahead.filter((F.col("left") > 0) & (F.col("left") <= F.col("groups"))).drop("groups")
        passed.append(key)
    last = found.select(F.struct("behind", *keys).alias("last"))
    return groups.filter(F.struct("behind", *keys) <= last.scalar())


def _bit_length(groups: DataFrame, share: float) -> DataFrame:
    """``digit, left``: the bit length of the last wanted group's sum, and its place among the groups of that length.

    There are 64 lengths at most; each gives its counts to all of them, so every
    length knows the total, and the groups of greater lengths, from one small sum.
    """
    counts = groups.groupBy("digit").agg(F.count_if("complete").alias("groups"), F.sum("sessions").alias("sessions"))
    spread = counts.select(F.col("digit").alias("of"), "groups", "sessions", F.explode(F.sequence(F.lit(1), F.lit(64))).alias("digit"))
    sums = spread.groupBy("digit").agg(
        F.coalesce(F.sum(F.when(F.col("of") > F.col("digit"), F.col("groups"))), F.lit(0)).alias("ahead"),
        F.coalesce(F.sum(F.when(F.col("of") == F.col("digit"), F.col("groups"))), F.lit(0)).alias("here"),
        F.sum("groups").alias("groups"),
        F.sum("sessions").alias("sessions"),
    )
    wanted = F.least((F.col("sessions").cast("double") * F.lit(share)).cast("bigint"), F.col("groups"))
    places = sums.select("digit", (wanted - F.col("ahead")).alias("left"), "here")
    return places.filter((F.col("left") > 0) & (F.col("left") <= F.col("here"))).drop("here")


def rows_in_groups(
    sessions: DataFrame, groups: DataFrame, keys: Sequence[str] = GROUP_KEYS, converted_only: bool = True
) -> DataFrame:
    """Sessions of the groups: the converted ones, or all."""
    wanted = sessions.filter(F.col("redirected") > 0) if converted_only else sessions
    return _members(wanted, groups, keys, inside=True)


def rows_outside_groups(sessions: DataFrame, groups: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Sessions outside the groups, those with a missing key among them."""
    return _members(sessions, groups, keys, inside=False)


def _members(sessions: DataFrame, groups: DataFrame, keys: Sequence[str], inside: bool) -> DataFrame:
    """Sessions by membership of their key.

    A missing key is decided where it is read, and a key that holds much of all
    sessions by a look-up of the few such keys, so that neither gathers its
    sessions in one task. All other sessions join the groups.
    """
    marked = with_hot_keys(sessions, groups.select(*keys), keys)
    lost = F.lit(False)
    for key in keys:
        lost = lost | F.col(key).isNull()
    is_member = F.col("_member") & ~lost
    decided = marked.filter((lost | F.col("_member").isNotNull()) & F.coalesce(is_member if inside else ~is_member, F.lit(not inside)))
    others = marked.filter(~lost & F.col("_member").isNull())
    joined = others.join(groups.select(*keys), list(keys), "left_semi" if inside else "left_anti")
    return decided.select(*sessions.columns).unionByName(joined.select(*sessions.columns))


def single_session_converted(sessions: DataFrame, funnel: int = 1) -> DataFrame:
    """Converted first sessions, in one funnel, of users who never came back."""
    returned = sessions.filter(F.col("session_number") > 1).select("user_id").distinct()
    first = sessions.filter(converted([funnel]) & (F.col("session_number") == 1))
    return first.join(returned, "user_id", "left_anti")
