"""URL filters with dated list entries.

A list is a log of entries (kind, value, added or removed, when). Each entry
holds until the next one for the same value, which makes validity intervals; an
as-of join tests every capture against the entries active when it was fetched.
Intervals are cut at bins of a month, and the join is on (value, bin), so that a
capture meets only what is dated near it. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The end of an entry that nothing ends.
FOREVER = "9999-01-01"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; NULL without one."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame, until: str = FOREVER) -> DataFrame:
    """kind, value, since, ended of every stretch during which a value is listed.

    ``entries``: kind, value, listed (true adds, false removes), at. Entries with a
    NULL are ignored; of several at one time an adding one wins; repeated ones
    change nothing. ``ended`` is exclusive.
    """
    known = entries.dropna(subset=["kind", "value", "listed", "at"])
    moments = known.groupBy("kind", "value", "at").agg(F.max("listed").alias("listed"))
    order = W.partitionBy("kind", "value").orderBy("at")
    return (
        moments.withColumn("ended", F.coalesce(F.lead("at").over(order), F.to_timestamp(F.lit(until))))
        .filter("listed")
        .select("kind", "value", F.col("at").alias("since"), "ended")
    )


def candidates(captures: DataFrame) -> DataFrame:
    """What a capture can be listed by: its host, each parent domain, and its url without query."""
    labels = F.split(F.col("host"), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    address = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    keys = F.concat(
        F.coalesce(F.transform(domains, lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("value"))), F.array()),
        F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")), F.struct(F.lit("url").alias("kind"), address.alias("value"))),
    )
    return captures.select("capture", "fetched_at", F.explode(keys).alias("key")).select("capture", "fetched_at", "key.kind", "key.value")


def listed_captures(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """capture, kind, value, since of every interval active at a capture's fetch time."""
    # Only the months between the first and the last capture matter.
    oldest, newest = (F.lit(t) for t in captures.agg(F.min("fetched_at"), F.max("fetched_at")).first())
    near = spans.filter((F.col("since") <= newest) & (F.col("ended") > oldest))
    bins = F.sequence(F.trunc(F.greatest("since", oldest), "month"), F.trunc(F.least("ended", newest), "month"), F.expr("interval 1 month"))
    cut = near.withColumn("bin", F.explode(bins))
    keys = candidates(captures).filter(F.col("value").isNotNull()).withColumn("bin", F.trunc("fetched_at", "month"))
    return keys.join(cut, ["kind", "value", "bin"]).filter((F.col("since") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("ended"))).select("capture", "kind", "value", "since")


_RESULTS = ("host", "blocked", "n_entries", "first_kind", "first_value", "first_since", "first", "_url", "_at")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` (page_id, url, fetched_at) with host, blocked, n_entries, first_kind, first_value, first_since.

    Captures without url, host or fetch time are kept and not blocked. Repeated
    rows give repeated rows: equal (url, fetch time) is judged once and joined
    back. Other columns of the input stay; one that bears the name of a result, in any
    case, is kept as ``input_<name>``. Ties of the earliest entry go by kind and value.
    """
    captures = captures.withColumnsRenamed({c: f"input_{c}" for c in captures.columns if c.lower() in _RESULTS})
    named = captures.withColumn("host", host_of(F.col("url")))
    once = named.select("url", "host", "fetched_at").dropna(subset=["url", "fetched_at"]).distinct()
    once = once.withColumn("capture", F.struct("url", "fetched_at"))
    hits = (
        listed_captures(once, intervals(entries))
        .groupBy("capture")
        .agg(F.count("*").alias("n_entries"), F.min(F.struct("since", "kind", "value")).alias("first"))
        .select(F.col("capture.url").alias("_url"), F.col("capture.fetched_at").alias("_at"), "n_entries", "first")
    )
    joined = named.join(hits, (F.col("url") == F.col("_url")) & (F.col("fetched_at") == F.col("_at")), "left")
    return joined.select(
        *named.columns,
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.col("first.kind").alias("first_kind"),
        F.col("first.value").alias("first_value"),
        F.col("first.since").alias("first_since"),
    )
