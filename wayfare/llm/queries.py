"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, html_text, katz, language, merkle, mixing, near_duplicates, packing, periodic_runs, pii, token_counts, url_filters, vector_links
from wayfare.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.vector_links(table(spark, sf_dir, "embeddings"))


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(7)))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents.filter(~language.held_out()).select("doc_id", "text", "lang"))
    found = language.identify(documents.select("doc_id", "text", language.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_mix").alias("n_langs"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no fetch time, so the id gives one within the year 2024."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(366 * 24 * 60))
    return pages.select("page_id", "url", F.timestamp_add("MINUTE", minutes.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries from the pages' own hosts and addresses.

    A host's md5 says whether it is listed, when, and when it is taken off; hosts
    of adverts are listed with all below them; every address whose page id is
    divisible by 50 is listed in March.
    """
    host = url_filters.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).filter("host IS NOT NULL").distinct().withColumn("code", F.md5(F.col("host").cast("binary")))

    def day(first: int) -> F.Column:
        n = F.ascii(F.substring("code", first, 1)) * 3 + F.ascii(F.substring("code", first + 1, 1)) - 190
        return F.timestamp_add("DAY", n.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))

    listed = hosts.filter(F.substring("code", 1, 1) < "6")
    adverts = hosts.filter(F.col("host").contains("ads-track") | F.col("host").contains("cheap-pills"))
    address = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    parts = [
        listed.select(F.lit("host").alias("kind"), F.col("host").alias("value"), F.lit(True).alias("listed"), day(2).alias("at")),
        listed.select(F.lit("host"), "host", F.lit(False), day(4)),
        listed.select(F.lit("host"), "host", F.lit(True), day(6)),
        adverts.select(F.lit("domain"), F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.[^.]*\.)", ""), F.lit(True), day(8)),
        pages.filter("page_id % 50 = 0 AND url IS NOT NULL").select(F.lit("url"), address, F.lit(True), F.lit("2024-03-01 00:00:00").cast("timestamp")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filters.filter_urls(captures(pages), list_entries(pages))
    return found.select("page_id", "url", "host", "fetched_at", "blocked", "n_entries", "first_kind", "first_value", "first_since")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    told = F.when(tampered, merkle.leaf_of([lowered if c == "text" else F.col(c) for c in merkle.FIELDS]))
    return merkle.manifest(documents, told)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), code).drop("collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_pii,
        op3_vector_links,
        op4_katz_scores,
        op5_near_duplicates,
        op6_main_text,
        op7_decontamination,
        op8_mixing,
        op9_language,
        op10_url_filters,
        op11_merkle_manifest,
        op12_packing,
        op13_periodic_runs,
    )
}
