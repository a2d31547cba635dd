"""From raw documents to a mixed training corpus, in five stages.

Each stage reads what its predecessor wrote to the shared folder, so that a lost
executor or a failed stage costs that stage alone. All but the last return the
columns of ``documents``. NULL or empty texts go at the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, language, mixing, near_duplicates, pii
from wayfare.llm.common import table, written

#: A document of which no language has this share is none of the learned languages.
LEAST_SHARE = 0.5


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with other names for columns that an operator's results would replace, and the columns to select afterwards."""
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mainly in one learned language; texts without a letter go.

    Learns from three quarters of the labelled rows; NULL labels teach nothing. If
    no row has a label, no language is known and only texts without a letter go.
    """
    model = language.learn(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    aside, back = _aside(docs, "lang_pred", "score", "lang_mix")
    found = language.identify(aside, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Of equal rows one stays. Where an id is NULL or different rows bear it, rows are
    linked and dropped by keys of their own, in the order of id, text and the rest.
    """
    rest = F.xxhash64(F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")))))
    marked = docs.select("*", F.md5(F.col("text").cast("binary")).alias("_text"), rest.alias("_rest"))
    rows = written(marked.select("doc_id", "_text", "_rest").distinct())
    if rows.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        kept = near_duplicates.near_duplicates(docs).filter("kept").select("doc_id").distinct()
        return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    order = F.col("doc_id").asc_nulls_last(), F.col("_text"), F.col("_rest")
    keys = written(rows.orderBy(*order).select(F.monotonically_increasing_id().alias("_key"), *(F.col(c).alias(f"_of_{c}") for c in rows.columns)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in rows.columns]
    keyed = written(marked.join(keys, same).select(*docs.columns, "_key"))
    kept = near_duplicates.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those that are mostly benchmark go."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; all documents stay."""
    aside, back = _aside(docs, "pii_base", "pii_added", "pii_redacted")
    found = pii.find_pii(aside)
    changed = F.size("pii_base") + F.size("pii_added") > 0
    return found.select(
        *(
            F.when(changed, F.col("pii_redacted")).otherwise(F.col("text")).alias("text")
            if c == "text"
            else F.when(changed, F.char_length("pii_redacted").cast("long")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else column
            for c, column in zip(docs.columns, back)
        )
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (``copies``)."""
    return mixing.taken_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", remove_benchmark),
    ("pii", redact_pii),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: SQL can express neither the models nor the links; tests hold every stage against plain Python.
ORACLE_SQL = None
