"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from wayfare.llm import decontaminate, near_duplicates, pii
from wayfare.llm.common import table, written
from wayfare.llm.oracles import ORACLES
from wayfare.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


def test_entry_registers_every_query():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    made = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(made.columns)
    want = sorted(tuple(str(x) for x in row) for row in result.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in made.collect()) == want


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    names = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR))
        seen.append(docs)
        assert name == "mix" or docs.columns == names
    start, language, single, clean, safe, mixed = ({r.doc_id: r for r in f.collect()} for f in seen)
    assert len(language) >= 0.95 * len(start)  # these texts are all in learned languages
    kept = {r.doc_id for r in near_duplicates.near_duplicates(seen[1]).collect() if r.kept}
    assert set(single) == kept
    benchmark = decontaminate.Benchmark([(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()])
    hits = dict(zip(single, benchmark.hits([r.text for r in single.values()])))
    for i, (n, spans, _) in hits.items():
        hit = sum(b - a for a, b in spans)
        assert (i in clean) == (hit <= 0.5 * n)
        if i in clean and not hit:
            assert clean[i] == single[i]
    for i, r in safe.items():
        assert not pii.base_spans(r.text) or pii.base_spans(clean[i].text)
        if not pii.base_spans(clean[i].text):
            assert r.text == clean[i].text or "[" in r.text
    assert set(mixed) <= set(safe) and all(r.copies in (1, 2) for r in mixed.values())


def test_edge_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 !", "en", "a", 4), (4, "some words of text here", "en", None, 23), (4, "some words of text here", "en", None, 23), (None, "other words are in this", None, "b", 23)]
    rows = [(*r, "own", 7) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            part = written(stage(spark, part, SF_DIR))
        assert part.count() in (0, 1, 2)
        assert {(r.score, r.n_words) for r in part.collect()} <= {("own", 7)}


def test_rows_of_one_id_and_rows_without_id_are_documents_of_their_own(spark):
    one, two, three, four = ("".join(f"{w}{i} " for i in range(30)) for w in "abcd")
    rows = [(1, one, "x"), (1, two, "x"), (2, one, "x"), (None, three, "x"), (None, three, "x"), (None, three, "y"), (None, four, "x"), (7, four, "x"), (8, "", "x"), (3, two + "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect())
    assert got == sorted([("1", one), ("1", two), ("None", three), ("7", four), ("8", "")])
