"""Repeated and textual ids, corpora without rare words, and columns that bear the names of results."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from wayfare.llm import katz, url_filters, vector_links


def test_vectors_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_links.vector_links(frame).collect())
    assert found == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    named = frame.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.when(F.col("embedding")[1] == 1, "b").otherwise("")))
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_links.vector_links(named).collect())
    assert found == [("v1", 1, "v1", True), ("v1b", 0, "v1b", True), ("v2", 1, "v1", False), ("v3", 0, "v3", True)]


def test_unknown_words_have_a_share_where_no_word_is_rare(spark):
    rows = [(i, "all words are here often", False) for i in range(8)] + [(8, "all words are new", True), (9, "unheard of", True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    scores = {r.doc_id: r.score for r in katz.katz_scores(frame).collect()}
    assert all(math.isfinite(s) and s < 0 for s in scores.values())
    assert scores[0] > scores[8] > scores[9] - 30


def test_word_probabilities_add_up_to_one():
    for stats in ([48, 6, 0, 0, 0, 0, 0, 0], [30, 10, 5, 2, 1, 1, 0, 0], [7, 7, 7, 0, 0, 0, 0, 0]):
        model = katz.Model(stats, 3, 1)
        counts = [r for r, n in enumerate(stats[2:], 1) for _ in range(n)]
        rest, types = stats[0] - sum(counts), stats[1] - len(counts)
        counts += [rest // types] * types if types else []
        total = float(model.word(katz.np.array(counts)).sum()) + model.unknown
        assert math.isclose(total, 1.0, rel_tol=1e-9), (stats, total)
        assert model.unknown > 0


def test_input_columns_with_the_names_of_results_are_kept(spark):
    at = dt.datetime(2024, 2, 1)
    captures = spark.createDataFrame([(1, "http://a.example/x", at, "mine", True, 7)], "page_id long, url string, fetched_at timestamp, Host string, blocked boolean, extra int")
    entries = spark.createDataFrame([("host", "a.example", True, dt.datetime(2024, 1, 1))], "kind string, value string, listed boolean, at timestamp")
    (row,) = url_filters.filter_urls(captures, entries).collect()
    assert (row.host, row.blocked, row.input_Host, row.input_blocked, row.extra) == ("a.example", True, "mine", True, 7)
    assert len(set(row.asDict())) == len(row)


def _groups(sizes, seed=5):
    """Vectors in groups of ``sizes`` whose members are all linked with one another, and the brute-force links."""
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.standard_normal(24) + 0.1 * rng.standard_normal((size, 24)) for size in sizes])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= vector_links.COSINE
    np.fill_diagonal(near, False)
    return vectors, near


def test_lists_of_saturated_vectors_are_enlarged(spark):
    vectors, near = _groups([1] * 40 + [3, 12, 25, 70])
    nodes, _ = vector_links.nodes_of(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    count = len(vectors)
    lists = vector_links.written(vector_links.with_forest(None, nodes, count, 0))
    plain = vector_links.settled(lists, nodes, count)
    assert max(len(r.near) for r in plain.collect()) == vector_links.NEIGHBOURS
    for r in vector_links.enlarged(plain, nodes, count).collect():
        found = [n for n in r.near if near[r.u, n.v]]
        true = int(near[r.u].sum())
        # All links where the list can hold them, and a list full of links where it can't.
        assert len(found) == min(true, vector_links.LARGEST)
        assert len(r.near) == max(min(true, vector_links.LARGEST), vector_links.NEIGHBOURS)
        assert all(abs(n.s) <= 1.01 for n in r.near) and [n.s for n in r.near] == sorted((n.s for n in r.near), reverse=True)


def test_forests_that_bring_nothing_end_in_blocks(spark, monkeypatch):
    vectors, near = _groups([1] * 20 + [2, 9, 40], seed=8)
    vectors[3] = vectors[-1]  # a repeated row, far from its copy in the table
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= vector_links.COSINE
    np.fill_diagonal(near, False)
    group = np.arange(len(vectors))
    for _ in range(len(vectors)):
        group = np.minimum(group, np.where(near, group, len(vectors)).min(axis=1))
    monkeypatch.setattr(vector_links, "BLOCK", 16)
    monkeypatch.setattr(vector_links, "audit", lambda known, nodes, k: 0.0)
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links.vector_links(frame).collect()}
    assert got == {i: (int(near[i].sum()), int(group[i]), int(group[i]) == i) for i in range(len(vectors))}
