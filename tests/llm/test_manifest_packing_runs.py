"""Merkle manifest, packing and periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.llm import merkle, packing, periodic_runs, queries
from wayfare.llm.merkle import Block, addresses, folded, levels_of, tree_size

_R = random.Random(11)
_LONG = " ".join(_R.choice(["alpha", "beta", "Gamma", "été"]) + str(_R.randint(0, 99)) for _ in range(9000))
TEXTS = [None, "", " \t\n", "One", "a b " * 40, _LONG, _LONG, "日本語 " * 30, "x" * 5000, "two  spaces\n \nand <|endoftext|> more"]
ROWS = [(i, TEXTS[i % len(TEXTS)], ["en", None, ""][i % 3], ["web", None, "été", "a", "web", "web"][i % 6], i if i % 4 else None, 0.5, b"x") for i in range(60)]
ROWS += [ROWS[9]] * 40 + [(None, "no id", None, None, None, 0.5, None), (9, "other text", None, "a", 1, 0.5, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf double, cells binary"


@pytest.fixture(scope="module")
def documents(spark):
    """Edge texts, repeated rows and ids, NULLs in every column, and columns whose names clash with results."""
    return spark.createDataFrame(ROWS, SCHEMA)


# Manifest


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain_tree(leaves, fanout):
    """The last node, and for every leaf the siblings (left, right) of each level."""
    level, ways = list(leaves), [[] for _ in leaves]
    below = [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, held = [], []
        for i in range(0, len(level), fanout):
            run = level[i : i + fanout]
            for k in range(len(run)):
                for leaf in below[i + k]:
                    ways[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(_sha("".join(run)))
            held.append(sum(below[i : i + fanout], []))
        level, below = above, held
    return level[0], ways


def _plain_manifest(rows, fanout):
    def leaf(row, lower=False):
        text = row[1] and (row[1].encode().lower().decode() if lower else row[1])
        fields = [row[0], row[3], row[2], row[4], row[1] if not row[1] else text]
        return _sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def first(value):
        return (value is not None, value if value is not None else 0)

    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (first(r[0]), leaf(r)))
        trees[name] = (own, *_plain_tree([leaf(r) for r in own], fanout))
    root, above = _plain_tree([trees[n][1] for n in names], fanout)
    out = []
    for name, outer in zip(names, above):
        own, subroot, ways = trees[name]
        for row, way in zip(own, ways):
            steps = way + outer
            code = zlib.crc32(("" if row[0] is None else str(row[0])).encode())
            node = leaf(row, lower=code % 5 == 0)
            for left, right in steps:
                node = _sha(left + node + right)
            out.append((-1 if row[0] is None else row[0], leaf(row), subroot, root, _sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out)


@pytest.mark.parametrize("levels, fanout", [(3, 16), (1, 2), (2, 3)])
def test_manifest(spark, documents, monkeypatch, levels, fanout):
    plain, real = _plain_manifest(ROWS, fanout), merkle.manifest
    monkeypatch.setattr(queries, "table", lambda *_: documents)
    monkeypatch.setattr(merkle, "manifest", lambda d, told: real(d, told, levels, fanout))
    rows = [tuple(r) for r in queries.op11_merkle_manifest(spark, "").collect()]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows) == plain
    assert {r[-1] for r in rows} == {True, False}


def test_manifest_of_few_rows(documents):
    assert merkle.manifest(documents.limit(0)).collect() == []
    one = documents.filter("doc_id = 3")
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_addresses_fill_the_block_and_split_at_half_height():
    for fanout, levels in ((2, 1), (2, 2), (2, 5), (3, 4), (16, 4)):
        every = np.concatenate([addresses(levels, d, np.arange(fanout**d), fanout) for d in range(levels)])
        assert sorted(every) == list(range(tree_size(levels, fanout)))
    # Four levels: the upper two first, then each subtree of two below it in one piece.
    assert addresses(4, 2, np.arange(4), 2).tolist() == [3, 6, 9, 12]
    assert addresses(4, 3, np.arange(8), 2).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.sampled_from([(2, 7), (3, 5), (16, 3)]))
def test_every_leaf_of_a_block_folds_to_its_root(n, shape):
    fanout, most = shape
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    block = Block.build(leaves, levels_of(n, most, fanout), fanout)
    again = Block(n, levels_of(n, most, fanout), fanout, block.cells.tobytes())
    root, ways = _plain_tree([x.hex() for x in leaves], fanout)
    assert again.root().hex() == root
    for i, leaf in enumerate(leaves):
        steps = again.steps(again.bottom, i)
        assert [(a.hex(), b.hex()) for a, b in zip(steps[::2], steps[1::2])] == ways[i]
        assert folded(leaf, steps).hex() == root


def test_places_span_tasks(spark):
    rows = spark.range(0, 3000, numPartitions=7).select((F.col("id") % 3).alias("g"), F.lit(5).alias("v"))
    rows = rows.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    found = merkle.numbered(rows, ["g"], ["v"]).groupBy("g").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    assert len(found) == 3 and all(r.p == list(range(1000)) for r in found)


# Packing


def _library():
    return packing.Ids("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé1 \n\t'sll!%_日🎉½ࢿ\x1c\x85\xa0　ⷠ")) | st.characters(exclude_categories=["Cs"]), max_size=60), st.booleans())
def test_ids_are_the_library_s(text, special):
    text = text[:9] + "<|endoftext|>" + text[9:] if special else text
    assert np.frombuffer(_ids().text(text), "<u4").tolist() == _ids().library.encode(text, add_special_tokens=False).ids


_kept = []


def _ids():
    if not _kept:
        _kept.append(_library())
    return _kept[0]


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 50)
    for text in (_LONG[:5000], "a  b\n\n c" * 200, "x" * 400 + " y"):
        assert np.frombuffer(_ids().text(text), "<u4").tolist() == _ids().library.encode(text, add_special_tokens=False).ids


def _laid_out(slots, sequences):
    """Filled places of every sequence; checks that pieces lie one behind the other."""
    spans = [[] for _ in range(sequences)]
    for length, _, count, sequence, offset in zip(*map(np.ndarray.tolist, slots)):
        for s in range(sequence, sequence + count):
            spans[s].append((offset, length))
    for own in spans:
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    return [sum(n for _, n in own) for own in spans]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=20))
def test_plan_places_every_piece_once(counted):
    counts = np.zeros(41, np.int64)
    for length, n in counted:
        counts[length] += n
    slots, sequences = packing.plan(counts, 40)
    assert all(0 < n <= 40 for n in _laid_out(slots, sequences))
    for length in range(1, 41):
        mine = slots.length == length
        ends = slots.rank[mine] + slots.count[mine]
        assert slots.rank[mine].tolist() == [0, *ends.tolist()[:-1]] if mine.any() else not counts[length]
        assert slots.count[mine].sum() == counts[length]
    assert sequences <= _plain_best_fit(counts, 40)


def _plain_best_fit(counts, limit):
    free = []
    for length in range(limit, 0, -1):
        for _ in range(counts[length]):
            at = min((i for i, f in enumerate(free) if f >= length), key=lambda i: free[i], default=None)
            if at is None:
                free.append(limit)
                at = -1
            free[at] -= length
    return len(free)


def test_patterns_beat_best_fit_where_it_is_short_sighted():
    counts = np.zeros(101, np.int64)
    counts[[50, 31, 19]] = 600  # 50 + 31 + 19 fills; best fit pairs the fifties
    counts[[40, 30]] = 300
    counts[30] = 600
    _, sequences = packing.plan(counts, 100)
    whole = -(-int((counts * np.arange(101)).sum()) // 100)
    assert sequences <= _plain_best_fit(counts, 100) and sequences <= whole * 1.01 + 1


def test_fit_finds_an_exact_mixture():
    patterns = np.array([[40, 60, 0], [30, 30, 40], [20, 80, 0]])
    wanted = np.zeros(101)
    for p, n in zip(patterns, (10, 7, 0)):
        np.add.at(wanted, p, n)
    wanted[0] = 0
    assert np.allclose(packing.fit(patterns, wanted, 500), [10, 7, 0], atol=0.05)


@pytest.mark.parametrize("limit", [2048, 64])
def test_pack(documents, limit):
    rows = packing.pack(documents, limit, with_ids=True).collect()
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault((r.doc_id, r.piece), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text, *_ in ROWS[:60]:
        if i == 9:  # this id has rows of two texts
            continue
        ids = _ids().library.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % limit + 1
        bounds = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            (r,) = by_document[i, k]
            own = np.array(ids[a:b], "<u4").tobytes()
            assert (r.start, r.length, r.ids_crc32, bytes(r.ids)) == (a, b - a, zlib.crc32(own), own)
        assert (i, len(bounds) - 1) not in by_document
    assert len([r for r in rows if r.piece == 0]) == len(ROWS)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    total = sum(r.length for r in rows)
    assert -(-total // limit) <= len(by_sequence) <= total / limit * 1.1 + 2


def test_pack_nothing_and_sequences(documents):
    assert packing.pack(documents.limit(0)).collect() == []
    packed = packing.written(packing.pack(documents.filter("doc_id < 9"), 64, with_ids=True))
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.n_tokens for r in whole.values()) == packed.agg(F.sum("length")).first()[0]
    for r in packed.collect():
        own = bytes(whole[r.sequence_id].ids)
        assert own[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


# Periodic runs


def _plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                own = words[i : j + q]
                if all(any(a != b for a, b in zip(own, own[p:])) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


_words = st.one_of(
    st.lists(st.sampled_from([b"a", b"b"]), max_size=120),
    st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=80),
    st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), st.integers(1, 12)), max_size=4).map(lambda parts: [w for own, k in parts for w in own * k]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(_words, max_size=4))
def test_runs(documents):
    found = periodic_runs.runs_of(documents)
    for words, runs in zip(documents, found):
        assert [tuple(r) for r in runs] == _plain_runs(words)


def test_runs_of_long_periods():
    r = random.Random(2)
    base = [str(r.randint(0, 30)).encode() for _ in range(300)]
    for period in (8, 9, 16, 17, 31, 32, 33, 64, 100, 250):
        words = base[:50] + base[50 : 50 + period] * 3 + base[: period // 2]
        assert [tuple(x) for x in periodic_runs.runs_of([base, words])[1]] == _plain_runs(words)
    fibonacci = [b"a"], [b"a", b"b"]
    for _ in range(12):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert [tuple(x) for x in periodic_runs.runs_of([fibonacci[1]])[0]] == _plain_runs(fibonacci[1])


def test_periodic_runs(spark, documents, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: documents)
    rows = queries.op13_periodic_runs(spark, "").collect()
    assert len(rows) == len(ROWS)
    texts = {(i, t) for i, t, *_ in ROWS}
    expected = {}
    for i, text in texts:
        words = (text or "").encode().split()
        h = zlib.crc32(("" if i is None else str(i)).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = [tuple(r) for r in periodic_runs.runs_of([words])[0]]
        if n <= 300:
            assert runs == _plain_runs(words)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        left = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        expected.setdefault(i, []).append((len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest, hashlib.sha256(left).hexdigest()))
    for r in rows:
        assert tuple(r)[1:] in expected[r.doc_id]
    assert any(r.n_runs for r in rows)
    assert periodic_runs.periodic_runs(documents.limit(0)).count() == 0
    kept = periodic_runs.periodic_runs(documents.filter("doc_id = 4")).first()
    assert (kept.n_runs, kept.start, kept.length, kept.period, kept.collapsed) == (1, 0, 80, 2, "a b")
