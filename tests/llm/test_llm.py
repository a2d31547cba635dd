"""Operators for training data against plain Python, with NULLs, empty texts, repeated rows and clashing columns."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, html_text, katz, language, mixing, near_duplicates, pii, pii_crf, token_counts, url_filters, vector_links
from wayfare.llm.common import WORD, fold
from wayfare.llm.components import components

_R = random.Random(5)
_WORDS = ["alpha", "beta", "gamma", "Delta", "eps", "zeta", "été", "naïve", "x", "42"]


def _prose(n: int) -> str:
    return " ".join(_R.choice(_WORDS) + str(_R.randint(0, 60)) for _ in range(n))


_LONG = _prose(6000)
_BASE = _prose(60)
TEXTS = [None, "", " \t\n", "one", "one two three", _BASE, _BASE, _BASE + " tail", "!!! 123", _LONG, _LONG.replace("alpha1 ", "q "), _prose(40), _prose(40), "mail bob@mail.example.com now +1 (555) 123-4567 or 4111 1111 1111 1111, 10.0.0.1"]


@pytest.fixture(scope="module")
def documents(spark):
    """Edge texts, a repeated row, NULL source and language, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 5 else None, "clash", 1.5) for i, t in enumerate(TEXTS)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, class string, score double")


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)


# Token counts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé1 \n\t'sll!%_日🎉½ࢿ\x1c\x85\xa0　ⷠ")) | st.characters(exclude_categories=["Cs"]), max_size=40), st.booleans())
def test_look_ups_count_as_the_library(text, special):
    counter = _counter()
    text = text[:10] + token_counts.SPECIAL + text[10:] if special else text
    assert counter.text(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


_kept = []


def _counter():
    if not _kept:
        _kept.append(token_counts.Counts("byte_bpe_50k.json"))
    return _kept[0]


def test_settled_characters_have_the_library_classes():
    counter = _counter()
    for block in range(0, 0x20000, 97):  # a text with each of these in three surroundings
        c = chr(block) if not 0xD800 <= block < 0xE000 else "a"
        for text in (f"a{c}a", f"1{c}1", f"!{c}!", f" {c} "):
            assert counter.text(text) == len(counter.library.encode(text, add_special_tokens=False).ids), hex(block)


def test_token_counts(documents, empty):
    rows = token_counts.token_counts(documents, limit=100).collect()
    counter = _counter()
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(counter.library.encode(text).ids))
        assert r.over_limit == (r.n_tokens > 100)
    assert len(rows) == len(TEXTS) + 1
    assert token_counts.token_counts(empty).count() == 0


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    assert _counter().text(_LONG) == len(_counter().library.encode(_LONG).ids)


# Personal data

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain_spans(text):
    out = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], ("email", "ip", "card", "phone").index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@+- ()0123456789é\n", max_size=60))
def test_linear_patterns_equal_the_plain_ones(text):
    assert pii.base_spans(text) == _plain_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii_crf.default_field()


def test_field_is_right_on_held_out_rows(field):
    rows = pii_crf.labelled_table(300, seed=99)
    paths = field.decode([w for w, _ in rows])
    right = sum([pii_crf.TAGS[p] for p in path] == tags for path, (_, tags) in zip(paths, rows))
    assert right / len(rows) > 0.95


def test_viterbi_equals_trying_every_path(field):
    words = ["call", "+1", "(555)", "123-4567"]
    scores, k = field.emissions(words), len(pii_crf.TAGS)
    best = max(
        ((a, b, c, d) for a in range(k) for b in range(k) for c in range(k) for d in range(k)),
        key=lambda p: pii_crf._START[p[0]] + sum(scores[i][x] for i, x in enumerate(p)) + sum(field.step[x][y] for x, y in zip(p, p[1:])),
    )
    assert field.decode([words, [], words[:1]])[0] == list(best)


def test_pii_report(documents, empty, field):
    rows = pii.pii_report(documents, field).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        spans = _plain_spans(TEXTS[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[2] for s in spans) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert set(pii.joined(spans).split(",")) <= set(r.spans.split(","))
    assert pii.pii_report(empty, field).count() == 0


def test_field_adds_what_the_patterns_miss_and_redaction_keeps_the_rest(field):
    text = "Ask (555) 123-4567 or jo [at] mail [dot] org please, on 2024-11-12 at 10:30"
    base = pii.base_spans(text)
    added = pii.added_spans(field, [text], [base])[0]
    assert [(text[a:b], k) for a, b, k in added] == [("(555) 123-4567", "phone"), ("jo [at] mail [dot] org", "email")]
    assert pii.redacted(text, added) == "Ask [PHONE] or [EMAIL] please, on 2024-11-12 at 10:30"
    assert pii.added_spans(field, ["plain words only", ""], [[], []]) == [[], []]


def test_cues_count_in_any_case_and_bare(field):
    def found(text):
        return [(text[a:b], k) for a, b, k in pii.added_spans(field, [text], [pii.base_spans(text)])[0]]

    assert found("please write jo [AT] mail [DOT] org soon") == [("jo [AT] mail [DOT] org", "email")]
    assert found("please write jo(AT)mail(DOT)org soon") == [("jo(AT)mail(DOT)org", "email")]
    assert found("please write jo at mail dot org soon") == [("jo at mail dot org", "email")]
    assert found("we looked at this and at the dot on the map") == []
    assert pii_crf.shape("a" * 300 + "7") == "a9"


# Vectors


def test_vector_links(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    rows = [c for c in centres] + [centres[0] + 0.05 * r.standard_normal(16) for _ in range(60)] + [centres[1] * 2] * 30 + [centres[2] + 0.3 * r.standard_normal(16) for _ in range(10)]
    vectors = [list(map(float, v)) for v in rows] + [None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    vectors.append([None] + [1.0] * 15)
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n_links int")
    got = {x.vec_id: x for x in vector_links.vector_links(frame, k=4).collect()}
    assert len(got) == len(vectors)

    def good(v):
        return v and None not in v and all(map(math.isfinite, v)) and any(v)

    def linked(a, b):
        return bool(good(a) and good(b)) and len(a) == len(b) and float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) >= 0.9 - 1e-12

    for i, v in enumerate(vectors):
        assert got[i].n_links == sum(linked(v, w) for j, w in enumerate(vectors) if j != i), i
        assert got[i].kept == (got[i].component_id == i)
    assert got[len(rows) + 6].component_id == len(rows) + 5
    assert vector_links.vector_links(frame.limit(0)).count() == 0


def _isolated_pairs(n, loose):
    """``n`` vectors of 32 dimensions, then as many that make pairs of cosine 0.905 to 0.92 with them, then ``loose`` others."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(r.standard_normal((n, 32)))
    b = r.standard_normal((n, 32))
    b = unit(b - (a * b).sum(axis=1)[:, None] * a)
    c = r.uniform(0.905, 0.92, n)[:, None]
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * b, r.standard_normal((loose, 32))])


def test_isolated_pairs_are_found_however_long_the_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "LEAF", 2)
    n = 400
    rows = [(i, v.tolist()) for i, v in enumerate(_isolated_pairs(n, 5200))]
    got = {x.vec_id: x for x in vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[n + i].component_id == i for i in range(n)) >= 0.95 * n
    assert vector_links.forests_for(10**9) > vector_links.forests_for(10**6) > vector_links.forests_for(1000)


def test_audit_counts_a_linked_vector_once(spark):
    n, r = 40, np.random.default_rng(9)
    centre = r.standard_normal(32)
    vectors = [*_isolated_pairs(n, 60), *(centre + 0.01 * r.standard_normal((500, 32)))]
    nodes, _ = vector_links.nodes_of(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))

    def known(found):
        links = [1 if i % n < found else 0 for i in range(2 * n)] + [0] * 60 + [499] * 500
        return spark.createDataFrame([(i, 1, x) for i, x in enumerate(links)], "node long, copies long, n_links long")

    assert vector_links.audit(known(n), nodes) == 1.0
    assert vector_links.audit(known(n // 2), nodes) == pytest.approx(0.5)


def test_saturated_components_joined_by_few_links_are_one(spark):
    r = np.random.default_rng(12)
    a, b, off = np.zeros(48), np.zeros(48), np.zeros(48)
    a[0], b[1], off[2] = 1, 1, 1
    unit = lambda x: x / np.linalg.norm(x)
    far = unit(np.cos(0.62) * a + np.sin(0.62) * b)  # two groups of near copies, not linked but for a pair
    groups = [unit(c + 0.012 * r.standard_normal(48)) for c in (a, far) for _ in range(1500)]
    x = unit(np.cos(0.09) * a + np.sin(0.09) * b)
    y = unit(np.cos(0.53) * a + np.sin(0.53) * b)
    vectors = [*groups, x, y]
    m = np.stack(vectors)
    linked = m @ m.T >= 0.9
    assert not linked[:1500, 1500:3000].any() and linked[3000, 3001] and not linked[3000, 1500:3000].any() and not linked[3001, :1500].any()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {v.vec_id: v for v in vector_links.vector_links(frame).collect()}
    assert {v.component_id for v in got.values()} == {0}
    assert all(got[i].n_links == linked[i].sum() - 1 for i in got)


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# Language model


def test_katz_scores(documents, empty, monkeypatch):
    monkeypatch.setattr(katz, "LEAST_BUCKETS", 4)
    frame = documents.withColumn("held_out", language.held_out(7))
    got = katz.katz_scores(frame).collect()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5])]
    words, pairs, history = Counter(), Counter(), Counter()
    tokens = {i: [*WORD.findall(fold(t or "")), " end"] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, _ in rows:
        if not out[i]:
            words.update(tokens[i])
            before = [" start", *tokens[i]]
            pairs.update(zip(before, tokens[i]))
            history.update(before[:-1])
    total = sum(words.values())

    def discounted(counts):
        seen = Counter(counts.values())
        d = katz.discounts([seen[r] for r in range(1, 7)])
        return lambda c: c * d[c - 1] if c <= 5 else c

    one, two = discounted(words), discounted(pairs)
    unknown = 1 - sum(map(one, words.values())) / total

    def p1(w):
        return one(words[w]) / total if w in words else unknown

    def p2(h, w):
        if h not in history:
            return p1(w)
        known = {x: c for (g, x), c in pairs.items() if g == h}
        whole = history[h] + all(c > 5 for c in known.values())
        if w in known:
            return two(known[w]) / whole
        return (1 - sum(map(two, known.values())) / whole) / (1 - sum(map(p1, known))) * p1(w)

    for r in got:
        t = tokens[r.doc_id]
        if len(t) > 100:
            continue  # the plain form is slow
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(w in words for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p2(h, w)) for h, w in zip([" start", *t], t)))
    assert len(got) == len(rows)
    for h in (" start", "one", "alpha1"):  # exactly normalised over the vocabulary and the unknown word
        assert sum(p2(h, w) for w in [*words, "never seen"]) == pytest.approx(1)
    assert katz.katz_scores(empty.withColumn("held_out", F.lit(False))).count() == 0


# Near-duplicates


def _sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(fold(t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_near_duplicates(spark, documents, empty):
    passage, texts = _prose(45), list(TEXTS)
    texts += [passage + " " + _prose(22) for _ in range(25)]  # one passage in common, and yet different
    chain = _prose(80).split()
    texts += [" ".join(chain[i * 4 :] + ["z"]) for i in range(6)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class string")
    sets = _sets(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    for r in near_duplicates.near_duplicates(frame).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_duplicates.near_duplicates(documents).count() == len(TEXTS) + 1
    assert near_duplicates.near_duplicates(empty).count() == 0


# Pages

_PAGE = (
    "<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>"
    "<div class='cookie-notice'><p>We use cookies and say so at length, for a long while.</p></div><div class='post-{n}'><h2>Title &amp; more</h2><p>First  para<br>goes on"
    "<p>Second <b>bold</b> &lt;x&gt;<div class=ad>Buy</div><form><p>Mail?</p></form><section class=comments><p>{long}</p></section></div><footer>c</footer></body></html>"
)


def test_main_text(spark):
    page = _PAGE.replace("{long}", "nice post " * 60)
    rows = [(i, f"http://h.example.com/{i}", page.replace("{n}", str(i))) for i in range(4)]
    rows += [(4, None, None), (5, "http://h.example.com/e", ""), (6, "nothing", "<p>alone"), (6, "nothing", "<p>alone")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = sorted(html_text.main_text(frame).collect(), key=lambda r: r.page_id)
    whole = "Title & more\n\nFirst para goes on\n\nSecond bold <x>"
    assert [r.text for r in got] == [whole] * 4 + ["", "", "alone", "alone"]
    assert [r.n_chars for r in got] == [len(r.text) for r in got]
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_headline_and_lead_beside_sections_stay_and_other_templates_keep_their_article(spark):
    body = "<section class=part><p>" + "part of the text " * 30 + "</p></section>"
    sentence = "A long sentence of the other template. " * 20
    pages = [
        *(f"<body><div class=top><article><h1>Head {i}</h1><p>Lead {i}</p>{body * 3}<ul><li>Item</ul></article></div><p><a href=x>All the news of today</a>" for i in range(4)),
        *(f"<body><div class=box><h1>Head {i}</h1><div class=a><p>{'first words ' * 40}</div><div class=a><p>more</div></div><div class=rest><a href=y>Go to the other pages</a></div>" for i in range(2)),
        f"<body><article><section class=part><p>scrap</p></section></article><td class=main><p>{sentence}</td>",
    ]
    hosts = ["a.example"] * 4 + ["b.example"] * 2 + ["a.example"]
    frame = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(zip(hosts, pages))], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html_text.main_text(frame).collect()}
    for i in range(4):
        assert got[i] == [f"Head {i}", f"Lead {i}", *[("part of the text " * 30).strip()] * 3, "Item"]
    assert got[4] == ["Head 0", ("first words " * 40).strip(), "more"]
    assert got[6] == [sentence.strip()]


def test_all_paths_of_a_page_vote():
    page = "<body>" + "".join(f"<div class={c}><p>{'word ' * n}</div>" for c, n in zip("abcdef", range(9, 3, -1)))
    assert len(html_text.scored_paths(page)) > 5


# Benchmark passages


def _plain_hits(text, items):
    words, hit, found = decontaminate.WORD.findall(fold(text or "")), set(), set()
    for i, item in items:
        for w in decontaminate.windows(decontaminate.WORD.findall(fold(item or ""))):
            for a in range(len(words) - len(w) + 1):
                if tuple(words[a : a + len(w)]) == w:
                    hit.update(range(a, a + len(w)))
                    found.add(i)
    return words, hit, found


@pytest.mark.parametrize("block_words", [1_000_000, 4])
def test_overlaps(spark, documents, empty, block_words):
    items = [(1, " ".join(_BASE.split()[10:30])), (2, "Two THREE"), (3, None), (4, ""), (5, " ".join(_LONG.split()[500:512])), (1, "one")]
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    rows = decontaminate.find_overlaps(documents, benchmark, block_words=block_words).collect()
    for r in rows:
        words, hit, found = _plain_hits(TEXTS[r.doc_id], items)
        assert (r.n_words, r.hit_words, set(r.hit_items)) == (len(words), len(hit), found)
    assert len(rows) == len(TEXTS) + 1
    assert decontaminate.find_overlaps(empty, benchmark).count() == 0
    none = decontaminate.overlap_report(documents, benchmark.limit(0)).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none)


def test_cut_takes_whole_hit_words_and_nothing_else(spark, empty):
    item = "Please Name THE capital City of Every Country in The World"
    texts = [f"A B. I say: {item.upper()}! Then, Ünder A tree, WE rest and Sing a Song of old times Again", "No Passage HERE at All", item, f"{item}. X Y Z\n" * 2, None, "", f"Q{item}", "A B C"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "own") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, hit_words string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.without_overlaps(docs, benchmark).collect()}
    for i, text in enumerate(texts):
        words, hit, _ = _plain_hits(text, [(1, item)])
        assert (i in got) == (2 * len(hit) <= len(words))
        if i not in got:
            continue
        assert got[i].hit_words == "own"
        if not hit:
            assert (got[i].text, got[i].n_chars) == (text, len(text or ""))
        else:
            left = [w for k, w in enumerate(words) if k not in hit]
            assert decontaminate.WORD.findall(fold(got[i].text)) == left and got[i].n_chars == len(got[i].text)
    assert got[0].text.startswith("A B. I say: ! Then, Ünder A tree") and 2 not in got
    assert {r.doc_id: r.text for r in decontaminate.without_overlaps(docs, benchmark.limit(0)).collect()} == dict(enumerate(texts))
    assert decontaminate.without_overlaps(empty, benchmark).count() == 0


def test_blocks_of_a_benchmark_lose_no_window(spark, documents):
    items = [(dt.date(2024, 1, 1 + i % 3), " ".join(_LONG.split()[40 * i : 40 * i + 20 + 25 * i])) for i in range(6)] + [(None, "two three")]
    benchmark = spark.createDataFrame(items, "item_id date, text string")
    blocks = decontaminate.benchmark_blocks(benchmark, block_words=10)
    rows = blocks.collect()
    assert len(rows) > len(items) and max(len(r["words"]) for r in rows) <= 20
    windows = {" ".join(w) for _, text in items for w in decontaminate.windows(decontaminate.WORD.findall(fold(text)))}
    stored = set()
    for r in rows:
        numbers = [r["patterns"][i : i + 10] for i in range(0, len(r["patterns"]), 10)]
        stored |= {" ".join(r["words"][n - 1] for n in window if n) for window in numbers}
    assert stored == windows
    for r in decontaminate.find_overlaps(documents, benchmark, block_words=10).collect():
        _, hit, found = _plain_hits(TEXTS[r.doc_id], items)
        assert (r.hit_words, set(r.hit_items)) == (len(hit), found)


def test_index_against_plain_search():
    r = random.Random(4)
    for _ in range(40):
        words = [r.choice("abcde") for _ in range(r.randint(0, 80))]
        items = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 14)))) for i in range(5)]
        n, spans, found = decontaminate.Benchmark(items).hits([" ".join(words)])[0]
        _, hit, want = _plain_hits(" ".join(words), items)
        assert (n, {x for a, b in spans for x in range(a, b)}, set(found)) == (len(words), hit, want)


# Mixing


def test_mixing(spark, documents, empty):
    rows = mixing.mix(documents).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert r.size == len(WORD.findall(TEXTS[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:  # what is above a ceiling is shared again
        share = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * share > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    target |= {s: weights[s] * share for s in free}
    for s in names:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(documents).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_is_near_with_many_rows(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    sums = mixing.mix(frame).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 50 for r in sums)


# Languages


def test_language(spark, documents, empty):
    r = random.Random(1)
    parts = {"aa": ["ba", "ka", "ta", "ra"], "bb": ["schi", "pfe", "ung", "eit"], "cc": ["ción", "oso", "llo", "que"]}

    def text(lang, n):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    rows = [(i, text(l, 80), l if i % 10 else None, "x") for i, l in enumerate(r.choices(list(parts), k=240))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language.learn(frame.filter(~language.held_out()).select("doc_id", "text", "lang"))
    extra = [(1000, None), (1001, ""), (1002, "12 !?"), (1003, text("aa", 60) + " " + text("bb", 60)), (1003, text("aa", 200))]
    asked = frame.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = language.identify(asked, model).collect()
    truth = {i: l for (i, t, l, _) in rows}
    held = [x for x in got if x.doc_id < 1000 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2 and truth[x.doc_id]]
    assert len(held) > 30 and all(x.lang_pred == truth[x.doc_id] for x in held)
    tail = [x for x in got if x.doc_id >= 1000]
    assert [(x.lang_pred, x.score) for x in tail[:3]] == [("und", 0.0)] * 3
    assert set(tail[3].lang_mix) == {"aa", "bb"} and 0.3 < tail[3].score < 0.7
    assert tail[4].lang_pred == "aa" and tail[4].score == 1.0
    nothing = language.learn(empty.select("doc_id", "text", "lang"))
    assert {x.lang_pred for x in language.identify(documents, nothing).collect()} == {"und"}


def test_a_few_labels_among_many_rows_are_all_learned(spark):
    rows = [(i, "the cat sat on the mat", None) for i in range(3000)]
    rows += [(3000 + i, "wer das liest ist gut", "de") for i in range(20)]
    rows += [(4000 + i, f"one of them says {'abcdefghij'[i % 10]}", "en") for i in range(400)] + [(5000, "qui quae quod", "la")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logs = language.learn(frame, 40)
    assert names == ["de", "en", "la"]
    slots, _ = language.trigrams("qui quae quod")
    assert (logs[2][slots] > logs[0][slots]).all()
    every = language.learn(frame.filter("lang = 'de'"), 1000)
    assert np.allclose(np.exp(logs[0]) / np.exp(logs[0]).max(), np.exp(every[1][0]) / np.exp(every[1][0]).max())


# URL lists


def test_url_filters(spark):
    at = "2024-0{}-15 00:00:00"
    entries = [("domain", "bad.example", True, 1), ("domain", "bad.example", False, 3), ("domain", "bad.example", True, 5), ("host", "a.good.example", True, 2), ("url", "b.good.example/x", True, 1), ("host", None, True, 1), ("domain", "bad.example", True, 1)]
    entries = spark.createDataFrame([(k, v, l, at.format(m)) for k, v, l, m in entries], "kind string, value string, listed boolean, at string").withColumn("at", F.col("at").cast("timestamp"))
    asked = [(1, "http://w.bad.example/", 2), (2, "https://bad.example:80/p", 4), (3, "http://u@W.BAD.example./", 6), (4, "http://notbad.example/", 2), (5, "http://a.good.example/x", 1), (6, "http://a.good.example/x", 2), (7, "http://b.good.example/x?q", 2), (8, None, 2), (9, "http://w.bad.example/", None), (1, "http://w.bad.example/", 2)]
    frame = spark.createDataFrame([(i, u, at.format(m) if m else None, "x") for i, u, m in asked], "page_id long, url string, fetched_at string, kind string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = url_filters.filter_urls(frame, entries).collect()
    assert Counter((r.page_id, r.blocked, r.first_kind) for r in got) == Counter(
        [(1, True, "domain"), (1, True, "domain"), (2, False, None), (3, True, "domain"), (4, False, None), (5, False, None), (6, True, "host"), (7, True, "url"), (8, False, None), (9, False, None)]
    )
    assert url_filters.filter_urls(frame.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filters.filter_urls(frame, entries.limit(0)).collect())
