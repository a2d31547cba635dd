"""Main text of odd and hostile pages, and of random ones against a plain parser."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from wayfare.llm import html_text


def _read(page):
    best = html_text.scored_paths(page)
    return html_text.extract(page, best[0][0] if best else None)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>one</p><svg-icon></svg-icon><style-x a=1>in</style-x><p>two</p></article>", "one\n\nin\n\ntwo"),
        ('<article><p>a</p><svg viewBox="0 0"/><svg/><p>b</p><svg><text>no</text></svg></article>', "a\n\nb"),
        ("<article><script data-x='>'>no</script><p title=don't>it is</p><p title=a\"b>x</p></article>", "it is\n\nx"),
        ('<div title="our class id" data-class="ad" class="story"><p>kept text</p></div>', "kept text"),
        ('<div class=story class="ad"><p>the first counts</p></div>', "the first counts"),
        ('<div><a href="x>y">link</a><p>text = "q" > z</p></div>', 'link\n\ntext = "q" > z'),
        ('<p title="unclosed>text</p><p>more</p>', "text\n\nmore"),
        ("<p>a<p>b</div></p>c", "a\n\nb\n\nc"),
        ("<script>never closed <p>x", ""),
    ],
)
def test_odd_markup(page, text):
    assert _read(page) == text


def test_names_that_only_contain_a_word_are_read_by_what_they_hold():
    page = (
        '<article><p>Start of it all.</p><div class="side-effects"><p>Nausea and more text here</p></div>'
        '<section id="related-work-2"><p>Earlier work did this</p></section>'
        '<div class="related-reading"><a href=1>Link one</a> <a href=2>Link two</a></div>'
        '<div class="share-buttons">Share</div><div class="related_posts-2">Other</div><div class="ad">Buy</div></article>'
    )
    assert _read(page) == "Start of it all.\n\nNausea and more text here\n\nEarlier work did this"
    assert _read('<div class="side-effects"><p>not in an article</p></div>') == ""


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 40000 + '"',
        "<div>x" * 20000,
        "<div>" * 20000 + "</x>" * 20000,
        "<p>" + "<div>" * 20000 + "</p>" * 20000,
        "<script " * 40000,
        "<script></script " * 40000,
        '<a x="' * 40000,
        "<foo>t" * 20000,
        '<div class="' + "c " * 40000 + '">' + "<div>t" * 10000,
        "<!--" * 40000,
    ],
    ids=range(10),
)
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    _read(page)
    whole = time.process_time() - start
    assert whole < 20 * len(page) / 1e6 + 1  # square time would be minutes


class _Plain(HTMLParser):
    """Blocks of a well-formed page outside the tags that are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.piece, self.out = [], "", 0

    def cut(self):
        if block := " ".join(self.piece.split()):
            self.blocks.append(block)
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "a", "em"):
            return
        if tag == "br":
            self.piece += " "
            return
        self.cut()
        self.out += tag in ("nav", "aside", "form", "footer")

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "em", "br"):
            self.cut()
            self.out -= tag in ("nav", "aside", "form", "footer")

    def handle_data(self, data):
        if not self.out:
            self.piece += data


@pytest.mark.parametrize("seed", range(30))
def test_random_articles_equal_a_plain_parser(seed):
    r = random.Random(seed)

    def words():
        return " ".join(r.choice(["one", "two &amp; three", "caf&eacute;", "x &lt; y", "<b>bold</b>", "a<br>b", "\n new"]) for _ in range(r.randint(1, 9)))

    def inner(depth):
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.choice(["p", "p", "h2", "div", "section", "ul", "nav", "aside", "form"])
            if kind in ("p", "h2"):
                out.append(f"<{kind} title=don't>{words()}</{kind}>")
            elif kind == "ul":
                out.append("<ul>" + "".join(f"<li>{words()}</li>" for _ in range(3)) + "</ul>")
            elif depth:
                out.append(f'<{kind} class="c{depth}">{inner(depth - 1)}</{kind}>')
        return "".join(out)

    article = f"<p>{words()}</p>{inner(3)}"
    plain = _Plain()
    plain.feed(article)
    plain.cut()
    page = f"<html><head><title>t</title></head><body><nav><a href=/>home</a></nav><article>{article}</article><footer>end</footer></body></html>"
    path = "/html/body/article"
    assert html_text.extract(page, path).split("\n\n") == plain.blocks
