"""Main text of web pages by host consensus.

Each page scores its containers; Spark adds the scores up per host and
generalised tag-class path; each page is then read again along its host's best
path and what surrounds it of the same article, or along its own best path where
the host's holds a scrap of it. What a page is scored and read with is a small
scanner over its tags.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import in_batches, written

#: Bound on the exception rows that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: A host's path that holds less than this share of the text of the page's own best path is not the page's.
LEAST_COVER = 0.25
#: Text directly in the body counts as part of the article from this share of it on.
BODY_SHARE = 0.1

# Quantifiers that give nothing back: whatever a page holds, each character is passed once.
# Quotes count after an equals sign only, and a quote that nothing closes is part of the value.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/])[^>]*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_READ = frozenset("class id role hidden style aria-hidden".split())
#: Longer paths and steps are shortened to a digest, so that nesting costs nothing.
MOST_PATH = 512
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_DROPPED = frozenset("nav footer aside form button select option input label fieldset dialog menu head title object canvas audio video map".split())
# Words of class names and ids that name what is around an article.
_AROUND = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal"
    " newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer foot masthead topbar share sharing social"
    " related recommended comment comments commentlist replies reply respond disqus tags pagination pager login search"
).split()
_BOILERPLATE = re.compile(rf"(?:^|[-_ ])(?:{'|'.join(_AROUND)})(?:$|[-_ 0-9])", re.I)
# Words that name a part of a page together with one of those.
_PARTS = (
    "area bar block body bottom box button buttons col column container content form group head header holder icons inner item items left link links list"
    " main module outer overlay panel post posts right row section slot stories text title top unit wrap wrapper"
).split()
_HEADER = re.compile(r"(?:^|[-_ ])header(?:$|[-_ 0-9])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_CLOSES_P = frozenset("p div article section main ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote header footer nav aside form figure hr address details".split())
#: The empty tag is the page itself, for what stands outside all containers.
_CONTAINERS = frozenset(["", *"html body main article section div td table tbody tr center blockquote figure details ul ol dl li dd header".split()])


class Node:
    """An element; ``at`` is its number in order of start tags, and the next ``size`` numbers are those below it and its own.

    ``container`` is itself or the nearest container around it, ``paragraph`` the
    place on the stack of a <p> around it inside that container, ``within`` whether
    it is or stands in an article, ``doubtful`` whether its name alone says too little.
    """

    __slots__ = ("tag", "path", "dropped", "parent", "at", "size", "own", "linked", "score", "direct", "kept", "links", "container", "paragraph", "within", "doubtful")

    def __init__(self, tag: str, path: str, dropped: bool, parent: Node | None, at: int, doubtful: bool = False):
        self.tag, self.path, self.dropped, self.parent, self.at, self.size = tag, path, dropped, parent, at, 1
        self.own = self.linked = self.score = self.direct = self.kept = self.links = 0
        self.container = self if parent is None or tag in _CONTAINERS else parent.container
        self.paragraph = 0 if parent is None or tag in _CONTAINERS else parent.paragraph
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.doubtful = doubtful


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text) if text else ():
        name = m[1].lower()
        if name in _READ:  # the first of a name counts
            found.setdefault(name, html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _generalised(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes; digits become 0, so that numbered classes fall together."""
    names = sorted({re.sub(r"[0-9]+", "0", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([tag, *names])


def _joined(path: str, step: str) -> str:
    """The path one step further, shortened where it gets long."""
    step = step if len(step) <= MOST_PATH else _digest(step)
    return f"{path if len(path) <= MOST_PATH else _digest(path)}/{step}"


def _digest(text: str) -> str:
    return "#" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _is_dropped(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not inside_article):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if not inside_article and (_HEADER.search(attributes.get("class", "")) or _HEADER.search(attributes.get("id", ""))):
        return True
    return any(_names_around(attributes[name], not inside_article) for name in ("class", "id") if name in attributes)


def _names_around(names: str, any_part: bool) -> bool:
    """Whether a name has a word of what surrounds articles; in an article, whether all its words say so.

    ``share-buttons`` does in both cases, ``side-effects`` outside an article only.
    """
    if any_part or not _BOILERPLATE.search(names):
        return bool(_BOILERPLATE.search(names))
    for name in names.lower().split():
        words = [w for w in (w.strip("0123456789") for w in name.replace("_", "-").split("-")) if w]
        if any(w in _AROUND for w in words) and all(w in _AROUND or w in _PARTS for w in words):
            return True
    return False


def read_page(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's elements, and its blocks outside dropped elements, as they stand, with the number of their element.

    Linear in the page. Unclosed tags are closed by what follows them: a block
    closes an open paragraph, an end tag closes all up to its start tag. An element
    of an article whose name only contains a word of what surrounds articles is
    dropped if it holds mostly links; else it is read, scored and voted for.
    """
    root = Node("", "", False, None, 0)
    stack, nodes = [root], [root]
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    link = 0  # open <a>
    opened: dict[str, int] = {}  # tags on the stack

    def flush() -> None:
        if not pieces:
            return
        text = "".join(pieces).strip()
        pieces.clear()
        top = stack[-1]
        if not text or top.dropped:
            return
        blocks.append((top.at, text))
        node = top.container
        node.direct += len(text)
        if top.tag not in ("ul", "ol", "li"):  # lists are as often menus as text
            node.own += len(text)

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text = source[at : m.start()]
            if not stack[-1].dropped:
                pieces.append(text)
                if link:
                    stack[-1].container.linked += len(text)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                link = 0 if m["end"] else 1
            continue
        flush()
        if m["end"]:
            depth = stack[-1].paragraph if tag == "p" else 0
            if tag != "p" and opened.get(tag):
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
            if depth:
                for node in stack[depth:]:
                    opened[node.tag] -= 1
                del stack[depth:]
            continue
        if tag in _VOID:
            continue
        if stack[-1].tag == "p" if tag in _CLOSES_P else tag == "li" and stack[-1].tag == "li":
            opened[stack.pop().tag] -= 1
        attributes = _attributes(m["attrs"])
        top = stack[-1]
        step = _generalised(tag, attributes) if tag in _CONTAINERS else tag
        dropped = top.dropped or _is_dropped(tag, attributes, top.within)
        doubtful = not dropped and top.within and any(_names_around(attributes[name], True) for name in ("class", "id") if name in attributes)
        node = Node(tag, _joined(top.path, step), dropped, top, len(nodes), doubtful)
        if tag == "p":
            node.paragraph = len(stack)
        opened[tag] = opened.get(tag, 0) + 1
        nodes.append(node)
        stack.append(node)
    if at < len(source) and not stack[-1].dropped:
        pieces.append(source[at:])
    flush()
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
    if any(node.doubtful for node in nodes):
        blocks = _settled(nodes, blocks)
    return nodes, blocks


def _settled(nodes: list[Node], blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Drop doubtful elements that are mostly links, and all in them; the blocks that stay."""
    text, links = [n.direct for n in nodes], [n.linked for n in nodes]
    for node in reversed(nodes[1:]):
        text[node.parent.at] += text[node.at]
        links[node.parent.at] += links[node.at]
    end = 0
    for node in nodes:
        if node.doubtful and 2 * links[node.at] > text[node.at]:
            end = max(end, node.at + node.size)
        node.dropped = node.dropped or node.at < end
    return [block for block in blocks if not nodes[block[0]].dropped]


def _scored(nodes: list[Node]) -> list[tuple[str, int]]:
    totals: dict[str, int] = {}
    for node in reversed(nodes):
        if node.dropped or node.tag not in _CONTAINERS:
            continue
        score = 3 * max(0, node.own - 2 * node.linked) + node.score
        node.kept += node.direct
        node.links += node.linked
        if node.parent is not None:
            above = node.parent.container
            above.score += score // 3
            above.kept += node.kept
            above.links += node.links
        if score:
            totals[node.path] = totals.get(node.path, 0) + score
    return sorted(totals.items(), key=lambda x: (-x[1], x[0]))


def scored_paths(source: str) -> list[tuple[str, int]]:
    """The container paths of a page with whole-number scores, best first.

    A container has the text of its own blocks in full and a third of what its
    child containers have, less what stands in links.
    """
    return _scored(read_page(source)[0])


def _article(nodes: list[Node], path: str) -> list[Node]:
    """The containers to read for ``path``: those that bear it, or one that holds them all and more of the same article.

    That is the nearest ``article`` around them, else the nearest ``main``, unless
    what it has besides is mostly links. Else containers are climbed as long as
    they have text of their own besides (a headline, a lead), less in other
    children than on the path, and not mostly links; the body only where its own
    text is no trifle.
    """
    found: list[Node] = []
    for node in nodes:
        if node.path == path and not node.dropped and not (found and node.at < found[-1].at + found[-1].size):
            found.append(node)
    if not found:
        return []
    covered, linked, last = sum(n.kept for n in found), sum(n.links for n in found), found[-1].at

    def around(node: Node) -> Iterator[Node]:
        while node.parent is not None:
            node = node.parent.container
            if node.at + node.size > last:
                yield node

    def prose(node: Node) -> bool:
        return 2 * (node.links - linked) <= node.kept - covered

    if any(n.tag in ("article", "main") for n in found):
        return found
    above = list(around(found[0]))
    named = next((n for n in above if n.tag == "article"), None) or next((n for n in above if n.tag == "main" and prose(n)), None)
    if named is not None:
        return [named]
    for node in above:
        own, least = node.direct - 2 * node.linked, BODY_SHARE * covered if node.tag in ("", "html", "body") else 0
        if own <= least or node.kept - covered - node.direct > covered or not prose(node):
            break
        found, covered, linked = [node], node.kept, node.links
    return found


def _text(nodes: list[Node], blocks: list[tuple[int, str]], path: str) -> str:
    out, spans, k = [], [(n.at, n.at + n.size) for n in _article(nodes, path)], 0
    for at, raw in blocks:
        while k < len(spans) and at >= spans[k][1]:
            k += 1
        if k < len(spans) and at >= spans[k][0] and (block := " ".join(html.unescape(raw).split())):
            out.append(block)
    return "\n\n".join(out)


def extract(source: str, path: str | None) -> str:
    """Text along ``path``; along the page's own best path where that one holds little of it or is not there."""
    nodes, blocks = read_page(source)
    own = _scored(nodes)
    text = _text(nodes, blocks, path) if path is not None else ""
    if own and own[0][0] != path:
        best = _text(nodes, blocks, own[0][0])
        if len(text) < LEAST_COVER * len(best):
            return best
    return text


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the generalised path with the highest sum of scores, ties by path."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], int] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for path, value in scored_paths(source or ""):
                    sums[host, path] = sums.get((host, path), 0) + value
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())],
                names=["host", "path", "score"],
            )

    votes = in_batches(pages.select(_host().alias("host"), "html"), score, "host string, path string, score long")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("less"), "path")).alias("best"), F.sum("score").alias("score")).select("host", "best.path", "score")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``; other columns are ignored.

    NULL or empty html gives an empty text. Pages whose url has no host vote
    together. Repeated rows give repeated rows, no rows give none, and pages of
    any length are read whole. The winning path of most hosts is the commonest
    one; only hosts with another are looked up, by broadcast while they are few.
    """
    winners = written(host_paths(pages))
    common = winners.groupBy("path").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "path").first()
    default = common["path"] if common else None
    others = winners.filter(F.col("path") != F.lit(default)).select("host", "path")
    few = others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = pages.select("page_id", "url", "html", _host().alias("host")).join(F.broadcast(others) if few else others, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(s or "", default if p is None else p) for s, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return in_batches(rows.select("page_id", "url", "html", "path"), read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
