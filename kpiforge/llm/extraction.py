"""Main text of web pages by consensus paths per host.

A page is read into blocks of text and the elements that contain them.  Each
container (article, div, section, table cell, ...) is scored by the share of
the page's running text it holds, by how little else it holds, and by depth.  A
container's path is the chain of its tags with their classes, generalised
(numbers and order removed).  Pages vote for the path of their best container,
with its score; Spark adds the votes by host and path, and the path with most votes wins.
Pages are then read again: the text of the elements on the winning path, and
where a page has none, of its own best container.

What never is main text: menus, headers, footers, sidebars, notices,
advertisements, forms, scripts, styles, comments in the markup and readers'
comments, told by tag, role or words in class and id.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space.

Cases.  Null or empty html: empty text.  No url: the page's own best
container.  Open or stray tags are taken as they come; a page without markup
is one block.  Very long pages are read whole, in time
linear in their length, whatever they hold.  Repeated rows each keep their
row and vote.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import same_type, stored

# fixed values: tags and words in class, id and role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg canvas math head title select textarea option button audio video".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset label input".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong
sub sup time tt u var wbr img""".split())
CONTAINERS = frozenset("body main article section div td center".split())
AWAY = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr
newsletter subscribe subscription signup breadcrumb breadcrumbs nav navbar navigation menu pagination pager related recommended
recommendations share sharing social comment comments disqus respond reply replies popup modal overlay paywall login""".split())
WEAK = frozenset("sidebar header footer masthead widget banner notice alert toolbar copyright legal search aside rail skip meta tags byline".split())
BODY = frozenset("content article main post entry story body text page wrapper container".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLOSES = {"p": frozenset("""address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
hr main menu nav ol p pre section table ul""".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

_NAME = re.compile(r"</?+([A-Za-z][^\s/>]*+)")
_RUN = re.compile(r"[^>\"']*+")
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}


class Node:
    """An element: its parent, the innermost element around it (or itself) that is no inline element, containers around it,
    and by tag the innermost of the elements, from itself outwards, that a next one may close."""

    __slots__ = ("tag", "label", "parent", "away", "link", "block", "depth", "level", "inside", "open", "text", "good", "nest", "ends")

    def __init__(self, tag, label, parent, away, link):
        self.tag, self.label, self.parent, self.away, self.link = tag, label, parent, away, link
        self.block = self if parent is None or tag not in INLINE else parent.block
        self.depth = 0 if parent is None else parent.depth + (parent.tag in CONTAINERS)
        self.open = {} if self.block is self else None  # inline elements that are open in a block, by tag
        self.nest = 0 if parent is None else parent.nest + 1
        self.ends = {**parent.ends, tag: self} if tag in CLOSES else {}
        self.text = self.good = self.level = 0
        self.inside = False


class Marks:
    """Tags, comments and declarations of a page, one after another, in time linear in its length: what a search found out about
    the rest of the page (no ``>`` follows, a quote stays open) is not found out again at the next ``<``."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quote = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()  # quotes from which no tag's end is reached

    def _end(self, at: int) -> int:
        """Where the attributes from ``at`` end: the first > outside quotes (-1: there is none)."""
        page, n, seen = self.page, len(self.page), []
        while at <= self.last:
            at = _RUN.match(page, at).end()
            if at >= n:
                break
            mark = page[at]
            if mark == ">":
                return at
            if at in self.dead or at >= self.quote[mark]:
                seen.append(at)
                break
            seen.append(at)
            at = page.index(mark, at + 1) + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int):
        """The first mark from ``at`` on: start, end, whether it closes, tag ("" for no tag) and attributes; None after the last."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, False, "", ""
            if at > self.last:
                # no > follows: the rest is text, but for a comment
                at = page.find("<!--", at)
                if at < 0:
                    return None
                continue
            if page.startswith(("<!", "<?"), at):
                return at, page.index(">", at) + 1, False, "", ""
            name = _NAME.match(page, at)
            if name:
                end = self._end(name.end())
                end = page.find(">", name.end()) if end < 0 else end
                if end >= 0:
                    return at, end + 1, page[at + 1] == "/", name[1], page[name.end(): end]
            at += 1


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for name, value in _ATTR.findall(text):
        out.setdefault(name.lower(), entities.unescape(value.strip("\"'")) if value else "")
    return out


def _label(tag: str, given: dict[str, str]) -> str:
    """The tag with its generalised classes."""
    names = sorted({w for c in given.get("class", "").lower().split() if (w := re.sub(r"\d+|>", "#", c))})
    return ".".join([tag, *names])


def _away(tag: str, given: dict[str, str]) -> bool:
    """Whether an element is no part of an article."""
    if tag in ASIDE or tag in HIDDEN or given.get("role", "").lower() in ROLES:
        return True
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return tag not in ("body", "html")
    if tag in ("html", "body", "main", "article"):
        return False
    words = set(_WORD.findall((given.get("class", "") + " " + given.get("id", "")).lower()))
    return bool(words & AWAY) or bool(words & WEAK and not words & BODY)


def read(page: str) -> tuple[list[tuple[str, Node, int]], list[Node]]:
    """Blocks of a page in order (text, innermost element that is no inline element, characters inside links), and its elements,
    each after the one around it."""
    root = Node("", "", None, False, False)
    marks, top, blocks, nodes, held, links, at, n = Marks(page), root, [], [root], [], 0, 0, len(page)
    count: dict[str, int] = {}  # open elements by tag

    def flush():
        nonlocal links
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                blocks.append((text, top.block, links))
            held.clear()
            links = 0

    def leave(until):
        """Close elements from the innermost to ``until``, itself included."""
        nonlocal top
        while True:
            gone, top = top, top.parent
            count[gone.tag] -= 1
            if gone.open is None:
                gone.block.open[gone.tag] -= 1
            if gone is until:
                return

    while at < n:
        mark = marks.next(at)
        stop = mark[0] if mark else n
        if stop > at:
            run = page[at:stop]
            held.append(run)
            if top.link:
                links += len(run)
        if not mark:
            break
        _, at, close, tag, rest = mark
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if close:
            # an inline element is closed inside its block only; nothing is looked for that is not open
            if (top.block.open if tag in INLINE else count).get(tag):
                found = top
                while found.tag != tag:
                    found = found.parent
                leave(found)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # an open inline element does not reach over blocks, an open paragraph not over the next
            if top is not top.block:
                found = top
                while found.parent is not top.block:
                    found = found.parent
                leave(found)
            ends = [x for x in top.ends.values() if tag in CLOSES[x.tag]]  # elements may nest in their like without end: no walk
            if ends:
                leave(max(ends, key=lambda x: x.nest))
        given = _attributes(rest) if rest else {}
        if tag in RAW and not rest.endswith("/"):
            end = _END[tag].search(page, at)
            at = end.end() if end else n
            continue
        top = Node(tag, _label(tag, given), top, top.away or _away(tag, given), top.link or tag == "a")
        nodes.append(top)
        count[tag] = count.get(tag, 0) + 1
        if top.open is None:
            top.block.open[tag] = top.block.open.get(tag, 0) + 1
    flush()
    return blocks, nodes


def _path(node: Node) -> str:
    """Labels from the outermost element down to this one."""
    chain = []
    while node.tag:
        chain.append(node.label)
        node = node.parent
    return ">".join(reversed(chain))


def scores(blocks, nodes) -> dict[Node, float]:
    """Score of each container: the square of its share of the page's running text, times the share of that in all its
    text, times a bonus for depth; so the deepest container that holds nearly all of the text scores best."""
    for node in nodes:
        node.text = node.good = 0
    for text, node, links in blocks:
        node.text += len(text)
        node.good += 0 if node.away else max(len(text) - 2 * links, 0)
    for node in reversed(nodes[1:]):  # what an element holds, the one around it holds too
        node.parent.text += node.text
        node.parent.good += node.good
    total = nodes[0].good
    return {x: (x.good / total) ** 2 * (x.good / x.text) * (1 + 0.1 * min(x.depth, 8)) for x in nodes
            if x.good and x.tag in CONTAINERS and not x.away}


def best_container(blocks, nodes) -> tuple[Node | None, float]:
    """The container with the highest score (ties: the deeper one)."""
    rank = scores(blocks, nodes)
    best = max(rank, key=lambda x: (rank[x], x.depth), default=None)
    return best, rank.get(best, 0.0)


def votes(page: str) -> dict[str, int]:
    """A page's vote: the path of its best container, with its score in thousandths."""
    best, score = best_container(*read(page))
    return {_path(best): round(1000 * score)} if best is not None else {}


def main_text(page: str | None, path: str | None) -> str:
    """Text of the elements on the path; without one, of the page's best container, or else all that is not set aside."""
    blocks, nodes = read(page or "")
    if path:
        labels = path.split(">")
        for node in nodes[1:]:  # level: how many labels of the path lead to an element (-1: it lies beside the path)
            up = node.parent
            on = 0 <= up.level < len(labels) and node.label == labels[up.level]
            node.level = up.level + 1 if on else -1
            node.inside = up.inside or (node.level == len(labels) and node.tag in CONTAINERS)
        inside = [text for text, node, _ in blocks if node.inside and not node.away]
        if inside:
            return " ".join(inside)
    best, _ = best_container(blocks, nodes)
    for node in nodes:
        node.inside = best is None or node is best or (node.parent is not None and node.parent.inside)
    return " ".join(text for text, node, _ in blocks if node.inside and not node.away)


def _vote(batches):
    for batch in batches:
        host, path, vote = [], [], []
        for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for p, v in votes(page or "").items():
                host.append(h)
                path.append(p)
                vote.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(vote, pa.int64())], ["host", "path", "vote"])


def _extract(batches):
    for batch in batches:
        text = [main_text(page, path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def host_of(url):
    """Host of a url column in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, votes``: the winning container path of each host."""
    src = same_type(pages, {url: "string", html: "string"}).select(host_of(F.col(url)).alias("host"), html).where("host IS NOT NULL")
    cast = src.mapInArrow(_vote, "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    best = F.max_by("path", F.struct("votes", F.length("path"), "path"))
    return cast.groupBy("host").agg(best.alias("path"), F.max("votes").alias("votes"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.  The paths' table is broadcast only where Spark finds it small."""
    paths = stored(host_paths(pages, url, html), "host-paths")
    src = same_type(pages, {page_id: "long", url: "string", html: "string"}).select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    return src.join(paths.select("host", "path"), "host", "left").select("page_id", "url", "html", "path").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
