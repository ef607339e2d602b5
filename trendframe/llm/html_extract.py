"""Main-text extraction by consensus host paths.

Every page's containers are scored by the running text in them; the page
votes for the generalised path of its best one - tags and classes from the
root, with digits replaced - and Spark counts the votes per host. Pages are
then extracted again by the winning paths of their host: a page whose own
best container is a long menu or comment thread follows the majority of its
site. A page that has none of its host's paths keeps its own best container.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Winning paths of a host.
PATHS = 5
#: Parts a host's pages are dealt to.
SALTS = 32

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S)
#: A tag whose quotes do not close ends at the next ``>`` or before the next ``<``.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>?")
_QUOTES = re.compile(r"""["'>]""")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Character references of more digits than any character has.
_LONG_REF = re.compile(r"&#[0-9]{8,}+;?")
_ZEROS = re.compile(r"&#0++(?=[0-9])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Never part of an article.
SKIP = frozenset("head script style noscript iframe template svg math object canvas audio video nav aside footer form "
                 "button select textarea menu dialog noembed noframes title datalist".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead cookie cookies consent gdpr notice "
    "notification popup modal overlay newsletter subscribe subscription signup social share sharing related "
    "recommended recommendations comment comments commentlist disqus respond replies reply login search toolbar "
    "pagination pager".split())
SKIP_PREFIX = frozenset("with has no without is".split())
CONTAINERS = frozenset("article main section div td body center blockquote details".split())
KEPT = frozenset("html body main article".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol option p pre section summary "
                   "table tbody td tfoot th thead tr ul".split())
#: An opening tag ends these open elements, up to one of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
#: What an opening tag ends, and what stops it: an open paragraph, and elements of its own kind.
PARAGRAPH = (("p",), tuple(CONTAINERS))
IMPLIED = {tag: ((*ended, "p"), tuple((CONTAINERS | bounds) - ended)) for tag, (ended, bounds) in ENDS.items()}
#: How much a container's kind says for it.
WEIGHT = {"article": 2.0, "main": 1.5, "body": 0.6}


@dataclass
class Container:
    path: int           # its generalised path in the page's tree of paths
    parent: int
    tag: str
    first: int          # its first block
    last: int = -1      # one past its last block
    score: float = 0.0


@dataclass
class Page:
    containers: list[Container] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    #: (path around it, step) -> path; each path's outer path and step
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    steps: list[tuple[int, str]] = field(default_factory=list)

    def inner(self, path: int, step: str) -> int:
        """The path of a step inside ``path`` (-1: the outermost)."""
        at = self.paths.setdefault((path, step), len(self.steps))
        if at == len(self.steps):
            self.steps.append((path, step))
        return at

    def path_of(self, k: int) -> str:
        """A container's whole path as text."""
        at, out = self.containers[k].path, []
        while at >= 0:
            at, step = self.steps[at]
            out.append(step)
        return ">".join(reversed(out))

    def find(self, path: str) -> int | None:
        at: int | None = -1
        for step in path.split(">"):
            at = self.paths.get((at, step))
            if at is None:
                return None
        return at

    def text(self, spans: list[tuple[int, int]]) -> str:
        return " ".join(b for a, z in spans for b in self.blocks[a:z])

    def best(self) -> int | None:
        """The container with most running text; the first of equals."""
        found = [(-c.score, k) for k, c in enumerate(self.containers) if c.score > 0]
        return min(found)[1] if found else None

    def by_paths(self, paths: list[str]) -> str | None:
        """Text of all containers that have the first path the page knows."""
        for path in paths:
            spans, end, at = [], 0, self.find(path)
            for c in self.containers if at is not None else ():
                if c.path == at and c.first >= end and c.last > c.first:
                    spans.append((c.first, c.last))
                    end = c.last
            if spans:
                return self.text(spans)
        return None

    def own(self) -> str:
        k = self.best()
        return self.text([(0, len(self.blocks))] if k is None else [(self.containers[k].first, self.containers[k].last)])


def boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element with everything in it is no part of an article."""
    if tag in SKIP or tag == "header" and not in_article:
        return True
    if not attrs or tag in KEPT:
        return False
    if _HIDDEN.search(attrs):
        return True
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name == "role" and (a or b or c).strip().lower() in SKIP_ROLES:
            return True
        if name in ("class", "id"):
            for token in (a or b or c).lower().split():
                words = re.split(r"[-_]+", token)
                if words[0] in SKIP_WORDS or words[-1] in SKIP_WORDS and words[0] not in SKIP_PREFIX:
                    return True
                if token == "header" and not in_article:
                    return True
    return False


def step(tag: str, attrs: str) -> str:
    """An element's part of a generalised path."""
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if name.lower() == "class" and (a or b or c).strip():
            names = {_DIGITS.sub("0", x) for x in (a or b or c).lower().replace(">", "").split()}
            return tag + "." + ".".join(sorted(names))
    return tag


class Broken:
    """Which tags of a page never end, found once for the whole page.

    A tag ends at the first ``>`` outside quotes. From the page's end
    backwards, each quote and ``>`` learns whether such an end lies ahead of
    a tag that is outside quotes there.
    """

    def __init__(self, html: str):
        self.marks = [m.start() for m in _QUOTES.finditer(html)]
        self.ends = [False] * (len(self.marks) + 1)
        later = {}  # the nearest quote of each kind ahead
        for i in range(len(self.marks) - 1, -1, -1):
            c = html[self.marks[i]]
            if c == ">":
                self.ends[i] = True
            else:
                j = later.get(c)
                self.ends[i] = j is not None and self.ends[j + 1]
                later[c] = i

    def at(self, start: int) -> bool:
        return not self.ends[bisect_left(self.marks, start)]


def tags(html: str) -> list[tuple[int, int, bool, str, str]]:
    """start, end, closing, name, attributes of a page's tags in one pass.

    Comments and declarations have no name. A raw element (script, title and
    the like) is one entry that ends after its closing tag, or at the page's
    end. Linear in the page, however malformed it is.
    """
    out = []
    at, broken, last = 0, None, html.rfind(">")
    while (start := html.find("<", at)) >= 0:
        m, known = None, start < last and (broken is None or not broken.at(start))
        if known or html.startswith("<!--", start):
            m = _TAG.match(html, start)
        if m is None:
            m = _LOOSE.match(html, start)  # only a tag, so a lone "<" stays text
            if m and known:
                broken = Broken(html)
        if m is None:
            at = start + 1
            continue
        at = m.end()
        tag, attrs = (m[2] or "").lower(), m[3] or ""
        if tag in RAW and not m[1] and not attrs.endswith("/"):
            end = _ENDS_OF[tag].search(html, at)
            at = end.end() if end else len(html)
        out.append((start, at, bool(m[1]), tag, attrs))
    return out


_ENDS_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}


def parse(html: str) -> Page:
    """Blocks of text and the containers around them, without boilerplate.

    Linear in the page, however deep or malformed it is.
    """
    page = Page()
    stack: list[tuple[str, int, int, bool]] = []  # tag, path, innermost container, in an article
    where: dict[str, list[int]] = {}              # tag -> its places in the stack
    open_text: list[str] = []
    link, link_chars = 0, 0
    found = tags(html)
    partners: dict[str, dict[int, int]] = {}

    def flush():
        nonlocal link_chars
        if open_text:
            text = _SPACE.sub(" ", decoded("".join(open_text))).strip()
            open_text.clear()
            if text:
                page.blocks.append(text)
                worth = max(len(text) - 2 * link_chars, 0)
                k = stack[-1][2] if stack else -1
                share = 1.0
                while k >= 0 and share > 0.2:
                    c = page.containers[k]
                    c.score += worth * share * WEIGHT.get(c.tag, 1.0)
                    k, share = c.parent, share / 2
        link_chars = 0

    def close(depth: int):
        flush()
        while len(stack) > depth:
            tag, _, k, _ = stack.pop()
            where[tag].pop()
            if k >= 0 and (not stack or stack[-1][2] != k):
                page.containers[k].last = len(page.blocks)

    def end_implied(tag: str):
        """Close what an opening tag ends: a paragraph, and elements of its own kind up to their bound."""
        ended, walls = IMPLIED.get(tag, PARAGRAPH)
        opened = [x for t in ended if (x := where.get(t))]
        if not opened:
            return
        wall = max((where[t][-1] for t in walls if where.get(t)), default=-1)
        if ended is PARAGRAPH[0]:
            if opened[0][-1] > wall:
                close(opened[0][-1])
            return
        inside = [x[k] for x in opened if (k := bisect_right(x, wall)) < len(x)]
        if inside:
            close(min(inside))

    at, i = 0, 0
    while i < len(found):
        start, end, closing, tag, attrs = found[i]
        if start > at:
            open_text.append(html[at:start])
            if link:
                link_chars += start - at
        at, i = end, i + 1
        if not tag:
            continue
        if closing:
            if tag == "a":
                link = max(link - 1, 0)
            elif tag in BLOCKS:
                if where.get(tag):
                    close(where[tag][-1])
                else:
                    flush()
            continue
        if tag == "a":
            link += 1
            continue
        if tag == "br":
            open_text.append(" ")
            continue
        in_article = bool(stack) and stack[-1][3]
        if tag in RAW or boilerplate(tag, attrs, in_article):
            if tag in BLOCKS or tag in ("head", "menu"):
                flush()
            if tag not in RAW and tag not in VOID and not (attrs.endswith("/") and tag not in BLOCKS):
                if tag not in partners:
                    partners[tag] = closers(found, tag)
                j = partners[tag].get(i - 1)
                if j is not None:  # an element that is never closed goes on right here
                    at, i = found[j][1], j + 1
            continue
        if tag not in BLOCKS:
            continue
        end_implied(tag)
        flush()
        if tag in VOID:
            continue
        parent = stack[-1][2] if stack else -1
        path = page.inner(stack[-1][1] if stack else -1, step(tag, attrs))
        k = parent
        if tag in CONTAINERS:
            k = len(page.containers)
            page.containers.append(Container(path, parent, tag, len(page.blocks)))
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, k, in_article or tag in ("article", "main")))
    if at < len(html):
        open_text.append(html[at:])
    close(0)
    return page


def decoded(text: str) -> str:
    """Character references decoded; a number of too many digits is no character."""
    return unescape(_LONG_REF.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text)


def closers(found: list, tag: str) -> dict[int, int]:
    """Which closing tag belongs to each opening tag of a kind."""
    out, opened = {}, []
    for i, (_, _, closing, name, _) in enumerate(found):
        if name == tag:
            if not closing:
                opened.append(i)
            elif opened:
                out[opened.pop()] = i
    return out


def host(url: Column) -> Column:
    """Lower-cased host of a URL; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n: how many of the host's pages have their best container there."""
    def run(batches):
        for b in batches:
            hosts, paths = [], []
            for h, html in zip(b.column(0).to_pylist(), b.column(1)):
                page = parse(html.as_py() or "")
                k = page.best()
                if k is not None:
                    hosts.append(h)
                    paths.append(page.path_of(k))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string")
    return found.groupBy("host", "path").agg(F.count("*").alias("n"))


def extract(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """page_id, url, text, n_chars, by_host for each row.

    Blocks are joined by one space, white space inside a block is one space,
    character references are decoded. ``by_host`` tells whether one of the
    host's winning paths was used. A null html is empty and gives an empty
    text; pages without a host vote together. Rows may repeat. An empty table
    gives an empty result; other columns are not read.
    """
    ranked = Window.partitionBy("host").orderBy(F.desc("n"), "path")
    winners = (votes(pages).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= paths)
               .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("found"))
               .select("host", F.col("found.path").alias("paths"),
                       F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    winners = staged(winners, "paths")
    dealt = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "paths")

    def run(batches):
        for b in batches:
            text, by_host = [], []
            for html, known in zip(b.column(2), b.column(3).to_pylist()):
                page = parse(html.as_py() or "")
                found = page.by_paths(known or [])
                by_host.append(found is not None)
                text.append(page.own() if found is None else found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                 pa.array(by_host)], ["page_id", "url", "text", "n_chars", "by_host"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_host boolean")
