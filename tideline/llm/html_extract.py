"""Main text of web pages by consensus of each host's pages on the container that holds it."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, heavy_join

#: A quote opens a value only after an equals sign; an unquoted value ends at white space or the tag's end. Nothing that was taken is given back, so broken tags take no longer.
_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))?+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+{_VALUE})*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]*+))?+""")
SPACE = re.compile(r"\s+")

# HTML's element kinds.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section table tbody td tr".split())
#: A start tag of the key ends an open element of these names, unless one of the others lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
SCOPE = frozenset("article aside body div dl footer form header main nav ol section table td th ul".split())
JUNK_TAG = frozenset("nav footer aside form head button select option label input menu dialog object svg canvas audio video applet search datalist script style textarea noscript iframe template".split())
JUNK_ROLE = frozenset("navigation banner complementary contentinfo search dialog alert menu menubar toolbar".split())
JUNK_WORD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond discussion share sharing social related recommended recommendation newsletter subscribe subscription signup login popup modal overlay pagination pager widget toolbar skip copyright".split())
GOOD_WORD = frozenset("article content entry post story text main body page".split())
#: Parts that make a class name one of layout: before a junk word (with-sidebar), or after it (comments-open, related-story).
LAYOUT_FIRST = frozenset("with without no has is".split())
LAYOUT_LAST = frozenset("open opened closed wrap wrapper enabled disabled article entry main page post story".split())
COMMENT_WORD = frozenset("comment comments disqus reply replies respond discussion".split())
#: Only these can be junk by their name: a block of prose is never.
GROUPING = frozenset("center details div dl fieldset figure li ol section table tbody td tr ul".split())


@dataclass
class Element:
    tag: str
    path: int  # of the page's paths
    parent: int
    junk: bool
    weight: float = 1.0
    clean: int = 0  # characters of text that is neither junk nor link, below it
    all: int = 0  # characters of any text below it
    soft: bool = False  # junk by its name or as a form, unless it holds most of the page's text
    hard: bool = False  # junk in any case


@dataclass
class Page:
    """Paths are numbers: each is its parent's number and a tag with classes, so that deep nesting costs no more a tag."""

    elements: list[Element] = field(default_factory=list)
    paths: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "")])
    path_of: dict[tuple[int, str], int] = field(default_factory=dict)
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)  # element, block, text, in a link

    def path(self, parent: int, label: str) -> int:
        found = self.path_of.get((parent, label))
        if found is None:
            found = self.path_of[parent, label] = len(self.paths)
            self.paths.append((parent, label))
        return found

    def spelled(self, path: int) -> str:
        labels = []
        while path:
            path, label = self.paths[path]
            labels.append(label)
        return "".join(">" + x for x in reversed(labels))

    def number(self, spelled: str) -> int | None:
        """The number of a path, if the page has it; of the empty one 0."""
        path = 0
        for label in spelled.split(">")[1:]:
            if (path := self.path_of.get((path, label))) is None:
                return None
        return path


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", value.lower()) if w]


def _junk_words(values: dict[str, str]) -> set[str]:
    """The junk words in class names and the id, without names of layout."""
    found = set()
    for name in (*values.get("class", "").split(), *values.get("id", "").split()):
        words = _words(name)
        if words and words[0] not in LAYOUT_FIRST and words[-1] not in LAYOUT_LAST:
            found |= JUNK_WORD.intersection(words)
    return found


def settle(page: Page) -> None:
    """Set what is junk: what an element is by itself or by the one around it; soft junk with most of the text is none."""
    elements = page.elements
    for e in elements[1:]:
        e.hard = e.hard or elements[e.parent].hard
    plain = [0] * len(elements)
    if any(e.soft for e in elements):
        for k, _, data, link in page.runs:
            if not link and not elements[k].hard:
                plain[k] += len(data.strip())
        for k in range(len(elements) - 1, 0, -1):
            plain[elements[k].parent] += plain[k]
    for k, e in enumerate(elements[1:], 1):
        e.junk = e.hard or elements[e.parent].junk or (e.soft and 2 * plain[k] <= plain[0])


def parse(html: str) -> Page:
    """Elements with generalised tag-class paths, and text runs with the element and block that each is in.

    The work is in proportion to the text: how many elements of a name are open is counted, so the stack is searched
    only for names that are in it, and what is found is closed.
    """
    page = Page()
    elements, runs = page.elements, page.runs
    elements.append(Element("", 0, -1, False))
    stack, names, block, at = [0], [""], 0, 0
    open_now: Counter[str] = Counter()

    def close_to(depth: int) -> None:
        nonlocal block
        while len(stack) > depth:
            name = names.pop()
            stack.pop()
            open_now[name] -= 1
            block += name in BLOCK

    def text(data: str) -> None:
        if data and not data.isspace():
            runs.append((stack[-1], block, unescape(data) if "&" in data else data, open_now["a"] > 0))
        elif data:
            runs.append((stack[-1], block, " ", open_now["a"] > 0))

    def nearest(wanted, among) -> int:
        """The place of the innermost open element of the wanted names, before one of the others; 0 if there is none."""
        for k in range(len(names) - 1, 0, -1):
            if names[k] in wanted:
                return k
            if names[k] in among:
                return 0
        return 0

    last = html.rfind(">") + 1  # no tag ends beyond
    while m := TOKEN.search(html, at, last):
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                at = at if m[0].endswith("]]>") else len(html)
                text(html[m.start() + 9 : at].removesuffix("]]>"))
            elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)
            continue
        tag = m[2].lower()
        if m[1]:
            if open_now[tag]:
                if low := nearest((tag,), () if tag in SCOPE else SCOPE):
                    close_to(low)
            elif tag == "p":
                block += 1
            continue
        if tag == "br":
            runs.append((stack[-1], block, " ", False))
            continue
        ends = ENDS.get(tag, ()) + (("p",) if tag in BLOCK else ())
        while any(open_now[x] for x in ends) and (low := nearest(ends, SCOPE.difference(ends))):
            close_to(low)
        if tag in BLOCK:
            block += 1
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        parent = elements[stack[-1]]
        values = {k.lower(): v.strip("\"'") for k, v in reversed(ATTRIBUTE.findall(m[3]))} if m[3] else {}  # of equal names the first
        classes = sorted({re.sub(r"\d+", "#", c.replace(">", "#")) for c in values.get("class", "").lower().split()})
        words = [*_words(values.get("class", "")), *_words(values.get("id", ""))] if values else []
        inside = open_now["article"] or open_now["main"]
        bad = _junk_words(values) if words and tag in GROUPING else ()
        hard = (tag in JUNK_TAG and tag != "form") or (tag == "header" and not inside) or values.get("role", "").lower() in JUNK_ROLE or "hidden" in values or any(w in COMMENT_WORD for w in bad) or (tag == "article" and any(w in ("comment", "comments", "reply") for w in words))
        weight = 1.0 + 0.6 * (tag in ("article", "main")) + 0.3 * any(w in GOOD_WORD for w in words)
        path = parent.path if tag == "html" else page.path(parent.path, ".".join([tag.replace(">", "#"), *classes]))
        elements.append(Element(tag, path, stack[-1], False, weight, soft=tag == "form" or bool(bad), hard=hard))
        stack.append(len(elements) - 1)
        names.append(tag)
        open_now[tag] += 1
    text(html[at:])
    settle(page)
    return page


def measure(page: Page) -> None:
    elements = page.elements
    for k, _, data, link in page.runs:
        size = len(data.strip())
        elements[k].all += size
        if not link and not elements[k].junk:
            elements[k].clean += size
    for k in range(len(elements) - 1, 0, -1):
        up = elements[elements[k].parent]
        up.all += elements[k].all
        up.clean += elements[k].clean


def best_path(page: Page, among: set[int] | None = None) -> int:
    """Path of the container (at a path of `among`) that holds most clean text, and little else; 0 if there is no text."""
    measure(page)
    best, path = 0.0, 0
    for e in page.elements[1:]:
        if e.tag in CONTAINER and not e.junk and e.clean and (among is None or e.path in among):
            score = e.clean * e.weight * e.clean / e.all
            if score >= best:  # of equal ones the innermost
                best, path = score, e.path
    return path


def extract(html: str, paths: list[str] | None = None) -> tuple[str, str]:
    """(text, path): the blocks of every container at that of `paths` which scores best here (of equal ones the first), or
    at the page's own best path if it has none of them."""
    page = parse(html)
    have = {e.path for e in page.elements if not e.junk}
    found = [p for x in paths or () if (p := page.number(x)) in have]
    path = found[0] if len(found) == 1 else best_path(page, set(found) or None) or (found or [0])[0]
    inside = [False] * len(page.elements)
    for k, e in enumerate(page.elements):
        inside[k] = not e.junk and ((e.path == path) or (k > 0 and inside[e.parent]))
    blocks, last = [], None
    for k, block, data, _ in page.runs:
        if inside[k]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(data)
    texts = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t), page.spelled(path)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame, scratch: Scratch, least_share: float = 0.1) -> DataFrame:
    """(host, paths): containers that at least `least_share` of a host's pages vote for, most votes first.

    A page gives one vote, to its best container. A single vote wins only where none has more, so that no page outvotes
    its host by itself; of equally many votes the path that sorts first. Votes and their sums by host are counted with
    map-side combining; a host with as many paths as pages takes its sum by broadcast, and no more than 1 / least_share
    of its paths are left when they meet. Pages without a host have no vote.
    """

    def vote(batches):
        for batch in batches:
            found = [winner(html) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "path"])

    def winner(html):
        page = parse(html)
        return page.spelled(best_path(page))

    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("host <> ''")
    votes = rows.mapInArrow(vote, "host string, path string").where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    votes = scratch.table(votes, "votes")
    sums = votes.groupBy("host").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    shares = heavy_join(votes, sums, ["host"], scratch).where((F.col("n") >= least_share * F.col("all")) & ((F.col("n") > 1) | (F.col("most") == 1)))
    return shares.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "path"))), lambda x: x.path).alias("paths"))


def html_extract(pages: DataFrame, broadcast_hosts: int = 200_000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path (the container it was taken from).

    Null and empty pages have an empty text. A page without its host's winning containers, or without a host, uses its
    own best one. Repeated rows give repeated results; other columns of the input are not read. The paths of up to
    `broadcast_hosts` hosts (at most 1 / least_share short strings each) are broadcast; of more they are joined, a hot host's by broadcast.
    """
    scratch = Scratch(pages.sparkSession, "html-paths")
    paths = scratch.table(host_paths(pages, scratch), "paths")
    small = paths.count() <= broadcast_hosts
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(paths), "host", "left") if small else heavy_join(rows, paths, ["host"], scratch, "left")
    rows = rows.select("page_id", "url", "html", "paths")

    def take(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [extract(html, paths) for html, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                columns = [part.column(0), part.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "path"])

    return rows.mapInArrow(take, "page_id long, url string, text string, n_chars long, path string")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
