"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored; the best one votes with a hash of its generalised path (tags and all classes from the
root, runs of digits as one sign). Spark counts the votes of each host, and every page is extracted again from the elements on its
host's winning path. A page without such an element, or whose element has no text, uses its own best container.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import map_arrow, slices

#: Hosts up to which the winning paths are broadcast (under 64 MB, as a path is a hash of 16 bytes in hexadecimal).
BROADCAST_HOSTS = 100_000
#: Votes that a task sums before it passes them on.
VOTES = 100_000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
CONTAINER = frozenset("html body main article section div td center blockquote".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup legend body html".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
#: What an implied end doesn't pass.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements that are never part of the main text.
DROP = frozenset("head nav footer aside form script style noscript template iframe button select option textarea input svg math object embed canvas audio video map dialog menu title noembed noframes xmp label fieldset".split())
#: Of these, and of DROP_WORDS, only what holds neither an article nor most of a page that has none elsewhere is dropped.
SOFT = frozenset(["form", "header"])
#: Whole classes, ids and roles of what isn't main text.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts "
    "sidebar sidebars menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer foot header masthead topbar comment comments commentlist disqus respond replies reply "
    "social share sharing related recommended newsletter subscribe subscription signup popup modal overlay widget widgets pagination pager skip login search searchbox toolbar outbrain taboola hidden complementary contentinfo".split()
)
#: Words of classes and ids that mark the main text.
MAIN_WORDS = frozenset("article content main post entry story text body blog page".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


_HIDES = re.compile(r"<(?:!|script|style|textarea|title|xmp|iframe|noembed|noframes)", re.IGNORECASE).search


@functools.lru_cache(1000)
def _same(tag: str):
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: str
    dropped: bool
    weight: float
    soft: bool = False
    marked: bool = False
    text: float = 0.0
    links: float = 0.0
    own: list[int] = field(default_factory=list)


def _attributes(raw: str) -> tuple[str, list[str], list[str], bool]:
    """The generalised class, the words and the whole tokens of class, id and role, and whether the element is hidden."""
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return "", [], [], False
    label, words, tokens, hidden = "", [], [], False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role"):
            words += _WORDS.findall(value)
            tokens += value.split()
            if name == "class":
                label = _DIGITS.sub("#", " ".join(sorted(value.split())))
    return label, words, tokens, hidden


@functools.lru_cache(100_000)
def _below(path: str, step: str) -> str:
    """The hash of a path by that of the path above it."""
    return hashlib.blake2b(f"{path}/{step}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Page:
    """Elements and blocks of text of a page; tolerant of ends that are missing, doubled or out of order."""

    def __init__(self, source: str):
        self.elements = [Element("", -1, "", False, 1.0)]
        self.blocks: list[tuple[int, int, list[str]]] = []  # element, characters in links, parts
        self.goes_on: list[bool] = []  # of each block: whether no block element began or ended before it
        stack = [0]
        fresh, link, at, n = True, 0, 0, len(source)
        last_end = source.rfind(">")  # no tag starts after it

        def text(raw: str) -> None:
            nonlocal fresh
            top = stack[-1]
            if self.elements[top].dropped:
                return
            if fresh or self.blocks[-1][0] != (box := self._box(top)):
                if not raw.strip():
                    return
                box = self._box(top)
                if fresh or self.blocks[-1][0] != box:
                    self.blocks.append((box, 0, []))
                    self.goes_on.append(not fresh)
                fresh = False
            box, chars, parts = self.blocks[-1]
            decoded = html.unescape(raw) if "&" in raw else raw
            parts.append(decoded)
            if link:
                self.blocks[-1] = (box, chars + len(decoded), parts)

        while at < n:
            start = source.find("<", at)
            if start < 0 or start > last_end:
                text(source[at:])
                break
            m = _TOKEN.match(source, start)
            if m is None:  # a bare sign
                text(source[at : start + 1])
                at = start + 1
                continue
            if start > at:
                text(source[at:start])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, end, raw = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
            if tag == "br":
                if not fresh:
                    text(" ")
                continue
            if tag in BLOCK:
                fresh = True
            if end:
                at_stack = len(stack) - 1
                while at_stack and self.elements[stack[at_stack]].tag != tag:
                    at_stack -= 1
                if at_stack:
                    del stack[at_stack:]
                    link = link and sum(self.elements[i].tag == "a" for i in stack)
                continue
            if tag in CLOSES_P or tag in CLOSES:
                self._imply(stack, tag)
                link = link and sum(self.elements[i].tag == "a" for i in stack)
            if tag in VOID:
                continue
            outer = self.elements[stack[-1]].dropped
            if self._open(stack, tag, raw) and not outer and tag not in RAW and (skip := self._past(source, at, tag)):
                stack.pop()
                at = skip
                continue
            link += tag == "a"
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                if not self.elements[stack[-1]].dropped:
                    text(source[at : close.start() if close else n])
                stack.pop()
                at = close.end() if close else n
        self._settle()
        self._score()

    def _imply(self, stack: list[int], tag: str) -> None:
        """Ends that the start of `tag` implies."""
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                t = self.elements[stack[i]].tag
                if t == "p":
                    del stack[i:]
                    break
                if t in BLOCK:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            t = self.elements[stack[i]].tag
            if t in FENCE[tag]:
                break
            if t in CLOSES[tag]:
                del stack[i:]

    @staticmethod
    def _past(source: str, at: int, tag: str) -> int:
        """Where a dropped element ends, if the ends of its tag are in order and nothing in it could hide one; else 0."""
        depth = 1
        for m in _same(tag)(source, at):
            depth += -1 if m[1] else 1
            if not depth:
                return 0 if _HIDES(source, at, m.start()) else m.end()
        return 0

    def _open(self, stack: list[int], tag: str, raw: str) -> bool:
        """Whether the element is dropped whatever it holds; _settle() sees to soft ones."""
        above = self.elements[stack[-1]]
        label, words, tokens, hidden = _attributes(raw) if tag in BLOCK or tag not in ("a", "b", "i", "em", "strong", "span") or "class" in raw or "hidden" in raw or "style" in raw else ("", [], [], False)
        dropped = above.dropped or hidden or tag in DROP and tag not in SOFT
        soft, marked = False, not DROP_WORDS.isdisjoint(tokens)
        if not dropped and tag not in ("html", "body"):
            in_main = any(self.elements[i].tag in ("article", "main") for i in stack)
            soft = tag == "form" or tag == "header" and not in_main or marked and not (tag in ("article", "main") or MAIN_WORDS.intersection(words) and not {"ad", "ads", "comment", "comments"}.intersection(words) and tag not in ("header", "span", "a", "p"))
        path, weight = above.path, above.weight
        if tag in CONTAINER:
            path = _below(above.path, tag + f".{label.replace(' ', '.')}" * bool(label))
            weight = 2.0 if tag in ("article", "main") else 1.3 if MAIN_WORDS.intersection(words) else 1.0
        self.elements.append(Element(tag, stack[-1], path, dropped, weight, soft, marked))
        stack.append(len(self.elements) - 1)
        return dropped

    def _box(self, i: int) -> int:
        """The nearest block element, or soft one, at or above i."""
        while i and self.elements[i].tag not in BLOCK and not self.elements[i].soft:
            i = self.elements[i].parent
        return i

    def _settle(self) -> None:
        """Drop the soft elements, but none that holds an article or, where none is elsewhere, most of the text."""
        es = self.elements
        if not any(e.soft for e in es):
            return
        size, articles = [0] * len(es), [0] * len(es)
        for i, _, parts in self.blocks:
            size[i] += len(" ".join("".join(parts).split()))
        for i in range(len(es) - 1, 0, -1):
            articles[i] += es[i].tag in ("article", "main") and not es[i].marked and not es[i].dropped and size[i] > 0
            size[es[i].parent] += size[i]
            articles[es[i].parent] += articles[i]
        gone = [False] * len(es)
        for i, e in enumerate(es[1:], 1):
            kept = articles[i] or not articles[0] and 2 * size[i] > size[0]
            gone[i] = gone[e.parent] or e.soft and not kept
        if self.blocks and all(gone[i] for i, _, _ in self.blocks):
            return  # nothing would be left
        for e, g in zip(es, gone, strict=True):
            e.dropped = e.dropped or g
        old, self.blocks = self.blocks, []
        begins = True
        for (i, links, parts), more in zip(old, self.goes_on, strict=True):
            begins = begins or not more
            if gone[i]:
                continue
            if not begins and self.blocks[-1][0] == i:  # what stood between was dropped
                links, parts = self.blocks[-1][1] + links, self.blocks.pop()[2] + parts
            self.blocks.append((i, links, parts))
            begins = False

    def _score(self) -> None:
        """Text that isn't in links, summed upwards."""
        for k, (i, links, parts) in enumerate(self.blocks):
            size = len(" ".join("".join(parts).split()))
            self.elements[i].own.append(k)
            self.elements[i].text += size
            self.elements[i].links += min(links, size)
        for e in reversed(self.elements):
            if e.parent >= 0:
                above = self.elements[e.parent]
                above.text += e.text
                above.links += e.links

    def best(self) -> int:
        """The container of the main text: deepest of those that hold most of the text outside links, marked ones first."""
        value = [max(0.0, e.text - 1.5 * e.links) for e in self.elements]
        whole = value[0] or 1.0
        pick, rank = 0, (0.0, 0)
        depth = [0] * len(self.elements)
        for i, e in enumerate(self.elements):
            depth[i] = depth[e.parent] + 1 if i else 0
            if e.tag in CONTAINER and not e.dropped and value[i] > 0:
                share = value[i] / whole
                score = (min(share, 0.6) * e.weight, depth[i])
                if score > rank:
                    pick, rank = i, score
        return pick

    def path(self, i: int) -> str:
        return self.elements[i].path

    def on(self, path: str) -> list[int]:
        return [i for i, e in enumerate(self.elements) if e.tag in CONTAINER and e.path == path and not e.dropped]

    def text_of(self, roots: list[int]) -> str:
        inside = [False] * len(self.elements)
        chosen = set(roots)
        for i, e in enumerate(self.elements):
            inside[i] = i in chosen or i > 0 and inside[e.parent]
        out = (" ".join("".join(parts).split()) for i, _, parts in self.blocks if inside[i])
        return "\n".join(x for x in out if x)


def extract_page(source: str, path: str | None = None) -> str:
    """Main text by the path of the host, or by the page's own best container."""
    page = Page(source)
    if path is not None and (roots := page.on(path)) and (found := page.text_of(roots)):
        return found
    return page.text_of(page.on(page.path(page.best())) or [0])


def host_of(url_col: str):
    """Lower-cased host; null if the url is null or has none."""
    host = F.regexp_extract(F.col(url_col), _HOST, 1)
    return F.when(F.length(host) > 0, F.lower(host))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path and votes: for each host the path with the most votes, of equal ones the first in order."""

    def make():
        def step(batch):
            votes = Counter()
            for part in slices(batch, 1):
                for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = Page(source)
                    if page.blocks:
                        votes[host, page.path(page.best())] += 1
                if len(votes) >= VOTES:
                    yield packed(votes)
                    votes.clear()
            yield packed(votes)

        def packed(votes):
            keys = list(votes)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64())], ["host", "path", "votes"])

        return step

    rows = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).where("host is not null")
    votes = map_arrow(rows, make, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), F.col("path"))).alias("w")).select("host", "w.path", "w.votes")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text (empty if none) and n_chars (code points) of every page, from its whole html (null: empty).

    Pages without a host vote for none and use their own best container. One row in, one row out.
    """
    ships = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(url_col).alias("host"))
    winners = winning_paths(pages, url_col, html_col).select("host", "path").persist()
    if winners.count() <= BROADCAST_HOSTS:
        joined = ships.join(F.broadcast(winners), "host", "left")
    else:  # both sides shuffle by host; Spark splits the tasks of a hot host, as each host has one row on the right
        joined = ships.join(winners, "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def make():
        def step(batch):
            for part in slices(batch, 2):
                texts = [extract_page(s, p) for s, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

        return step

    out = map_arrow(joined.select("id", "url", "html", "path"), make, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
