"""Main text of web pages by tree scoring.

Method. A page's tags are read from left to right into a tree, with the end tags that may be left
out put in; text between the borders of blocks is a paragraph. A paragraph gives points for its
length and its commas to the block that holds it and, by less at each level, to the blocks around
that one. A block's points are multiplied by what isn't link text in it, and by a factor where the
page marks it as its article. The best block, or the outermost article around it, is the container;
its siblings stay if they score a fair part of it or hold plain text. Menus, headers, footers,
sidebars, notices, adverts, forms and comments never take part; they are known by their tag, role,
or the words of their class and id, lists and boxes of links also by their links.

Defined results: a null html is empty; a page without such text gives an empty one; unclosed and
stray tags, comments and quotes, and cut character references are read as browsers read them; a
page's blocks keep their order and repeated blocks stay; repeated pages are rows of their own; null
ids and urls are passed on; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# Names of HTML.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes noscript")
BLOCKS = _set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul"
)
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: Blocks whose text speaks for the block around them.
LEAVES = HEADINGS | _set("p pre li dd dt td th blockquote figcaption caption summary address legend center")
#: An open block of the key's ends where one of these starts, unless one of its fences stands between.
_ROWS = "tr tbody thead tfoot"
ENDED_BY = {
    "li": (_set("li"), _set("ul ol menu dir")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")), "option": (_set("option optgroup"), _set("select datalist")),
    "td": (_set(f"td th {_ROWS}"), _set("table")), "th": (_set(f"td th {_ROWS}"), _set("table")), "tr": (_set(_ROWS), _set("table")),
    **{x: (_set("tbody thead tfoot"), _set("table")) for x in ("tbody", "thead", "tfoot")},
}
ENDS_PARAGRAPH = BLOCKS - _set("body button caption dd dt html legend li option optgroup select tbody td template textarea tfoot th thead title tr") | _set("dd dt li")
_PARAGRAPH = _set("p")
FENCES = _set("table td th caption button template html")

#: What is never the main text, by tag, by role, and by the words of class and id.
OUT_TAGS = _set("nav aside footer form script style noscript template iframe object svg canvas button select textarea dialog menu datalist search audio video xmp noembed noframes")
OUT_ROLES = _set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist")
OUT_WORDS = _set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars menu menus nav navbar navigation"
    " breadcrumb breadcrumbs footer footers header masthead topbar cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations comment comments commenting commentlist disqus respond reply replies discussion pager pagination form forms search"
)
#: Of these the headings stay, inside an article.
HEADER_WORDS = _set("header headers masthead")
#: Such a word says nothing of the block if one of these stands before it, or if the name begins with the name of a subject.
WITHOUT, SUBJECTS = _set("has with no without show hide"), _set("category cat tag topic")
ARTICLE_PROPERTIES = _set("articlebody")

LEAST_CHARS = 25
ARTICLE_FACTOR, MAIN_FACTOR = 5.0, 3.0
SIBLING_SHARE, SIBLING_LINKS, PLAIN_LINKS = 0.2, 0.5, 0.25
BOX_LINKS = 0.5


def _told_by_names(names: str) -> frozenset[str]:
    """The words of class and id that name something other than main text."""
    found = set()
    for name in names.split():
        parts = [x.lower() for x in _NAME_PARTS.findall(name)]
        if not parts or parts[0] in SUBJECTS:
            continue
        found |= {x for k, x in enumerate(parts) if x in OUT_WORDS and not (k and parts[k - 1] in WITHOUT)} | ({"".join(parts)} & OUT_WORDS)
    return frozenset(found)


class Page:
    """The tree of a page's blocks, in the order of their start tags, and the paragraphs of each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.head, self.kind = ["#page"], [-1], [False], [False], [""]
        self.owner: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._open, self._words, self._links, self._in_link = [0], [], 0, 0
        self._counts: dict[str, int] = {}
        self._read(source)

    # -- reading

    def _flush(self) -> None:
        text = " ".join("".join(self._words).split()) if self._words else ""
        if text:
            self.owner.append(self._open[-1])
            self.text.append(text)
            self.linked.append(min(self._links, len(text)))
        self._words, self._links = [], 0

    def _add(self, text: str) -> None:
        text = entities.unescape(text) if "&" in text else text
        self._words.append(text)
        if self._in_link:
            self._links += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        names, kind, out, head = "", "", tag in OUT_TAGS, tag == "header"
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    names += f" {value}"
                elif key == "role":
                    out = out or value.lower() in OUT_ROLES
                    kind = value.lower() if value.lower() in ("article", "main") else kind
                elif key == "itemprop":
                    kind = "article" if value.lower() in ARTICLE_PROPERTIES else kind
                else:
                    out = out or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and bool(_HIDDEN.search(value)))
            told = _told_by_names(names) if names else frozenset()
            out, head = out or bool(told - HEADER_WORDS), head or bool(told & HEADER_WORDS)
        if tag not in BLOCKS and not out and not self._counts.get(tag):
            return
        self._flush()
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.out.append(out)
        self.head.append(head)
        self.kind.append(tag if tag in ("article", "main") else kind)
        self._open.append(len(self.tag) - 1)
        self._counts[tag] = self._counts.get(tag, 0) + 1

    def _pop(self) -> None:
        self._flush()
        self._counts[self.tag[self._open.pop()]] -= 1

    def _close(self, tags: frozenset[str], fences: frozenset[str]) -> None:
        """End the innermost open block of tags, and all inside it, if no fence stands between."""
        for k in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[k]]
            if name in tags:
                while len(self._open) > k:
                    self._pop()
                return
            if name in fences:
                return

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _MARKUP.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if tag == "br":
                self._words.append(" ")
            elif m[1]:
                if tag == "a":
                    self._in_link = 0
                if self._counts.get(tag):
                    self._close(frozenset((tag,)), FENCES - {tag} if tag not in ("table", "html", "body") else frozenset())
            else:
                if tag == "a":
                    self._in_link = 1
                if tag in ENDS_PARAGRAPH and self._counts.get("p"):
                    self._close(_PARAGRAPH, FENCES)
                for open_tag, (starts, fences) in ENDED_BY.items():
                    if tag in starts and self._counts.get(open_tag):
                        self._close(frozenset((open_tag,)), fences)
                if tag in VOID:
                    if tag == "hr":
                        self._flush()
                    continue
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(source, at)
                    at = end.end() if end else size
                    continue
                if not m[3].endswith("/") or tag in BLOCKS:
                    self._start(tag, m[3])
        self._flush()

    # -- scoring

    def _settle(self) -> None:
        """Which blocks are out, with all inside them. One that holds the page's only article is not, nor is a form around most of the page."""
        n = len(self.tag)
        holds = [k in ("article", "main") and not o for k, o in zip(self.kind, self.out, strict=True)]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        chars = [0] * n
        for o, t, linked in zip(self.owner, self.text, self.linked, strict=True):
            chars[o] += len(t) - linked
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        named = list(self.out)  # out, or inside what is
        for i in range(1, n):
            named[i] |= named[self.parent[i]]
        if any(k == "article" and c and not o for k, c, o in zip(self.kind, chars, named, strict=True)):
            holds = [False] * n
        self.gone, in_article = [False] * n, [False] * n
        self.in_header = [False] * n
        for i in range(1, n):
            p, tag = self.parent[i], self.tag[i]
            in_article[i] = in_article[p] or self.kind[i] == "article"
            out = self.out[i] or (self.head[i] and not in_article[i])
            if out and (holds[i] or tag in ("html", "body") or (tag == "form" and 3 * chars[i] > 2 * chars[0] > 0)):
                out = False
            self.gone[i] = self.gone[p] or out
            self.in_header[i] = self.kind[i] != "article" and (self.in_header[p] or (self.head[i] and in_article[i]))

    def main_text(self) -> str:
        n = len(self.tag)
        self._settle()
        kept = [k for k, o in enumerate(self.owner) if not self.gone[o] and (self.tag[o] in HEADINGS or not self.in_header[o])]
        if not kept:
            return ""
        chars, links, score, n_links = [0] * n, [0] * n, [0.0] * n, [0] * n
        for k in kept:
            o, size, linked = self.owner[k], len(self.text[k]), self.linked[k]
            chars[o] += size
            links[o] += linked
            n_links[o] += linked > 0
            points = size / 1000
            if size >= LEAST_CHARS:
                text = self.text[k]
                points += (1 + sum(map(text.count, ",，、،")) + min(size // 100, 3)) * (1 - linked / size)
            holder, level = self.parent[o] if self.tag[o] in LEAVES else o, 1
            while holder >= 0:
                score[holder] += points / level
                holder, level = self.parent[holder], level + 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            n_links[p] += n_links[i]
        within = [""] * n
        for i in range(1, n):
            up = within[self.parent[i]]
            within[i] = "article" if "article" in (up, self.kind[i]) else "main" if "main" in (up, self.kind[i]) else ""
            factor = ARTICLE_FACTOR if within[i] == "article" else MAIN_FACTOR if within[i] else 1.0
            score[i] *= factor * (1 - links[i] / chars[i] if chars[i] else 0)
        top = max(range(n), key=lambda i: (score[i], -i))
        if not score[top]:
            return ""
        for kind in ("article", "main"):
            around = [i for i in self._ancestors(top) if self.kind[i] == kind]
            if around:
                top = around[-1]
                break
        marked = bool(self.kind[top])
        chosen = {top}
        for i in range(1, n):
            if self.parent[i] == self.parent[top] and chars[i] and not self.gone[i]:
                density = links[i] / chars[i]
                fair = score[i] >= SIBLING_SHARE * score[top] and density < SIBLING_LINKS
                plain = density < PLAIN_LINKS and (self.tag[i] in HEADINGS or chars[i] >= 3 * LEAST_CHARS)
                if (fair and self.kind[i] == self.kind[top]) if marked else (fair or plain):
                    chosen.add(i)
        inside, boxed = [0 in chosen] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = inside[p] or i in chosen
            box = self.tag[i] not in LEAVES and i not in chosen and n_links[i] > 1 and links[i] > BOX_LINKS * chars[i]
            boxed[i] = boxed[p] or (inside[i] and box)
        own = self.parent[top]
        return " ".join(self.text[k] for k in kept if (inside[o := self.owner[k]] and not boxed[o]) or (not marked and o == own and own > 0 and self.linked[k] <= PLAIN_LINKS * len(self.text[k])))

    def _ancestors(self, i: int) -> Iterator[int]:
        while i > 0:
            yield i
            i = self.parent[i]


def main_text(source: str) -> str:
    """The main text of one page's html."""
    return Page(source).main_text()


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2).cast(pa.binary())
            found = [main_text(x.as_py().decode("utf-8", "replace")) if x.is_valid else "" for x in sources]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], schema=_OUT)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
