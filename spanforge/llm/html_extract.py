"""Operator 12: main text of web pages by scores in their tree.

A page is read once into its elements, as a browser nests them, and the blocks of text between them. Elements that say what they are (menus, headers,
footers, sidebars, notices, adverts, forms, comments) go by tag, role and the words of their class and id. Every block that is left passes points for its
length and commas, less its share of links, to the container round it, half of them to the next one and ever less further out. The best container is
widened to the article that holds it, without articles inside that one, which are comments on it; where there is none, siblings stay that score alike or are headings, lists or sentences. Within it lists of links go.

All steps are linear in the page, whatever its tags; elements are numbers, not nested calls, so depth is no limit. A narrow map without a shuffle.

Edge cases: null html is an empty page with an empty text; url is passed on as it is, null too; a page may end anywhere, an unfinished tag at its end is no
text; without any container that scores all blocks stay that say nothing against themselves; repeated rows give repeated results; a null page_id is an id
like others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end a paragraph and stand apart from the text round them.
BLOCKS = HEADINGS | frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr legend li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead tr caption ul title".split()
)
#: Those whose text is a paragraph; it counts for what holds them.
PARAGRAPHS = frozenset("p pre blockquote li dt dd td th figcaption caption summary".split())
#: Text in these is no markup, up to their own end.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
NEVER = RAW | frozenset("head template nav footer aside svg canvas math object embed button select input option datalist dialog menu search audio video map".split())
#: Elements that an end tag of an inline element inside them doesn't reach over.
SCOPED = BLOCKS | NEVER
#: What a start tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
P_SCOPE = frozenset("html td th caption button object table".split())
#: Words of a class, id or role that speak against an element.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification"
    " alert announcement disclaimer toast popup modal overlay dialog alertdialog newsletter subscribe subscription signup login paywall sidebar side aside complementary rail"
    " widget widgets share sharing social menu menubar nav navbar navigation masthead topbar toolbar contentinfo copyright search searchbox form skip".split()
)
#: Those that no element round an article has.
FIRM = frozenset("comment comments disqus replies reply responses respond related recommended recommendations trending popular footer colophon breadcrumb breadcrumbs pagination pager".split())
_AGAINST_PART = re.compile(r"^(?:cookie|comment(?!ar)|sidebar|footer|advert|sponsor|newsletter|breadcrumb|disqus|promo|popup|navbar|masthead)|(?:sidebar|footer|nav|navbar|navigation|menu|comments|banner)$")
_STATES = frozenset("has no with without is not".split())
_SETTINGS = frozenset("open closed enabled disabled on off count".split())
_ARTICLE_WORDS = frozenset("article articlebody content main post entry story body text blog".split())

_MARKUP = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=/>][^\s=/>]*)(\s*=\s*)?")
_PIECES = re.compile(r"[^A-Za-z0-9]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMAS = re.compile("[,،、，﹐]")

KEEP, GO, MAY_GO, HEAD = 0, 1, 2, 3
#: Levels that points reach; what an article's own tag and a telling name multiply a score by; share of the best score that keeps a sibling.
LEVELS, ARTICLE_FACTOR, NAME_FACTOR, SIBLING_SHARE = 5, 4.0, 1.5, 0.2
#: A list of at least so many links, and of that share of them, is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8


@lru_cache(100_000)
def words_of(names: str) -> tuple[frozenset[str], bool, bool, bool]:
    """(words, whether one speaks against the element, even if it holds an article, or for a header only) of a class, an id and a role."""
    words, bad, firm, head = set(), False, False, False
    for name in names.split():
        parts = [p for p in _PIECES.split(name) if p]
        pieces = {q for p in parts for q in (p.lower().rstrip("0123456789"), *(c.lower() for c in _CAMEL.findall(p)))}
        words |= pieces
        if parts and (parts[0].lower() in _STATES or parts[-1].lower() in _SETTINGS):
            continue
        firm = firm or bool(pieces & FIRM)
        bad = bad or firm or bool(pieces & AGAINST) or any(_AGAINST_PART.search(p) for p in pieces)
        head = head or "header" in pieces or any(p.endswith("header") and p != "subheader" for p in pieces)
    return frozenset(words), bad, firm, head and not bad


def attributes(html: str, at: int, missing: dict[str, bool]) -> tuple[dict[str, str], int]:
    """(attributes, where the tag ends) from after a tag's name; the end is -1 where the page ends first.

    ``missing`` notes quotes that do not come again, so that none is searched for twice in vain.
    """
    found: dict[str, str] = {}
    size = len(html)
    while at < size:
        if html[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(html, at)
        if not m:
            at += 1
            continue
        at, value = m.end(), ""
        if m[2] and at < size and html[at] != ">":
            quote = html[at]
            end = -1 if quote not in "\"'" or missing.get(quote) else html.find(quote, at + 1)
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                if quote in "\"'":
                    missing[quote] = True
                start = at
                while at < size and html[at] not in " \t\n\r\f>":
                    at += 1
                value = html[start:at]
        found.setdefault(m[1].lower(), value)
    return found, -1


class Page:
    """The elements of a page in order, and its text as (block number, element, text)."""

    def __init__(self, html: str):
        self.tag, self.kind, self.parent, self.mode, self.name_words, self.holder, self.in_link = ["html"], ["html"], [-1], [KEEP], [frozenset()], [0], [False]
        self.texts: list[tuple[int, int, str]] = []
        self._stack, self._p_at, self._open, self._inline = [0], [-1], {"html": 1}, [{}]
        self._block = 0
        self._read(html)

    def _push(self, tag: str, attrs: dict[str, str]) -> int:
        k, up = len(self.tag), self._stack[-1]
        words, bad, firm, head = words_of(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}")
        mode = KEEP
        if tag in NEVER or (firm and tag not in ("body", "main")) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _UNSEEN.search(attrs.get("style", "")):
            mode = GO
        elif tag == "form" or (bad and tag not in ("body", "main")):
            mode = MAY_GO
        elif (tag == "header" or head) and tag not in ("body", "main", "article"):
            mode = HEAD
        self.tag.append(tag)
        self.kind.append(role if (role := attrs.get("role", "").strip().lower()) in ("article", "main") else tag)
        self.parent.append(up)
        self.mode.append(mode)
        self.name_words.append(words | ({"articlebody"} if attrs.get("itemprop", "").lower() == "articlebody" else frozenset()))
        self.holder.append(k if tag in BLOCKS else self.holder[up])
        self.in_link.append(self.in_link[up] or (tag == "a" and "href" in attrs))
        self._p_at.append(len(self._stack) if tag == "p" else -1 if tag in P_SCOPE else self._p_at[-1])
        self._stack.append(k)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._block += tag in BLOCKS
        if tag in SCOPED:
            self._inline.append({})
        else:
            self._inline[-1][tag] = self._inline[-1].get(tag, 0) + 1
        return k

    def _pop_to(self, depth: int) -> None:
        """Closes all elements from that place of the stack on."""
        while len(self._stack) > depth:
            tag = self.tag[self._stack.pop()]
            self._p_at.pop()
            self._open[tag] -= 1
            self._block += tag in BLOCKS
            if tag in SCOPED:
                self._inline.pop()
            else:
                self._inline[-1][tag] -= 1

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self._open.get(tag):
            return
        if tag in BLOCKS and self._p_at[-1] >= 0:
            self._pop_to(self._p_at[-1])
        if tag in CLOSES:
            closes, stop = CLOSES[tag]
            for depth in range(len(self._stack) - 1, 0, -1):
                on = self.tag[self._stack[depth]]
                if on in closes:
                    self._pop_to(depth)
                if on in closes or on in stop:
                    break
        if tag == "body" and self._open.get("head"):
            self._pop_to(1)
        self._push(tag, attrs)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if not (self._open if tag in SCOPED else self._inline[-1]).get(tag):
            self._block += tag in BLOCKS
            return
        depth = len(self._stack) - 1
        while self.tag[self._stack[depth]] != tag:
            depth -= 1
        self._pop_to(depth)

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._block, self._stack[-1], unescape(text) if "&" in text else text))

    def _read(self, html: str) -> None:
        at, missing = 0, {}
        while m := _MARKUP.search(html, at):
            self._text(html[at : m.start()])
            if m[1]:
                end = html.find("-->", m.start() + 2)
                if end < 0:
                    return
                at = end + 3
            elif not m[3]:
                end = html.find(">", m.end())
                if end < 0:
                    return
                at = end + 1
            else:
                tag = m[3].lower()
                attrs, at = ({}, m.end() + 1) if html[m.end() : m.end() + 1] == ">" else attributes(html, m.end(), missing)
                if at < 0:
                    return
                if m[2]:
                    self._end(tag)
                elif tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    end = html.find(">", close.end()) if close else -1
                    if end < 0:
                        return
                    at = end + 1
                elif tag in VOID:
                    if tag == "br":
                        self._text(" ")
                    elif tag == "hr":
                        self._block += 1
                else:
                    self._start(tag, attrs)
        self._text(html[at:])

    def main_blocks(self) -> list[str]:
        """The blocks of the main text, in order."""
        n, parent, tag, kind, mode = len(self.tag), self.parent, self.tag, self.kind, self.mode
        is_article = [kind[k] == "article" and mode[k] != MAY_GO and mode[k] != GO for k in range(n)]
        held = [is_article[k] or (kind[k] == "main" and mode[k] != GO) for k in range(n)]
        for k in range(n - 1, 0, -1):
            held[parent[k]] |= held[k]
        article, state = [-1] * n, [KEEP] * n
        for k in range(n):
            up = parent[k]
            outer = article[up] if k else -1
            article[k] = k if is_article[k] else outer
            above = state[up] if k else KEEP
            own = mode[k]
            if own == MAY_GO:
                own = KEEP if held[k] else GO
            elif own == HEAD:
                inner = outer >= 0 or bool(self.name_words[k] & _ARTICLE_WORDS)
                own = KEEP if held[k] else HEAD if inner else GO
            state[k] = GO if above == GO or own == GO else own if above == KEEP else KEEP if tag[k] in HEADINGS else HEAD

        blocks: list[tuple[int, str]] = []
        chars, link_chars, links = [0] * n, [0] * n, [0] * n
        score, has_own = [0.0] * n, [False] * n
        for _, run in groupby(self.texts, lambda t: t[0]):
            kept = [(k, s) for _, k, s in run if state[k] == KEEP]
            text = " ".join("".join([s for _, s in kept]).split())
            if not text:
                continue
            owner = self.holder[kept[0][0]]
            linked = min(len(text), sum(len(s.strip()) for k, s in kept if self.in_link[k]))
            blocks.append((owner, text))
            chars[owner] += len(text)
            link_chars[owner] += linked
            if tag[owner] not in HEADINGS:
                points = (1 + len(_COMMAS.findall(text)) + len(text) / 100) * (1 - linked / len(text))
                at = parent[owner] if tag[owner] in PARAGRAPHS and owner else owner
                has_own[article[owner]] |= points > 0 and article[owner] >= 0
                for level in range(LEVELS):
                    score[at] += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
                    if at == 0:
                        break
                    at = parent[at]
        for k in range(1, n):
            links[self.holder[k]] += tag[k] == "a" and state[k] == KEEP
        for k in range(n - 1, 0, -1):
            chars[parent[k]] += chars[k]
            link_chars[parent[k]] += link_chars[k]
            links[parent[k]] += links[k]

        def worth(k: int) -> float:
            factor = ARTICLE_FACTOR if kind[k] in ("article", "main") or "articlebody" in self.name_words[k] else NAME_FACTOR if self.name_words[k] & _ARTICLE_WORDS and tag[k] != "body" else 1.0
            return score[k] * factor * (1 - link_chars[k] / chars[k]) if chars[k] else 0.0

        values = [worth(k) for k in range(n)]
        best = max(range(n), key=values.__getitem__)
        if not values[best]:
            return [text for _, text in blocks]
        nested = [False] * n
        if (top := article[best]) >= 0:
            outer = parent[top]
            while outer >= 0 and (outer := article[outer]) >= 0:
                top, outer = outer if has_own[outer] else top, parent[outer]
            regions = {top}
            if has_own[top]:  # articles within one are comments on it, unless it only holds them together
                nested = [is_article[k] and k > top for k in range(n)]
        else:
            regions = {best}
            for k in range(1, n):
                if parent[k] == parent[best] and k != best and chars[k] and best:
                    share = link_chars[k] / chars[k]
                    if tag[k] in HEADINGS:
                        stays = k < best
                    elif tag[k] in ("p", "ul", "ol", "dl", "table", "blockquote", "pre", "figure"):
                        stays = share < 0.25
                    else:
                        stays = values[k] >= SIBLING_SHARE * values[best]
                    if stays:
                        regions.add(k)
        inside, out = [False] * n, [False] * n
        for k in regions:
            inside[k] = True
        for k in range(1, n):
            inside[k] |= inside[parent[k]]
            menu = tag[k] in ("ul", "ol", "dl", "div", "section", "table") and links[k] >= MENU_LINKS and link_chars[k] >= MENU_SHARE * chars[k]
            out[k] = out[parent[k]] or nested[k] or (menu and k not in regions)
        return [text for owner, text in blocks if inside[owner] and not out[owner]]


def main_text(html: str) -> str:
    """The main text of a page, a line for each block."""
    return "\n".join(Page(html).main_blocks())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def work(batches):
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string())], schema=schema)

    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return read.mapInArrow(work, "page_id long, url string, text string")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages and its length."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
