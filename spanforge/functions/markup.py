"""Page markup to text with the way back, and string similarity. Imports no queries: workers load this module alone."""

from __future__ import annotations

import difflib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio()


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


#: Tags that end a line, cells, and characters with a plain form.
BLOCKS = frozenset("p div br tr table ul ol li h1 h2 h3 h4 h5 h6 section article header footer nav hr title body".split())
CELLS = frozenset(("td", "th"))
STRONG, HEADINGS = frozenset(("b", "strong")), frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = str.maketrans({"\u00a0": " ", "\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'})
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>|<![^>]*>|(&#?\w+;)|[^<&]+|.", re.S | re.I)
#: The same where no ">" follows, so that a search for one never runs to the end of the page in vain.
_LATE_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|(?!)(/?)([A-Za-z]*)|(&#?\w+;)|(?:[^<&]|<(?!!--|(?:script|style)\b))+|.", re.S | re.I)
_WORD = re.compile(r"\S+")
#: White space that does not stay as it is.
_UNEVEN = re.compile(r"[^\S ]|  ")
_BLOCK_TAG = re.compile(r"<\s*(?:p|div|br|tr|table|li|h[1-6])\b", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BOLD, HEADING, INNER_LINK = 1, 2, 4


def _tokens(raw: str) -> Iterator[re.Match]:
    at, end = 0, raw.rfind(">") + 1
    while at < len(raw):
        m = (_TOKEN if at < end else _LATE_TOKEN).match(raw, at)
        yield m
        at = m.end()


def is_plain(raw: str) -> bool:
    """Whether a page has at least 50 lines and fewer than one block tag in ten of them."""
    newlines = raw.count("\n")
    return newlines >= 50 and sum(1 for _ in _BLOCK_TAG.finditer(raw)) < 0.1 * newlines


def read_page(raw: str) -> tuple[str, list[int], list[int], list[int], list[tuple[int, int, int]]]:
    """(text, text starts, raw starts, lengths, marks): the visible text of a page, its runs that came from the source character by character, and what it is set in.

    White space becomes one space, block tags end a line, a cell ends with a space; scripts, styles and comments go; an entity is a run of length 1. Marks are
    (start, end, flags) of the text in bold, in a heading or in a link to a place of the same page. In a page that is lines of plain text (``is_plain``) line breaks stay.
    """
    lined = is_plain(raw)
    out, starts, sources, lengths, marks, size, gap = [], [], [], [], [], 0, ""
    bold = heading = inner = 0
    links: list[bool] = []

    def emit(s: str, at: int) -> None:
        nonlocal size, gap
        if gap and size:
            out.append(gap)
            size += 1
        gap = ""
        out.append(s)
        if starts and starts[-1] + lengths[-1] == size and sources[-1] + lengths[-1] == at:
            lengths[-1] += len(s)
        else:
            starts.append(size)
            sources.append(at)
            lengths.append(len(s))
        flags = BOLD * (bold > 0) | HEADING * (heading > 0) | INNER_LINK * (inner > 0)
        if flags:
            if marks and marks[-1][2] == flags and size - marks[-1][1] <= 1:
                marks[-1] = (marks[-1][0], size + len(s), flags)
            else:
                marks.append((size, size + len(s), flags))
        size += len(s)

    def say(text: str, at: int) -> None:
        nonlocal gap
        bare = text.strip()
        if not bare:
            gap = gap or " " * bool(text)
        elif not _UNEVEN.search(bare):
            before = text.index(bare[0])
            gap = gap or " " * (before > 0)
            emit(bare, at + before)
            gap = " " * (before + len(bare) < len(text))
        else:
            done = 0
            for w in _WORD.finditer(text):
                if w.start() > done:
                    gap = gap or " "
                emit(w.group(), at + w.start())
                done = w.end()
            if done < len(text):
                gap = gap or " "

    for m in _tokens(raw):
        tag, token = (m.group(3) or "").lower(), m.group()
        if tag:
            if tag in BLOCKS:
                gap = "\n"
            elif tag in CELLS:
                gap = gap or (" " if m.group(2) else "")
            if tag in STRONG or tag in HEADINGS or tag == "a":
                opens, closes = not m.group(2), bool(m.group(2)) or token.endswith("/>")
                if tag in STRONG:
                    bold = max(0, bold + opens - closes)
                elif tag in HEADINGS:
                    heading = max(0, heading + opens - closes)
                else:
                    if opens:
                        href = _HREF.search(token)
                        links.append(bool(href) and (href[1] or href[2] or href[3] or "").startswith("#"))
                        inner += links[-1]
                    if closes and links:
                        inner -= links.pop()
        elif not token.startswith(("<!", "<script", "<style", "<SCRIPT", "<STYLE")) and not m.group(1):
            text = (html.unescape(token) if m.group(4) else token).translate(PLAIN)
            if m.group(4):
                text = text[:1]
            if lined and "\n" in text:
                at = m.start()
                for k, line in enumerate(text.split("\n")):
                    gap = "\n" if k else gap
                    say(line, at)
                    at += len(line) + 1
            else:
                say(text, m.start())
    return "".join(out), starts, sources, lengths, marks


def plain_text(raw: str) -> tuple[str, list[dict]]:
    """The visible text of a page and its runs (text_start, raw_start, length)."""
    text, starts, sources, lengths, _ = read_page(raw)
    return text, [{"text_start": a, "raw_start": b, "length": n} for a, b, n in zip(starts, sources, lengths, strict=True)]


def _normalized(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for raw in pages:
        done = [read_page(r or "") for r in raw]
        columns = list(zip(*done, strict=True)) or [()] * 5
        made = dict(zip(("text", "text_start", "raw_start", "length"), map(list, columns), strict=False))
        yield pd.DataFrame(made | {"marks": [[{"start": a, "end": b, "flags": f} for a, b, f in page] for page in columns[4]]})


def _guarded(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for raw in pages:
        rows = []
        for r in raw:
            try:
                text, _, _, _, marks = read_page(r or "")
                rows.append((text, [{"start": a, "end": b, "flags": f} for a, b, f in marks], None))
            except Exception as error:  # one page's fault is that page's row, not the job's end
                rows.append(("", [], f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(rows, columns=["text", "marks", "fault"])


def similarity(a: Column | str, b: Column | str) -> Column:
    """Matching-blocks ratio without regard to case; 0 where a side is null."""
    return F.pandas_udf(_similarity, "double")(a, b)


def normalized(page: Column | str) -> Column:
    """``read_page`` of a column, its runs as three arrays. A null page is empty."""
    made = "text: string, text_start: array<int>, raw_start: array<int>, length: array<int>, marks: array<struct<start: int, end: int, flags: int>>"
    return F.pandas_udf(_normalized, f"struct<{made}>")(page)


def guarded(page: Column | str) -> Column:
    """Text and marks of a column; where a page cannot be read both are empty and ``fault`` says why."""
    return F.pandas_udf(_guarded, "struct<text: string, marks: array<struct<start: int, end: int, flags: int>>, fault: string>")(page)
