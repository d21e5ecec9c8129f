"""Rules over the text of one filing, each from its text alone: headings, sections, bodies bound elsewhere, declarations, indexes and the whole run.

Imports no queries: workers load this module and what it names. A document is a row, so nothing of it is shuffled. Patterns are those of the operators, read as Java reads
them (``_java``): blanks, digits and case in ASCII, words by all letters and digits, and a dot stops at any line break.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from statistics import median
from typing import NamedTuple

import pyarrow as pa

from spanforge.functions import markup
from spanforge.functions.sequences import page_run_places
from spanforge.operators.stubs import _LETTERS, FEW_NUMBERS, LONG_BODY, NUMBER, POINTS, POINTS_OUTSIDE, SHORT_BODY

#: Item codes of the annual form with their titles, in order.
ITEMS = [
    ("1", "Business"), ("1A", "Risk Factors"), ("1B", "Unresolved Staff Comments"), ("1C", "Cybersecurity"), ("2", "Properties"), ("3", "Legal Proceedings"),
    ("4", "Mine Safety Disclosures"), ("5", "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities"), ("6", "[Reserved]"), ("7", "Management's Discussion and Analysis of Financial Condition and Results of Operations"),
    ("7A", "Quantitative and Qualitative Disclosures About Market Risk"), ("8", "Financial Statements and Supplementary Data"),
    ("9", "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure"), ("9A", "Controls and Procedures"), ("9B", "Other Information"),
    ("9C", "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections"), ("10", "Directors, Executive Officers and Corporate Governance"), ("11", "Executive Compensation"),
    ("12", "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters"), ("13", "Certain Relationships and Related Transactions, and Director Independence"),
    ("14", "Principal Accountant Fees and Services"), ("15", "Exhibits, Financial Statement Schedules"), ("16", "Form 10-K Summary"),
]

#: Heading lines (plain, with a part before or no blank, and of two items), a page number at a line's end, a contents marker, the line before signatures.
STRICT = r"(?i)^\s*item\s+(\d{1,2})\s*([a-c])?\s*[.:\-]?\s*(.*)$"
LOOSE = r"(?i)^\s*(?:part\s+[ivx]+[.,]?\s*[-:]?\s*)?item\s*(\d{1,2})\s*([a-c])?\b[\s.:\-]*(.*)$"
COMBINED = r"(?i)^\s*items\s+(\d{1,2})\s*([a-c])?\s+and\s+(\d{1,2})\s*([a-c])?\b[\s.:\-]*(.*)$"
PAGE_AT_END = r"(?:\.{3,}|·{3,}|\s)\s*\d{1,4}\s*$"
MARKER = r"(?i)table\s+of\s+contents|\bindex\b"
SIGNED = r"(?i)^\s*signatures?\s*$|^\s*s\s+i\s+g\s+n\s+a\s+t\s+u\s+r\s+e\s+s?\s*$|^\s*pursuant\s+to\s+the\s+requirements\s+of\s+section\s+13\s+or\s+15\s*\(\s*d\s*\)"
FURNITURE = r"(?i)^\s*(?:page\s+)?\d{1,3}\s*$|^\s*table of contents\s*$|^\s*part\s+[iv]+\.?\s*$"
NEAR_MARKER, BAND, SHORT_GAP, AMBIGUOUS = 3000, 1500, 300, 0.85
LONGEST_LINE, LONGEST_STRICT, EMPHASIS, LINKED = 200, 120, 0.7, 0.5
#: Titles that items had before, a line that may be a heading without the word "item", and how like a title the rest of it must be.
EARLIER_TITLES = [
    ("4", "Submission of Matters to a Vote of Security Holders"), ("6", "Selected Financial Data"), ("10", "Directors and Executive Officers of the Registrant"), ("14", "Principal Accounting Fees and Services"),
]
LOOSE_HEADING = r"(?i)^\s*(?:item[\s.]+)?(\d{1,2})\s*([a-c])?(?:\(t\))?\s*[.:\-–—]?\s*(.*)$"
HEAD_MARGIN, TITLE_SIMILARITY, PLAUSIBLE_SIMILARITY = 300, 0.6, 0.4

#: What a stub says of its target, headings that end a section, and the thresholds of both.
STUB_PAGES, STUB_SECTION = r"(?i)(pages?\s+\d{1,4}(?:\s*[-–]\s*\d{1,4})?)", r"(?i)section\s+entitled\s+[\"“]([^\"”]{4,120})[\"”]"
PROXY, THIS_FILING = r"(?i)proxy\s+statement", r"(?i)financial\s+section|annual\s+report|on\s+pages?\s+\d"
OTHER_ITEM = r"(?i)[\"“]([^\"”]{4,200})[\"”]\s+in\s+part\s+[ivx]+\s*,?\s+item\s+(\d{1,2}[a-c]?)\s+of\s+this\s+form\s*10-k"
ENDING_TITLES = ("management's report on internal control over financial reporting", "report of independent registered public accounting firm", "index to exhibits", "signatures")
LEAST_APPENDED, LEAST_RESOLVED = 20_000, 400
LONGEST_FURNITURE, FURNITURE_PAGES, LONGEST_HEADING, TOP_LINES, TOPIC_SIMILARITY, SNAP_SIMILARITY = 80, 3, 60, 6, 0.5, 0.75
#: Lines after an anchor that show whether it is an entry of a table of contents: how far to look, how many short ones count, and how long others are.
ENTRY_LINES, ENTRY_SHORT, ENTRY_LONG = 11, 4, 80
#: A map of fewer pages is no pagination of a body.
LEAST_PAGES = 5

#: A part's declaration, and how it lists items.
DECLARATION = (
    r"(?i)information\s+required\s+by\s+this\s+part\s*[(\[]?\s*(items?\s+\d[^)\]]{0,120}?)\s*[)\]]?\s*(?:of\s+this\s+(?:report|form\s*10-?k)\s*)?"
    rf"(?:is|are|will\s+be|shall\s+be)\s+incorporated\s+(?:herein\s+)?by\s+reference[{_LETTERS}\s,'’&\-\"“”()]{{0,200}}?\b(?:definitive\s+)?(?:proxy|information)\s+statement\b"
)
ITEM_RANGE = r"(?i)^(?:items?\s+)?(\d{1,2}[A-C]?)\s*(?:through|thru|to|[-–—])\s*(?:items?\s+)?(\d{1,2}[A-C]?)$"
ITEM_SINGLE = r"(?i)^(?:items?\s+)?(\d{1,2}[A-C]?)$"

#: A line of page numbers, an entry without the word "item", an answer in place of a page, and the thresholds of an index.
PAGE_LINE = r"(?i)^\s*(?:pages?\s*)?\d{1,4}(?:\s*[-–]\s*\d{1,4})?(?:\s*,\s*\d{1,4}(?:\s*[-–]\s*\d{1,4})?)*\s*$"
BARE_ENTRY = r"^\s*(\d{1,2}[A-C]?)\.\s*([A-Za-z][A-Za-z '&,./()-]{3,110}?)\s*(\d[\d\s,\-–]*)?$"
NO_CONTENT = r"(?i)^(none|not\s+applicable|\[?reserved\]?)\.?$"
NAMED_PAGES, LAST_PAGES = r"(?i)(pages?\s+\d[\d,\s\-–]*)", r"(\d{1,4}(?:\s*[-–]\s*\d{1,4})?)\s*$"
LEAST_CODES, WINDOW_CHARS, OUTSIDE_CODES, LEAST_REFERRING, PACKED_GAP = 8, 8000, 3, 0.25, 300
BARE_SIMILARITY, BARE_WINDOW = 0.5, 3 * WINDOW_CHARS
WHOLE_RANGE, LEAST_BODY, SPARSE_PAGES, CHARS_PER_PAGE = 20_000, 400, 3, 300

#: Classes of filings.
UNSUPPORTED, FAILED, INDEX, STANDARD, OTHER = "unsupported_scanned_or_binary", "failed", "cross_reference_index", "standard", "non_10k"

_ORD = {c: i for i, (c, _) in enumerate(ITEMS)}
_TITLE = dict(ITEMS)
_BLANK = " \t\n\x0b\f\r"
_ENDS = "\n\r\x85\u2028\u2029"
_NO_WORD = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("No", "Nl"))
_W = rf"[^\W{_NO_WORD}]"
_BOUNDARY = f"(?u:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _java(pattern: str) -> re.Pattern:
    """A pattern as Java's engine reads it."""
    flags = re.ASCII | (re.IGNORECASE if pattern.startswith("(?i)") else 0)
    out = []
    for m in re.finditer(r"\\.|\[\^?(?:\\.|[^\]\\])*\]|.", pattern.removeprefix("(?i)"), re.S):
        t = m.group()
        if _LETTERS in t:
            t = "(?u:" + t.replace(_LETTERS, r"\w").replace(r"\s", _BLANK) + ")"
        out.append({r"\b": _BOUNDARY, ".": f"[^{_ENDS}]", "$": rf"(?=(?:\r\n|[{_ENDS}])?\Z)"}.get(t, t))
    return re.compile("".join(out), flags)


_STRICT, _LOOSE, _COMBINED, _PAGE_AT_END, _MARKER, _SIGNED, _FURNITURE, _LOOSE_HEADING = map(_java, (STRICT, LOOSE, COMBINED, PAGE_AT_END, MARKER.replace(r"\s", r"[ \t\x0b\f\r]"), SIGNED, FURNITURE, LOOSE_HEADING))
_POINTS, _POINTS_OUTSIDE, _NUMBER = _java(f"(?i){POINTS}"), _java(f"(?i){POINTS_OUTSIDE}"), _java(NUMBER)
_NOT_LETTER, _NOT_CAPITAL, _BLANKS = re.compile("[^A-Za-z]"), re.compile("[^A-Z]"), re.compile(r"\s+", re.A)
_HOLDS = [(c, _java(r"(?i)\b" + r"\s+".join(re.escape(w) for w in t.split()) + r"\b")) for c, t in ITEMS if c != "6"]
_OPENINGS: dict[str, list[tuple[str, re.Pattern]]] = {}
for _c, _t in [*ITEMS, *EARLIER_TITLES]:
    _OPENINGS.setdefault(_c, []).append((_t, _java("(?i)^" + r"[\W_]+".join(re.findall("[A-Za-z]+", _t)[:2]) + r"\b")))


@lru_cache(maxsize=1 << 14)
def _alike(a: str, b: str) -> float:
    return markup.ratio(a, b)


@lru_cache(maxsize=1 << 12)
def _held(title: str) -> frozenset:
    """Codes whose whole title a title holds, item 6 aside."""
    return frozenset(c for c, p in _HOLDS if p.search(title))


def is_stub(body: str) -> bool:
    """Whether a body only points elsewhere (``stub_target`` names where)."""
    if len(body) <= SHORT_BODY:
        return bool(_POINTS.search(body))
    return len(body) <= LONG_BODY and bool(_POINTS_OUTSIDE.search(body)) and len(_NUMBER.findall(body)) < FEW_NUMBERS


class Heading(NamedTuple):
    line_idx: int
    start: int
    end: int
    title: str
    signs: float
    numbered: bool
    linked: bool
    upper: bool
    strict: bool
    set: bool
    apart: bool
    combined: bool
    code: str
    ord: int
    canonical: str
    sim: float
    score: float
    listed: bool


class Item(NamedTuple):
    status: str
    start: int | None = None
    end: int | None = None
    body_chars: int | None = None
    toc_listed: bool = False
    provenance: str | None = None
    needs_review: bool | None = None


class Text:
    """A text with its lines, their places, and its marks (start, end, flags) in order."""

    def __init__(self, text: str | None, marks: list | None = None):
        self.text = text or ""
        self.rows = self.text.split("\n")
        self.starts = list(accumulate((len(r) + 1 for r in self.rows), initial=0))
        self.marks = sorted((m["start"], m["end"], m["flags"]) for m in marks or ())
        self.reach = list(accumulate((m[1] for m in self.marks), max))
        self.bare: dict[int, str] = {}
        self.keys: dict[int, str] = {}

    def end(self, k: int) -> int:
        return self.starts[k + 1] - 1

    def line_at(self, place: int) -> int:
        """The line that begins at a place or is the last to begin before it."""
        return bisect_right(self.starts, place, 0, len(self.rows)) - 1

    def t(self, k: int) -> str:
        """A line without blanks at its ends."""
        if k not in self.bare:
            self.bare[k] = self.rows[k].strip(_BLANK)
        return self.bare[k]

    def share(self, k: int, mask: int) -> float:
        """The share of a line's characters, blanks aside, that marks say are set so."""
        a, b = self.starts[k], self.end(k)
        chars = 0
        for i in range(bisect_right(self.reach, a), bisect_left(self.marks, (b,))):
            start, end, flags = self.marks[i]
            if flags & mask and end > a:
                chars += len(_BLANKS.sub("", self.text[max(start, a) : min(end, b)]))
        size = len(_BLANKS.sub("", self.rows[k]))
        return chars / size if size else 0.0


def _code(number: str, letter: str | None) -> str:
    return number + (letter or "").upper()


def headings(doc: Text) -> list[Heading]:
    """What ``candidates`` gives, of one document."""
    text, rows, lines = doc.text, doc.rows, []
    for k, line in enumerate(rows):
        if not 5 <= len(line) <= LONGEST_LINE or "item" not in line.lower():
            continue
        if m := _COMBINED.search(line):
            codes, title = [_code(m[1], m[2]), _code(m[3], m[4])], m[5]
        elif m := _LOOSE.search(line):
            codes, title = [_code(m[1], m[2])], m[3]
        else:
            continue
        if all(c in _ORD for c in codes):
            lines.append((k, doc.starts[k], doc.end(k), line, codes, title.strip(" ")))
    # where a marker stands in the 3000 characters before a heading or in its line
    marked, done, last = [], 0, -1
    for _, a, b, *_ in lines:
        lo = max(done, a - NEAR_MARKER)
        low = text[lo:b].lower()
        if "index" in low or "contents" in low:
            last = max((m.start() for m in _MARKER.finditer(text, lo, b)), default=last)
        marked.append(0 <= last and a - last <= NEAR_MARKER)
        done = max(done, b)
    starts, heads = [x[1] for x in lines], [0, *accumulate(len(x[4]) for x in lines)]
    latest = {c: x[1] for x in lines for c in x[4]}
    found = []
    for n, (k, a, b, line, codes, title) in enumerate(lines):
        alone = k == 0 or k + 1 == len(rows) or not rows[k - 1].strip(" ") or not rows[k + 1].strip(" ")
        emphasis, linked = (doc.share(k, 3), doc.share(k, 4) >= LINKED) if doc.marks else (0.0, False)
        numbered = bool(_PAGE_AT_END.search(line))
        own = len(codes)
        near = heads[bisect_right(starts, a + BAND)] - heads[bisect_left(starts, a - BAND)] - own
        after = heads[bisect_right(starts, a + BAND)] - heads[n + 1]
        signs = 2.0 * linked + numbered + marked[n] + (near >= 4 and after >= 2) + (0.75 if n + 1 < len(lines) and starts[n + 1] - b < SHORT_GAP else 0.0)
        letters = len(_NOT_LETTER.sub("", line))
        upper = letters > 0 and len(_NOT_CAPITAL.sub("", line)) > 0.8 * letters
        short = len(line.strip(" ")) <= LONGEST_STRICT
        strict, apart = short and bool(_STRICT.search(line)), short and (alone or upper)
        for code in codes:
            sim = _alike(title, _TITLE[code]) if title else 0.0
            score = 2.0 * strict + (emphasis >= EMPHASIS) + 0.5 * apart + 2.0 * sim + 0.25 * upper
            listed = signs >= 2 and latest[code] > a
            found.append(Heading(k, a, b, title, signs, numbered, linked, upper, strict, emphasis >= EMPHASIS, apart, own > 1, code, _ORD[code], _TITLE[code], sim, score, listed))
    return found


def is_plausible(h: Heading) -> bool:
    """As ``plausible``."""
    return h.signs < 2 and h.strict and (h.set or h.apart) and not h.numbered and not h.linked and (h.sim >= PLAUSIBLE_SIMILARITY or not h.title)


def titled(doc: Text, k: int) -> list[int]:
    """Places in the form of the items whose number and present or earlier title a line is, with or without the word "item".

    The line starts with the first two words of the title and is alike by 0.6. Lines with a page number at their end, over 120 characters, or set as links don't count.
    """
    bare = doc.rows[k].strip(" ")
    if bare.isdigit():
        return []
    first = bare.lstrip(_BLANK)[:1]
    if len(bare) > LONGEST_STRICT or not (first in "iI" or "0" <= first <= "9") or not first or not (m := _LOOSE_HEADING.search(bare)) or _PAGE_AT_END.search(bare):
        return []
    code, rest = _code(m[1], m[2]), m[3].strip(_BLANK).rstrip(".:").strip(" ")
    met = any(p.search(rest) and _alike(known, rest) >= TITLE_SIMILARITY for known, p in _OPENINGS.get(code, ()))
    return [_ORD[code]] if met and not (doc.marks and doc.share(k, 4) >= LINKED) else []


class Pick(NamedTuple):
    ord: int
    cost: float
    start: int
    code: str
    end: int
    combined: bool
    ratio: float | None
    line_idx: int
    title: str


def chosen(found: list[Heading]) -> list[Pick]:
    """One heading an item: the best one that starts after the choice for the item before (or with it, where one line names both)."""
    by_code: dict[str, list[Heading]] = {}
    for h in found:
        if not h.listed:
            by_code.setdefault(h.code, []).append(h)
    picks = []
    for same in by_code.values():
        same.sort(key=lambda h: (-h.score, h.start))
        for h, runner_up in zip(same, [*same[1:], None], strict=True):
            picks.append(Pick(h.ord, -h.score, h.start, h.code, h.end, h.combined, runner_up.score / h.score if runner_up and h.score else None, h.line_idx, h.title))
    kept, last, at = [], -1, -1
    for p in sorted(picks, key=lambda p: p[:3]):
        if p.ord > last and (p.start > at or (p.combined and p.start == at)):
            kept.append(p)
            last, at = p.ord, p.start
    return kept


def with_shared(heads: list[Pick]) -> list[Pick]:
    """``chosen`` headings, and for each item without one the nearest earlier chosen heading whose title holds that item's whole title.

    Both then count as combined. A heading serves one such item, none if it names several items itself; item 6 takes no part.
    """
    have, lent = {h.code for h in heads}, {}
    for i, (code, _) in enumerate(ITEMS):
        if code not in have:
            lenders = [h for h in heads if h.ord < i and not h.combined and code in _held(h.title) and h.code not in lent]
            if lenders:
                lent[lenders[-1].code] = code
    kept = [h._replace(combined=True) if h.code in lent else h for h in heads]
    return kept + [h._replace(code=lent[h.code], ord=_ORD[lent[h.code]], combined=True) for h in heads if h.code in lent]


def sections(doc: Text, found: list[Heading] | None = None) -> dict[str, Item]:
    """All 23 items of a document by code, as the operator of that name says."""
    found = headings(doc) if found is None else found
    toc = {h.code for h in found if h.listed}
    out = {c: Item("reserved" if c == "6" else "missing", toc_listed=c in toc) for c, _ in ITEMS}
    heads = with_shared(chosen(found))
    if not heads:
        return out
    rows = doc.rows
    signed = next((k for k, line in enumerate(rows) if line.strip(_BLANK)[:1] in "sSpP" and _SIGNED.search(line)), len(rows))
    at = sorted({h.line_idx for h in heads})
    named = {h.line_idx for h in found}
    later: dict[int, list[int]] = {}
    for h in found:
        if is_plausible(h):
            later.setdefault(h.line_idx, []).append(h.ord)
    for k in range(at[0], signed):
        if k not in named and (ords := titled(doc, k)):
            later[k] = ords
    places = sorted(later)
    for h in heads:
        first, stop = h.line_idx, signed
        if first >= signed:
            continue
        n = bisect_right(at, first)
        if n < len(at):
            stop = min(stop, at[n])
        for i in range(bisect_left(places, first), bisect_left(places, stop)):
            k = places[i]
            if max(later[k]) > h.ord and doc.starts[k] >= max(h.start + HEAD_MARGIN, h.end + 1):
                stop = k
                break
        k = stop - 1
        while k > first and (not rows[k].strip(" ") or _FURNITURE.search(rows[k])):
            k -= 1
        body_end = doc.end(k)
        chars = body_end - h.end
        body = doc.text[h.end : h.end + min(chars, LONG_BODY)].strip(" ")
        if h.combined:
            status = "partial"
        elif chars <= LONG_BODY and is_stub(body):
            status = "incorporated_by_reference"
        elif h.code == "6" and chars < 200 and "reserved" in body.lower():
            status = "reserved"
        elif h.ratio is not None and h.ratio >= AMBIGUOUS:
            status = "ambiguous"
        else:
            status = "partial" if chars <= 1 else "pass"
        out[h.code] = Item(status, h.start, body_end, chars, h.code in toc)
    return out


# Bodies bound elsewhere in the same filing

_STUB_PAGES, _STUB_SECTION, _PROXY, _THIS_FILING, _OTHER_ITEM = map(_java, (STUB_PAGES, STUB_SECTION, PROXY, THIS_FILING, OTHER_ITEM))
_PAGE_NUMBER, _FOOT, _DIGITS, _LONG_WORDS = re.compile("[0-9]{1,4}"), _java(r"^\s*(\d{1,4})\s*$"), re.compile("[0-9]+"), re.compile("[a-z]{6,}")
_UNEVEN = ("  ", "\t", "\r", "\n", "\x0b", "\f")
_PAGE_RANGE = re.compile(r"([0-9]{1,4})\s*-\s*([0-9]{1,4})", re.A)


def _number(t: str) -> bool:
    """Whether a line without blanks at its ends is a page number."""
    return len(t) <= 5 and "0" <= t[:1] <= "9" and bool(_FOOT.search(t))


def _normal(title: str) -> str:
    """White space as one blank, straight apostrophes, lower case (``normal_title``)."""
    plain = title.replace("’", "'").strip(_BLANK)
    return (_BLANKS.sub(" ", plain) if any(b in plain for b in _UNEVEN) else plain).lower()


def _key(doc: Text, k: int) -> str:
    """A line's normal form without numbers."""
    if k not in doc.keys:
        doc.keys[k] = _DIGITS.sub("", _normal(doc.t(k)))
    return doc.keys[k]


class Pages(NamedTuple):
    """Printed page numbers: (line, page) in order, and where each page's number begins and ends."""

    markers: list[tuple[int, int]]
    starts: dict[int, int]
    ends: dict[int, int]


def page_map(doc: Text, lo: int, hi: int) -> Pages:
    """As ``page_maps``, of the lines that begin in [lo, hi)."""
    feet = []
    for k in range(bisect_left(doc.starts, lo, 0, len(doc.rows)), bisect_left(doc.starts, hi, 0, len(doc.rows))):
        bare = doc.t(k)
        if _number(bare):
            feet.append((k, int(_FOOT.search(bare)[1])))
    run = [feet[i] for i in page_run_places([page for _, page in feet])]
    return Pages(run, {page: doc.starts[k] for k, page in run}, {page: doc.end(k) for k, page in run})


def page_spans(ref: str, pages: Pages) -> list[tuple[int, int, int, int]]:
    """(a, b, start, end) of each range of a reference that a page map can place, as the operator of that name says."""
    low, high = min(pages.starts, default=0), max(pages.starts, default=0)
    if high - low < LEAST_PAGES:
        return []
    said = ref.replace("–", "-")
    ranges = [(int(a), int(b)) for a, b in _PAGE_RANGE.findall(said)] or [(int(n), int(n)) for n in _PAGE_NUMBER.findall(said)]
    out = []
    for a, b in ranges:
        if low <= a <= high:
            b = min(b, high)
            start, end = pages.ends.get(a - 1, pages.starts.get(a)), pages.starts.get(b, pages.ends.get(b))
            if start is not None and end is not None and end > start:
                out.append((a, -b, start, end))
    return [(a, -wide, start, end) for a, wide, start, end in sorted(out)]


class Top(NamedTuple):
    start: int
    title: str
    body_end: int


def page_tops(doc: Text, lo: int, hi: int, markers: list[tuple[int, int]]) -> list[Top]:
    """The headings that pages begin with in a region.

    A line of at most 80 characters that stands within two lines before or six after at least three page numbers is furniture, numbers aside. The first
    other line of the six after a page number is a heading if it has at most 60 characters. ``body_end`` is where the text before it ends, without furniture, numbers and blanks.
    """
    n = len(doc.rows)
    marks = [k for k, _ in markers if lo <= doc.starts[k] < hi]
    seen: Counter = Counter()
    for k in marks:
        near = (j for j in range(max(0, k - 2), min(n, k + TOP_LINES + 1)) if j != k and doc.rows[j])
        seen.update({_key(doc, j) for j in near if (t := doc.t(j)) and len(t) <= LONGEST_FURNITURE and not _number(t)})
    furniture = {key for key, times in seen.items() if times >= FURNITURE_PAGES}
    tops = set()
    for k in marks:
        left, j = TOP_LINES, k + 1
        while j < n and left:
            t = doc.t(j)
            if t:
                if not _number(t) and _key(doc, j) not in furniture:
                    if len(t) <= LONGEST_HEADING:
                        tops.add(j)
                    break
                left -= 1
            j += 1

    def idle(k: int) -> bool:
        t = doc.t(k)
        return not t or _number(t) or (len(t) <= LONGEST_FURNITURE and _key(doc, k) in furniture)

    out = []
    for j in sorted(tops):
        if doc.starts[j] < hi and doc.end(j) >= lo:
            k = j - 1
            while k >= 0 and doc.end(k) >= lo and idle(k):
                k -= 1
            out.append(Top(doc.starts[j], doc.t(j), doc.end(k) + 1 if k >= 0 and doc.end(k) >= lo else doc.starts[j]))
    return out


def anchors(doc: Text, titles: set[str], region_start: int) -> dict[str, int]:
    """The first line from ``region_start`` on that is a wanted title and no entry of a table of contents.

    An entry is followed by at least two numbers among its next four short lines, of eleven, before a line of 80 characters or more.
    """
    out: dict[str, int] = {}
    longest = max(map(len, titles), default=0)
    for k in range(bisect_left(doc.starts, region_start, 0, len(doc.rows)), len(doc.rows)):
        if len(t := doc.t(k)) > longest:
            continue
        title = t.replace("’", "'").lower()
        if title in titles and title not in out:
            numbers = short = 0
            for j in range(k + 1, min(len(doc.rows), k + ENTRY_LINES + 1)):
                t = doc.t(j)
                if len(t) >= ENTRY_LONG or short == ENTRY_SHORT:
                    break
                short += bool(t)
                numbers += _number(t)
            if numbers < 2:
                out[title] = doc.starts[k]
    return out


def _stubs(doc: Text, items: dict[str, Item]) -> dict[str, str]:
    """Items that only point elsewhere, with the text of the pointer, but none to a proxy statement."""
    said = {c: doc.text[i.start : i.end] for c, i in items.items() if i.status == "incorporated_by_reference" and i.start is not None}
    return {c: s for c, s in said.items() if not _PROXY.search(s)}


def appended_bodies(doc: Text, items: dict[str, Item]) -> dict[str, tuple[int, int, str]]:
    """(start, end, provenance) of pointers into a report of 20,000 characters or more behind the last item.

    A pointer that names pages gets the first range it names, snapped to the heading inside it that reads like the item's title, up to the next heading a page begins with;
    one that names a section gets what follows that heading up to the next such section or one of the endings of a report. Spans of 400 characters or less don't count.
    """
    lo, hi = max((i.end for i in items.values() if i.end is not None), default=0), len(doc.text)
    stubs = {c: s for c, s in _stubs(doc, items).items() if _THIS_FILING.search(s)} if lo > 0 and hi - lo >= LEAST_APPENDED else {}
    if not stubs:
        return {}
    out, quoted = {}, {}
    pages = None
    for code, stub in stubs.items():
        if m := _STUB_PAGES.search(stub):
            pages = pages or page_map(doc, lo, hi)
            spans = page_spans(m[1], pages)
            if not spans or spans[0][3] - spans[0][2] <= LEAST_RESOLVED:
                continue
            start, end = spans[0][2:]
            tops, best = page_tops(doc, start, hi, pages.markers), None
            for n, top in enumerate(tops):
                if start < top.start < end and (sim := _alike(_normal(_TITLE[code]), _normal(top.title))) >= SNAP_SIMILARITY and (best is None or sim > best[0]):
                    best = (sim, n)
            if best:
                off, following = tops[best[1]].start, tops[best[1] + 1].body_end if best[1] + 1 < len(tops) else -1
                snap_end = following if off < following <= end else end
                if snap_end - off > LEAST_RESOLVED:
                    start, end = off, snap_end
            out[code] = (start, end, "resolved_from_page_anchor")
        elif m := _STUB_SECTION.search(stub):
            quoted[code] = m[1].replace("’", "'").lower()
    if quoted:
        places = anchors(doc, {*quoted.values(), *ENDING_TITLES}, lo)
        for code, title in quoted.items():
            if title in places:
                start = places[title]
                end = min((a for a in places.values() if a > start), default=hi)
                if end - start > LEAST_RESOLVED:
                    out[code] = (start, end, "resolved_from_section_anchor")
    return out


def bodies_in_items(doc: Text, items: dict[str, Item]) -> dict[str, tuple[int, int, str]]:
    """(start, end, provenance) of pointers to a heading inside another item's span of over 400 characters.

    The last part of the quoted path must be the first heading of that name that a page of the span begins with, in a span of numbered pages, and must read like
    the item's own title or share a word of six letters with it. The body ends at the next such heading or with the span.
    """
    out = {}
    for code, stub in _stubs(doc, items).items():
        m = _OTHER_ITEM.search(stub)
        target = items.get(m[2].upper()) if m and m[2].upper() != code else None
        if target is None or target.start is None or target.end - target.start <= LEAST_RESOLVED:
            continue
        lo, hi = target.start, target.end
        pages = page_map(doc, lo, hi)
        if not pages.markers or pages.markers[-1][1] - pages.markers[0][1] < LEAST_PAGES:
            continue
        title, own = _normal(_PATH.split(m[1])[-1]), _normal(_TITLE[code])
        tops = page_tops(doc, lo, hi, pages.markers)
        n = next((n for n, top in enumerate(tops) if _normal(top.title) == title), None)
        if n is None or not (_alike(own, title) >= TOPIC_SIMILARITY or set(_LONG_WORDS.findall(title)) & set(_LONG_WORDS.findall(own))):
            continue
        start, end = tops[n].start, tops[n + 1].body_end if n + 1 < len(tops) else hi
        if end - start > LEAST_RESOLVED:
            out[code] = (start, end, "resolved_from_section_anchor")
    return out


_PATH = re.compile(r"\s+[-–—]\s+", re.A)


def with_bodies(doc: Text, items: dict[str, Item]) -> dict[str, Item]:
    """Items with provenance: pointers whose body stands in the same filing get its span and are partial; nothing else changes. A body in an appended report goes first."""
    bound = appended_bodies(doc, items)
    # an item that the report gave a body is no longer a pointer, and counts with that body as another's target
    now = {c: i._replace(status="partial", start=bound[c][0], end=bound[c][1]) if c in bound else i for c, i in items.items()}
    bodies = bound | bodies_in_items(doc, now)
    out = {}
    for c, i in items.items():
        if c in bodies:
            start, end, how = bodies[c]
            out[c] = i._replace(status="partial", start=start, end=end, body_chars=end - start, provenance=how, needs_review=True)
        else:
            own = "unresolved" if i.start is None and i.status != "reserved" else "offset_exact_span"
            out[c] = i._replace(provenance=own, needs_review=i.status not in ("pass", "reserved"))
    return out


# Declarations by part

_DECLARATION, _ITEM_RANGE, _ITEM_SINGLE, _AND = map(_java, (DECLARATION, ITEM_RANGE, ITEM_SINGLE, r"(?i),|\band\b"))


def listed_codes(listing: str) -> list[str]:
    """The codes that an enumeration names ("Items 10, 11 and 12", "Items 10 through 14"), in the form's order."""
    named: set[str] = set()
    for part in _AND.split(listing):
        part = _BLANKS.sub(" ", part).strip(" ")
        if (m := _ITEM_RANGE.search(part)) and (a := _ORD.get(m[1].upper())) is not None and (b := _ORD.get(m[2].upper())) is not None and b >= a:
            named.update(c for c, _ in ITEMS[a : b + 1])
        elif m := _ITEM_SINGLE.search(part):
            named.add(m[1].upper())
    return [c for c, _ in ITEMS if c in named]


def declarations(text: str) -> dict[str, tuple[int, int]]:
    """The span of the first declaration by part that names each item: the line or lines that it stands in."""
    out: dict[str, tuple[int, int]] = {}
    for m in _DECLARATION.finditer(text):
        end = text.find("\n", m.end())
        span = (text.rfind("\n", 0, m.start()) + 1, len(text) if end < 0 else end)
        for code in listed_codes(m[1]):
            out[code] = min(out.get(code, span), span)
    return out


def with_declarations(doc: Text, items: dict[str, Item]) -> dict[str, Item]:
    """Items where a missing one that a declaration names is incorporated by reference, and its span the declaration; no other item changes."""
    if not any(i.status == "missing" for i in items.values()):
        return items
    said = declarations(doc.text)
    told = {"status": "incorporated_by_reference", "provenance": "cross_reference_pointer", "needs_review": True}
    return {c: i._replace(start=said[c][0], end=said[c][1], **told) if i.status == "missing" and c in said else i for c, i in items.items()}


# Indexes into a bound report

_PAGE_LINE, _BARE_ENTRY, _NO_CONTENT, _NAMED_PAGES, _LAST_PAGES = map(_java, (PAGE_LINE, BARE_ENTRY, NO_CONTENT, NAMED_PAGES, LAST_PAGES))


class Entry(NamedTuple):
    start: int
    end: int
    ref: str
    none: bool


def _by_code(rows: list[tuple[str, Entry]]) -> dict[str, Entry]:
    """Of each code the first entry, with the first page reference."""
    out: dict[str, Entry] = {}
    for code, e in rows:
        known = out.setdefault(code, e)
        if not known.ref and e.ref:
            out[code] = known._replace(ref=e.ref)
    return out


def clustered_index(doc: Text, found: list[Heading]) -> dict[str, Entry] | None:
    """The entries of a document whose headings are an index and no table of contents, as the operator of that name says."""
    rows = sorted(found, key=lambda h: (h.start, h.ord))
    inside: Counter = Counter()
    best, j = None, 0
    for i, h in enumerate(rows):
        while j < len(rows) and rows[j].start <= h.start + WINDOW_CHARS:
            inside[rows[j].code] += 1
            j += 1
        if best is None or len(inside) > best[0]:
            best = (len(inside), h.start, rows[j - 1].end)
        inside[h.code] -= 1
        if not inside[h.code]:
            del inside[h.code]
    if best is None or best[0] < LEAST_CODES:
        return None
    n, lo, hi = best
    heads = [h for h in rows if lo <= h.start <= hi]
    if len({h.code for h in rows if not lo <= h.start <= hi}) >= OUTSIDE_CODES:
        return None
    text, entries, gaps = doc.text, [], []
    for h, following in zip(heads, [*heads[1:], None], strict=True):
        until = following.start if following else min(hi + 1, len(text))
        if following:
            gaps.append(following.start - h.start)
        named = _NAMED_PAGES.findall(text[h.end : max(h.end, until)])
        at_end = _LAST_PAGES.search(text[h.start : h.end])
        ref = "; ".join(r.strip(_BLANK) for r in named) if named else at_end[1] if at_end else ""
        k = h.line_idx + 1
        while k < len(doc.rows) and not doc.rows[k].strip(" "):
            k += 1
        after = doc.rows[k].strip(" ") if k < len(doc.rows) else ""
        entries.append((h.code, Entry(h.start, doc.end(k) if after and _PAGE_LINE.search(after) else h.end, ref, bool(_NO_CONTENT.search(after)))))
    referring = len({c for c, e in entries if e.ref}) / n
    return _by_code(entries) if referring >= LEAST_REFERRING or (gaps and median(gaps) <= PACKED_GAP) else None


def bare_index(doc: Text) -> dict[str, Entry] | None:
    """The same for entries without the word "item", as the operator of that name says."""
    rows, lo = [], None
    for k, line in enumerate(doc.rows):
        if not "0" <= line.lstrip(_BLANK)[:1] <= "9" or not (m := _BARE_ENTRY.search(line)):
            continue
        code, title, ref = m[1].upper(), m[2].strip(" "), (m[3] or "").strip(" ")
        if code in _TITLE and _alike(title, _TITLE[code]) >= BARE_SIMILARITY:
            lo = doc.starts[k] if lo is None else lo
            if doc.starts[k] - lo > BARE_WINDOW:
                break
            rows.append((code, Entry(doc.starts[k], doc.end(k), ref, bool(_NO_CONTENT.search(ref or title)))))
    return _by_code(rows) if len({c for c, _ in rows}) >= LEAST_CODES else None


def index_of(doc: Text, found: list[Heading]) -> dict[str, Entry] | None:
    """The index of a document that has one: of its headings, or, where these are fewer than eight, of bare entries."""
    return clustered_index(doc, found) if len(found) >= LEAST_CODES else bare_index(doc)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Row(NamedTuple):
    """An item of the run."""

    status: str
    provenance: str
    start: int
    end: int
    ranges: list[tuple[int, int]]
    needs_review: bool


def index_segments(doc: Text, index: dict[str, Entry]) -> dict[str, Row]:
    """All 23 items of a document with an index, as the operator of that name says."""
    pages = page_map(doc, 0, len(doc.text) + 1)
    claimed: set[tuple[int, int]] = set()
    out = {}
    for code, _ in ITEMS:
        e = index.get(code)
        free = [p for p in page_spans(e.ref if e else "", pages) if p[2:] not in claimed]
        spans = merged([p[2:] for p in free])
        chars = sum(b - a for a, b in spans)
        count = len({n for a, b, *_ in free for n in range(a, b + 1)})
        got: list[tuple[int, int]] = []
        status, how = "incorporated_by_reference", "cross_reference_pointer"
        if e and e.ref:
            if free and free[0][3] - free[0][2] >= WHOLE_RANGE:
                got = [free[0][2:]]
            elif chars > LEAST_BODY and count >= SPARSE_PAGES and chars < count * CHARS_PER_PAGE:
                status, how = "unsupported", "unresolved"
            elif chars > LEAST_BODY:
                got = spans
            if got:
                status, how = "partial", "resolved_from_page_anchor"
        elif code == "6":
            status, how = "reserved", "offset_exact_span"
        elif e is None or e.none:
            status, how = "missing", "unresolved"
        claimed.update(got)
        start, end = (got[0][0], got[-1][1]) if got else (0, 0) if status in ("reserved", "missing") else (e.start, e.end)
        out[code] = Row(status, how, start, end, got if len(got) > 1 else [], status != "reserved")
    return out


# The whole run


def routed(html: str | None, binary: bool) -> list[tuple]:
    """(code, filing_class, status, provenance, start, end, ranges, needs_review, reasons) of all items of a raw filing, as ``routed_run`` says."""
    fault, found, doc = "no text of a filing", [], None
    kind = UNSUPPORTED
    if not binary:
        try:
            text, _, _, _, marks = markup.read_page(html or "")
            doc = Text(text, [{"start": a, "end": b, "flags": f} for a, b, f in marks])
            fault = None
        except Exception as error:  # one page's fault is that page's row, not the job's end
            kind, fault = FAILED, f"{type(error).__name__}: {error}"
    if doc is None:
        rows = {c: Row("unsupported", "unresolved", 0, 0, [], True) for c, _ in ITEMS}
    else:
        found = headings(doc)
        index = index_of(doc, found)
        if index is not None:
            kind, rows = INDEX, index_segments(doc, index)
        else:
            kind = STANDARD if found else OTHER
            items = with_declarations(doc, with_bodies(doc, sections(doc, found)))
            rows = {c: Row(i.status, i.provenance, i.start or 0, i.end or 0, [], i.needs_review) for c, i in items.items()}
    spans = Counter((r.start, r.end, *r.ranges) for r in rows.values() if r.end > r.start and r.provenance != "cross_reference_pointer")
    later = [h for h in found if is_plausible(h)]
    out = []
    for code, r in rows.items():
        passed = r.status == "pass" and r.provenance == "offset_exact_span"
        over = passed and any(h.ord > _ORD[code] and r.start + HEAD_MARGIN <= h.start < r.end and h.end <= r.end for h in later)
        shared = r.provenance != "cross_reference_pointer" and spans[(r.start, r.end, *r.ranges)] > 1
        said = (fault, over and "later heading inside", shared and "shared span", r.status == "missing" and "nothing found")
        reasons = [s for s in said if s]
        ranges = [{"start": a, "end": b} for a, b in r.ranges]
        out.append((code, kind, r.status, r.provenance, r.start, r.end, ranges, r.needs_review or bool(reasons), reasons))
    return out


# Arrow: rows of (doc_id, text[, marks]) in, rows of a document's items out


def _documents(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[tuple[pa.Array, list[Text]]]:
    """The ids and texts of short slices, so that a worker's memory follows these and not the Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            texts = part.column("text").to_pylist()
            marks = part.column("marks").to_pylist() if "marks" in part.schema.names else [None] * len(texts)
            yield part.column("doc_id"), list(map(Text, texts, marks))
    pa.default_memory_pool().release_unused()


def _rows(ids: pa.Array, places: list[int], rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [ids.take(pa.array(places, pa.int32())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(n for n, _ in fields)])


_TYPES = {"spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "strings": pa.list_(pa.string()), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def fields_of(ddl: str) -> list[tuple[str, pa.DataType]]:
    named = ddl.replace("array<struct<start: bigint, end: bigint>>", "spans").replace("array<string>", "strings")
    return [(n, _TYPES[t]) for n, t in (f.split() for f in named.split(", "))]


HEADING_ROWS = (
    "line_idx long, start long, end long, title string, signs double, numbered boolean, linked boolean, upper boolean, strict boolean, set boolean, apart boolean, combined boolean, code string, ord int, canonical string, sim double, "
    "score double, listed boolean"
)
ITEM_ROWS = "code string, status string, start_offset long, end_offset long, body_chars long, toc_listed boolean"
BODY_ROWS = f"{ITEM_ROWS}, provenance string, needs_review boolean"
DECLARATION_ROWS = "code string, start long, end long"
ROUTED_ROWS = "code string, filing_class string, status string, provenance string, start long, end long, ranges array<struct<start: bigint, end: bigint>>, needs_review boolean, reasons array<string>"


def heading_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, docs in _documents(batches):
        found = [(i, h) for i, d in enumerate(docs) for h in headings(d)]
        yield _rows(ids, [i for i, _ in found], [h for _, h in found], fields_of(HEADING_ROWS))


def section_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _item_rows(batches, sections, ITEM_ROWS)


def _item_rows(batches: Iterator[pa.RecordBatch], rule, ddl: str) -> Iterator[pa.RecordBatch]:
    fields = fields_of(ddl)
    for ids, docs in _documents(batches):
        rows = [(code, *item[: len(fields) - 1]) for d in docs for code, item in rule(d).items()]
        yield _rows(ids, [i for i in range(len(docs)) for _ in ITEMS], rows, fields)


def body_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _item_rows(batches, lambda d: with_bodies(d, sections(d)), BODY_ROWS)


def declared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _item_rows(batches, lambda d: with_declarations(d, sections(d)), ITEM_ROWS)


def declaration_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, docs in _documents(batches):
        said = [(i, (code, *span)) for i, d in enumerate(docs) for code, span in declarations(d.text).items()]
        yield _rows(ids, [i for i, _ in said], [r for _, r in said], fields_of(DECLARATION_ROWS))


def given_body_rows(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The same as ``body_rows`` of documents with the sections that they are given as ``items``."""
    fields = fields_of(BODY_ROWS)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            places, out = [], []
            for i, (text, items) in enumerate(zip(part.column("text").to_pylist(), part.column("items").to_pylist(), strict=True)):
                given = {r["code"]: Item(r["status"], r["start_offset"], r["end_offset"], r["body_chars"], r["toc_listed"]) for r in items}
                out += [(code, *item) for code, item in with_bodies(Text(text), given).items()]
                places += [i] * len(given)
            yield _rows(part.column("doc_id"), places, out, fields)


def routed_rows(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            done = [routed(h, b) for h, b in zip(part.column("html").to_pylist(), part.column("binary").to_pylist(), strict=True)]
            yield _rows(part.column("doc_id"), [i for i, d in enumerate(done) for _ in d], [r for d in done for r in d], fields_of(ROUTED_ROWS))
    pa.default_memory_pool().release_unused()
