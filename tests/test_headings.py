"""Headings with the evidence of markup, and pages as text with marks and offsets, against plain versions."""

import difflib
import html
import random
import re
from html.parser import HTMLParser

from spanforge.functions.markup import BLOCKS, PLAIN, read_page
from spanforge.operators import filings as G
from spanforge.operators import sections as S

SF = "/root/testdata/sf0.001"
TITLES = dict(S.ITEMS)


class Page(HTMLParser):
    """Text, and of every character its place in the source and its flags, one by one."""

    def __init__(self, raw):
        super().__init__(convert_charrefs=False)
        self.out, self.gap, self.skip, self.bold, self.head, self.links = [], "", 0, 0, 0, []
        self.starts = [0, *(m.end() for m in re.finditer("\n", raw))]
        self.feed(raw)
        self.close()

    def at(self):
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.gap = "\n" if tag in BLOCKS else self.gap
        self.bold += tag in ("b", "strong")
        self.head += bool(re.fullmatch("h[1-6]", tag))
        if tag == "a":
            self.links.append((dict(attrs).get("href") or "").startswith("#"))

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.gap = "\n" if tag in BLOCKS else self.gap or (" " if tag in ("td", "th") else "")
        self.bold = max(0, self.bold - (tag in ("b", "strong")))
        self.head = max(0, self.head - bool(re.fullmatch("h[1-6]", tag)))
        if tag == "a" and self.links:
            self.links.pop()

    def say(self, text, at, whole=False):
        for i, c in enumerate("" if self.skip else text):
            if c.isspace():
                self.gap = self.gap or " "
                continue
            if self.gap and self.out:
                self.out.append((self.gap, None, 0))
            self.gap = ""
            self.out.append((c, at if whole else at + i, (self.bold > 0) + 2 * (self.head > 0) + 4 * any(self.links)))

    def handle_data(self, data):
        self.say(data.translate(PLAIN), self.at())

    def handle_entityref(self, name):
        self.say(html.unescape(f"&{name};").translate(PLAIN)[:1], self.at(), True)

    def handle_charref(self, name):
        self.say(html.unescape(f"&#{name};").translate(PLAIN)[:1], self.at(), True)


def test_marks_and_offsets_of_random_pages():
    rng = random.Random(8)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<strong>", "</strong>", "<h2>", "</h2>", "<a href='#x'>", '<a href="/y">', "<a>", "</a>", "<td>", "</td>", "one two", "three ", " four", "  \n ", "a&amp;b", "&#233;", "é – x", "<br>", "<script>x<b>y</script>",
              "<!-- <b> -->", "five\tsix  seven"]
    for _ in range(600):
        raw = "".join(rng.choices(pieces, k=rng.randrange(16)))
        text, starts, sources, lengths, marks = read_page(raw)
        want = Page(raw).out
        assert text == "".join(c for c, *_ in want)
        flags, places = [0] * len(text), [None] * len(text)
        for a, b, n in zip(starts, sources, lengths, strict=True):
            places[a : a + n] = range(b, b + n)
        for a, b, f in marks:
            flags[a:b] = [f] * (b - a)
        for k, (c, at, f) in enumerate(want):
            assert c.isspace() or (places[k], flags[k]) == (at, f)


def test_offsets_by_halving(spark):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        starts, sources, lengths, a, b = [], [], [], 0, 0
        for _ in range(rng.randrange(0, 40)):
            a, b, n = a + rng.randrange(2), b + rng.randrange(5), rng.randrange(1, 6)
            starts, sources, lengths, a, b = [*starts, a], [*sources, b], [*lengths, n], a + n, b + n
        raw = rng.randrange(b + 3)
        after = next((i for i, (s, n) in enumerate(zip(sources, lengths)) if s + n > raw), None)
        want = starts[after] + max(0, raw - sources[after]) if after is not None else starts[-1] + lengths[-1] if starts else 0
        rows.append((starts, sources, lengths, raw, want))
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, n array<int>, raw long, want long")
    assert df.where(G.text_offset(G.F.col("a"), G.F.col("b"), G.F.col("n"), G.F.col("raw")) != G.F.col("want")).count() == 0


def plain_candidates(text, flags=None):
    """{(line, code): (start, score, signs, listed, plausible)}"""
    flags = flags or [0] * len(text)
    rows, at = [], 0
    for line in text.split("\n"):
        rows.append((at, at + len(line), line))
        at += len(line) + 1
    share = lambda a, b, mask: (sum(bool(flags[i] & mask) for i in range(a, b) if not text[i].isspace()) / n if (n := sum(not text[i].isspace() for i in range(a, b))) else 0)
    cands = []
    for k, (a, b, line) in enumerate(rows):
        if not line.strip() or len(line) > 200:
            continue
        two, one = re.match(r"^\s*items\s+(\d{1,2})\s*([a-c])?\s+and\s+(\d{1,2})\s*([a-c])?\b[\s.:\-]*(.*)$", line, re.I), re.match(r"^\s*(?:part\s+[ivx]+[.,]?\s*[-:]?\s*)?item\s*(\d{1,2})\s*([a-c])?\b[\s.:\-]*(.*)$", line, re.I)
        codes, title = ([], "")
        if two:
            codes, title = [two[1] + (two[2] or "").upper(), two[3] + (two[4] or "").upper()], two[5]
            codes = codes if all(c in TITLES for c in codes) else []
        elif one:
            codes, title = [c for c in [one[1] + (one[2] or "").upper()] if c in TITLES], one[3]
        letters = [c for c in line if c.isascii() and c.isalpha()]
        upper = bool(letters) and sum(c.isupper() for c in letters) / len(letters) > 0.8
        for code in codes:
            sim = difflib.SequenceMatcher(None, title.strip().casefold(), TITLES[code].casefold()).ratio() if title.strip() else 0.0
            short = len(line.strip()) <= 120
            strict = short and bool(re.match(r"^\s*item\s+(\d{1,2})\s*([a-c])?\s*[.:\-]?\s*(.*)$", line, re.I))
            bold = share(a, b, 3) >= 0.7
            apart = short and (upper or k == 0 or not rows[k - 1][2].strip() or k + 1 == len(rows) or not rows[k + 1][2].strip())
            score = 2 * strict + bold + 0.5 * apart + 2 * sim + 0.25 * upper
            cands.append((k, code, a, b, score, share(a, b, 4) >= 0.5, bool(re.search(r"(?:\.{3,}|·{3,}|\s)\s*\d{1,4}\s*$", line)), strict and (bold or apart), sim, title.strip()))
    markers = [m.start() for m in re.finditer(r"table\s+of\s+contents|\bindex\b", text, re.I)]
    out = {}
    for k, code, a, b, score, linked, numbered, shaped, sim, title in cands:
        near = [c[2] for c in cands if c[2] != a and abs(c[2] - a) <= 1500]
        following = [c[2] for c in cands if c[2] > a]
        signs = 2.0 * linked + numbered + any(0 <= a - p <= 3000 for p in markers) + (len(near) >= 4 and sum(s > a for s in near) >= 2) + 0.75 * (bool(following) and min(following) - b < 300)
        listed = signs >= 2 and any(c[1] == code and c[2] > a for c in cands)
        out[k, code] = (a, round(score, 6), signs, listed, signs < 2 and not linked and not numbered and shaped and (sim >= 0.4 or not title))
    return out


def test_headings_of_all_documents(spark):
    docs = S._filed(spark, SF)
    found = S.candidates(docs)
    good = {(r.doc_id, r.line_idx, r.code) for r in G.plausible(found).collect()}
    got = {(r.doc_id, r.line_idx, r.code): (r.start, round(r.score, 6), r.signs, r.listed, (r.doc_id, r.line_idx, r.code) in good) for r in found.collect()}
    want = {(d.doc_id, *k): v for d in docs.collect() for k, v in plain_candidates(d.text).items()}
    assert got == want and len(got) > 2000


FILING = (
    "<html><body><p><a href='#i1'>Item 1. Business</a> 3</p><p><a href='#i2'>Item 2. Properties</a></p><h2>Item 1. Business</h2><p>We make things, in bulk.</p>"
    "<p><b>Item 2.</b> <b>Properties</b></p><p>One plant.</p><p>Item 3. Legal <b>Proceedings</b></p><p>None, see the index.</p><p>Items 7 and 7A. Discussion of risk</p><p>text</p><p>PART II, ITEM 8. STATEMENTS</p><p>Item 99. None</p></body></html>"
)


def test_headings_with_marks(spark):
    pages = spark.createDataFrame([(1, FILING), (2, None), (3, "<p>none</p>")], "doc_id long, html string").select("doc_id", G.normalized("html").alias("n")).select("doc_id", "n.text", "n.marks")
    text, *_, marks = read_page(FILING)
    flags = [0] * len(text)
    for a, b, f in marks:
        flags[a:b] = [f] * (b - a)
    found = S.candidates(pages)
    good = {(r.line_idx, r.code) for r in G.plausible(found).collect()}
    got = {(r.line_idx, r.code): (r.start, round(r.score, 6), r.signs, r.listed, (r.line_idx, r.code) in good) for r in found.collect()}
    assert got == plain_candidates(text, flags) and len(got) == 8
    rows = {(r.line_idx, r.code): r for r in found.collect()}
    assert rows[0, "1"].linked and rows[0, "1"].listed and not rows[2, "1"].linked and rows[2, "1"].set and rows[4, "2"].set and not rows[6, "3"].set
    kept = {r.code: r.start_offset for r in S.sections(pages).where("doc_id = 1").collect()}
    assert text[kept["1"] :].startswith("Item 1. Business\nWe make") and text[kept["2"] :].startswith("Item 2. Properties\nOne plant")
