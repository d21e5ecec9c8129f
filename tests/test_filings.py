"""Rules over filings against known answers and plain versions."""

from html.parser import HTMLParser

from spanforge.functions.tags import tagged_fragments
from spanforge.operators import filings as G
from spanforge.operators.sections import sections


def test_stub_targets(spark):
    long = "Our directors are listed. " * 40
    bodies = {
        "Incorporated by reference to the Proxy Statement.": "the definitive proxy statement (external document, not fetched)",
        "See Note 12 to the statements.": "a financial-statement note (Note 12) elsewhere in this filing",
        "As set forth in Item 7A below.": "another item (Item 7A) in this filing",
        "It is set forth in our consolidated financial statements, pages 3-9.": "a page range (pages 3-9) of this filing",
        "Reference is made to it.": "content located elsewhere in this filing",
        "We make things.": None, "": None,
        long + "This is incorporated by reference to the annual report.": "the annual report / financial statements bound in this filing",
        long + "See Note 12.": None,
        long + "1 2 3 4 5 6 7 8 9 10 11 12 This is incorporated by reference to the annual report.": None,
        long * 3 + "This is incorporated by reference to the annual report.": None,
    }
    got = {r.body: r.t for r in spark.createDataFrame([(b,) for b in (*bodies, None)], "body string").select("body", G.stub_target(G.F.col("body")).alias("t")).collect()}
    assert got == bodies | {None: None}


def test_shared_headings(spark):
    text = "Item 1. Business and Properties\nWe make things.\nItem 3. Legal Proceedings and Mine Safety Disclosures\nNone.\nItems 7 and 8. Risk Factors\nNo.\n"
    got = {r.code: r for r in sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["2"].status == got["1"].status == "partial" and got["2"].start_offset == got["1"].start_offset == 0 and got["2"].end_offset == got["1"].end_offset
    assert got["4"].start_offset == got["3"].start_offset and got["4"].status == "partial"
    assert got["1A"].status == "missing" and got["6"].status == "reserved"  # a heading of several items lends to none


def test_declarations(spark):
    said = "As told,\nthe information required by this Part (Items 1, 10 through 12, item 14 and 99) is incorporated herein by\nreference to our definitive proxy statement for 2024. More.\nEnd"
    text = "Item 1. Business\nWe make things and sell them.\n" + said
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no items")], "doc_id long, text string")
    before = {(r.doc_id, r.code): r for r in sections(docs).collect()}
    after = {(r.doc_id, r.code): r for r in G.with_declarations(sections(docs), docs).collect()}
    changed = {k[1] for k in before if before[k] != after[k]}
    assert changed == {"10", "11", "12", "14"} and len(before) == len(after)
    r = after[1, "11"]
    assert r.status == "incorporated_by_reference" and text[r.start_offset : r.end_offset] == said[said.index("the info") : said.index("\nEnd")]


def test_later_headings(spark):
    """A heading needs emphasis or room of its own; one sign of a table of contents alone does not rule it out, two do."""
    body = "Item 1. Business\n" + "We make things. " * 20 + "\n"
    plant = "One plant. " * 40
    at = (len(body) + 1, "2")
    cases = [
        ("1", body + "\nItem 2. Properties\n" + plant + "\n\nItem 3. Legal Proceedings\nNone.\n", at), ("3", body + "\nItem 2. Properties\nx", None), ("1", body + "\nas in Item 2. Properties\n", None),
        ("1", body + "Item 2. Properties\nOne plant.", None), ("1", body + "ITEM 2. PROPERTIES\nOne plant.", (len(body), "2")), ("1", body + "Item 2. Properties\n\nOne plant.", (len(body), "2")),
        ("1", "Item 1. Business\nItem 2. Properties\n" + "One plant. " * 90, None), ("1", None, None), ("1", body + "\nItem 2. Zebras\n" + plant, None), ("1", body + "\nItem 2.\n" + plant, at),
        ("1", body + "\nItem 2. Properties\nOne.\n\nItem 3. Legal Proceedings\n" + plant, at),  # a short gap
        ("1", "Table of Contents\n" + body + "\nItem 2. Properties\n" + plant, (len(body) + 19, "2")),  # a marker before
        ("1", "Table of Contents\n" + body + "\nItem 2. Properties 12\n" + plant, None), ("1", body + "\nItem 2. Properties 12\n" + plant, None),
        ("1", "Table of Contents\n" + body + "\n\n".join(["", "Item 2. Properties", "Item 3. Legal Proceedings", "Item 4. Mine Safety Disclosures", "Item 6. Reserved", "Item 9B. Other Information", plant]), (0, "")),  # the first with fewer than two headings after it
    ]
    rows = [(k, code, text) for k, (code, text, _) in enumerate(cases)]
    got = {r.doc_id: (r.start, r.later) for r in G.later_headings(spark.createDataFrame(rows, "doc_id long, code string, text string")).collect()}
    last = cases[-1][1].index("Item 6")
    want = {k: w for k, (*_, w) in enumerate(cases) if w} | {len(cases) - 1: (last, "6")}
    assert got == want


class Plain(HTMLParser):
    """Blocks and continuations on one line of source, read by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.out, self.depth = [], [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "ix:hidden":
            self.depth += 1
        elif tag.startswith("ix:"):
            name = a.get("name") or ""
            name = name if tag == "ix:nonnumeric" and name.startswith("cyd:") and name.endswith("TextBlock") else ""
            keep = name or (tag == "ix:continuation" and a.get("id"))
            self.open.append((tag, keep and [name, a.get("id") or "", a.get("continuedat") or "", self.getpos()[1] + len(self.get_starttag_text()), self.depth > 0]))

    def handle_endtag(self, tag):
        if tag == "ix:hidden":
            self.depth = max(0, self.depth - 1)
            return
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                f = self.open.pop(i)[1]
                if f and (f[0] or f[1] not in {o[1] for o in self.out if not o[0]}):
                    self.out.append([*f, self.getpos()[1]])
                return


def test_tagged_fragments():
    import random

    rng = random.Random(3)
    pieces = ['<ix:nonNumeric name="cyd:ATextBlock" id="a" continuedAt="c1">', "<ix:nonNumeric name='cyd:Flag'>", "</ix:nonNumeric>", '<ix:continuation id="c1" continuedAt="c2">', '<ix:continuation id="c2">', "<ix:continuation>",
              "</ix:continuation>", "<ix:hidden>", "</ix:hidden>", "<!-- <ix:hidden> -->", "<script>'<ix:hidden>'</script>", '<style a="b"><ix:continuation id="c3"></ix:continuation></style>', "<p>text</p>", "words "]
    for _ in range(400):
        raw = "".join(rng.choices(pieces, k=rng.randrange(14)))
        plain = Plain()
        plain.feed(raw)
        plain.close()
        assert [[f["name"], f["id"], f["next"], f["start"], f["hidden"], f["end"]] for f in tagged_fragments(raw)] == plain.out
    other = '<html xmlns:q="http://xbrl.sec.gov/cyd/2024"><ix:nonNumeric name="q:ATextBlock">x</ix:nonNumeric><ix:nonNumeric name="cyd:ATextBlock">y</ix:nonNumeric>'
    assert [f["name"] for f in tagged_fragments(other)] == ["q:ATextBlock"] and tagged_fragments("") == [] and tagged_fragments("<ix:hidden" * 20000) == []


def test_official_spans(spark):
    page = ('<p>Before &amp; all</p><ix:nonNumeric name="cyd:ATextBlock" continuedAt="c1"><p>one two</p></ix:nonNumeric><p>gap</p><ix:continuation id="c1" continuedAt="c2"><p>three</p></ix:continuation>'
            '<ix:continuation id="c2" continuedAt="c1">four</ix:continuation><ix:hidden><ix:nonNumeric name="cyd:BTextBlock">five</ix:nonNumeric></ix:hidden><p>six</p>')  # fmt: skip
    docs = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = {r.page_id: r for r in G.official_spans(docs).collect()}
    r, text = got[1], G.normalized
    assert (r.blocks, r.fragments, r.hidden) == (2, 4, 1) and [page[s.start : s.end] for s in r.raw_spans] == ["<p>one two</p>", "<p>three</p>", "four"]
    text = docs.select("page_id", G.normalized("html")["text"].alias("t")).where("page_id = 1").first().t
    assert [text[s.start : s.end].strip() for s in r.text_spans] == ["one two", "three", "four"]
    assert all((got[k].blocks, got[k].raw_spans) == (0, []) for k in (2, 3))


def test_fact_candidates(spark):
    facts = [("a", "Revenues", "USD", "10-K", "2023-01-01", 1), ("a", "SalesRevenueNet", "USD", "10-K", "2023-01-01", 2), ("a", "Assets", "USD", "10-K/A", None, 3), ("a", "Assets", "USD", "10-K", "2023-01-01", 4),
             ("a", "ProfitLoss", "EUR", "10-K", "2023-01-01", 5), ("b", "SalesRevenueNet", "USD", "10-K", "2023-01-01", 6), ("b", "Revenues", "USD", "10-Q", "2023-01-01", 7), ("b", "Other", "USD", "10-K", None, 8)]
    df = spark.createDataFrame(facts, "accn string, concept string, unit string, form string, start string, val long")
    assert {(r.metric, r.val) for r in G.fact_candidates(df).collect()} == {("revenue", 1), ("total_assets", 3), ("revenue", 6)}
    ids = spark.createDataFrame([("000032019324000123",), ("0000320193-24-000123",)], "a string").select(G.dashed(G.F.col("a")).alias("a"))
    assert {r.a for r in ids.collect()} == {"0000320193-24-000123"}


def test_action_screen(spark):
    rows = [("fill", "my password", None, None, "sensitive_input"), ("fill", "x", "#cvv", None, "sensitive_input"), ("keyboard", None, None, "pay now", "sensitive_input"), ("click", None, "buy-now", None, "irreversible_action"),
            ("press", None, "add_to_cart", None, "irreversible_action"), ("goto", "checkout", "checkout", None, "ok"), ("click", "password", "next", None, "ok"), (None, None, None, None, "ok")]
    df = spark.createDataFrame(rows, "kind string, value string, target string, typed string, want string")
    got = df.select("want", G.screen_action(*(G.F.col(c) for c in ("kind", "value", "target", "typed"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_declarations_are_found_where_a_document_is_read(spark):
    """The query is the rule over its own sections, without a shuffle."""
    sf = "/root/testdata/sf0.001"
    done = G.d9_part_declarations(spark, sf)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    said = "\nPART III\nThe information required by this Part (Items 10, 11, and 12 through 14) is incorporated by reference to the definitive proxy statement.\n"
    docs = G._filed(spark, sf).withColumn("text", G.F.concat("text", G.F.lit(said)))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, G.with_declarations(sections(docs), docs).collect()))
