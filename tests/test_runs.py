"""The run from raw filings to items: against its parts, on known filings, and on sources that cannot be read."""

from collections import Counter

import pandas as pd

from spanforge.functions import markup
from spanforge.operators import runs as R
from spanforge.operators.filings import with_declarations
from spanforge.operators.indexes import index_segments, indexes
from spanforge.operators.sections import ITEMS, candidates, sections
from spanforge.operators.wrappers import with_bodies

SF = "/root/testdata/sf0.001"


def run(spark, filings):
    got = {}
    for r in R.routed_run(spark.createDataFrame(filings, "doc_id long, html string")).collect():
        assert r.code not in got.setdefault(r.doc_id, {})
        got[r.doc_id][r.code] = r
    assert all(set(items) == {c for c, _ in ITEMS} for items in got.values()) and set(got) == {i for i, _ in filings}
    return got


def test_run_is_its_parts(spark):
    raw = R._raw_filings(spark, SF)
    rows = raw.collect()
    read = [(r.doc_id, *(lambda t: (t[0], [{"start": a, "end": b, "flags": f} for a, b, f in t[4]]))(markup.read_page(r.html))) for r in rows if r.doc_id % 6 < 4]
    docs = spark.createDataFrame(read, "doc_id long, text string, marks array<struct<start:int,end:int,flags:int>>")
    heads = candidates(docs)
    index = indexes(docs, heads)
    want = {(r.doc_id, r.code): (R.INDEX, r.status, r.provenance, r.start, r.end, len(r.ranges)) for r in index_segments(docs, index).collect()}
    headed, indexed = {r.doc_id for r in heads.select("doc_id").collect()}, {k[0] for k in want}
    rest = docs.where(~docs.doc_id.isin(*indexed))
    for r in with_declarations(with_bodies(rest, sections(rest)), rest).collect():
        want[r.doc_id, r.code] = (R.STANDARD if r.doc_id in headed else R.OTHER, r.status, r.provenance, r.start_offset or 0, r.end_offset or 0, 0)
    for r in rows:
        if r.doc_id % 6 >= 4:
            want |= {(r.doc_id, c): (R.UNSUPPORTED, "unsupported", "unresolved", 0, 0, 0) for c, _ in ITEMS}
    got = {(r.doc_id, r.code): (r.filing_class, r.status, r.provenance, r.start, r.end, len(r.ranges)) for r in R.routed_run(raw).collect()}
    assert got == want and len(got) == 200 * len(ITEMS)
    kinds = Counter((d % 6, v[0]) for (d, c), v in got.items() if c == "1")
    assert {k for k, _ in kinds} == set(range(6)) and {c for _, c in kinds} == {R.INDEX, R.STANDARD, R.OTHER, R.UNSUPPORTED}


def test_known_filings(spark):
    head = "<html><body>"
    body = "<p>We make things and sell them, in bulk and at length.</p>" * 12
    standard = f"{head}<p><a href='#a'>Item 1. Business</a></p><p><a href='#b'>Item 2. Properties</a></p><h2>Item 1. Business</h2>{body}<h2>Item 2. Properties</h2>{body}<p>SIGNATURES</p></body></html>"
    bleeding = f"{head}<h2>Item 1. Business</h2>{body}<p><b>Item 2.</b></p>{body}<h2>Item 2. Properties</h2>{body}<h2>Item 3. Legal Proceedings</h2>{body}"
    shared = f"{head}<h2>Items 1 and 2. Business and Properties</h2>{body}<h2>Item 3. Legal Proceedings</h2>{body}"
    lined = "ITEM 1. BUSINESS\n" + "We make things.\n" * 60 + "ITEM 2. PROPERTIES\nOne plant & more.\n"
    part = f"{head}<h2>Item 1. Business</h2>{body}<p>The information required by this Part (Items 10 through 14) is incorporated by reference to the definitive proxy statement.</p>"
    got = run(spark, [(1, standard), (2, bleeding), (3, shared), (4, lined), (5, part), (6, None), (7, ""), (8, "  %PDF-1.4 item"), (9, "<p>item\0</p>"), (10, "no markup at all"), (11, "<p>no headings</p>"), (12, "x" * 3000 + "<p>item</p>")])
    status = {d: {c: r.status for c, r in items.items()} for d, items in got.items()}
    assert status[1]["1"] == status[1]["2"] == "pass" and not got[1]["1"].needs_review and status[1]["3"] == "missing" and got[1]["3"].reasons == ["nothing found"]
    text = markup.read_page(standard)[0]
    assert text[got[1]["1"].start : got[1]["1"].end].startswith("Item 1. Business\nWe make") and text[got[1]["2"].start : got[1]["2"].end].endswith("at length.")
    bled = markup.read_page(bleeding)[0]
    assert got[2]["1"].status == "pass" and bled[got[2]["1"].start : got[2]["1"].end].endswith("at length.") and bled[got[2]["1"].end :].startswith("\nItem 2.\n") and got[2]["1"].reasons == []
    assert got[3]["1"].reasons == got[3]["2"].reasons == ["shared span"] and (got[3]["1"].start, got[3]["1"].end) == (got[3]["2"].start, got[3]["2"].end)
    assert status[4]["1"] == status[4]["2"] == "pass" and got[4]["2"].filing_class == R.STANDARD
    assert {status[5][c] for c in "10 11 12 13 14".split()} == {"incorporated_by_reference"} and got[5]["12"].provenance == "cross_reference_pointer" and got[5]["12"].reasons == []
    for d in (6, 7, 8, 9, 10, 12):
        assert {r.filing_class for r in got[d].values()} == {R.UNSUPPORTED} and {r.status for r in got[d].values()} == {"unsupported"}
    assert {r.filing_class for r in got[11].values()} == {R.OTHER} and status[11]["6"] == "reserved" and status[11]["1"] == "missing"


def test_overshoot(spark):
    """A passed item of which a plausible heading of a later one stands 300 characters or more behind its start."""
    text = "Item 1. Business\n" + "We make things. " * 30 + "\n\nItem 3. Legal Proceedings\nNone.\n"
    heads = candidates(spark.createDataFrame([(d, text) for d in range(5)], "doc_id long, text string"))
    rows = [(0, "1", "pass", "offset_exact_span", 0, len(text)), (1, "3", "pass", "offset_exact_span", 0, len(text)), (2, "1", "partial", "offset_exact_span", 0, len(text)), (3, "1", "pass", "offset_exact_span", 0, 490), (4, "1", "pass", "offset_exact_span", 300, len(text))]
    spans = spark.createDataFrame(rows, "doc_id long, code string, status string, provenance string, start long, end long")
    assert sorted(map(tuple, R._overshot(spans, heads).collect())) == [(0, "1")]


def test_a_fault_is_a_row(monkeypatch):
    real = markup.read_page

    def broken(raw):
        if "bad" in raw:
            raise ValueError("no page")
        return real(raw)

    monkeypatch.setattr(markup, "read_page", broken)
    made = pd.concat(markup._guarded(iter([pd.Series(["<b>x</b> y", "bad", None])])))
    assert made.values.tolist() == [["x y", [{"start": 0, "end": 1, "flags": 1}], None], ["", [], "ValueError: no page"], ["", [], None]]


def test_pages_of_plain_lines():
    lines = [f"  line {k}  of   text &amp; more " if k % 3 else "" for k in range(90)]
    want = [f"line {k} of text & more" for k in range(90) if k % 3]
    text, starts, sources, lengths, _ = markup.read_page("\n".join(lines))
    assert text.split("\n") == want
    raw = "\n".join(lines)
    for a, b, n in zip(starts, sources, lengths, strict=True):
        assert text[a : a + n] == raw[b : b + n] or raw[b : b + 5] == "&amp;"
    assert markup.read_page("\n".join(f"<p>{x}</p>" for x in lines))[0].split("\n") == want


def test_a_filing_is_read_once(spark):
    """The run over all filings is one narrow map."""
    plan = R.d23_routed_run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "ExistingRDD" not in plan
