"""Sections, markup, sequences and streams against known answers and plain versions."""

import html
import random

import pytest

from spanforge.functions.markup import plain_text
from spanforge.functions.sequences import page_run, repeated_block
from spanforge.operators.sections import ITEMS, candidates, sections

FILING = """Annual report
Table of Contents
Item 1. Business 3
Item 1A. Risk Factors 9
Item 2. Properties 12
Item 3. Legal Proceedings 14
PART I
Item 1. Business
We make things and sell them.
Still more about things.

4
Items 2 and 3. Properties and Legal Proceedings
One plant, no suits.
Item 6. Reserved
[Reserved]
Item 7. Management's Discussion and Analysis
Item 11. Executive Compensation
This is incorporated herein by reference to the proxy statement.
SIGNATURES
Item 16. Form 10-K Summary"""


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(1, FILING), (2, None), (3, ""), (4, "No headings here")], "doc_id long, text string")
    return {(r.doc_id, r.code): r for r in sections(docs).collect()}


def test_every_item_is_there(found):
    assert len(found) == 4 * len(ITEMS)
    for doc in (2, 3, 4):
        assert {r.status for k, r in found.items() if k[0] == doc and k[1] != "6"} == {"missing"}
        assert found[doc, "6"].status == "reserved"


def test_statuses(found):
    status = {code: found[1, code].status for code, _ in ITEMS}
    assert status["1"] == "pass" and status["2"] == status["3"] == "partial" and status["6"] == "reserved"
    assert status["7"] == "partial" and status["11"] == "incorporated_by_reference" and status["4"] == "missing"


def test_extents(found):
    r = found[1, "1"]
    span = FILING[r.start_offset : r.end_offset]
    assert span == "Item 1. Business\nWe make things and sell them.\nStill more about things."
    assert r.toc_listed and not found[1, "7"].toc_listed
    assert found[1, "2"].start_offset == found[1, "3"].start_offset == FILING.index("Items 2 and 3")


def test_listed_headings(spark):
    docs = spark.createDataFrame([(1, FILING)], "doc_id long, text string")
    rows = candidates(docs).collect()
    assert {r.code for r in rows if r.listed} == {"1", "2", "3"}
    assert sum(r.code == "1A" for r in rows) == 1  # nothing later stands for it, so it stays


def test_ends_are_scanned_again(spark):
    """A line that is a later item's number and title ends a section, with or without the word "item", by its present title or an earlier one."""
    head, say = "Item 1. Business\n", "We make things and sell them. " * 12 + "\n"
    lines = {
        "3. LEGAL PROCEEDINGS": True, "9B Other Information": True, "4. Submission of Matters to a Vote of Security Holders.": True, "Item 6 - Selected Financial Data": True, "10 (x) Directors": False, "1. Business": False,
        "3. Legal Proceedings are described in Note 12.": False, "3. Legal Proceedings 14": False, "12,345 units": False, "10 May 2013": False, "2 Properties and other things that we own": False, "2. PROPERTIES:": True, "14. Principal Accountant Fees and Services": True,
    }
    texts = [head + say + line + "\n" + say for line in lines] + [head + "2. Properties\n" + say * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: texts[r.doc_id][: r.end_offset] for r in sections(docs).where("code = '1'").collect()}
    for k, (line, cuts) in enumerate(lines.items()):
        assert got[k] == (head + say if cuts else texts[k])[:-1], line
    assert got[len(lines)] == texts[-1][:-1]  # too near the section's own heading


def test_ends_of_all_documents(spark):
    from spanforge.operators.sections import w12_f12s_end_rescan

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.code): (r.start_offset, r.end_offset) for r in w12_f12s_end_rescan(spark, sf).collect()}
    head, titled = "Item 3. Legal Proceedings\n", "4. Submission of Matters to a Vote of Security Holders\n"
    cut = 0
    for i, text in texts.items():
        filed = head + text + "\n" + titled + text + "\n"
        scanned = len(head + text) + 1 >= 300
        kept = (head + text if scanned else filed).split("\n")
        while not kept[-1].strip(" ") or kept[-1].strip().isdigit():
            kept.pop()
        assert got[i, "3"] == (0, len("\n".join(kept))), i
        cut += scanned
    assert len(got) == 2 * len(texts) and cut > 150


def test_size_guards(spark):
    """Passed sections against a fifth of and eight times their item's median; an item with fewer than five samples has no band."""
    import statistics

    from spanforge.operators.sections import _filed, d13_d14_guards

    sf = "/root/testdata/sf0.001"
    passed = [(r.doc_id, r.code, r.body_chars) for r in sections(_filed(spark, sf)).where("status = 'pass'").collect()]
    want = set()
    for doc, code, chars in passed:
        sample = [n for _, c, n in passed if c == code]
        middle = int(statistics.median(sample))
        want.add((doc, code, chars, len(sample) >= 5 and not max(1, middle // 5) <= chars <= 8 * middle))
    got = {tuple(r) for r in d13_d14_guards(spark, sf).collect()}
    assert got == want and {w[3] for w in want} == {True, False}


PAGE = "<html><head><style>p{}</style><script>if(a<b){}</script></head><body><!-- x --><h1>A &amp; B</h1><p>one&nbsp;two  <b>thr</b>ee<br>four</p><table><tr><td>1</td><td>2</td></tr></table></body></html>"


def test_plain_text():
    text, runs = plain_text(PAGE)
    assert text == "A & B\none two three\nfour\n1 2"
    for r in runs:
        raw = PAGE[r["raw_start"] : r["raw_start"] + r["length"]]
        got = text[r["text_start"] : r["text_start"] + r["length"]]
        assert got == raw or html.unescape(PAGE[r["raw_start"] :])[:1] == got[:1]
    assert plain_text("") == ("", [])


def slow_page_run(numbers):
    best, back = [1] * len(numbers), [-1] * len(numbers)
    for i, x in enumerate(numbers):
        for j in range(i):
            if numbers[j] < x and best[j] + 1 > best[i]:
                best[i], back[i] = best[j] + 1, j
    if not numbers:
        return []
    i, chain = best.index(max(best)), []
    while i >= 0:
        chain.insert(0, numbers[i])
        i = back[i]
    parts = [[chain[0]]]
    for a, b in zip(chain, chain[1:]):
        parts.append([b]) if b - a > 100 else parts[-1].append(b)
    return max(parts, key=len)


def test_page_run():
    rng = random.Random(5)
    for _ in range(500):
        numbers = [rng.randrange(rng.choice((5, 40, 600))) for _ in range(rng.randrange(25))]
        assert page_run(numbers) == slow_page_run(numbers)


def test_repeated_block():
    import numpy as np

    assert repeated_block(np.array(list("aaa"))) == (1, 3)
    assert repeated_block(np.array(list("xababab"))) == (2, 3)
    assert repeated_block(np.array(list("abc"))) == (0, 1)
    assert repeated_block(np.array([], dtype=object)) == (0, 1)


def test_budget_stream_is_the_batch_form(spark, tmp_path):
    from spanforge.streaming.state import budget_stream, l2_budget

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null")
    cut = events.selectExpr("percentile(event_id, array(0.3, 0.7)) as c").first().c
    for i, part in enumerate((f"event_id <= {cut[0]}", f"event_id > {cut[0]} and event_id <= {cut[1]}", f"event_id > {cut[1]}")):
        events.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = budget_stream(stream, 4, 60).writeStream.format("memory").queryName("stops").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {tuple(r) for r in spark.table("stops").collect()}
    steps: dict = {}
    want = {}
    for r in events.orderBy("ts", "event_id").collect():
        n, spent = steps.get(r.user_id, (0, 0))
        n, spent = n + 1, spent + int(r.value // 1)
        steps[r.user_id] = n, spent
        if r.user_id not in want and (n >= 4 or spent >= 60):
            want[r.user_id] = n
    assert got == set(want.items()) and l2_budget(spark, sf).columns == ["user_id", "stop_step"]


def test_similarity_and_linked_lines(spark, tmp_path):
    import difflib

    from spanforge.operators.sections import f4s_f7s_linked_lines, f9s_similarity

    turns = [(1, 0, "user", "Where is it"), (1, 1, "assistant", "There it is\nand more"), (2, 0, "user", None), (2, 1, "assistant", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.ratio for r in f9s_similarity(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): round(difflib.SequenceMatcher(None, "where is it", "there it is").ratio(), 6), (2, 1): 0.0}
    page = '<p><a href="/x">Go back</a></p><p>Go on</p><p>text <a href="/y">Go on</a></p>'
    spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [(r.page_id, r.line) for r in f4s_f7s_linked_lines(spark, str(tmp_path)).orderBy("line_idx").collect()] == [(1, "Go back"), (1, "Go on")]


def test_sections_are_found_where_a_document_is_read(spark):
    """No line is shuffled, and a heading that names one item twice gives it once."""
    from spanforge.operators.sections import d1_d3_w1_w19_sections

    plan = d1_d3_w1_w19_sections(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    rows = sections(spark.createDataFrame([(1, "Items 1 and 1. Business\nWe make things and sell them.\n")], "doc_id long, text string")).collect()
    assert sorted(r.code for r in rows) == sorted(c for c, _ in ITEMS)
