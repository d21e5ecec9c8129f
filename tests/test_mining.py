"""Mining: families, schemas, picks, votes against a plain version, and whole records."""

import random
import re

from pyspark.sql import functions as F

from spanforge.operators import mining as M


def values(spark, rows, schema, make):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r.v for r in df.select("k", make(F.col).alias("v")).orderBy("k").collect()]


def test_forms_schemas_and_items(spark):
    forms = [("10-K",), (" 10-k405 ",), ("10-K/A",), ("10-KT",), ("10KSB40",), ("10-KSB/A",), ("8-K",), ("",), (None,)]
    assert values(spark, forms, "f string", lambda c: M.form_family(c("f"))) == ["10K", "10K", "10K", "10KT", "10KSB", "10KSB", "other", "other", "other"]
    assert [k for k, v in enumerate(values(spark, forms, "f string", lambda c: M.is_amendment(c("f")))) if v] == [2, 5]
    eras = [("2003-12-14", None), ("2003-12-15", ""), ("2003-12-31", "Item 14. EXHIBITS"), ("2002-12-31", "Principal Accountant Fees"), (None, None)]
    assert values(spark, eras, "d string, h string", lambda c: M.era_schema(c("d"), c("h"))) == ["PRE2003", "MODERN", "PRE2003", "MODERN", "PRE2003"]
    keys = [("section_14", "PRE2003"), ("section_15", "PRE2003"), ("section_1A", "PRE2003"), ("section_7A", "PRE2003"), ("section_14", "MODERN"), ("SECTION_9a", "MODERN"), ("cik", "MODERN"), ("section_", "MODERN"), ("section_123", "MODERN"), (None, "MODERN")]
    assert values(spark, keys, "k2 string, s string", lambda c: M.canonical_item(c("k2"), c("s"))) == ["15", None, None, "7A", "14", "9A", None, None, None, None]
    assert values(spark, [("6",), ("8a",), ("13",), ("14",), (None,)], "c string", lambda c: M.small_form_item(c("c"))) == ["7", "9A", "15", None, None]
    tails = [("a\nb Item 16. Summary", 2018, "section_15"), ("a ITEM16 b", 2016, "Section_15"), ("a item 16 b", 2015, "section_15"), ("a item 16", 2018, "section_1"), ("a item 160\n", 2018, "section_15"), ("", 2018, "section_15")]
    assert values(spark, tails, "t string, y int, s string", lambda c: M.without_tail(c("t"), c("y"), c("s"))) == ["a\nb ", "a ", "a item 16 b", "a item 16", "a item 160\n", ""]


FILINGS = [
    (1, "10-K", "a1", "2010-03-01", "2009-12-31"), (1, "10-K/A", "a2", "2010-05-01", "2009-12-31"), (2, "10-K/A", "b1", "2010-05-01", "2009-12-31"), (3, "10-K", "c1", "2010-01-10", "2009-01-31"),
    (3, "10-K405", "c2", "2010-12-30", "2009-12-31"), (4, "10-KSB", "d1", "2010-01-10", "2009-12-31"), (5, "10-K", "e1", "2010-01-10", ""), (5, "8-K", "e2", "2009-01-10", "2009-01-10"), (6, "10-KT", "f1", None, None),
]
_F = "cik long, form string, accession string, filing_date string, report_date string"


def test_picked(spark):
    asked = [(k, cik, year) for k, (cik, year) in enumerate([(1, 2009), (1, 2010), (2, 2009), (3, 2009), (4, 2009), (5, 2010), (5, 2009), (6, 2009), (7, 2009), (None, 2009), (1, None)])]
    got = {r.rec_id: (r.outcome, r.basis, r.n_originals, r.n_amendments, r.one and r.one.accession) for r in M.picked(spark.createDataFrame(asked, "rec_id int, cik long, year int"), spark.createDataFrame(FILINGS, _F)).collect()}
    none = ("not_found", None, 0, 0, None)
    assert got == {
        0: ("matched", "report_date", 1, 1, "a1"), 1: ("matched", "filing_date", 1, 1, "a1"), 2: ("amendment_only", "report_date", 0, 1, None), 3: ("ambiguous", "report_date", 2, 0, None), 4: none,
        5: ("matched", "filing_date", 1, 0, "e1"), 6: none, 7: none, 8: none, 9: none, 10: none,
    }


def plain_vote(ours, theirs, status, suspect, teacher):
    a, b = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (ours, theirs))

    def held(x, y):
        if len(x) < 8:
            return float(" ".join(x) in " ".join(y))
        rows = lambda w: {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))}
        return len(rows(x) & rows(y)) / len(rows(x))

    if not b:
        return "unavailable" if a else "agree"
    if not a:
        return "agree" if status == "reserved" and len(b) < 30 else "suspect" if suspect and not teacher else "disagree"
    if teacher:
        return "agree" if len(b) - len(a) <= 40 and held(b, a) >= 0.6 else "disagree"
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if held(small, large) < 0.6:
        return "suspect" if suspect else "disagree"
    return "disagree" if len(small) / len(large) < 0.35 and len(large) - len(small) > 40 else "agree"


def test_votes(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(200)]
    pick = lambda: rng.choice([None, "", " .. ", "Not applicable.", "NOT Applicable", " ".join(base[: rng.randrange(1, 200)]), " ".join(base[rng.randrange(60) : rng.randrange(60, 200)]), " ".join(rng.sample(base, 50))])
    rows = [(k, rng.choice(["pass", "reserved", "missing"]), pick(), pick(), pick(), rng.random() < 0.8, rng.random() < 0.3) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, status string, ours string, teacher string, engine string, parsed boolean, suspect boolean")
    got = {r.k: (r.teacher_vote, r.engine_vote) for r in M.compared(df).collect()}
    assert got == {k: (plain_vote(o, t, s, False, True), plain_vote(o, e, s, sus, False) if par else None) for k, s, o, t, e, par, sus in rows}
    assert {v for _, v in got.values()} == {"agree", "disagree", "unavailable", "suspect", None}
    votes = [("disagree", "agree"), ("unavailable", "agree"), ("agree", "agree"), ("agree", "disagree"), ("agree", "suspect"), ("agree", "unavailable"), ("agree", None), ("unavailable", "disagree")]
    weak = "pseudo_gold_2way_corpus_only"
    assert values(spark, votes, "t string, e string", lambda c: M.tier(c("t"), c("e"))) == ["hard_case", "no_corpus_signal", "pseudo_gold_3way", "hard_case", weak, weak, weak, "no_corpus_signal"]


def test_mined(spark):
    said = lambda code: f"words of item {code} as the filing has them, in full"
    codes = ("1", "2", "3", "7", "14", "15")
    records = [
        (0, 1, 2009, {"section_1": said("1").upper(), "section_2": said("2"), "section_3": "else " * 60, "section_7": " \n", "filename": "x", "section_9C": "words", "section_14": said("14")}), (1, 2, 2009, {"section_1": "x"}), (2, 5, 2010, {"section_1": "x"}),
        (3, 8, 2009, {}), (4, 3, 2009, None), (5, 9, 2009, {"section_1": said("1")}),
    ]
    filings = [*FILINGS, (8, "10-K", "h1", "2010-01-01", "2009-06-30"), (9, "10-K", "i1", "2010-01-01", "2009-06-30")]
    items = [(acc, "non_10k" if acc == "i1" else "standard", c, "pass", 10, 10 + len(said(c)), "Exhibits" if acc == "h1" else None, said(c)) for acc in ("a1", "h1", "i1") for c in codes] + [("e1", "standard", "1", "pass", 0, 5, None, "words")]
    read = [("a1", "1", said("1"), False), ("a1", "2", "other words altogether that nobody wrote", False), ("h1", None, None, None)]
    got = M.mined(
        spark.createDataFrame(records, "rec_id int, cik long, year int, sections map<string,string>"), spark.createDataFrame(filings, _F),
        spark.createDataFrame(items, "accession string, filing_class string, code string, status string, start_offset long, end_offset long, heading string, text string"),
        spark.createDataFrame(read, "accession string, code string, text string, suspect boolean"),
    ).collect()
    by = {(r.rec_id, r.code): r for r in got}
    assert len(by) == len(got) and {k: r.tier for k, r in by.items()} == {
        (0, "1"): "pseudo_gold_3way", (0, "2"): "hard_case", (0, "3"): "hard_case", (0, "9C"): "hard_case", (0, "14"): "pseudo_gold_2way_corpus_only", **{(k, None): None for k in range(1, 6)}
    }
    assert [by[k, None].disposition for k in range(1, 6)] == ["hard_case:join_amendment_only", "hard_case:our_side_unsupported", "voted", "hard_case:join_ambiguous", "hard_case:our_side_unsupported"]
    gold = by[0, "1"]
    assert (gold.start_offset, gold.end_offset, len(gold.text_sha256), gold.schema) == (10, 10 + len(said("1")), 64, "MODERN") and by[0, "2"].text_sha256 is None and by[3, None].schema == "PRE2003"
    assert (by[0, "9C"].status, by[0, "14"].engine_vote) == ("missing", "unavailable")
    empty = M.mined(*(spark.createDataFrame([], s) for s in ("rec_id int, cik long, year int, sections map<string,string>", _F, "accession string, filing_class string, code string, status string, start_offset long, end_offset long, heading string, text string", "accession string, code string, text string, suspect boolean")))
    assert empty.count() == 0
