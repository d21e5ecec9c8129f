"""Sections of numbered-item documents: headings, choice, extents, status; page markup to text with a map of offsets.

A document is one row and stays one: its lines, headings and sections are worked out in the task that reads it (``functions.filings``), so no line is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.filings import HEAD_MARGIN, HEADING_ROWS, ITEM_ROWS, ITEMS, PLAUSIBLE_SIMILARITY, heading_rows, section_rows  # noqa: F401
from spanforge.functions.markup import normalized, similarity
from spanforge.plans.registry import query
from spanforge.sources.tables import table


def items(spark: SparkSession) -> DataFrame:
    """(code, ord, canonical): the 23 items."""
    return spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(ITEMS)], "code string, ord int, canonical string")


def by_document(docs: DataFrame, rule, ddl: str) -> DataFrame:
    """Rows that a rule gives of each document (doc_id, text[, marks]) by itself: a narrow map."""
    columns = [c for c in ("doc_id", "text", "marks", "items") if c in docs.columns]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(ddl).fields])
    return docs.select(*columns).mapInArrow(rule, schema)


def candidates(docs: DataFrame) -> DataFrame:
    """Headings of (doc_id, text): one row for each item that a heading line names, with its score and whether it only lists the item.

    A heading counts as listed (as in a table of contents) with signs worth 2 or more - set as a link inside the page 2, a page number at its end 1, a contents marker
    within 3000 characters before 1, at least four other headings within 1500 characters of which two follow 1, the next heading within 300 characters 0.75 - and
    a later heading of the same item. The score is 2 for a plain heading line of at most 120 characters, 1 for one set in bold or as a heading, 0.5 for one next to
    a blank line or in capitals, twice its title's similarity, and 0.25 for capitals. How lines are set is read from ``marks`` (``read_page``) where docs have that column.
    """
    return by_document(docs, heading_rows, HEADING_ROWS)


def plausible(found: DataFrame) -> DataFrame:
    """Headings that read as a body's: plain lines that are set in bold, as a heading or apart, without a page number or a link, with signs of a table of contents worth
    less than 2, and a title like the item's or none."""
    shaped = F.col("strict") & (F.col("set") | F.col("apart")) & ~F.col("numbered") & ~F.col("linked")
    return found.where((F.col("signs") < 2) & shaped & ((F.col("sim") >= PLAUSIBLE_SIMILARITY) | (F.col("title") == "")))


def sections(docs: DataFrame) -> DataFrame:
    """All 23 items of every document: (doc_id, code, status, start_offset, end_offset, body_chars, toc_listed).

    A section ends before the next chosen heading, before an earlier line in it, 300 characters or more after its start, that is a plausible heading or a titled line of a later
    item, or at a line that opens the signatures, or with the text; page furniture and blank lines at its end are cut off.
    Status, the first that holds: no heading - reserved for item 6, else missing; a heading shared by items - partial; a short pointer elsewhere -
    incorporated_by_reference; a short item 6 that says so - reserved; a runner-up of 0.85 of the score or more - ambiguous; no body - partial; else pass.
    A null text has no headings.
    """
    return by_document(docs, section_rows, ITEM_ROWS)


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, laid out as filings: a table of contents, some items, a pointer and signatures round each text."""
    text = F.coalesce("text", F.lit(""))
    contents = "Table of Contents\nItem 1. Business 3\nItem 1A. Risk Factors 9\nItem 2. Properties 12\nItem 3. Legal Proceedings 14\nItem 11. Executive Compensation 20\nPART I\n"
    filed = F.concat(
        F.lit(contents + "Item 1. Business\n"), text, F.lit("\n3\nItem 1A. Risk Factors\n"), F.substring(text, 1, 500), F.lit("\n\nItems 2 and 3. Properties and Legal Proceedings\n"), F.left(text, F.lit(90)),
        F.lit("\nItem 6. Reserved\n[Reserved]\nItem 11. Executive Compensation\nThis is incorporated by reference to the proxy statement.\nSIGNATURES\nsigned\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", filed.alias("text"))


@query("d1_d3_w1_w19_sections")
def d1_d3_w1_w19_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the documents laid out as filings; tests hold it against a plain version and known answers."""
    return sections(_filed(spark, sf_dir))


@query("w12_f12s_end_rescan")
def w12_f12s_end_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents in which the next item is headed by its number and an earlier title only, without the word "item"; tests hold every end against its place."""
    text = F.coalesce("text", F.lit(""))
    filed = F.concat(F.lit("Item 3. Legal Proceedings\n"), text, F.lit("\n4. Submission of Matters to a Vote of Security Holders\n"), text, F.lit("\nItem 5. Market for Registrant\nSIGNATURES\n"))
    return sections(table(spark, sf_dir, "documents").select("doc_id", filed.alias("text"))).where("start_offset is not null")


@query("d13_d14_guards")
def d13_d14_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that pass but whose size lies far off their item's median (under a fifth or over eight times it); items with under five samples have no band."""
    passed = sections(_filed(spark, sf_dir)).where("status = 'pass'").select("doc_id", "code", "body_chars")
    bands = passed.groupBy("code").agg(F.floor(F.percentile("body_chars", 0.5)).alias("p50"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    lo, hi = F.greatest(F.lit(1), F.floor(F.col("p50") / 5)), F.col("p50") * 8
    return passed.join(F.broadcast(bands), "code", "left").select("doc_id", "code", "body_chars", F.coalesce(~F.col("body_chars").between(lo, hi), F.lit(False)).alias("needs_review"))


@query("f1s_normalized_pages")
def f1s_normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text with the way back to the source. A null page is empty. Tests hold every run against the source."""
    done = table(spark, sf_dir, "pages").select("page_id", normalized("html").alias("n"))
    return done.select("page_id", "n.text", F.size("n.length").alias("n_runs"), F.aggregate("n.length", F.lit(0), lambda s, n: s + n).alias("mapped_chars"))


@query("f4s_f7s_linked_lines")
def f4s_f7s_linked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page's text that say nothing but the text of one of its links."""
    anchors = F.transform(F.regexp_extract_all("html", F.lit(r"<a [^>]*>([^<]*)</a>"), 1), lambda a: F.regexp_replace(F.lower(a), "[^a-z0-9]+", ""))
    pages = table(spark, sf_dir, "pages").select("page_id", anchors.alias("anchors"), normalized("html")["text"].alias("text"))
    lines = pages.select("page_id", "anchors", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "line"))
    bare = F.regexp_replace(F.lower("line"), "[^a-z0-9]+", "")
    return lines.where((bare != "") & F.array_contains("anchors", bare)).select("page_id", "line_idx", "line")


@query("f9s_similarity")
def f9s_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each question with its answer's first line."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.left("text", F.lit(150)).alias("q"))
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.left(F.get(F.split("text", "\n"), F.lit(0)), F.lit(150)).alias("a"))
    return answers.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", F.round(similarity("q", "a"), 6).alias("ratio"))
