"""Bodies that stand elsewhere in the same filing: in a report bound behind the last item, or under a heading inside another item.

All that a document's bodies depend on is the document, so they are found in the task that reads it (``functions.filings``). Section headings are those that a page
begins with, once the short lines that pages repeat are set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.filings import BODY_ROWS, ENDING_TITLES, OTHER_ITEM, STUB_PAGES, STUB_SECTION, THIS_FILING, body_rows, given_body_rows  # noqa: F401
from spanforge.operators.sections import by_document
from spanforge.plans.registry import query
from spanforge.sources.tables import table


def with_bodies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``sections`` with ``provenance`` and ``needs_review``: pointers whose body stands in the same filing get its span and are partial; nothing else changes.

    A body in an appended report goes before one inside an item. Where ``found`` is ``sections`` of the same documents, ``bound_sections`` gives the same without a shuffle.
    """
    items = found.groupBy("doc_id").agg(F.collect_list(F.struct("code", "status", "start_offset", "end_offset", "body_chars", "toc_listed")).alias("items"))
    return by_document(items.join(docs.select("doc_id", "text"), "doc_id", "left"), given_body_rows, BODY_ROWS)


def bound_sections(docs: DataFrame) -> DataFrame:
    """``with_bodies`` of the documents' own ``sections``: a narrow map."""
    return by_document(docs, body_rows, BODY_ROWS)


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, whole, as filings with four pointers: pages and a section of a report bound behind the signatures, a heading inside item 7, a proxy statement.

    The tables hold no filings. The report is the document four times over in pages of 400 characters, numbered from 46; item 7 is the document once, numbered from 2.
    """
    text = F.coalesce("text", F.lit(""))

    def paged(body: Column, first: int, heads: dict[int, str]) -> Column:
        pages = F.regexp_extract_all(body, F.lit(r"((?s).{1,400})"), 1)
        head = lambda i: F.coalesce(*(F.when(i == k, h + "\n") for k, h in heads.items()), F.lit(""))
        return F.array_join(F.transform(pages, lambda p, i: F.concat(head(i), p, F.lit("\n"), (i + first).cast("string"), F.lit("\nThe Company Annual Report "), (i + first + 1).cast("string"), F.lit("\n"))), "")

    filed = F.concat(
        F.lit('Item 1. Business\nWe make things.\nItem 1C. Cybersecurity\nSee "Management\'s Discussion - Cybersecurity Risk Management" in Part II, Item 7 of this Form 10-K.\nItem 7. Management\'s Discussion\n'),
        paged(text, 2, {2: "Cybersecurity Risk Management", 4: "Results"}),
        F.lit('\nItem 7A. Quantitative and Qualitative Disclosures About Market Risk\nThis appears in the Financial Section on pages 47-60.\nItem 8. Financial Statements and Supplementary Data\nSee the section entitled "The Statements" in the Financial Section.\n'),
        F.lit("Item 11. Executive Compensation\nThis is incorporated by reference to the proxy statement.\nSIGNATURES\nsigned\nThe Statements\n50\nIndex to Exhibits\n90\n"),
        paged(F.repeat(F.concat(text, F.lit("\n")), F.lit(4)), 46, {5: "Quantitative and Qualitative Disclosures on Market Risk", 9: "Liquidity", 12: "The Statements"}), F.lit("Index to Exhibits\nnone\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", filed.alias("text"))


@query("d10_d11_d12_bound_bodies")
def d10_d11_d12_bound_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of whole documents as filings with bodies bound elsewhere; tests hold it against a plain version and known answers."""
    return bound_sections(_wrapped(spark, sf_dir))
