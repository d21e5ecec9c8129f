"""The whole run from raw filings to certified items: gate, text, routing by class, repairs, guards and safety nets. Every filing gives all its items, whatever happens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.filings import FAILED, INDEX, OTHER, ROUTED_ROWS, STANDARD, UNSUPPORTED, routed_rows  # noqa: F401
from spanforge.operators.indexes import _indexed
from spanforge.operators.sections import HEAD_MARGIN, _filed, items, plausible
from spanforge.operators.wrappers import _wrapped
from spanforge.plans.registry import query
from spanforge.sources.tables import table

#: How far the gate looks for a page's beginning and for a zero byte.
HEAD_CHARS, ZERO_CHARS = 2000, 4000


def is_binary(html: Column) -> Column:
    """Whether a source is no filing's text: a PDF, one with a zero byte among its first 4000 characters, or one whose first 2000 have neither a tag nor the word "item"."""
    text = F.coalesce(html, F.lit(""))
    head = F.left(F.regexp_replace(text, r"^\s+", ""), F.lit(HEAD_CHARS))
    return head.startswith("%PDF") | F.left(text, F.lit(ZERO_CHARS)).contains("\0") | ~(head.contains("<") | F.lower(head).contains("item"))


def _overshot(found: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, code) of passed items with a plausible heading of a later item inside, 300 characters or more after their start."""
    own = items(found.sparkSession)
    passed = found.where("status = 'pass' and provenance = 'offset_exact_span'").join(F.broadcast(own.select("code", F.col("ord").alias("own"))), "code").select("doc_id", "code", "own", "start", F.col("end").alias("until"))
    later = plausible(headings).select("doc_id", "ord", F.col("start").alias("at"), F.col("end").alias("head_end"))
    met = passed.join(later, "doc_id").where((F.col("ord") > F.col("own")) & (F.col("at") >= F.col("start") + HEAD_MARGIN) & (F.col("at") < F.col("until")) & (F.col("head_end") <= F.col("until")))
    return met.select("doc_id", "code").distinct()


def routed_run(filings: DataFrame) -> DataFrame:
    """All 23 items of every filing (doc_id, html): (doc_id, code, filing_class, status, provenance, start, end, ranges, needs_review, reasons).

    A source that is no text, and one that cannot be read, has unsupported items. A filing that is an index has its entries' items. Any other has its sections, with bodies that
    stand elsewhere in it put in their place and declarations by part; one without any heading is of class non_10k. Reasons for review are a later heading inside a passed
    item, a span that two items share, a pointer's text aside, a status that nothing supports, and the fault itself. A filing is one row and read once: nothing is shuffled.
    """
    sources = filings.select("doc_id", "html", is_binary(F.col("html")).alias("binary"))
    schema = T.StructType([T.StructField("doc_id", filings.schema["doc_id"].dataType), *T.StructType.fromDDL(ROUTED_ROWS).fields])
    return sources.mapInArrow(routed_rows, schema)


def _raw_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each whole in one raw filing: an index, a wrapper, a plain one, bare text, a PDF and a source with a zero byte, by turns. The tables hold no filings."""
    kind = F.col("doc_id") % 6
    escaped = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    page = F.concat(F.lit("<html><body><p>"), F.regexp_replace(escaped, "\n", "</p>\n<p>"), F.lit("</p></body></html>")).alias("html")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = [
        _indexed(spark, sf_dir).where(kind == 0).select("doc_id", page), _wrapped(spark, sf_dir).where(kind == 1).select("doc_id", page), _filed(spark, sf_dir).where(kind == 2).select("doc_id", page),
        texts.where(kind == 3).select("doc_id", page), texts.where(kind == 4).select("doc_id", F.concat(F.lit(" %PDF-1.7 "), "text").alias("html")), texts.where(kind == 5).select("doc_id", F.concat(F.lit("<p>\0"), "text").alias("html")),
    ]
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


@query("d23_routed_run")
def d23_routed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run over raw filings of six kinds that hold all documents; tests hold it against the parts it is made of and known answers."""
    done = routed_run(_raw_filings(spark, sf_dir))
    return done.withColumn("ranges", F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")).withColumn("reasons", F.array_join("reasons", "; "))
