"""Filings whose main document is an index into a report bound behind it: finding the index, and what each item's entry comes to.

Entries of a document are few and meet in one row; its text is read for documents with an index only, and its lines only as far as they are page numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.filings import (
    BARE_ENTRY, BARE_SIMILARITY, BARE_WINDOW, CHARS_PER_PAGE, LAST_PAGES, LEAST_BODY, LEAST_CODES, LEAST_REFERRING, NAMED_PAGES, NO_CONTENT, OUTSIDE_CODES, PACKED_GAP, PAGE_LINE, SPARSE_PAGES, WHOLE_RANGE, WINDOW_CHARS,
)
from spanforge.functions.markup import similarity
from spanforge.functions.sequences import page_places
from spanforge.operators.lines import lines_of
from spanforge.operators.references import merged_spans, page_spans
from spanforge.operators.sections import ITEMS, candidates, items
from spanforge.plans.registry import query
from spanforge.sources.tables import table

_ENTRIES = "array<struct<code:string,start:bigint,end:bigint,ref:string,none:boolean>>"
_SPAN = "struct<start:bigint,end:bigint>"
_RESULT = f"struct<code:string,status:string,provenance:string,start:bigint,end:bigint,ranges:array<{_SPAN}>>"


def page_maps(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, rid, markers, starts, ends) of each region (doc_id, rid, map_lo, map_hi): its printed page numbers, lines of nothing but a number.

    Of these the longest rising run counts. ``starts`` and ``ends`` give the place of each page's number; regions without such lines are left out.
    """
    number = F.regexp_extract("line", r"^\s*(\d{1,4})\s*$", 1)
    feet = lines_of(docs).withColumn("number", number).where("number <> ''").select("doc_id", "line_idx", "start", "end", F.col("number").cast("int").alias("page"))
    inside = feet.join(regions.select("doc_id", "rid", "map_lo", "map_hi"), "doc_id").where("start >= map_lo and start < map_hi")
    by = inside.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "page", "line_idx"))).alias("feet"))
    run = by.withColumn("places", page_places(F.col("feet.page")))
    marked = run.select("doc_id", "rid", F.transform("places", lambda i: F.get("feet", i)).alias("markers"))
    at = lambda side: F.map_from_entries(F.transform("markers", lambda m: F.struct(m["page"], m[side])))
    return marked.select("doc_id", "rid", "markers", at("start").alias("starts"), at("end").alias("ends"))


def _by_code(rows: DataFrame) -> DataFrame:
    """One row a document: its index's extent and, of each code, the first entry in order (``start``, then ``ord``) with the first page reference."""
    first = lambda c: F.min_by(c, F.struct("start", "ord"))
    each = rows.groupBy("doc_id", "code").agg(
        first("start").alias("start"), first("end").alias("end"), F.min_by("ref", F.when(F.col("ref") != "", F.struct("start", "ord"))).alias("ref"), first("none").alias("none"),
        F.min("index_start").alias("index_start"), F.max("index_end").alias("index_end"),
    )
    entry = F.struct("code", "start", "end", "ref", "none")
    return each.groupBy("doc_id").agg(F.min("index_start").alias("index_start"), F.max("index_end").alias("index_end"), F.collect_list(entry).cast(_ENTRIES).alias("entries"))


def clustered_index(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, index_start, index_end, entries) of documents whose headings (``candidates``) are an index and no table of contents.

    The first window of 8000 characters with most codes has at least eight; fewer than three codes have a heading outside it; and a quarter of the codes
    name pages, or the median distance of its headings is at most 300. An entry's pages are those named before the next heading, else those at the end of its line.
    """
    span = Window.partitionBy("doc_id").orderBy("start").rangeBetween(0, WINDOW_CHARS)
    counted = found.select("doc_id", "start", F.size(F.collect_set("code").over(span)).alias("n"), F.max("end").over(span).alias("hi"))
    best = counted.groupBy("doc_id").agg(F.max(F.struct("n", -F.col("start"), "hi")).alias("b")).select("doc_id", F.col("b.n").alias("n"), (-F.col("b")["col2"]).alias("lo"), "b.hi")
    placed = found.join(best.where(F.col("n") >= LEAST_CODES), "doc_id").withColumn("inside", F.col("start").between(F.col("lo"), F.col("hi")))
    alone = placed.groupBy("doc_id").agg(F.size(F.collect_set(F.when(~F.col("inside"), F.col("code")))).alias("outside")).where(F.col("outside") < OUTSIDE_CODES)
    order = Window.partitionBy("doc_id").orderBy("start", "ord")
    heads = placed.where("inside").join(alone.select("doc_id"), "doc_id").select(
        "doc_id", "line_idx", "code", "ord", "start", "end", "n", "lo", "hi", F.lead("start").over(order).alias("next")
    )
    line = F.trim("line")
    filled = lines_of(docs).where(line != "").select("doc_id", "line_idx", F.struct("end", line.rlike(PAGE_LINE).alias("pages"), line.rlike(NO_CONTENT).alias("none")).alias("l"))
    following = filled.select("doc_id", "line_idx", F.lead("l").over(Window.partitionBy("doc_id").orderBy("line_idx")).alias("after"))
    entry = F.struct("start", "ord", "code", "end", "next", F.when(F.col("after.pages"), F.col("after.end")).otherwise(F.col("end")).alias("entry_end"), F.coalesce("after.none", F.lit(False)).alias("none"))
    listed = heads.join(following, ["doc_id", "line_idx"], "left").groupBy("doc_id", "n", "lo", "hi").agg(F.array_sort(F.collect_list(entry)).alias("heads"))

    def pages(h: Column) -> Column:
        until = F.coalesce(h["next"], F.least(F.col("hi") + 1, F.length("text").cast("long")))
        block = F.substr("text", (h["end"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), until - h["end"]).cast("int"))
        named = F.regexp_extract_all(block, F.lit(NAMED_PAGES), 1)
        at_end = F.regexp_extract(F.substr("text", (h["start"] + 1).cast("int"), (h["end"] - h["start"]).cast("int")), LAST_PAGES, 1)
        return F.when(F.size(named) > 0, F.array_join(F.transform(named, lambda r: F.trim(F.regexp_replace(r, r"^\s+|\s+$", ""))), "; ")).otherwise(at_end)

    read = listed.join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", "n", "lo", "hi", F.inline(F.transform("heads", lambda h: F.struct(h["start"].alias("start"), h["ord"].alias("ord"), h["code"].alias("code"), h["entry_end"].alias("end"), h["none"].alias("none"), h["next"].alias("next"), pages(h).alias("ref"))))
    )
    kind = read.groupBy("doc_id").agg(
        (F.size(F.collect_set(F.when(F.col("ref") != "", F.col("code")))) / F.max("n")).alias("referring"), F.percentile(F.col("next") - F.col("start"), 0.5).alias("gap")
    )
    indexes = kind.where((F.col("referring") >= LEAST_REFERRING) | (F.col("gap") <= PACKED_GAP)).select("doc_id")
    return _by_code(read.join(indexes, "doc_id").select("doc_id", "code", "ord", "start", "end", "ref", "none", F.col("lo").alias("index_start"), F.col("hi").alias("index_end")))


def bare_index(docs: DataFrame) -> DataFrame:
    """The same for entries without the word "item" ("1A.Risk Factors49-62"): lines with a code and half of its title, at least eight codes in the 24,000 characters from the first."""
    part = lambda g: F.regexp_extract("line", BARE_ENTRY, g)
    lines = lines_of(docs).where(F.col("line").rlike(BARE_ENTRY))
    named = lines.select("doc_id", "start", "end", F.upper(part(1)).alias("code"), F.trim(part(2)).alias("title"), F.trim(F.coalesce(part(3), F.lit(""))).alias("ref"))
    alike = named.join(F.broadcast(items(docs.sparkSession)), "code").where(similarity("title", "canonical") >= BARE_SIMILARITY)
    by = Window.partitionBy("doc_id")
    near = alike.withColumn("lo", F.min("start").over(by)).where(F.col("start") - F.col("lo") <= BARE_WINDOW).withColumn("codes", F.size(F.collect_set("code").over(by)))
    said = F.when(F.col("ref") != "", F.col("ref")).otherwise(F.col("title"))
    return _by_code(
        near.where(F.col("codes") >= LEAST_CODES).select(
            "doc_id", "code", "ord", "start", "end", "ref", said.rlike(NO_CONTENT).alias("none"), F.col("lo").alias("index_start"), F.max("start").over(by).alias("index_end")
        )
    )


def indexes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The index of each document that has one: of its headings, or, where these are fewer than eight, of bare entries."""
    clustered = clustered_index(docs, found)
    several = found.groupBy("doc_id").count().where(F.col("count") >= LEAST_CODES).select("doc_id")
    bare = bare_index(docs.join(several, "doc_id", "left_anti")).join(clustered.select("doc_id"), "doc_id", "left_anti")
    return clustered.unionByName(bare)


def index_segments(docs: DataFrame, index: DataFrame) -> DataFrame:
    """All 23 items of documents with an index: (doc_id, code, status, provenance, start, end, ranges, needs_review).

    Items are taken in the form's order, and none gets a span that an earlier one has. The first that holds: a first page range of 20,000 characters or more
    is the body alone; all ranges together, of over 400 characters, are the body - unless three pages or more have under 300 characters each, which
    is unsupported; pages that cannot be placed, and entries without pages, point elsewhere; item 6 is reserved; an entry that says none, and no entry, is missing.
    """
    maps = page_maps(docs, index.select("doc_id", F.lit("all").alias("rid"), F.lit(0).cast("long").alias("map_lo"), F.lit((1 << 62)).alias("map_hi"))).drop("rid", "markers")
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
    mapped = index.join(maps, "doc_id", "left").withColumns({c: F.coalesce(c, none) for c in ("starts", "ends")})

    def entry(code: str) -> Column:
        e = F.get(F.filter("entries", lambda x: x["code"] == code), F.lit(0))
        return F.struct(F.lit(code).alias("code"), e.alias("e"), page_spans(F.coalesce(e["ref"], F.lit("")), F.col("starts"), F.col("ends")).alias("placed"))

    rows = mapped.select("doc_id", F.array(*(entry(c) for c, _ in ITEMS)).alias("wanted"))
    no_spans, no_rows = F.array().cast(f"array<{_SPAN}>"), F.array().cast(f"array<{_RESULT}>")
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    nowhere = span(F.lit(0), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        free = F.filter(x["placed"], lambda p: ~F.array_contains(state["claimed"], span(p["start"], p["end"])))
        first, merged = F.get(free, F.lit(0)), merged_spans(free)
        chars = F.aggregate(merged, F.lit(0).cast("long"), lambda s, m: s + m["end"] - m["start"])
        pages = F.size(F.array_distinct(F.flatten(F.transform(free, lambda p: F.sequence(p["a"], F.greatest(p["a"], p["b"]))))))
        refers, e = F.coalesce(x["e"]["ref"], F.lit("")) != "", x["e"]
        whole = refers & F.coalesce(first["end"] - first["start"] >= WHOLE_RANGE, F.lit(False))
        body = refers & ~whole & (chars > LEAST_BODY)
        sparse = body & (pages >= SPARSE_PAGES) & (chars < pages * CHARS_PER_PAGE)
        body = body & ~sparse
        reserved, empty = ~refers & (x["code"] == "6"), ~refers & F.coalesce(e["none"], F.lit(False))
        got = F.when(whole, F.array(span(first["start"], first["end"]))).when(body, merged).otherwise(no_spans)
        status = (
            F.when(whole | body, "partial").when(sparse, "unsupported").when(refers, "incorporated_by_reference").when(reserved, "reserved").when(empty | e.isNull(), "missing").otherwise("incorporated_by_reference")
        )
        provenance = (
            F.when(whole | body, "resolved_from_page_anchor").when(sparse, "unresolved").when(refers, "cross_reference_pointer").when(reserved, "offset_exact_span").when(empty | e.isNull(), "unresolved").otherwise("cross_reference_pointer")
        )
        place = F.when(F.size(got) > 0, span(F.get(got, F.lit(0))["start"], F.get(got, F.size(got) - 1)["end"])).when(reserved | empty | e.isNull(), nowhere).otherwise(span(e["start"], e["end"]))
        row = F.struct(x["code"].alias("code"), status.alias("status"), provenance.alias("provenance"), place["start"].alias("start"), place["end"].alias("end"), F.when(F.size(got) > 1, got).otherwise(no_spans).alias("ranges"))
        return F.struct(F.concat(state["claimed"], got).alias("claimed"), F.concat(state["rows"], F.array(row.cast(_RESULT))).alias("rows"))

    start = F.struct(no_spans.alias("claimed"), no_rows.alias("rows"))
    folded = rows.select("doc_id", F.inline(F.aggregate("wanted", start, step, lambda s: s["rows"])))
    return folded.withColumn("needs_review", F.col("status") != "reserved")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, whole, bound behind an index of their pages: the tables hold no filings.

    A page has 500 characters, or 200 in every fifth document; the numbers start at 3. Every second document's entries leave out the word "Item".
    """
    text, bare = F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 1
    pages = F.when(F.col("doc_id") % 5 == 0, F.regexp_extract_all(text, F.lit(r"((?s).{1,200})"), 1)).otherwise(F.regexp_extract_all(text, F.lit(r"((?s).{1,500})"), 1))
    bound = F.array_join(F.transform(pages, lambda p, i: F.concat(p, F.lit("\n"), (i + 3).cast("string"), F.lit("\n"))), "")
    last = (F.size(pages) + 2).cast("string")
    refs = {"1": F.lit("4-5, 7-9"), "1A": F.concat(F.lit("4-"), last), "1B": F.lit("None"), "2": F.lit("6"), "3": F.lit("900-910"), "5": F.lit("6"), "7": F.lit("5-9, 8-12"), "7A": F.concat(F.lit("4-"), last), "8": F.lit("4-20"), "9": F.lit(""), "15": F.concat(F.lit("5-6, 10-"), last)}

    def line(code: str, title: str) -> Column:
        ref = refs[code]
        with_item = F.concat(F.lit(f"Item {code}. {title}\n"), F.when(ref.rlike(r"^\d"), F.concat(F.lit("Pages "), ref)).otherwise(ref))
        return F.when(bare, F.concat(F.lit(f"{code}. {title}"), F.when(ref.rlike(r"^\d"), F.concat(F.lit(" "), ref)).otherwise(F.lit("")))).otherwise(with_item)

    entries = F.concat_ws("\n", *(line(c, t) for c, t in ITEMS if c in refs))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Form 10-K\n"), entries, F.lit("\nSee the following report.\n"), bound).alias("text"))


@query("d8_w18_index_segments")
def d8_w18_index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of whole documents bound behind an index; tests hold it against a plain version and known answers."""
    docs = _indexed(spark, sf_dir)
    found = index_segments(docs, indexes(docs, candidates(docs)))
    return found.withColumn("ranges", F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["start"], r["end"])), ","))
