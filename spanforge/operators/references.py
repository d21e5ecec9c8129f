"""Page references between items and their pages, item codes and titles, quantiles, and ends by the next start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.filings import LEAST_PAGES
from spanforge.operators.lines import _LINES, lines_of
from spanforge.operators.sections import ITEMS, items
from spanforge.plans.registry import query
from spanforge.sources.tables import table

_SPANS = "array<struct<start:bigint,end:bigint>>"
_CODES_SQL = "(values " + ", ".join("('{}', '{}')".format(c, t.replace("'", "''")) for c, t in ITEMS) + ") as items(code, canonical)"


def page_ranges(ref: Column) -> Column:
    """Page ranges (a, b) that a reference names; where it names no range, each number is a page."""
    text = F.translate(ref, "–", "-")
    ranges = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d{1,4}\s*-\s*\d{1,4})"), 1),
        lambda r: F.struct(F.regexp_extract(r, r"^(\d+)", 1).cast("int").alias("a"), F.regexp_extract(r, r"(\d+)$", 1).cast("int").alias("b")),
    )
    pages = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,4})"), 1), lambda n: F.struct(n.cast("int").alias("a"), n.cast("int").alias("b")))
    return F.when(F.size(ranges) > 0, ranges).otherwise(pages)


def page_spans(ref: Column, starts: Column, ends: Column) -> Column:
    """(a, b, start, end) of each range of a reference that a page map can place, from the earliest start and the widest of these.

    ``starts`` and ``ends`` map a page's number to where its footer begins and ends. A page's text begins where the footer before it
    ends, or where its own begins if that is not known, and it ends where its own footer begins.
    """
    low, high = F.array_min(F.map_keys(starts)), F.array_max(F.map_keys(starts))
    valid = F.filter(page_ranges(ref), lambda r: r["a"].between(low, high))
    cut = F.transform(valid, lambda r: F.struct(r["a"].alias("a"), F.least(r["b"], high).alias("b")))
    placed = F.transform(
        cut,
        lambda r: F.struct(
            r["a"].alias("a"), (-r["b"]).alias("wide"), r["b"].alias("b"),
            F.coalesce(F.try_element_at(ends, r["a"] - 1), F.try_element_at(starts, r["a"])).cast("long").alias("start"),
            F.coalesce(F.try_element_at(starts, r["b"]), F.try_element_at(ends, r["b"])).cast("long").alias("end"),
        ),
    )
    good = F.array_sort(F.filter(placed, lambda p: p["end"] > p["start"]))
    return F.when(high - low >= LEAST_PAGES, good).otherwise(F.filter(good, lambda p: F.lit(False)))


def merged_spans(spans: Column) -> Column:
    """An array of (start, end) in order, with those that overlap or touch made one."""
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    none = F.expr(f"cast(array() as {_SPANS})")

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(span(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(span(s["start"], s["end"]))))

    return F.aggregate(F.array_sort(F.transform(spans, lambda s: span(s["start"], s["end"]))), none, add)


def resolve_all_ranges(refs: DataFrame) -> DataFrame:
    """``spans`` and ``pages`` of every reference (doc_id, code, page_ref, starts, ends): all its ranges merged, and the pages they cover."""
    placed = refs.withColumn("placed", page_spans(F.col("page_ref"), F.col("starts"), F.col("ends")))
    pages = F.size(F.array_distinct(F.flatten(F.transform("placed", lambda p: F.sequence(p["a"], F.greatest(p["a"], p["b"]))))))
    return placed.select("doc_id", "code", merged_spans(F.col("placed")).alias("spans"), pages.cast("long").alias("pages"))


def resolve_first_free(refs: DataFrame) -> DataFrame:
    """(doc_id, code, start, end): items of a document in order take the first span of their reference that no earlier item took, or none.

    One row a document holds its few items, and a fold over them keeps what is taken.
    """
    placed = refs.withColumn("placed", page_spans(F.col("page_ref"), F.col("starts"), F.col("ends")))
    options = F.transform("placed", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    docs = placed.select("doc_id", F.struct("ord", "code", options.alias("options")).alias("item")).groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    chosen = "struct<code:string,span:struct<start:bigint,end:bigint>>"

    def take(done: Column, item: Column) -> Column:
        taken = F.transform(done, lambda d: d["span"])
        free = F.filter(item["options"], lambda o: ~F.coalesce(F.array_contains(taken, o), F.lit(False)))
        return F.concat(done, F.array(F.struct(item["code"].alias("code"), F.get(free, F.lit(0)).alias("span"))))

    folded = docs.select("doc_id", F.explode(F.aggregate("items", F.expr(f"cast(array() as array<{chosen}>)"), take)).alias("c"))
    return folded.select("doc_id", "c.code", "c.span.start", "c.span.end")


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as pages, and references of three items to these: the tables hold no filings."""
    lines = lines_of(table(spark, sf_dir, "documents")).select("doc_id", (F.col("line_idx") + 1).cast("int").alias("page"), "start", "end")
    pages = lines.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "start")))).alias("starts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "end")))).alias("ends"),
        F.max("page").alias("last"),
    )
    last = F.col("last").cast("string")
    refs = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("7").alias("code"), F.lit("Pages 2-3, 4-5; 3-4").alias("page_ref")),
        F.struct(F.lit(2).alias("ord"), F.lit("7A").alias("code"), F.concat(F.lit("2-3, 6-"), last).alias("page_ref")),
        F.struct(F.lit(3).alias("ord"), F.lit("8").alias("code"), F.concat(F.lit("4, "), last, F.lit(" and 9999")).alias("page_ref")),
    )
    return pages.select("doc_id", "starts", "ends", F.explode(refs).alias("r")).select("doc_id", "r.ord", "r.code", "r.page_ref", "starts", "ends")


@query("d6_first_free_range")
def d6_first_free_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of references by page, none used twice in a document; tests hold it against a plain version."""
    return resolve_first_free(_referring(spark, sf_dir))


@query("d7_page_ranges")
def d7_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of references by page, merged; tests hold it against a plain version."""
    return resolve_all_ranges(_referring(spark, sf_dir)).select(
        "doc_id", "code", "pages", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans")
    )


@query("w3_next_start", f"""with h as (select distinct doc_id, start from {_LINES} where length(trim(line)) between 1 and 60)
  select doc_id, start, coalesce(lead(start) over (partition by doc_id order by start), length(coalesce(text, ''))) as "end" from h join documents using (doc_id)""")
def w3_next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines as headings; each reaches to the next distinct start, the last to the end of its document."""
    docs = table(spark, sf_dir, "documents")
    heads = lines_of(docs).where(F.length(F.trim("line")).between(1, 60)).select("doc_id", "start").distinct()
    following = heads.withColumn("next", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))
    whole = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return following.join(whole, "doc_id").select("doc_id", "start", F.coalesce("next", "size").alias("end"))


@query("a17_quantiles", """select lang, round(quantile_cont(n_chars, 0.05), 6) as p05, round(quantile_cont(n_chars, 0.5), 6) as p50, round(quantile_cont(n_chars, 0.95), 6) as p95 from documents group by 1""")
def a17_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles with linear interpolation, exact."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*(F.round(F.percentile("n_chars", q), 6).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))))


def item_code(number: Column, letter: Column, known: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with ``code``, number and letter in upper case where the form has such an item, else null; the form's items are a fixed list."""
    code = F.upper(F.concat(number.cast("string"), F.coalesce(letter, F.lit(""))))
    return rows.withColumn("code", code).join(F.broadcast(known.select("code", F.lit(True).alias("_known"))), "code", "left").withColumn("code", F.when(F.col("_known"), F.col("code"))).drop("_known")


@query("f10s_item_codes", f"""select items.code, count(*) as n from lineitem l left join {_CODES_SQL} on items.code = upper(l.l_linenumber || case l.l_returnflag when 'A' then 'A' when 'R' then 'b' else '' end) group by 1""")
def f10s_item_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes made of a number and a letter, null where the form has none such."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "b").alias("letter"))
    return item_code(F.col("l_linenumber"), F.col("letter"), items(spark), rows).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def normal_title(title: Column) -> Column:
    """A title in lower case with single blanks and straight apostrophes."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(title, "’", "'")), r"\s+", " "))


def without_digits(title: Column) -> Column:
    return F.regexp_replace(normal_title(title), "[0-9]+", "")


@query("f24s_titles", """select conv_id, turn, lower(regexp_replace(trim(replace(text, '’', '''')), '\\s+', ' ', 'g')) as title, regexp_replace(lower(regexp_replace(trim(replace(text, '’', '''')), '\\s+', ' ', 'g')), '[0-9]+', '', 'g') as bare from conversations""")
def f24s_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal titles, and the same without digits."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normal_title(F.col("text")).alias("title"), without_digits(F.col("text")).alias("bare"))


def title_patterns(known: DataFrame) -> DataFrame:
    """(code, whole, fragment): a pattern for the whole title of each item and one for its first two words, as columns to match by."""
    words = F.filter(F.split("canonical", " "), lambda w: w != "")
    escaped = F.transform(words, lambda w: F.regexp_replace(w, r"([^A-Za-z0-9])", r"\\$1"))
    letters = F.slice(F.regexp_extract_all("canonical", F.lit("([A-Za-z]+)"), 1), 1, 2)
    return known.select("code", F.concat(F.lit(r"(?i)\b"), F.array_join(escaped, r"\s+")).alias("whole"), F.concat(F.lit("(?i)^(?:"), F.array_join(letters, r"[\W_]+"), F.lit(r")\b")).alias("fragment"))


@query("f11s_title_patterns", f"""with w as (select code, canonical, regexp_extract_all(canonical, '[A-Za-z]+')[1:2] as l from {_CODES_SQL}), t as (select code as own, upper(canonical) || ' of 2024' as title from w)
  select own, count(*) filter (regexp_matches(lower(title), '\\b' || regexp_replace(regexp_replace(lower(canonical), '([^a-z0-9 ])', '\\\\\\1', 'g'), ' +', '\\\\s+', 'g'))) as whole,
  count(*) filter (regexp_matches(lower(title), '^(?:' || array_to_string(list_transform(l, lambda x: lower(x)), '[\\W_]+') || ')\\b')) as fragment from t, w group by 1""")
def f11s_title_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items' whole titles and first words each title meets; both sides are the form's fixed list of 23 items."""
    patterns = title_patterns(items(spark))
    titles = items(spark).select(F.col("code").alias("own"), F.concat(F.upper("canonical"), F.lit(" of 2024")).alias("title"))
    all_patterns = patterns.agg(F.collect_list(F.struct("whole", "fragment")).alias("p"))
    met = titles.join(F.broadcast(all_patterns), F.lit(True)).select("own", "title", F.explode("p").alias("p"))
    return met.groupBy("own").agg(*(F.count_if(F.expr(f"title rlike p.{c}")).alias(c) for c in ("whole", "fragment")))


@query("f43s_title_codes", f"""select items.code, count(*) as n from (select upper(regexp_extract(lower(p_name || ' item ' || p_size || case p_size % 4 when 1 then 'a' when 2 then ' B' else '' end), 'item[ _]*([0-9]{{1,2}}[ ]?[abc]?)', 1)) as raw from part) x
  left join {_CODES_SQL} on items.code = replace(raw, ' ', '') group by 1""")
def f43s_title_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard section titles to the item they name, null where the form has none such."""
    letter = F.when(F.col("p_size") % 4 == 1, "a").when(F.col("p_size") % 4 == 2, " B").otherwise("")
    title = F.lower(F.concat("p_name", F.lit(" item "), F.col("p_size").cast("string"), letter))
    found = table(spark, sf_dir, "part").select(F.replace(F.upper(F.regexp_extract(title, "item[ _]*([0-9]{1,2}[ ]?[abc]?)", 1)), F.lit(" "), F.lit("")).alias("raw"))
    known = F.broadcast(items(spark).select("code", F.col("code").alias("raw")))
    return found.join(known, "raw", "left").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
