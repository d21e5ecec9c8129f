"""Lines, their predicates and scalar functions on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.plans.registry import query
from spanforge.sources.tables import table


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_idx, start, end, line): half-open code-point offsets, newline excluded."""
    each = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line_idx", "line"))
    before = Window.partitionBy(id_col).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return each.withColumn("start", start).select(id_col, F.col("line_idx").cast("long").alias("line_idx"), "start", (F.col("start") + F.length("line")).alias("end"), "line")


_LINES = """(select doc_id, pos - 1 as line_idx, line,
  cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents))"""


@query("f3s_lines", f"""select doc_id, count(*) as n_lines, cast(sum(start) as bigint) as sum_start, max(start + length(line)) as last_end,
  cast(sum(case when trim(line) = '' then 1 else 0 end) as bigint) as n_blank from {_LINES} group by 1""")
def f3s_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("start").alias("sum_start"), F.max("end").alias("last_end"), F.count_if(F.trim("line") == "").alias("n_blank")
    )


@query("f8s_uppercase", f"""select doc_id, count(*) as n_upper from {_LINES}
  where length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 0
  and length(regexp_replace(line, '[^A-Z]', '', 'g')) > 0.8 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')) group by 1""")
def f8s_uppercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which over four fifths of the letters are capitals."""
    letters, capitals = F.length(F.regexp_replace("line", "[^A-Za-z]", "")), F.length(F.regexp_replace("line", "[^A-Z]", ""))
    return lines_of(table(spark, sf_dir, "documents")).where((letters > 0) & (capitals > 0.8 * letters)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_upper"))


@query("f2s_plain_text", """select page_id, n_newlines >= 50 and n_tags < 0.1 * n_newlines as plain from (select page_id,
  length(html) - length(replace(html, chr(10), '')) as n_newlines, len(regexp_extract_all(html, '(?i)<(?:p|div|table|tr|td|br)[ />]')) as n_tags from pages)""")
def f2s_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is plain text: many newlines and few block tags."""
    newlines = F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit("")))
    tags = F.regexp_count("html", F.lit("(?i)<(?:p|div|table|tr|td|br)[ />]"))
    return table(spark, sf_dir, "pages").select("page_id", ((newlines >= 50) & (tags < 0.1 * newlines)).alias("plain"))


@query("p1_input_gate", """select page_id, case when starts_with(ltrim(html), '%PDF') then 'pdf' when contains(left(html, 4000), chr(0)) then 'binary'
  when not contains(left(html, 2000), '<') and not contains(lower(left(html, 2000)), 'item') then 'unsupported' else 'ok' end as input_class from pages""")
def p1_input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that can't be read at all, told apart before any parsing."""
    head = F.left("html", F.lit(2000))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.startswith(F.ltrim("html"), F.lit("%PDF")), "pdf").when(F.contains(F.left("html", F.lit(4000)), F.lit("\0")), "binary")
        .when(~F.contains(head, F.lit("<")) & ~F.contains(F.lower(head), F.lit("item")), "unsupported").otherwise("ok").alias("input_class"),
    )


@query("f16s_f17s_tokens", """select doc_id, cast(len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) as bigint) as n_tokens,
  cast(len(regexp_extract_all(text, '[A-Za-z]+')) as bigint) as n_words from documents""")
def f16s_f17s_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of three letters or more, and alphabetic words."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))).cast("long").alias("n_tokens"),
        F.regexp_count("text", F.lit("[A-Za-z]+")).cast("long").alias("n_words"),
    )


def words_of(text):
    """Alphanumeric words in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def shingles_of(words, size: int = 8):
    """Distinct runs of ``size`` words; fewer words are one run, none are none. ``words`` is a column of its own: as an expression it would be split anew for every run."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))


@query("f18s_shingles", """select item_id, cast(len(case when len(w) = 0 then [] when len(w) < 8 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) end) as bigint) as n_shingles
  from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark)""")
def f18s_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", words_of(F.col("text")).alias("w"))
    return items.select("item_id", F.size(shingles_of(F.col("w"))).cast("long").alias("n_shingles"))


@query("f33s_domains", """select domain, count(*) as n from (select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^(www|m)\\.', '') as domain from pages) group by 1""")
def f33s_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host without its leading www or m."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select(F.regexp_replace(host, r"^(www|m)\.", "").alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("h1_h4_hashes", """select conv_id, turn, sha256(text) as text_sha256,
  left(sha256(coalesce(role, '') || '|' || trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 16) as task_key from conversations""")
def h1_h4_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, and a key of 16 hex digits that ignores white space."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), F.left(F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("|"), plain), 256), F.lit(16)).alias("task_key")
    )


@query("m5_m10_scales", """select o_orderkey, case when c >= 0.9 then 'high' when c >= 0.6 then 'medium' else 'low' end as band,
  cast(len(list_filter([o_totalprice, o_totalprice / 1e3, o_totalprice / 1e6], lambda x: x >= 10)) as bigint) as n_scales
  from (select o_orderkey, o_totalprice, (o_orderkey % 100) / 100.0 as c from orders)""")
def m5_m10_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk band of a confidence, and how many scales an amount can be written in."""
    c, price = (F.col("o_orderkey") % 100) / 100.0, F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(c >= 0.9, "high").when(c >= 0.6, "medium").otherwise("low").alias("band"),
        F.size(F.filter(F.array(price, price / 1e3, price / 1e6), lambda x: x >= 10)).cast("long").alias("n_scales"),
    )


@query("m2_span_prf", """select doc_id, round(case when inter = 0 then 0.0 else inter / p end, 6) as prec, round(case when inter = 0 then 0.0 else inter / g end, 6) as recall,
  round(case when inter = 0 then 0.0 else 2.0 * inter / (p + g) end, 6) as f1 from (select doc_id, cast(n_chars as double) as p, 1000.0 as g,
  cast(greatest(0, least(doc_id % 500 + n_chars, 1200) - greatest(doc_id % 500, 200)) as double) as inter from documents where n_chars > 0)""")
def m2_span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap precision, recall and F1 of a span against a gold span; no overlap is 0, not null."""
    start = F.col("doc_id") % 500
    inter = F.greatest(F.lit(0), F.least(start + F.col("n_chars"), F.lit(1200)) - F.greatest(start, F.lit(200))).cast("double")
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars").cast("double").alias("p"), F.lit(1000.0).alias("g"), inter.alias("i"))
    guarded = lambda x: F.round(F.when(F.col("i") == 0, 0.0).otherwise(x), 6)
    return d.select("doc_id", guarded(F.col("i") / F.col("p")).alias("prec"), guarded(F.col("i") / F.col("g")).alias("recall"), guarded(2 * F.col("i") / (F.col("p") + F.col("g"))).alias("f1"))
