"""Passes over ordered spans and ranked lists: hits, covers, overlaps, cycles, page runs, rescans, main files and capped samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.sequences import cycle, page_runs
from spanforge.operators.lines import _LINES, lines_of
from spanforge.plans.registry import query
from spanforge.sources.tables import table

MAX_HITS = 500


def hits_of(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, hit, found_at, total): leftmost non-overlapping places of a text, at most 500 a document beside their full number."""
    pieces = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), rf"\Q{needle}\E", -1).alias("pieces")).where(F.size("pieces") > 1)
    each = pieces.select("doc_id", (F.size("pieces") - 1).cast("long").alias("total"), F.posexplode("pieces").alias("hit", "piece"))
    upto = Window.partitionBy("doc_id").orderBy("hit").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.length("piece") + len(needle)).over(upto) - len(needle)
    placed = each.select("doc_id", F.col("hit").cast("long").alias("hit"), at.alias("found_at"), "total")
    return placed.where((F.col("hit") < F.least(F.lit(MAX_HITS), "total")))


@query("w23_x26_hits", """select doc_id, hit, found_at, total from (select doc_id, hit, total, cast(sum(length(piece) + 4) over (partition by doc_id order by hit rows unbounded preceding) as bigint) - 4 as found_at from (
  select doc_id, unnest(string_split(text, ' the')) as piece, generate_subscripts(string_split(text, ' the'), 1) - 1 as hit, len(string_split(text, ' the')) - 1 as total from documents)) where hit < least(500, total)""")
def w23_x26_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(table(spark, sf_dir, "documents"), " the")


_SHIPPED = "(select l_orderkey as k, l_linenumber as i, date_diff('day', timestamp '1990-01-01', l_shipdate) as s, date_diff('day', timestamp '1990-01-01', l_shipdate) + cast(l_quantity as bigint) as e from lineitem)"


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans (k, i, s, e) in days: the lines of an order, each as long as its quantity."""
    s = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"))


@query("jn7_tightest_cover", f"""with p as (select distinct * from {_SHIPPED}), c as (select k, s as cut from p union select k, e from p), z as (select k, cut, lead(cut) over (partition by k order by cut) as nxt from c)
  select z.k, z.cut, z.nxt, arg_min(p.i, (p.e - p.s) * 1000000 - p.s * 10 + p.i) as owner from z left join p on p.k = z.k and p.s <= z.cut and p.e >= z.nxt where nxt is not null group by 1, 2, 3""")
def jn7_tightest_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every elementary slice of a key's spans with the narrowest span that covers it, the later start on a tie; null where none does. A key's spans are few: an equi join on it, then the range."""
    spans = shipped(spark, sf_dir).distinct()
    cuts = spans.select("k", F.explode(F.array("s", "e")).alias("cut")).distinct()
    slices = cuts.withColumn("nxt", F.lead("cut").over(Window.partitionBy("k").orderBy("cut"))).where("nxt is not null")
    covering = slices.join(spans, "k").withColumn("covers", F.expr("s <= cut and e >= nxt"))
    owner = F.min(F.when(F.col("covers"), F.struct((F.col("e") - F.col("s")).alias("width"), (-F.col("s")).alias("late"), "i")))
    return covering.groupBy("k", "cut", "nxt").agg(owner.alias("o")).select("k", "cut", "nxt", F.col("o.i").alias("owner"))


@query("jn12_d19_overlap", f"""with a as (select * from {_SHIPPED} where i = 1), b as (select * from {_SHIPPED} where i > 1) select a.k, a.s, a.e, cast(coalesce(sum(case when b.k is not null then greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) end), 0) as bigint) as shared,
  coalesce(sum(case when b.k is not null then greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) end), 0) >= 0.85 * (a.e - a.s) as agrees from (select k, min(s) as s, max(e) as e from a group by 1) a left join b on a.k = b.k group by 1, 2, 3""")
def jn12_d19_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a key's span others overlap, and whether that is enough to agree."""
    spans = shipped(spark, sf_dir)
    own = spans.where("i = 1").groupBy("k").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    others = spans.where("i > 1").select("k", F.col("s").alias("s2"), F.col("e").alias("e2"))
    inside = F.greatest(F.lit(0), F.least("e", "e2") - F.greatest("s", "s2"))
    both = own.join(others, "k", "left").groupBy("k", "s", "e").agg(F.coalesce(F.sum(F.when(F.col("s2").isNotNull(), inside)), F.lit(0)).alias("shared"))
    return both.withColumn("agrees", F.col("shared") >= 0.85 * (F.col("e") - F.col("s")))


@query("jn1_jn3_jn19_guarded", """select state, count(*) as n from (select case when p.page_id is null then 'skipped' when p.lang = d.lang then 'matched' else 'mismatched' end as state from documents d left join (select page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) as lang from pages) p on d.doc_id = p.page_id) group by 1""")
def jn1_jn3_jn19_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records joined on their id and held against a second key: matched, mismatched, and those without a partner."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("page_lang"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(pages, "doc_id", "left")
    state = F.when(F.col("page_lang").isNull(), "skipped").when(F.col("page_lang") == F.col("lang"), "matched").otherwise("mismatched")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("w6_cycles", """with t as (select user_id, hour(ts) // 6 as token, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as i, cast(ts as date) as d from events), p as (
  select a.user_id, a.d, b.i - a.i as period, a.i from t a join t b on a.user_id is not distinct from b.user_id and a.d = b.d and b.i > a.i and a.token = b.token), g as (select user_id, d, period, count(*) as len from (select *, i - row_number() over (partition by user_id, d, period order by i) as g from p) group by user_id, d, period, g),
  r as (select user_id, d, period, max(len) // period + 1 as repeats from g group by 1, 2, 3), b as (select *, row_number() over (partition by user_id, d order by repeats * period desc, period) as r from r where repeats >= 2)
  select u.user_id, cast(u.d as varchar) as day, coalesce(b.period, 0) as period, coalesce(b.repeats, 1) as repeats from (select distinct user_id, d from t) u left join b on u.user_id is not distinct from b.user_id and u.d = b.d and b.r = 1""")
def w6_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest immediately repeated block of each run (a user's day)."""
    steps = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.struct("ts", "event_id", F.floor(F.hour("ts") / 6).alias("token")).alias("s"))
    runs = steps.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["token"]).alias("tokens"))
    return runs.select("user_id", "day", cycle("tokens").alias("c")).select("user_id", "day", "c.period", "c.repeats")


@query("w15_page_run")
def w15_page_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers of a document in order, without those that don't fit: here the line lengths stand for them. Tests hold it against the quadratic form."""
    numbers = lines_of(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", F.length("line").alias("v")))).alias("s"))
    kept = numbers.select("doc_id", page_runs(F.transform("s", lambda s: s["v"].cast("long"))).alias("kept"))
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.get("kept", F.lit(0)).alias("first_page"), F.element_at("kept", -1).alias("last_page"))


@query("w12_w14_rescan", f"""select a.doc_id, min(b.start) as cut_at, coalesce(min(b.start) < a.n - 2000, false) as overshoot from (select doc_id, max(start + length(line)) as n from {_LINES} group by 1) a left join {_LINES} b on a.doc_id = b.doc_id and b.start >= 300 and length(b.line) between 1 and 60 and regexp_matches(b.line, '^[A-Z]') group by a.doc_id, a.n""")
def w12_w14_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest heading-like line past a floor, and whether the span runs far beyond it; one pass by document."""
    eligible = (F.col("start") >= 300) & F.length("line").between(1, 60) & F.col("line").rlike("^[A-Z]")
    by = lines_of(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.max("end").alias("n"), F.min(F.when(eligible, F.col("start"))).alias("cut_at"))
    return by.select("doc_id", "cut_at", F.coalesce(F.col("cut_at") < F.col("n") - 2000, F.lit(False)).alias("overshoot"))


@query("w16_d12_page_furniture", f"""with l as (select doc_id, line_idx, regexp_replace(line, '[0-9]', '', 'g') as norm, length(line) % 7 = 0 as marker, length(line) <= 60 as short from {_LINES})
  select a.doc_id, a.norm, count(distinct m.line_idx) as n_markers from l a join l m on a.doc_id = m.doc_id and m.marker and a.line_idx between m.line_idx - 2 and m.line_idx + 6 where a.short and trim(a.norm) <> '' group by 1, 2 having count(distinct m.line_idx) >= 3""")
def w16_d12_page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines, digits left out, that stand near three page marks or more. Each mark names the nine places round it, so the join is on equal keys."""
    lines = lines_of(table(spark, sf_dir, "documents"))
    short = lines.where((F.length("line") <= 60) & (F.trim(F.regexp_replace("line", "[0-9]", "")) != "")).select("doc_id", "line_idx", F.regexp_replace("line", "[0-9]", "").alias("norm"))
    marks = lines.where(F.length("line") % 7 == 0).select("doc_id", F.col("line_idx").alias("mark"), F.explode(F.sequence(F.col("line_idx") - 2, F.col("line_idx") + 6)).alias("line_idx"))
    return short.join(marks, ["doc_id", "line_idx"]).groupBy("doc_id", "norm").agg(F.count_distinct("mark").alias("n_markers")).where("n_markers >= 3")


@query("d4_d5_tail", """select doc_id, least(coalesce(nullif(instr(substring(text, 1001), ' und '), 0) + 999, n_chars), coalesce(nullif(instr(substring(text, 21), chr(10) || 'The '), 0) + 19, n_chars)) as cut, n_chars >= 2000 as applies from documents""")
def d4_d5_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a last section really ends: the earlier of a hard break past 20 and a soft one past 1000 characters, else the text's end."""

    def past(mark: str, floor: int) -> Column:
        at = F.instr(F.substr("text", F.lit(floor + 1)), mark)
        return F.when(at > 0, at + floor - 1).otherwise(F.col("n_chars"))

    return table(spark, sf_dir, "documents").select("doc_id", F.least(past(" und ", 1000), past("\nThe ", 20)).alias("cut"), (F.col("n_chars") >= 2000).alias("applies"))


@query("d21_frozen_gold", """select d.doc_id, case when l.doc_id is null then 'excluded' when toxic = 1 then 'null' when quality = 1 then 'present' else 'review' end as state, case when quality = 1 and toxic = 0 then sha256(text) end as text_sha256 from documents d left join labels l on d.doc_id = l.doc_id""")
def d21_frozen_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold frozen from a record: what is present carries its hash."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    state = F.when(F.col("toxic").isNull(), "excluded").when(F.col("toxic") == 1, "null").when(F.col("quality") == 1, "present").otherwise("review")
    return joined.select("doc_id", state.alias("state"), F.when(state == "present", F.sha2("text", 256)).alias("text_sha256"))


_FILES = "(select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, html, url from pages)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), "html", "url")


@query("t1_t2_main_file", f"""select host, page_id, score from (select *, row_number() over (partition by host order by score desc, page_id) as r from (select host, page_id, 2 * cast(length(html) = max(length(html)) over (partition by host) as int) + cast(contains(html, '<table') as int) + cast(length(html) > 1500 as int) - cast(contains(url, '?') as int) as score from {_FILES})) where r = 1 and score > 0""")
def t1_t2_main_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best file of each package by rules; packages whose best has no points have none. Files are sized before the shuffle, so no page moves."""
    rated = files(spark, sf_dir).select("host", "page_id", F.length("html").alias("size"), (F.contains("html", F.lit("<table")).cast("int") + (F.length("html") > 1500).cast("int") - F.contains("url", F.lit("?")).cast("int")).alias("base"))
    largest = (F.col("size") == F.max("size").over(Window.partitionBy("host"))).cast("int")
    scored = rated.select("host", "page_id", (2 * largest + F.col("base")).alias("score"))
    return scored.groupBy("host").agg(F.max(F.struct("score", (-F.col("page_id")).alias("first"))).alias("b")).select("host", (-F.col("b.first")).alias("page_id"), "b.score").where("score > 0")


@query("t4_fallback_year", """select o_custkey, arg_max(o_orderkey, (case when year(o_orderdate) = 1997 then 1 else 0 end) * 1e15 + (case when o_orderstatus <> 'P' then 1 else 0 end) * 1e13 + epoch(o_orderdate) * 1e2 - o_orderkey / 1e9) as picked from orders group by 1""")
def t4_fallback_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of the year asked for, else of any; originals before amendments, then the newest, then the first. A record without a date or key is none, one without a status an amendment."""
    original = F.coalesce(F.col("o_orderstatus") != "P", F.lit(False))
    rank = F.when(F.col("o_orderdate").isNotNull() & F.col("o_orderkey").isNotNull(), F.struct(F.year("o_orderdate") == 1997, original, "o_orderdate", -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rank).alias("picked"))


@query("t6_t7_excerpts", f"""with l as (select doc_id, line, min(line_idx) as first from {_LINES} where contains(line, ' of ') or contains(line, ' de ') group by 1, 2), r as (select *, row_number() over (partition by doc_id order by length(line), first) as r from l)
  select d.doc_id, left(text, 200) || coalesce(max(e.lines), '') as excerpt from documents d left join (select doc_id, chr(10) || string_agg(line, chr(10) order by r) as lines from r where r <= 6 group by 1) e on d.doc_id = e.doc_id group by 1, text""")
def t6_t7_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a text and its six shortest different lines that bear on the question."""
    docs = table(spark, sf_dir, "documents")
    lines = lines_of(docs).where(F.contains("line", F.lit(" of ")) | F.contains("line", F.lit(" de "))).groupBy("doc_id", "line").agg(F.min("line_idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("line"), "first"))
    top = lines.withColumn("r", rank).where("r <= 6").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("s"))
    joined = docs.select("doc_id", F.left("text", F.lit(200)).alias("head")).join(top, "doc_id", "left")
    tail = F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("s", lambda s: s["line"]), "\n")), F.lit(""))
    return joined.select("doc_id", F.concat("head", tail).alias("excerpt"))


@query("t11_x25_capped_sample", f"""select lang, page_id from (select lang, page_id, row_number() over (partition by lang order by page_id) as b from (select *, row_number() over (partition by host order by page_id) as a from (select *, regexp_extract(html, 'lang="([a-z]+)"', 1) as lang from {_FILES})) where a <= 3) where b <= 20""")
def t11_x25_capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified sample, three of a domain and twenty of a level at most: the caps are the feature."""
    pages = files(spark, sf_dir).select("page_id", "host", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))
    place = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("page_id"))
    few = pages.withColumn("a", place("host")).where("a <= 3")
    return few.withColumn("b", place("lang")).where("b <= 20").select("lang", "page_id")


@query("x42_replicas", """select item_id || '-' || cast(i as varchar) as task_id from benchmark, (select unnest(range(3)) as i)""")
def x42_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task three times under ids of its own."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select(F.concat_ws("-", "item_id", "i").alias("task_id"))


@query("x14_x28_evidence", f"""with s as (select doc_id, line, line_idx from {_LINES} where length(line) >= 10) select doc_id, min(line_idx) as winner, count(*) as n_found from (select doc_id, line, line_idx, min(line_idx) over (partition by doc_id, line) as w, count(*) over (partition by doc_id, line) as n from s) where n > 1 group by doc_id, line having count(*) > 1""")
def x14_x28_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every repeated candidate the one that stands, with how often it occurs."""
    rows = lines_of(table(spark, sf_dir, "documents")).where(F.length("line") >= 10)
    return rows.groupBy("doc_id", "line").agg(F.min("line_idx").alias("winner"), F.count(F.lit(1)).alias("n_found")).where("n_found > 1").drop("line")


@query("s9_columns", """select o_custkey, unnest(keys) as o_orderkey, unnest(states) as state from (select o_custkey, list(o_orderkey order by o_orderkey) as keys, list(o_orderstatus order by o_orderkey) as states from orders group by 1)""")
def s9_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept as one array a column, turned back into rows."""
    kept = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("rows"))
    columns = kept.select("o_custkey", F.col("rows.o_orderkey").alias("keys"), F.col("rows.o_orderstatus").alias("states"))
    return columns.select("o_custkey", F.inline(F.arrays_zip("keys", "states"))).select("o_custkey", F.col("keys").alias("o_orderkey"), F.col("states").alias("state"))
