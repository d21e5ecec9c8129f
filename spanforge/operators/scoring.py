"""Scores against gold, corrected rates, differences of records, and ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.lines import _LINES, lines_of
from spanforge.plans.registry import query
from spanforge.sources.tables import table


def corrected_rate(observed: Column, sensitivity: float, specificity: float) -> Column:
    """The true rate behind an observed one, for a judge of known quality; null where that judge tells nothing."""
    gain = sensitivity + specificity - 1
    if abs(gain) < 1e-9:
        return F.lit(None).cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (observed + (specificity - 1)) / gain))


@query("m4_corrected_rate", """select source, round(least(1.0, greatest(0.0, (avg(toxic) + (0.95 - 1)) / (0.9 + 0.95 - 1))), 6) as rate from documents join labels using (doc_id) group by 1""")
def m4_corrected_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").groupBy("source").agg(F.round(corrected_rate(F.avg("toxic"), 0.9, 0.95), 6).alias("rate"))


@query("m6_m7_durations", """select l_orderkey, l_linenumber, l_partkey, cast(coalesce(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)), 0) as bigint) as days,
  coalesce(o_totalprice <= 0 or l_extendedprice / o_totalprice <= 1.25, true) as in_bound from lineitem left join orders on o_orderkey = l_orderkey""")
def m6_m7_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between two dates, 0 where one is missing, and whether a part stays within 1.25 of its whole; no whole is within."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_totalprice")
    bound = F.coalesce((F.col("o_totalprice") <= 0) | (F.col("l_extendedprice") / F.nullif(F.col("o_totalprice"), F.lit(0.0)) <= 1.25), F.lit(True))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey", "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.datediff("l_shipdate", "o_orderdate"), F.lit(0)).cast("long").alias("days"), bound.alias("in_bound")
    )


@query("j2_u3_diff", """with y as (select o_custkey as k, o_orderpriority as p, year(o_orderdate) as y, count(*) as n from orders where year(o_orderdate) in (1995, 1996) group by 1, 2, 3)
  select coalesce(a.k, b.k) as custkey, coalesce(a.p, b.p) as priority, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change
  from (from y where y = 1995) a full join (from y where y = 1996) b on a.k = b.k and a.p = b.p where a.n is distinct from b.n""")
def j2_u3_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys added, removed and changed between two years: one grouping holds both sides, so nothing is joined."""
    year = F.year("o_orderdate")
    both = table(spark, sf_dir, "orders").where(year.isin(1995, 1996)).groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"))
    counts = both.agg(F.count_if(year == 1995).alias("a"), F.count_if(year == 1996).alias("b")).where("a <> b")
    return counts.select("custkey", "priority", F.when(F.col("a") == 0, "added").when(F.col("b") == 0, "removed").otherwise("changed").alias("change"))


@query("p10_baseline", """select distinct user_id, event_type from events e where value >= 50 and not exists (
  select 1 from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as r from events) b where b.user_id = e.user_id and b.event_type = e.event_type and r <= 2)""")
def p10_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that come true, without those that held at the start."""
    events = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    start = events.select("user_id", "event_type", step.alias("r")).where("r <= 2")
    return events.where("value >= 50").select("user_id", "event_type").distinct().join(start, ["user_id", "event_type"], "left_anti")


@query("jn4_fallback", """select c_custkey, case when n0 = 1 or (n0 = 0 and n1 = 1) then 'matched' when n0 + n1 = 0 then 'not_found' else 'ambiguous' end as outcome, case when n0 > 0 then 'report' when n1 > 0 then 'filing' end as basis
  from (select c_custkey, count(o_orderkey) filter (year(o_orderdate) = 1992 + c_custkey % 6) as n0, count(o_orderkey) filter (year(o_orderdate) = 1993 + c_custkey % 6) as n1 from customer left join orders on o_custkey = c_custkey group by 1)""")
def jn4_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match on the wanted year, else on the one after it; more than one match at the better basis is ambiguous."""
    wanted = F.lit(1992) + F.col("c_custkey") % 6
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    near = table(spark, sf_dir, "customer").select("c_custkey", wanted.alias("wanted")).join(orders, "c_custkey", "left")
    held = lambda lag: F.coalesce(F.sum(F.when(F.col("year") == F.col("wanted") + lag, F.col("n"))), F.lit(0))
    n0, n1 = F.col("n0"), F.col("n1")
    outcome = F.when((n0 == 1) | ((n0 == 0) & (n1 == 1)), "matched").when(n0 + n1 == 0, "not_found").otherwise("ambiguous")
    return near.groupBy("c_custkey").agg(held(0).alias("n0"), held(1).alias("n1")).select("c_custkey", outcome.alias("outcome"), F.when(n0 > 0, "report").when(n1 > 0, "filing").alias("basis"))


@query("jn13_t9_current_fact", """select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end, value desc, event_id) as r from events) where r = 1""")
def jn13_t9_current_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind by priority, and its largest value: one aggregation, no sort."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(rank, -F.col("value"), "event_id")).alias("event_id"))


@query("a6_a7_filing_score", """with s as (select l_orderkey as k, l_linenumber as i, min(l_quantity) as a, max(l_quantity) + 5 as b from lineitem group by 1, 2),
  o as (select g.k, case when p.k is null then 'absent' when least(p.b, g.b + 4) > greatest(p.a, g.a + 4) then 'overlap' else 'disjoint' end as outcome,
  case when p.k is not null and least(p.b, g.b + 4) > greatest(p.a, g.a + 4) then 2 * (least(p.b, g.b + 4) - greatest(p.a, g.a + 4)) / ((p.b - p.a) + (g.b - g.a)) else 0.0 end as f1
  from s g left join (from s where i % 3 <> 0) p on p.k = g.k and p.i = g.i)
  select k as l_orderkey, count(*) as n_gold, count(*) filter (outcome = 'absent') as n_absent, count(*) filter (outcome = 'overlap') as n_overlap, round(avg(f1), 6) as macro_f1 from o group by 1""")
def a6_a7_filing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes and macro F1 of predicted spans against gold; an absent prediction scores 0 and stays in the mean."""
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("a"), (F.max("l_quantity") + 5).alias("b"))
    gold = spans.select("l_orderkey", "l_linenumber", (F.col("a") + 4).alias("ga"), (F.col("b") + 4).alias("gb"))
    both = gold.join(spans.where("l_linenumber % 3 <> 0"), ["l_orderkey", "l_linenumber"], "left")
    inter = F.coalesce(F.greatest(F.least("b", "gb") - F.greatest("a", "ga"), F.lit(0.0)), F.lit(0.0))
    inter = F.when(F.col("a").isNull(), 0.0).otherwise(inter)
    f1 = F.when(inter > 0, 2 * inter / ((F.col("b") - F.col("a")) + (F.col("gb") - F.col("ga")))).otherwise(0.0)
    return both.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_gold"), F.count_if(F.col("a").isNull()).alias("n_absent"), F.count_if(inter > 0).alias("n_overlap"), F.round(F.avg(f1), 6).alias("macro_f1")
    )


@query("a2_gate_then_average", """select user_id, case when n_crit > 0 and bad_crit > 0 then 'no' when n = 0 then 'abstain' when m >= 0.5 and n_abstain = 0 then 'yes' else 'no' end as verdict, round(m, 6) as mean_score from (
  select user_id, count(*) filter (event_type = 'purchase') as n_crit, count(*) filter (event_type = 'purchase' and value < 5) as bad_crit, count(*) filter (event_type = 'error') as n_abstain,
  count(*) filter (event_type <> 'error') as n, avg(least(value / 100, 1.0)) filter (event_type <> 'error') as m from events group by 1)""")
def a2_gate_then_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed critical judge decides; else the mean of the others, which an abstention leaves out but which then can't say yes."""
    kind, score = F.col("event_type"), F.least(F.col("value") / 100, F.lit(1.0))
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if((kind == "purchase") & (F.col("value") < 5)).alias("bad"), F.count_if(kind == "error").alias("abstain"),
        F.count_if(kind != "error").alias("n"), F.avg(F.when(kind != "error", score)).alias("m"),
    )
    verdict = F.when(F.col("bad") > 0, "no").when(F.col("n") == 0, "abstain").when((F.col("m") >= 0.5) & (F.col("abstain") == 0), "yes").otherwise("no")
    return by.select("user_id", verdict.alias("verdict"), F.round("m", 6).alias("mean_score"))


@query("a24_coverage", f"""select doc_id, round(case when sum(length(line)) = 0 then 1.0 else sum(case when length(line) >= 60 then length(line) else 0 end) / sum(length(line)) end, 6) as coverage from {_LINES} group by 1""")
def a24_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of characters that some span owns; an empty document is covered."""
    n, owned = F.sum(F.length("line")), F.sum(F.when(F.length("line") >= 60, F.length("line")).otherwise(0))
    return lines_of(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.round(F.when(n == 0, 1.0).otherwise(owned / n), 6).alias("coverage"))


@query("w8_observation_diff", """select event_id, case when p is null then 'first' when p.t <> event_type then 'moved' when value > p.v then 'more' when value < p.v then 'less' else 'same' end as change
  from (select event_id, event_type, value, lag({'t': event_type, 'v': value}) over (partition by user_id order by ts, event_id) as p from events)""")
def w8_observation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each observation differs from the one before; another kind makes any finer difference moot."""
    last = F.lag(F.struct("event_type", "value")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = table(spark, sf_dir, "events").select("event_id", "event_type", "value", last.alias("p"))
    change = F.when(F.col("p").isNull(), "first").when(F.col("p.event_type") != F.col("event_type"), "moved").when(F.col("value") > F.col("p.value"), "more").when(F.col("value") < F.col("p.value"), "less")
    return p.select("event_id", change.otherwise("same").alias("change"))


@query("w11_trailing_trim", f"""select doc_id, max(start + length(line)) as body_end from {_LINES} where length(trim(line)) >= 20 group by 1""")
def w11_trailing_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a text ends once short and blank lines at its end are cut off: the end of its last full line, by one aggregation."""
    full = lines_of(table(spark, sf_dir, "documents")).where(F.length(F.trim("line")) >= 20)
    return full.groupBy("doc_id").agg(F.max("end").alias("body_end"))


@query("w13_contained", f"""select a.doc_id, a.line_idx, min(b.start) as later from (select doc_id, line_idx, start from {_LINES} where length(line) between 1 and 60) a
  join (select doc_id, start from {_LINES} where length(line) between 1 and 60) b on a.doc_id = b.doc_id and b.start >= a.start + 300 and b.start < a.start + 2000 group by 1, 2""")
def w13_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest heading 300 to 2000 characters after each one that has any: a range frame in place of a range join."""
    heads = lines_of(table(spark, sf_dir, "documents")).where(F.length("line").between(1, 60))
    return heads.select("doc_id", "line_idx", F.min("start").over(Window.partitionBy("doc_id").orderBy("start").rangeBetween(300, 1999)).alias("later")).where("later is not null")


@query("w17_densest_window", """select user_id, max(n) as densest from (select a.user_id, a.event_id, count(distinct b.event_type) as n from events a join events b on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 6 hour group by 1, 2) group by 1""")
def w17_densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most different kinds in any six hours: the frame keeps a set of kinds, never the rows."""
    kinds = F.expr("collect_set(event_type) over (partition by user_id order by ts range between current row and interval 6 hours following)")
    seen = table(spark, sf_dir, "events").select("user_id", F.size(kinds).cast("long").alias("n"))
    return seen.groupBy("user_id").agg(F.max("n").alias("densest"))


@query("w20_coalesce", """select user_id, event_type, min(step) as first_step, max(step) as last_step from (select *, step - row_number() over (partition by user_id, event_type order by step) as g from (
  select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as step from events)) group by user_id, event_type, g""")
def w20_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent blocks of one owner as one block."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.lag("event_type").over(by)
    steps = table(spark, sf_dir, "events").withColumn("step", F.row_number().over(by).cast("long")).withColumn("new", (own.isNull() | (own != F.col("event_type"))).cast("int"))
    blocks = steps.withColumn("block", F.sum("new").over(by)).groupBy("user_id", "block", "event_type")
    return blocks.agg(F.min("step").alias("first_step"), F.max("step").alias("last_step")).drop("block")


@query("t10_even_spread", """select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as r, count(*) over (partition by o_custkey) as n from orders)
  where n <= 3 or r in (0, n // 3, 2 * n // 3)""")
def t10_even_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders of each customer, spread evenly over its dates; the report is what the limit is for."""
    by = Window.partitionBy("o_custkey")
    ranked = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", (F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")) - 1).alias("r"), F.count(F.lit(1)).over(by).alias("n")
    )
    return ranked.where("n <= 3 or r in (0, n div 3, (2 * n) div 3)").select("o_custkey", "o_orderkey")
