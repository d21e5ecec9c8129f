"""Ranked choices, censuses and agreement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.lines import _LINES, lines_of
from spanforge.plans.registry import query
from spanforge.sources.tables import table


@query("w2_ambiguity", """select o_custkey, max(o_totalprice) filter (r = 2) / max(o_totalprice) filter (r = 1) >= 0.85 as ambiguous from (
  select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) group by 1 having count(*) >= 2""")
def w2_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the runner-up comes close to the winner; a lone candidate has no runner-up and isn't listed."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    two = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", rank.alias("r")).where("r <= 2")
    return two.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.min("o_totalprice") / F.max("o_totalprice") >= 0.85).alias("ambiguous")).where("n = 2").drop("n")


@query("t5_top", """select p_brand, p_partkey, r as "rank" from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) where r <= 6""")
def t5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best of each group; a group limit before the shuffle keeps six a task."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", rank.cast("long").alias("rank")).where("rank <= 6")


@query("a10_two_means", """select event_type, round(avg(value) filter (value >= 20), 6) as mean_found, round(sum(case when value >= 20 then value else 0 end) / count(*), 6) as mean_all from events group by 1""")
def a10_two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over what was found, and one in which what wasn't counts as 0."""
    found = F.when(F.col("value") >= 20, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(found), 6).alias("mean_found"), F.round(F.sum(F.coalesce(found, F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mean_all"))


@query("a41_agreement", """select user_id, count(*) filter (a = 'pass' and b = 'pass') as both_pass, count(*) filter (a = 'fail' and b = 'fail') as both_fail, count(*) filter (a <> 'unknown' and b <> 'unknown') as decided,
  round(count(*) filter (a = b and a <> 'unknown') / nullif(count(*) filter (a <> 'unknown' and b <> 'unknown'), 0), 6) as agreement from (
  select user_id, case when value >= 50 then 'pass' when value >= 20 then 'unknown' else 'fail' end as a, case event_id % 3 when 0 then 'pass' when 1 then 'fail' else 'unknown' end as b from events) group by 1""")
def a41_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges side by side; only pairs in which both decided count for agreement."""
    a = F.when(F.col("value") >= 50, "pass").when(F.col("value") >= 20, "unknown").otherwise("fail")
    b = F.when(F.col("event_id") % 3 == 0, "pass").when(F.col("event_id") % 3 == 1, "fail").otherwise("unknown")
    both = table(spark, sf_dir, "events").select("user_id", a.alias("a"), b.alias("b"))
    counts = both.groupBy("user_id").agg(
        F.count_if(F.expr("a = 'pass' and b = 'pass'")).alias("both_pass"), F.count_if(F.expr("a = 'fail' and b = 'fail'")).alias("both_fail"),
        F.count_if(F.expr("a <> 'unknown' and b <> 'unknown'")).alias("decided"),
    )
    return counts.withColumn("agreement", F.round(F.try_divide(F.col("both_pass") + F.col("both_fail"), "decided"), 6))


@query("a47_census", """select cast(year(o_orderdate) as bigint) as year, o_orderstatus, o_orderpriority like '1-%' as urgent, count(*) as n from orders group by 1, 2, 3""")
def a47_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by year and family, a marked kind apart."""
    keys = F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus", F.col("o_orderpriority").startswith("1-").alias("urgent")
    return table(spark, sf_dir, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("jn17_semi", """select l_returnflag, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority like '1-%') group by 1""")
def jn17_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose record is wanted."""
    wanted = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1-")).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("u5_distinct_spans", f"""select doc_id, count(*) as n_spans, cast(sum(length(line)) as bigint) as n_chars from (select distinct doc_id, line from {_LINES}) group by 1""")
def u5_distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes over the different spans of a document."""
    each = lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line").distinct()
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.length("line")).alias("n_chars"))
