"""Equi, interval, as-of and collision joins over spans and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.lines import _LINES, lines_of
from spanforge.plans.registry import query
from spanforge.sources.tables import table


@query("jn2_missing", """select l.doc_id, case when b.item_id is null then 'absent' else 'present' end as state from labels l left join benchmark b on l.doc_id = b.item_id""")
def jn2_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold against records; a record that isn't there is an outcome."""
    gold, records = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("present").alias("state"))
    return gold.join(records, "doc_id", "left").select("doc_id", F.coalesce("state", F.lit("absent")).alias("state"))


@query("jn16_resume", "select count(*) as n_left, cast(sum(doc_id) as bigint) as sum_ids from documents where doc_id not in (select doc_id from labels)")
def jn16_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that is not done yet."""
    left = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("n_left"), F.sum("doc_id").alias("sum_ids"))


@query("jn21_collisions", f"""select doc_id, line_idx from (select doc_id, line_idx, count(*) over (partition by doc_id, line) as n from {_LINES} where length(line) >= 20) where n >= 2""")
def jn21_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one document that share the same content."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "line"))
    return lines_of(table(spark, sf_dir, "documents")).where(F.length("line") >= 20).withColumn("n", n).where("n >= 2").select("doc_id", "line_idx")


@query("jn8_point_in_span", f"""select p.doc_id, p.o as offset_at, l.line_idx from (select doc_id, unnest([0, 100, 500, 1000]) as o from documents) p
  join {_LINES} l on l.doc_id = p.doc_id and l.start <= p.o and p.o < l.start + length(l.line) + 1""")
def jn8_point_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds an offset: equi join on the document, range inside it."""
    docs = table(spark, sf_dir, "documents")
    points = docs.select("doc_id", F.explode(F.array(*map(F.lit, (0, 100, 500, 1000)))).alias("offset_at"))
    inside = (F.col("start") <= F.col("offset_at")) & (F.col("offset_at") < F.col("end") + 1)
    return points.join(lines_of(docs), "doc_id").where(inside).select("doc_id", "offset_at", "line_idx")


@query("jn9_next_start", """select event_id, min(n) as next_ts from (select e.event_id, f.ts as n from events e left join (select distinct user_id, ts from events) f on f.user_id = e.user_id and f.ts > e.ts) group by 1""")
def jn9_next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next strictly later distinct start."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    starts = events.select("user_id", "ts").distinct().withColumn("next_ts", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")))
    return events.join(starts, ["user_id", "ts"]).select("event_id", "next_ts")


@query("jn10_asof_backward", """select p.event_id, max(v.ts) as view_ts from (select * from events where event_type = 'purchase') p
  left join (select * from events where event_type = 'view') v on v.user_id = p.user_id and v.ts <= p.ts and v.ts >= p.ts - interval 1 day group by 1""")
def jn10_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest marker at or before, within a bound: one pass over the union, no range join."""
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("view_ts", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(upto)).where("event_type = 'purchase'")
    return seen.select("event_id", F.when(F.col("view_ts") >= F.col("ts") - F.expr("interval 1 day"), F.col("view_ts")).alias("view_ts"))


@query("jn11_band", f"""select a.doc_id, a.line_idx, count(b.line_idx) as n_near from {_LINES} a left join {_LINES} b on a.doc_id = b.doc_id and b.start <> a.start and abs(b.start - a.start) <= 300
  group by 1, 2""")
def jn11_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other starts lie within a distance; rows at the same start don't count."""
    by = Window.partitionBy("doc_id").orderBy("start")
    near, same = F.count(F.lit(1)).over(by.rangeBetween(-300, 300)), F.count(F.lit(1)).over(Window.partitionBy("doc_id", "start"))
    return lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line_idx", (near - same).alias("n_near"))


@query("jn14_self", """select a.o_orderkey, a.o_orderstatus as status, b.o_orderstatus as other from orders a join orders b on a.o_custkey = b.o_custkey and b.o_orderkey = a.o_orderkey + 1 where a.o_orderstatus <> b.o_orderstatus""")
def jn14_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of runs on one task whose status differs."""
    o = table(spark, sf_dir, "orders")
    other = o.select("o_custkey", (F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("other"))
    return o.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status")).join(other, ["o_custkey", "o_orderkey"]).where("status <> other").select("o_orderkey", "status", "other")
