"""Order-dependent operators: runs, islands, merged intervals, ladders, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.lines import _LINES, lines_of
from spanforge.plans.registry import query
from spanforge.sources.tables import table


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("w5_longest_run", """select user_id, max(n) as longest from (select user_id, g, event_type, count(*) as n from (
  select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as g from events) group by 1, 2, 3) group by 1""")
def w5_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of equal neighbours: a running sum of changes names the runs."""
    changed = table(spark, sf_dir, "events").withColumn("new", (F.coalesce(F.lag("event_type").over(_by_user()), F.lit("")) != F.col("event_type")).cast("int"))
    runs = changed.withColumn("run", F.sum("new").over(_by_user())).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


@query("w7_repetition", """select user_id, round(1 - count(distinct event_type) / count(*), 9) as repetition from events group by 1""")
def w7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(1 - F.count_distinct("event_type") / F.count(F.lit(1)), 9).alias("repetition"))


@query("w9_frozen", """select event_id from (select event_id, count(*) over w as n, max(event_type) over w as a, min(event_type) over w as b from events
  window w as (partition by user_id order by ts, event_id rows between 2 preceding and current row)) where n = 3 and a = b""")
def w9_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps after which the last three are all the same; a frame that isn't full doesn't count."""
    w = _by_user().rowsBetween(-2, 0)
    seen = table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.max("event_type").over(w).alias("a"), F.min("event_type").over(w).alias("b"))
    return seen.where("n = 3 and a = b").select("event_id")


@query("w21_gaps", f"""select doc_id, line_idx, gap from (select doc_id, line_idx, start - lag(start + length(line)) over (partition by doc_id order by line_idx) as gap
  from {_LINES} where length(line) >= 60) where gap >= 120""")
def w21_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of at least 120 characters between the spans that are owned."""
    owned = lines_of(table(spark, sf_dir, "documents")).where(F.length("line") >= 60)
    gap = F.col("start") - F.lag("end").over(Window.partitionBy("doc_id").orderBy("line_idx"))
    return owned.withColumn("gap", gap).where("gap >= 120").select("doc_id", "line_idx", "gap")


def merged(intervals: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping or touching intervals: a new island begins where a start lies beyond every earlier end."""
    by = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    named = intervals.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int")).withColumn("_island", F.sum("_new").over(by))
    return named.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


@query("w22_merge", """select user_id, s as "start", e as "end" from (select user_id, g, min(s) as s, max(e) as e from (select *, sum(n) over (partition by user_id order by s, e, event_id) as g from (
  select *, case when s <= max(e) over (partition by user_id order by s, e, event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from (
  select event_id, user_id, event_id % 997 as s, event_id % 997 + cast(floor(value) as bigint) as e from events where value >= 0))) group by 1, 2)""")
def w22_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("event_id") % 997
    spans = table(spark, sf_dir, "events").where("value >= 0").select("user_id", start.alias("start"), (start + F.floor("value")).alias("end"))
    return merged(spans, "user_id")


@query("w24_monotone", """select user_id, coalesce(bool_and(value <= p), true) as monotone from (select user_id, value, lag(value) over (partition by user_id order by ts, event_id) as p from events) group by 1""")
def w24_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a curve never rises."""
    steps = table(spark, sf_dir, "events").select("user_id", "value", F.lag("value").over(_by_user()).alias("p"))
    return steps.groupBy("user_id").agg(F.coalesce(F.bool_and(F.col("value") <= F.col("p")), F.lit(True)).alias("monotone"))


@query("a25_tiling", f"""select doc_id, bool_and(p is null or p + 1 = start) and min(start) = 0 as tiled from (select doc_id, start, lag(start + length(line)) over (partition by doc_id order by line_idx) as p from {_LINES}) group by 1""")
def a25_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the spans of a document tile it."""
    last = F.lag("end").over(Window.partitionBy("doc_id").orderBy("line_idx"))
    return lines_of(table(spark, sf_dir, "documents")).withColumn("p", last).groupBy("doc_id").agg((F.bool_and(F.col("p").isNull() | (F.col("p") + 1 == F.col("start"))) & (F.min("start") == 0)).alias("tiled"))


@query("t3_newest", """select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1""")
def t3_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each key, by one aggregation and no sort."""
    best = F.max_by(F.struct("o_orderkey"), F.struct("o_orderdate", -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey")


@query("span_segments", f"""select doc_id, line_idx, start as seg_start, coalesce(lead(start) over (partition by doc_id order by line_idx), n) as seg_end from (
  select l.doc_id, line_idx, start, max(start + length(line)) over (partition by l.doc_id) as n, line from {_LINES} l) where length(line) between 1 and 60""")
def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that run from one heading-like line to the next, the last one to the document's end."""
    lines = lines_of(table(spark, sf_dir, "documents")).withColumn("n", F.max("end").over(Window.partitionBy("doc_id")))
    heads = lines.where(F.length("line").between(1, 60))
    following = F.lead("start").over(Window.partitionBy("doc_id").orderBy("line_idx"))
    return heads.select("doc_id", "line_idx", F.col("start").alias("seg_start"), F.coalesce(following, "n").alias("seg_end"))
