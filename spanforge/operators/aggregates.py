"""Verdict folds, votes, calibration, quantile bands, lexicons and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.plans.registry import query
from spanforge.sources.tables import table


def fold_verdict(status: Column) -> Column:
    """No check: unknown; any fail: fail; any unknown: unknown; else pass."""
    return F.when(F.count(status) == 0, "unknown").when(F.max(status == "fail"), "fail").when(F.max(status == "unknown"), "unknown").otherwise("pass")


@query("a1_verdict_fold", """select u.user_id, case when count(s) = 0 then 'unknown' when bool_or(s = 'fail') then 'fail' when bool_or(s = 'unknown') then 'unknown' else 'pass' end as verdict
  from (select distinct user_id from events) u left join (select user_id, case when value < 5 then 'fail' when value < 20 then 'unknown' else 'pass' end as s from events where event_type = 'purchase') e
  on u.user_id = e.user_id group by 1""")
def a1_verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    checks = events.where("event_type = 'purchase'").select("user_id", F.when(F.col("value") < 5, "fail").when(F.col("value") < 20, "unknown").otherwise("pass").alias("s"))
    return events.select("user_id").distinct().join(checks, "user_id", "left").groupBy("user_id").agg(fold_verdict(F.col("s")).alias("verdict"))


@query("a3_vote", """select user_id, event_type, case max(r) when 4 then 'agree' when 3 then 'disagree' when 2 then 'suspect' else 'unavailable' end as verdict, count(*) as n_votes
  from (select user_id, event_type, case when event_id % 7 = 0 then 1 when event_id % 5 = 0 then 2 when event_id % 3 = 0 then 3 else 4 end as r from events) group by 1, 2""")
def a3_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest of several sources' verdicts: agree, disagree, suspect, unavailable."""
    e = F.col("event_id")
    rank = F.when(e % 7 == 0, 1).when(e % 5 == 0, 2).when(e % 3 == 0, 3).otherwise(4)
    best = F.max("r")
    return table(spark, sf_dir, "events").select("user_id", "event_type", rank.alias("r")).groupBy("user_id", "event_type").agg(
        F.when(best == 4, "agree").when(best == 3, "disagree").when(best == 2, "suspect").otherwise("unavailable").alias("verdict"), F.count(F.lit(1)).alias("n_votes")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(confidence, correct): labelled documents with a confidence from their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("c"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.round("c", 2).alias("confidence"), (F.col("quality") == 1).alias("correct"))


_SAMPLES = "(select round(least(n_chars, 4000) / 4000.0, 2) as confidence, quality = 1 as correct from documents join labels using (doc_id))"


@query("a11_auroc", f"""select round(case when p = 0 or n = 0 then null else (s - p * (p + 1) / 2.0) / (p * n) end, 9) as auroc from (
  select sum(case when correct then r end) as s, cast(count(*) filter (correct) as double) as p, cast(count(*) filter (not correct) as double) as n from (
  select correct, rank() over (order by confidence) + (count(*) over (partition by confidence) - 1) / 2.0 as r from {_SAMPLES}))""")
def a11_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve from average ranks; undefined with one class.

    Ranks come from counts by distinct confidence, of which there are few, so nothing but these meets in one task.
    """
    by = samples(spark, sf_dir).groupBy("confidence").agg(F.count_if("correct").alias("p"), F.count_if(~F.col("correct")).alias("n"))
    below = Window.orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)
    won = by.withColumn("less", F.coalesce(F.sum("n").over(below), F.lit(0))).agg(F.sum(F.col("p") * (F.col("less") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))), 9).alias("auroc"))


@query("a12_ece", f"""select b.bin, count(s.bin) as n, round(avg(confidence), 9) as mean_confidence, round(avg(case when correct then 1.0 when not correct then 0.0 end), 9) as accuracy
  from (select unnest(range(10)) as bin) b left join (select least(cast(floor(confidence * 10) as bigint), 9) as bin, confidence, correct from {_SAMPLES}) s on b.bin = s.bin group by 1""")
def a12_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal bins of confidence with their accuracy; 1.0 is in the top bin and empty bins are rows."""
    s = samples(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("confidence") * 10), F.lit(9)))
    by = s.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"))
    return spark.range(10).withColumnRenamed("id", "bin").join(by, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


@query("w4_risk_coverage", f"""select confidence, round(sum(n) over w / sum(n) over (), 9) as coverage, round(sum(bad) over w / sum(n) over w, 9) as risk from (
  select confidence, count(*) as n, count(*) filter (not correct) as bad from {_SAMPLES} group by 1) window w as (order by confidence desc rows unbounded preceding)""")
def w4_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and risk as confidence falls; ties enter together."""
    by = samples(spark, sf_dir).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("bad"))
    w = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return by.select("confidence", F.round(F.sum("n").over(w) / F.sum("n").over(every), 9).alias("coverage"), F.round(F.sum("bad").over(w) / F.sum("n").over(w), 9).alias("risk"))


@query("a18_length_priors", """select source, lang, count(*) as n, round(quantile_cont(n_chars, 0.05), 6) as p05, round(quantile_cont(n_chars, 0.5), 6) as p50,
  round(quantile_cont(n_chars, 0.95), 6) as p95, min(n_chars) as min_seen, max(n_chars) as max_seen from documents group by 1, 2 having count(*) >= 5""")
def a18_length_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear-interpolated quantiles of lengths by group, for groups of at least five."""
    q = lambda p: F.round(F.percentile("n_chars", F.lit(p)), 6)
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.min("n_chars").alias("min_seen"), F.max("n_chars").alias("max_seen")
    ).where("n >= 5")


def size_bands(docs: DataFrame) -> DataFrame:
    median = F.floor(F.percentile("n_chars", F.lit(0.5)))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), median.alias("p50")).where("n >= 5").select("lang", "n", "p50", F.greatest(F.lit(1), F.expr("p50 div 5")).alias("lo"), (F.col("p50") * 8).alias("hi"))


_BANDS = "(select lang, n, p50, greatest(1, p50 // 5) as lo, p50 * 8 as hi from (select lang, count(*) as n, cast(floor(quantile_cont(n_chars, 0.5)) as bigint) as p50 from documents group by 1 having count(*) >= 5))"


@query("a19_size_bands", f"select * from {_BANDS}")
def a19_size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands around the median size: a fifth to eight times."""
    return size_bands(table(spark, sf_dir, "documents"))


@query("a20_in_band", f"select round(coalesce(avg(case when n_chars between lo and hi then 1.0 else 0.0 end), 1.0), 9) as in_band from documents join {_BANDS} using (lang)")
def a20_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sizes within their band; without any it is 1."""
    docs = table(spark, sf_dir, "documents")
    joined = docs.select("lang", "n_chars").join(size_bands(docs), "lang")
    return joined.agg(F.round(F.coalesce(F.avg(F.col("n_chars").between(F.col("lo"), F.col("hi")).cast("double")), F.lit(1.0)), 9).alias("in_band"))


@query("a21_lexicon", """with tok as (select distinct lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as token from documents),
  d as (select lang, count(*) as nd from documents group by 1), t as (select lang, token, count(*) as df from tok group by 1, 2), a as (select token, sum(df) as all_df from t group by 1),
  s as (select lang, token, ln((df + 0.5) / (nd - df + 0.5)) - ln((all_df - df + 0.5) / ((select count(*) from documents) - nd - (all_df - df) + 0.5)) as w, df, nd, all_df from t join d using (lang) join a using (token))
  select lang, token, round(w, 6) as weight, row_number() over (partition by lang order by round(w, 6) desc, token desc) as rank from s
  where all_df < 0.5 * (select count(*) from documents) and df >= 0.4 * nd and w > 0 qualify rank <= 40""")
def a21_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that set a group apart: common in it, not common overall, by smoothed log-odds; forty a group."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))).alias("token"))
    t = tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"))
    overall = t.groupBy("token").agg(F.sum("df").alias("all_df"))
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("nd")).withColumn("n_all", F.sum("nd").over(Window.partitionBy(F.lit(1))))  # a row a language
    n = F.col("n_all")
    df, nd, other = F.col("df"), F.col("nd"), F.col("all_df") - F.col("df")
    w = F.log((df + 0.5) / (nd - df + 0.5)) - F.log((other + 0.5) / (n - nd - other + 0.5))
    good = t.join(sizes, "lang").where(df >= 0.4 * nd).join(overall, "token").where(F.col("all_df") < 0.5 * n).withColumn("w", w).where("w > 0").withColumn("weight", F.round("w", 6))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), F.desc("token")))
    return good.withColumn("rank", rank.cast("long")).where("rank <= 40").select("lang", "token", "weight", "rank")


@query("a26_pass_at_k", """select cast(count(*) as bigint) as n_tasks, round(avg(p), 9) as pass_1, round(avg(m), 9) as pass_k, round(avg(case when d = 1 then 1.0 else 0.0 end), 9) as consistency from (
  select user_id, event_type, avg(case when value >= 30 then 1.0 else 0.0 end) as p, max(case when value >= 30 then 1.0 else 0.0 end) as m, count(distinct value >= 30) as d from events group by 1, 2)""")
def a26_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates over repeated attempts at a task."""
    ok = (F.col("value") >= 30).cast("double")
    by = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(ok).alias("p"), F.max(ok).alias("m"), F.count_distinct(ok).alias("d"))
    return by.agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("p"), 9).alias("pass_1"), F.round(F.avg("m"), 9).alias("pass_k"), F.round(F.avg((F.col("d") == 1).cast("double")), 9).alias("consistency"))


@query("a29_cost_per_outcome", """select event_type, round(sum(value), 4) as cost, cast(count(*) filter (value >= 200) as bigint) as n_success,
  round(case when count(*) filter (value >= 200) = 0 then null else sum(value) / count(*) filter (value >= 200) end, 4) as cost_per_success from events group by 1""")
def a29_cost_per_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost for each success; without a success it is null, not 0."""
    n = F.count_if(F.col("value") >= 200)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("cost"), n.alias("n_success"), F.round(F.try_divide(F.sum("value"), n), 4).alias("cost_per_success"))


@query("a31_success_by_difficulty", """select o_orderpriority as difficulty, count(*) as n, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 9) as success
  from orders where o_orderstatus <> 'P' group by grouping sets ((), (o_orderpriority))""")
def a31_success_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success overall and by difficulty, blocked attempts left out."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return done.rollup(F.col("o_orderpriority").alias("difficulty")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 9).alias("success"))


@query("a33_confusion", """select source, cast(count(*) filter (quality = 1 and toxic = 0) as bigint) as tp, cast(count(*) filter (quality = 0 and toxic = 0) as bigint) as fp,
  cast(count(*) filter (quality = 1 and toxic = 1) as bigint) as fn, cast(count(*) filter (quality = 0 and toxic = 1) as bigint) as tn from documents join labels using (doc_id) group by 1""")
def a33_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-by-two table of a verdict against a truth by class."""
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(
        F.count_if((q == 1) & (t == 0)).alias("tp"), F.count_if((q == 0) & (t == 0)).alias("fp"), F.count_if((q == 1) & (t == 1)).alias("fn"), F.count_if((q == 0) & (t == 1)).alias("tn")
    )


@query("a42_latency_rollup", """select event_type, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, max(value) as max_value,
  count(distinct user_id) as n_users from events group by 1""")
def a42_latency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(both.alias("q"), F.max("value").alias("max_value"), F.count_distinct("user_id").alias("n_users"))
    return by.select("event_type", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p95"), "max_value", "n_users")


@query("a48_status_share", """select l_linestatus, l_returnflag, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_linestatus), 9) as share from lineitem group by 1, 2""")
def a48_status_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_linestatus")), 9))


@query("t12_mix", """select * from (select event_type, count(*) as n from events group by 1) order by n desc, event_type limit 6""")
def t12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent kinds; ties by name."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(6)
