"""Evaluation of runs, filings and detectors: rollups, triangulation, certificates, risk scores and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.aggregates import a21_lexicon
from spanforge.operators.lines import _LINES, lines_of
from spanforge.plans.registry import ORACLES, query
from spanforge.sources.tables import table


def count(condition: str | None = None) -> Column:
    return F.count_if(F.expr(condition)) if condition else F.count(F.lit(1))


def share(condition: str) -> Column:
    """Share of rows that meet a condition; an unknown condition doesn't count as met."""
    return F.round(F.avg(F.when(F.expr(condition), 1.0).otherwise(0.0)), 6)


def harmonic(tp: str, fp: str, fn: str) -> Column:
    """F1 from counts; 0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn)), F.lit(0.0)), 6)


@query("a4_a5_x30_triangulation", """with v as (select doc_id, src, vote from (select d.doc_id, unnest(['length', 'ending', 'label']) as src, unnest([case when n_chars > 400 then 'agree' else 'disagree' end,
  case when regexp_matches(text, '[.]$') then 'agree' else 'suspect' end, case when quality is null then 'unavailable' when quality = 1 then 'agree' else 'disagree' end]) as vote from documents d left join labels l on d.doc_id = l.doc_id))
  select doc_id, string_agg(src || '=' || vote, ',' order by src) as ballot, case when count(*) filter (vote = 'agree') >= 2 then 'agree' when count(*) filter (vote = 'disagree') >= 2 then 'disagree' when bool_or(vote = 'suspect') then 'suspect' else 'unavailable' end as verdict,
  case when count(*) filter (vote = 'agree') = 3 then 'gold' when count(*) filter (vote = 'agree') = 2 then 'silver' when bool_or(vote = 'disagree') then 'hard' else 'open' end as tier from v group by 1""")
def a4_a5_x30_triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three sources carry a verdict; the ballot tells who said what, the tier how far the sample can be trusted."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("text").rlike("[.]$").alias("ends")), table(spark, sf_dir, "labels").select("doc_id", "quality")
    vote = lambda src, v: F.struct(F.lit(src).alias("src"), v.alias("vote"))
    ballots = docs.join(labels, "doc_id", "left").select("doc_id", F.inline(F.array(
        vote("length", F.when(F.col("n_chars") > 400, "agree").otherwise("disagree")), vote("ending", F.when(F.col("ends"), "agree").otherwise("suspect")),
        vote("label", F.when(F.col("quality").isNull(), "unavailable").when(F.col("quality") == 1, "agree").otherwise("disagree")),
    )))
    said = F.array_sort(F.collect_list(F.concat_ws("=", "src", "vote")))
    tally = ballots.groupBy("doc_id").agg(F.array_join(said, ",").alias("ballot"), *(count(f"vote = '{v}'").alias(v) for v in ("agree", "disagree", "suspect")))
    verdict = F.when(F.col("agree") >= 2, "agree").when(F.col("disagree") >= 2, "disagree").when(F.col("suspect") > 0, "suspect").otherwise("unavailable")
    tier = F.when(F.col("agree") == 3, "gold").when(F.col("agree") == 2, "silver").when(F.col("disagree") > 0, "hard").otherwise("open")
    return tally.select("doc_id", "ballot", verdict.alias("verdict"), tier.alias("tier"))


@query("a8_two_grains", """with d as (select source, lang, avg(n_chars) as m, count(*) as n from documents group by 1, 2) select source, round(sum(m * n) / sum(n), 4) as micro, round(avg(m), 4) as macro from d group by 1""")
def a8_two_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over all rows and a mean of the groups' means."""
    by = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("s"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("source").agg(F.round(F.sum("s") / F.sum("n"), 4).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 4).alias("macro"))


@query("a9_jn5_line_scores", f"""with b as (select distinct regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as body from benchmark),
  l as (select distinct doc_id, line_idx, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') as norm, length(line) >= 60 as gold from {_LINES}),
  m as (select doc_id, gold, exists (select 1 from b where contains(b.body, l.norm)) as found from l where length(norm) >= 10),
  c as (select d.lang, count(*) filter (gold and found) as tp, count(*) filter (not gold and found) as fp, count(*) filter (gold and not found) as fn from m join documents d using (doc_id) group by 1)
  select lang, tp, fp, fn, round(case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end, 6) as f1 from c""")
def a9_jn5_line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten letters and digits or more that an item's text contains, against lines wanted, by group: right, wrong and missed ones, and F1.

    A line can only be where its first ten characters are, so places of ten characters in the items' texts are joined by equality, and each match is compared once, in place.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    docs = table(spark, sf_dir, "documents")
    lines = lines_of(docs).select("doc_id", "line_idx", norm("line").alias("norm"), (F.length("line") >= 60).alias("gold")).where("length(norm) >= 10").withColumn("key", F.left("norm", F.lit(10)))
    bodies = table(spark, sf_dir, "benchmark").select(norm("text").alias("body")).where("length(body) >= 10").distinct().withColumn("body_id", F.sha2("body", 256))
    places = bodies.select("body_id", "body", F.explode(F.sequence(F.lit(1), F.length("body") - 9)).alias("at")).select(F.expr("substring(body, at, 10)").alias("key"), "body_id", "at")
    near = lines.select("norm", "key").distinct().join(places, "key").join(bodies, "body_id")
    found = near.where(F.expr("substring(body, at, length(norm)) = norm")).select("norm", F.lit(True).alias("hit")).distinct()
    hits = lines.join(found, "norm", "left").withColumn("found", F.coalesce("hit", F.lit(False)))
    by_doc = hits.groupBy("doc_id").agg(count("gold and found").alias("tp"), count("not gold and found").alias("fp"), count("gold and not found").alias("fn"))
    by = by_doc.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return by.withColumn("f1", harmonic("tp", "fp", "fn"))


@query("a13_a14_a16_strata", """select lang, count(*) as n, round(avg(n_chars), 6) as mean_chars, min(n_chars) as least, count(*) filter (quality = 0 and n_chars >= 400) as false_passes,
  round(count(*) filter (quality = 0 and n_chars >= 400) / nullif(count(*) filter (n_chars >= 400), 0), 6) as false_pass_rate from documents join labels using (doc_id) group by 1""")
def a13_a14_a16_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a stratum: size, spread, and how often what passes clean is wrong."""
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    counts = both.groupBy("lang").agg(
        count().alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("least"), count("quality = 0 and n_chars >= 400").alias("false_passes"), count("n_chars >= 400").alias("passes")
    )
    return counts.withColumn("false_pass_rate", F.round(F.try_divide("false_passes", "passes"), 6)).drop("passes")


_COVERAGE = f"""(select t.doc_id, t.lang as own, l.lang as item, sum(l.weight) / max(l.total) as cov from (select distinct doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as token from documents) t
  join (select *, sum(weight) over (partition by lang) as total from ({ORACLES["a21_lexicon"]})) l on t.token = l.token group by 1, 2, 3)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, own, item, cov): how much of each group's lexicon weight a document holds. The lexicon has forty tokens a group, so it is broadcast."""
    lexicon = a21_lexicon(spark, sf_dir)
    totals = lexicon.groupBy("lang").agg(F.sum("weight").alias("total"))
    entries = lexicon.join(totals, "lang").select(F.col("lang").alias("item"), "token", (F.col("weight") / F.col("total")).alias("part"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("own"), F.explode(tokens).alias("token"))
    return rows.join(F.broadcast(entries), "token").groupBy("doc_id", "own", "item").agg(F.sum("part").alias("cov"))


@query("a23_jn18_d15_attribution", f"""select doc_id, own, item, round(cov, 4) as cov, item = own as fits from (select *, row_number() over (partition by doc_id order by round(cov, 6) desc, item) as r from {_COVERAGE}) where r = 1""")
def a23_jn18_d15_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group whose lexicon covers a document best; documents without any of the words aren't listed."""
    best = F.min_by(F.struct("item", "cov"), F.struct(-F.round("cov", 6), "item"))
    top = coverage(spark, sf_dir).groupBy("doc_id", "own").agg(best.alias("b"))
    return top.select("doc_id", "own", "b.item", F.round("b.cov", 4).alias("cov"), (F.col("b.item") == F.col("own")).alias("fits"))


@query("a22_t8_margins", f"""select own, round(coalesce(greatest(quantile_cont(m, 0.99), 0), 1.0), 4) as threshold from (select doc_id, own, coalesce(max(cov) filter (item <> own), 0) - coalesce(max(cov) filter (item = own), 0) as m from {_COVERAGE} group by 1, 2) group by 1""")
def a22_t8_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much another group's lexicon may cover a document better before it is flagged: the 99th percentile of what is seen, at least 0."""
    other, mine = F.max(F.when(F.col("item") != F.col("own"), F.col("cov"))), F.max(F.when(F.col("item") == F.col("own"), F.col("cov")))
    margins = coverage(spark, sf_dir).groupBy("doc_id", "own").agg((F.coalesce(other, F.lit(0.0)) - F.coalesce(mine, F.lit(0.0))).alias("m"))
    return margins.groupBy("own").agg(F.round(F.coalesce(F.greatest(F.percentile("m", 0.99), F.lit(0.0)), F.lit(1.0)), 4).alias("threshold"))


@query("a27_collated_passes", """select user_id, string_agg(cast(cast(day as bigint) as varchar) || ':' || p, ',' order by day) as passes from (select user_id, day(ts) as day, case when max(value) >= 100 then 'pass' else 'fail' end as p from events group by 1, 2) group by 1""")
def a27_collated_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of a task over its passes, in order."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.when(F.max("value") >= 100, "pass").otherwise("fail").alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("day", "p")))
    return days.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["day"], s["p"])), ",").alias("passes"))


@query("a28_p14_a32_a45_run_metrics", """select user_id, count(*) as n, count(*) filter (event_type <> 'error') as n_done, coalesce(round(count(*) filter (event_type <> 'error' and value >= 30) / nullif(count(*) filter (event_type <> 'error'), 0), 6), 0.0) as success_all_done,
  round(count(*) filter (event_type = 'purchase' and value >= 30) / greatest(1, count(*) filter (event_type = 'purchase')), 6) as verdict_rate from events group by 1""")
def a28_p14_a32_a45_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the runs that got done; a missing status counts as done, and an empty denominator gives 0."""
    done = table(spark, sf_dir, "events").withColumn("done", F.coalesce(F.col("event_type") != "error", F.lit(True)))
    counts = done.groupBy("user_id").agg(
        count().alias("n"), count("done").alias("n_done"), count("done and value >= 30").alias("good"), count("event_type = 'purchase' and value >= 30").alias("ok"), count("event_type = 'purchase'").alias("judged")
    )
    rate = F.coalesce(F.round(F.try_divide("good", "n_done"), 6), F.lit(0.0))
    return counts.select("user_id", "n", "n_done", rate.alias("success_all_done"), F.round(F.col("ok") / F.greatest(F.lit(1), "judged"), 6).alias("verdict_rate"))


@query("a34_a35_a43_silent_failures", """select event_type as kind, count(*) as n, count(*) filter (value < 5) as refused, round(avg(case when value >= 100 then 1.0 else 0.0 end), 6) as silent_rate, round(avg(case when cast(props ->> '$.k' as bigint) >= 90 then 1.0 else 0.0 end), 6) as attack_rate from events group by 1""")
def a34_a35_a43_silent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent success where none is possible, refusals apart, and how often a trap was taken, by kind."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.groupBy(F.col("event_type").alias("kind")).agg(count().alias("n"), count("value < 5").alias("refused"), share("value >= 100").alias("silent_rate"), share("k >= 90").alias("attack_rate"))


@query("a37_degradation", """with c as (select event_type as axis, cast(props ->> '$.k' as bigint) // 25 as level, round(avg(case when value >= 30 then 1.0 else 0.0 end), 6) as rate, count(*) as n from events group by 1, 2)
  select axis, level, rate, n, coalesce(bool_and(rate <= p) over (partition by axis), true) as monotone from (select *, lag(rate) over (partition by axis order by level) as p from c)""")
def a37_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success by level of disturbance, and whether each axis' curve never rises."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("axis"), F.floor(F.get_json_object("props", "$.k").cast("long") / 25).alias("level"), "value")
    cells = events.groupBy("axis", "level").agg(share("value >= 30").alias("rate"), count().alias("n"))
    steps = cells.withColumn("p", F.lag("rate").over(Window.partitionBy("axis").orderBy("level")))
    return steps.select("axis", "level", "rate", "n", F.coalesce(F.bool_and(F.col("rate") <= F.col("p")).over(Window.partitionBy("axis")), F.lit(True)).alias("monotone"))


@query("a38_trajectories", """select event_type, round(avg(n), 6) as mean_steps, max(n) as most_steps, count(*) filter (n > 15) as n_long from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def a38_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(count().alias("n"))
    return by.groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("mean_steps"), F.max("n").alias("most_steps"), count("n > 15").alias("n_long"))


@query("a39_x37_ablation", """with m as (select event_type as config, round(avg(case when value >= 30 then 1.0 else 0.0 end), 6) as rate, count(*) as n from events group by 1), f as (select rate from m where config = 'click')
  select config, m.rate, n, round(m.rate - f.rate, 6) as delta from m, f""")
def a39_x37_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration against the full one. One row holds the base, so every configuration can be set beside it."""
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config")).agg(share("value >= 30").alias("rate"), count().alias("n"))
    base = F.max(F.when(F.col("config") == "click", F.col("rate"))).over(Window.partitionBy(F.lit(1)))
    return by.select("config", "rate", "n", F.round(F.col("rate") - base, 6).alias("delta"))


_RISK = """(select event_id, user_id, event_type, value >= 100 as truth, case when event_type <> 'purchase' then 0.0 else least(1.0, 0.6 * cast(value >= 50 as int) + 0.25 * cast(k >= 60 as int) + 0.25 * cast(step > 40 as int) + 0.2 * cast(same as int)) end as risk
  from (select event_id, user_id, event_type, value, cast(props ->> '$.k' as bigint) as k, row_number() over w as step, coalesce(lag(event_type) over w = event_type, false) as same from events window w as (partition by user_id order by ts, event_id)))"""


def risk_scores(events: DataFrame) -> DataFrame:
    """(event_id, event_type, truth, risk): weighted signs of false success, at most 1, and 0 where no success was claimed."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sign = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("long")
    signs = 0.6 * sign(value >= 50) + 0.25 * sign(k >= 60) + 0.25 * sign(F.row_number().over(by) > 40) + 0.2 * sign(F.lag("event_type").over(by) == F.col("event_type"))
    return events.select("event_id", "event_type", (value >= 100).alias("truth"), F.when(F.col("event_type") != "purchase", 0.0).otherwise(F.least(F.lit(1.0), signs)).alias("risk"))


@query("a53_x7_risk", f"select event_id, round(risk, 6) as risk, risk >= 0.5 as flagged from {_RISK} where event_type = 'purchase'")
def a53_x7_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk that a claimed success is none."""
    scored = risk_scores(table(spark, sf_dir, "events")).where("event_type = 'purchase'")
    return scored.select("event_id", F.round("risk", 6).alias("risk"), (F.col("risk") >= 0.5).alias("flagged"))


@query("a40_x38_detector", f"""with c as (select count(*) filter (truth and risk >= 0.5) as tp, count(*) filter (not truth and risk >= 0.5) as fp, count(*) filter (truth and risk < 0.5) as fn, count(*) as n from {_RISK} where event_type = 'purchase')
  select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as prec, round(tp / nullif(tp + fn, 0), 6) as recall, round((tp + fp) / n, 6) as flag_rate from c""")
def a40_x38_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector against the truth."""
    scored = risk_scores(table(spark, sf_dir, "events")).where("event_type = 'purchase'")
    c = scored.agg(count("truth and risk >= 0.5").alias("tp"), count("not truth and risk >= 0.5").alias("fp"), count("truth and risk < 0.5").alias("fn"), count().alias("n"))
    return c.select(
        "tp", "fp", "fn", F.round(F.try_divide("tp", F.expr("tp + fp")), 6).alias("prec"), F.round(F.try_divide("tp", F.expr("tp + fn")), 6).alias("recall"), F.round(F.try_divide(F.expr("tp + fp"), "n"), 6).alias("flag_rate")
    )


@query("a44_a46_scaling", """with w as (select user_id % 4 as workers, count(*) as n, sum(cast(floor(value) as bigint)) as busy, max(value) as longest from events where user_id is not null group by 1), b as (select n / busy as base from w where workers = 0)
  select workers, n, round(n / nullif(busy, 0), 6) as throughput, round((n / nullif(busy, 0)) / base, 6) as speed_up, round(100.0 * longest / nullif(busy, 0), 6) as spread from w, b""")
def a44_a46_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput by number of workers, speed-up against the first row, and the longest job's share."""
    by = table(spark, sf_dir, "events").where("user_id is not null").groupBy((F.col("user_id") % 4).alias("workers")).agg(count().alias("n"), F.sum(F.floor("value")).alias("busy"), F.max("value").alias("longest"))
    through = by.withColumn("t", F.try_divide("n", "busy"))
    base = F.max(F.when(F.col("workers") == 0, F.col("t"))).over(Window.partitionBy(F.lit(1)))
    return through.select("workers", "n", F.round("t", 6).alias("throughput"), F.round(F.col("t") / base, 6).alias("speed_up"), F.round(F.try_divide(100.0 * F.col("longest"), "busy"), 6).alias("spread"))


@query("a49_x36_reclassified", """select o_orderstatus, count(*) filter (h = 1) as before, count(*) filter (h = 2) as after from (select o_orderstatus, case when o_orderdate < timestamp '1996-06-15' then 1 else 2 end as h from orders) group by 1""")
def a49_x36_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of two sweeps side by side."""
    half = F.when(F.col("o_orderdate") < F.lit("1996-06-15").cast("timestamp"), "before").otherwise("after")
    sweeps = table(spark, sf_dir, "orders").select("o_orderstatus", half.alias("sweep"))
    return sweeps.groupBy("o_orderstatus").pivot("sweep", ["before", "after"]).count().na.fill(0)


@query("a50_false_alarms", """select lang, round(avg(case when n_chars > 8 * m then 1.0 else 0.0 end), 6) as alarm_rate from (select d.lang, n_chars, m from documents d join (select doc_id from labels where quality = 1) l using (doc_id)
  left join (select lang, floor(quantile_cont(n_chars, 0.5)) as m from documents group by 1) b on d.lang = b.lang) group by 1""")
def a50_false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a size guard cries over documents that are known to be good; a group without a band never does."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    bands = docs.groupBy("lang").agg(F.floor(F.percentile("n_chars", 0.5)).alias("m"))
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return good.join(bands, "lang", "left").groupBy("lang").agg(share("n_chars > 8 * m").alias("alarm_rate"))


@query("a51_x40_claims", """with f as (select 'orders' as claim, cast((select count(*) from orders) as double) as found, 15000.0 as expected union all select 'mean_quantity', (select avg(l_quantity) from lineitem), 25.5
  union all select 'top_priority', (select avg(case when o_orderpriority like '1-%' then 1.0 else 0.0 end) from orders), 0.2) select claim, abs(found - expected) < 1e-9 as holds from f""")
def a51_x40_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated figures against the data, to within 1e-9."""
    claim = lambda name, found, expected: found.select(F.lit(name).alias("claim"), (F.abs(F.col("found") - expected) < 1e-9).alias("holds"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    urgent = F.when(F.col("o_orderpriority").startswith("1-"), 1.0).otherwise(0.0)
    return (
        claim("orders", orders.agg(F.count(F.lit(1)).cast("double").alias("found")), 15000.0)
        .unionByName(claim("mean_quantity", lines.agg(F.avg("l_quantity").alias("found")), 25.5)).unionByName(claim("top_priority", orders.agg(F.avg(urgent).alias("found")), 0.2))
    )


@query("a52_servability", """with i as (select l_orderkey, count(*) filter (l_linestatus = 'O' and l_discount >= 0.1) as fatal, sum(case when l_returnflag <> 'R' then l_quantity else 0 end) / sum(l_quantity) as cov, count(*) filter (l_tax >= 0.08) as notices from lineitem group by 1)
  select l_orderkey, case when fatal > 0 or cov < 0.8 then 'blocked' when notices > 2 then 'degraded' else 'clean' end as level, case when fatal > 0 and cov < 0.8 then 'fatal,coverage' when fatal > 0 then 'fatal' when cov < 0.8 then 'coverage' else '' end as reasons from i""")
def a52_servability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record may be served: any blocking reason blocks, two notices never degrade, three do."""
    kept = F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(count("l_linestatus = 'O' and l_discount >= 0.1").alias("fatal"), kept.alias("cov"), count("l_tax >= 0.08").alias("notices"))
    blocked = (F.col("fatal") > 0) | (F.col("cov") < 0.8)
    reasons = F.concat_ws(",", F.when(F.col("fatal") > 0, "fatal"), F.when(F.col("cov") < 0.8, "coverage"))
    return by.select("l_orderkey", F.when(blocked, "blocked").when(F.col("notices") > 2, "degraded").otherwise("clean").alias("level"), reasons.alias("reasons"))


@query("a54_d20_number_certificate", """select o_orderkey, case when n >= 2 then 'certified' when n = 1 then 'inconclusive' else 'contradicted' end as certificate from (select o_orderkey, count(distinct l_linenumber) filter (contains(body, cast(cast(l_quantity as bigint) as varchar))) as n
  from (select o_orderkey, cast(cast(o_totalprice * 100 as bigint) as varchar) as body from orders where o_totalprice is not null) join lineitem on l_orderkey = o_orderkey group by 1)""")
def a54_d20_number_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span is certified by two facts or more that it holds, and contradicted when it holds none."""
    body = table(spark, sf_dir, "orders").where("o_totalprice is not null").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("body"))
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").cast("string").alias("fact")).join(body, "l_orderkey")
    n = facts.groupBy("l_orderkey").agg(F.count_distinct(F.when(F.contains("body", "fact"), F.col("l_linenumber"))).alias("n"))
    return n.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("n") >= 2, "certified").when(F.col("n") == 1, "inconclusive").otherwise("contradicted").alias("certificate"))


@query("a55_a30_trust_card", """select 'quality' as row_name, round(avg(quality), 6) as value, avg(quality) >= 0.5 as met, count(*) as n from labels union all select 'not_toxic', round(1 - avg(toxic), 6), 1 - avg(toxic) >= 0.95, count(*) from labels""")
def a55_a30_trust_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with the gates they must meet, from one pass over the labels."""
    means = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("q"), (1 - F.avg("toxic")).alias("t"), count().alias("n"))
    row = lambda name, c, gate: F.struct(F.lit(name).alias("row_name"), F.round(c, 6).alias("value"), (F.col(c) >= gate).alias("met"), F.col("n"))
    return means.select(F.inline(F.array(row("quality", "q", 0.5), row("not_toxic", "t", 0.95))))


@query("a56_a57_x23_engine_ladder", """with w as (select conv_id, arg_min(text, turn) filter (role = 'user') as ours, arg_min(text, turn) filter (role = 'assistant') as theirs from conversations group by 1),
  c as (select conv_id, list_distinct(regexp_extract_all(lower(coalesce(ours, '')), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(coalesce(theirs, '')), '[a-z0-9]+')) as b from w),
  n as (select conv_id, len(a) as na, len(b) as nb, len(list_intersect(a, b)) as nab from c)
  select conv_id, case when nb = 0 then case when na = 0 then 'agree' else 'unavailable' end when na = 0 then 'disagree' when nab / least(na, nb) < 0.1 then 'suspect' when least(na, nb) / greatest(na, nb) < 0.35 then case when abs(na - nb) <= 40 then 'agree' else 'disagree' end else 'agree' end as verdict,
  case when na = 0 and nb = 0 then 'neither' when nab >= 0.5 * na then 'ours' when nab >= 0.5 * nb then 'theirs' else 'both' end as pick from n""")
def a56_a57_x23_engine_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines' spans compared by a ladder: nothing found, little overlap, unlike lengths, agreement; and which of them to keep."""
    words = lambda role: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit(""))), F.lit("([a-z0-9]+)"), 1))
    both = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(words("user").alias("a"), words("assistant").alias("b"))
    n = both.select("conv_id", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("nab"))
    na, nb, nab = F.col("na"), F.col("nb"), F.col("nab")
    small, large = F.least(na, nb), F.greatest(na, nb)
    verdict = (
        F.when(nb == 0, F.when(na == 0, "agree").otherwise("unavailable")).when(na == 0, "disagree").when(nab < 0.1 * small, "suspect")
        .when(small < 0.35 * large, F.when(F.abs(na - nb) <= 40, "agree").otherwise("disagree")).otherwise("agree")
    )
    pick = F.when((na == 0) & (nb == 0), "neither").when(nab >= 0.5 * na, "ours").when(nab >= 0.5 * nb, "theirs").otherwise("both")
    return n.select("conv_id", verdict.alias("verdict"), pick.alias("pick"))


@query("x29_era_matrix", """select era, count(*) filter (p = 'F') as "F", count(*) filter (p = 'O') as "O", count(*) filter (p = 'P') as "P", round(avg(s), 6) as supported from (select case when year(o_orderdate) < 1996 then 'early' else 'late' end as era, o_orderstatus as p,
  case when n >= 3 and q >= 50 then 1.0 else 0.0 end as s from orders left join (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1) on l_orderkey = o_orderkey) group by 1""")
def x29_era_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by era and kind, and the share that has enough parts to be supported."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(count().alias("n"), F.sum("l_quantity").alias("q"))
    era = F.when(F.year("o_orderdate") < 1996, "early").otherwise("late")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", era.alias("era")).join(parts, "o_orderkey", "left")
    return rows.groupBy("era").agg(*(count(f"o_orderstatus = '{p}'").alias(p) for p in "FOP"), share("n >= 3 and q >= 50").alias("supported"))


@query("x31_x32_certificates", """select axis, coalesce(n, 0) as n, mean from (values ('agree'), ('disagree'), ('undecided')) a(axis) left join (select case when toxic = 1 then 'disagree' when quality = 1 then 'agree' else 'undecided' end as axis, count(*) as n, round(avg(quality), 6) as mean from labels group by 1) using (axis)""")
def x31_x32_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on a fixed axis; an outcome nobody got is there with 0."""
    axis = F.when(F.col("toxic") == 1, "disagree").when(F.col("quality") == 1, "agree").otherwise("undecided")
    by = table(spark, sf_dir, "labels").groupBy(axis.alias("axis")).agg(count().alias("n"), F.round(F.avg("quality"), 6).alias("mean"))
    scaffold = spark.range(1).select(F.explode(F.array(*map(F.lit, ("agree", "disagree", "undecided")))).alias("axis"))
    return scaffold.join(by, "axis", "left").select("axis", F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("x33_x34_probe", """select source, count(*) filter (n_chars >= 300 and quality = 0) as unflagged_weak, min(n_chars) filter (quality = 1) as least_covered, count(*) filter (quality = 1 and n_chars < 300) as false_positives from documents left join labels using (doc_id) group by 1""")
def x33_x34_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes that are weak and weren't flagged, the least covered good one, and false alarms, by source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(
        count("n_chars >= 300 and quality = 0").alias("unflagged_weak"), F.min(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("least_covered"), count("quality = 1 and n_chars < 300").alias("false_positives")
    )


@query("a15_calibration_samples", """select case when confidence >= 0.6 then 'served' else 'held' end as gate, count(*) as n, count(*) filter (correct = 1) as n_correct from (select least(1.0, n_chars / 1000.0) as confidence, coalesce(quality, 0) as correct from documents left join labels using (doc_id)) group by 1""")
def a15_calibration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples for calibration; what nobody labelled counts as wrong."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 1000.0).alias("confidence")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    gate = F.when(F.col("confidence") >= 0.6, "served").otherwise("held")
    return rows.groupBy(gate.alias("gate")).agg(count().alias("n"), count("coalesce(quality, 0) = 1").alias("n_correct"))
