"""Contracts: conditions against observations, lint, latches and verdicts; grounding, diagnosis, rebinding and gates of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.aggregates import fold_verdict
from spanforge.plans.registry import query
from spanforge.sources.tables import table

#: Conditions as (id, contract, type, value, forbidden, revocable). A contract is chosen by conv_id % 3.
CONDITIONS = [
    (0, 0, "text", "the", False, False),
    (1, 1, "regex", "[.]$", False, True),
    (2, 1, "chars", "200", False, False),
    (3, 1, "text", "verschl", True, False),
    (4, 2, "text", "tion", False, False),
    (5, 2, "chars", "60", False, True),
    (6, 2, "regex", "^[A-Z].*[a-z] ", False, False),
    (7, 2, "region", "", False, False),
    (8, 1, "text", "zzzz", True, False),
]

#: Unrelated texts; a pattern that half of them meet tells nothing.
DECOYS = ["Page not found", "Sign in to continue.", "Results 1 to 10", "Loading", "Your cart is empty.", "Accept all cookies", "404", "Choose a language"]

_CONDITIONS = f"conds(cond_id, contract, type, value, forbidden, revocable) as (values {', '.join(map(str, CONDITIONS))})"
_DECOYS = f"decoys(d) as (values {', '.join(f'({d!r})' for d in DECOYS)})"
_CHECK = """case c.type when 'text' then case when contains(lower(t.text), c.value) then 'pass' else 'fail' end
  when 'regex' then case when regexp_matches(t.text, c.value) then 'pass' else 'fail' end
  when 'chars' then case when length(t.text) >= try_cast(c.value as bigint) then 'pass' else 'fail' end else 'unknown' end"""


def conditions() -> Column:
    """The conditions as one array column of structs; they are few and fixed."""
    names = ("cond_id", "contract", "type", "value", "forbidden", "revocable")
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in CONDITIONS))


def check(kind: Column, value: Column, text: Column) -> Column:
    """pass, fail or unknown for one condition and one observed text. A kind that can't be observed is unknown."""
    hit = F.when(kind == "text", F.contains(F.lower(text), value)).when(kind == "regex", F.regexp_like(text, value)).when(kind == "chars", F.length(text) >= value.try_cast("long"))
    return F.when(hit.isNull(), "unknown").when(hit, "pass").otherwise("fail")


def observed(turns: DataFrame) -> DataFrame:
    """Every condition of a conversation's contract at each of its turns: (conv_id, turn, the condition, result)."""
    each = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.explode(conditions()).alias("c")).where(F.col("conv_id") % 3 == F.col("c.contract"))
    return each.select("conv_id", "turn", "c.*", check(F.col("c.type"), F.col("c.value"), F.col("text")).alias("result"))


@query("x6_p5_p6_conditions", f"""with {_CONDITIONS} select cond_id, result, count(*) as n from (select c.cond_id, {_CHECK} as result from (select conv_id, coalesce(text, '') as text from conversations) t join conds c on t.conv_id % 3 = c.contract) group by 1, 2""")
def x6_p5_p6_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every condition over all observations."""
    return observed(table(spark, sf_dir, "conversations")).groupBy("cond_id", "result").agg(F.count(F.lit(1)).alias("n"))


def decoy_ratio(value: Column) -> Column:
    """The share of unrelated texts that a pattern meets."""
    decoys = F.array(*map(F.lit, DECOYS))
    return F.size(F.filter(decoys, lambda d: F.regexp_like(d, value))) / F.size(decoys)


@query("p8_decoys", f"""with {_DECOYS} select word, round(avg(case when regexp_matches(d, word) then 1.0 else 0.0 end), 6) as ratio, avg(case when regexp_matches(d, word) then 1.0 else 0.0 end) >= 0.5 as telling_nothing
  from (select distinct left(regexp_extract(lower(text), '[a-z]+'), 2) as word from conversations) w, decoys where word <> '' group by 1""")
def p8_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that also match texts of no concern; eight decoys a pattern, inside the row."""
    words = table(spark, sf_dir, "conversations").select(F.left(F.regexp_extract(F.lower("text"), "([a-z]+)", 1), F.lit(2)).alias("word")).where("word <> ''").distinct()
    return words.select("word", F.round(decoy_ratio(F.col("word")), 6).alias("ratio"), (decoy_ratio(F.col("word")) >= 0.5).alias("telling_nothing"))


@query("d28_p9_x4_contract_verdict", f"""with {_CONDITIONS}, {_DECOYS},
  r as (select cond_id, avg(case when regexp_matches(d, value) then 1.0 else 0.0 end) as ratio from conds, decoys group by 1),
  c2 as (select c.*, c.type = 'text' and length(c.value) < 4 as weak, c.type = 'regex' and r.ratio >= 0.5 as blunt from conds c join r using (cond_id)),
  o as (select t.conv_id, t.turn, max(t.turn) over (partition by t.conv_id) as last, c.*, {_CHECK} as result from (select conv_id, turn, coalesce(text, '') as text from conversations) t join c2 c on t.conv_id % 3 = c.contract),
  f as (select conv_id, cond_id, forbidden, weak, blunt, case when forbidden then case when bool_or(result = 'pass') then 'fail' else 'pass' end
    when revocable or blunt then arg_max(result, turn) when bool_or(result = 'pass') then 'pass' else arg_max(result, turn) end as status from o group by conv_id, cond_id, forbidden, revocable, weak, blunt)
  select conv_id, case when bool_or(forbidden and status = 'fail') then 'fail' when bool_and(weak or forbidden) then 'unknown' when bool_or(status = 'fail') then 'fail'
    when bool_or(status = 'unknown') or bool_or(blunt) then 'unknown' else 'pass' end as verdict from f group by 1""")
def d28_p9_x4_contract_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks, then latches, then lint, then the cap on patterns that tell nothing.

    A condition that held once stays held unless it is revocable or tells nothing; a forbidden one fails if it ever held, and that failure stands above all
    else. A contract of weak conditions only is unknown, and so is one that passes by a pattern that tells nothing.
    """
    blunt, weak = (F.col("type") == "regex") & (decoy_ratio(F.col("value")) >= 0.5), (F.col("type") == "text") & (F.length("value") < 4)
    rows = observed(table(spark, sf_dir, "conversations")).withColumns({"blunt": blunt, "weak": weak})
    ever, last = F.max(F.col("result") == "pass"), F.max_by("result", "turn")
    folded = rows.groupBy("conv_id", "cond_id", "forbidden", "revocable", "weak", "blunt").agg(ever.alias("ever"), last.alias("last"))
    status = F.when(F.col("forbidden"), F.when(F.col("ever"), "fail").otherwise("pass")).when(~F.col("revocable") & ~F.col("blunt") & F.col("ever"), "pass").otherwise(F.col("last"))
    by_conv = folded.withColumn("status", status).groupBy("conv_id").agg(
        F.max(F.col("forbidden") & (F.col("status") == "fail")).alias("broken"), F.min(F.col("weak") | F.col("forbidden")).alias("all_weak"),
        fold_verdict(F.col("status")).alias("fold"), F.max("blunt").alias("blunt"),
    )
    verdict = F.when(F.col("broken"), "fail").when(F.col("all_weak"), "unknown").when((F.col("fold") == "pass") & F.col("blunt"), "unknown").otherwise(F.col("fold"))
    return by_conv.select("conv_id", verdict.alias("verdict"))


@query("p7_masked_hits", """select a.conv_id, a.turn, contains(array_to_string(list_filter(string_split(lower(coalesce(a.text, '')), chr(10)), lambda l: not contains(l, u.q)), chr(10)), u.w) as hit
  from conversations a join (select conv_id, lower(text) as q, regexp_extract(lower(text), '[a-z]{4,}') as w from conversations where turn = 0 and text <> '') u on a.conv_id = u.conv_id where a.role = 'assistant'""")
def p7_masked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer holds the question's first long word in a line that doesn't just echo the whole question."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("turn = 0 and text <> ''").select("conv_id", F.lower("text").alias("q"), F.regexp_extract(F.lower("text"), "([a-z]{4,})", 1).alias("w"))
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.split(F.lower(F.coalesce("text", F.lit(""))), "\n", -1).alias("lines"))
    kept = F.array_join(F.filter("lines", lambda line: ~F.contains(line, F.col("q"))), "\n")
    return answers.join(asked, "conv_id").select("conv_id", "turn", F.contains(kept, F.col("w")).alias("hit"))


@query("d25_grounding", """with j as (select conv_id, turn, case when length(coalesce(text, '')) < 40 then 'no' else 'yes' end as said, lower(coalesce(text, '')) as hay,
  lower(substring(case when turn % 2 = 0 then coalesce(text, '') else coalesce(lag(text) over (partition by conv_id order by turn), '') end, 11, 20)) as quote from conversations)
  select conv_id, turn, case when coalesce(max(case when said = 'no' then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) = 1 then 'skipped'
  when said = 'yes' and (quote = '' or not contains(hay, quote)) then 'unknown' else said end as verdict from j""")
def d25_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yes stands only on a quote that the observed text holds; after the first no nothing is judged any more."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce("text", F.lit(""))
    source = F.when(F.col("turn") % 2 == 0, text).otherwise(F.coalesce(F.lag("text").over(by), F.lit("")))
    judged = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.length(text) < 40, "no").otherwise("yes").alias("said"), F.lower(text).alias("hay"), F.lower(F.substring(source, 11, 20)).alias("quote")
    )
    over = F.coalesce(F.max(F.col("said") == "no").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    loose = (F.col("said") == "yes") & ((F.col("quote") == "") | ~F.contains("hay", "quote"))
    return judged.select("conv_id", "turn", F.when(over, "skipped").when(loose, "unknown").otherwise(F.col("said")).alias("verdict"))


@query("d26_first_mention", """select doc_id, list_filter(string_split(text, chr(10)), lambda l: contains(l, ' that ') or contains(l, ' est '))[1] as line from documents""")
def d26_first_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that mentions one of the terms, null where none does."""
    mentions = F.filter(F.split("text", "\n", -1), lambda line: F.contains(line, F.lit(" that ")) | F.contains(line, F.lit(" est ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(mentions, F.lit(0)).alias("line"))


@query("d27_x13_a36_open_ended", """select conv_id, count(*) filter (s = 'yes') as n_yes, count(*) filter (s = 'no') as n_no, bool_and(s = 'yes') as all_yes, round(count(*) filter (s = 'yes') / nullif(count(*) filter (s <> 'unknown'), 0), 6) as score
  from (select conv_id, case when length(text) >= 300 then 'yes' when length(text) < 120 then 'no' else 'unknown' end as s from conversations) group by 1""")
def d27_x13_a36_open_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points met, missed and open; the score is over the decided ones, null without any."""
    s = F.when(F.length("text") >= 300, "yes").when(F.length("text") < 120, "no").otherwise("unknown")
    counts = table(spark, sf_dir, "conversations").withColumn("s", s).groupBy("conv_id").agg(
        F.count_if(F.col("s") == "yes").alias("n_yes"), F.count_if(F.col("s") == "no").alias("n_no"), F.bool_and(F.col("s") == "yes").alias("all_yes")
    )
    return counts.withColumn("score", F.round(F.try_divide("n_yes", F.col("n_yes") + F.col("n_no")), 6))


@query("d29_x9_diagnosis", """select event_id, case when event_type = 'purchase' then 'none' when event_type = 'error' and value >= 100 then 'overload' when event_type = 'error' and k >= 50 then 'blocked' when event_type = 'error' then 'not_found'
  when gap_s > 3600 then 'timeout' when event_type = prior then 'no_effect' else 'moved' end as diagnosis from (select event_id, event_type, value, cast(props ->> '$.k' as bigint) as k, date_diff('second', lag(ts) over w, ts) as gap_s, lag(event_type) over w as prior
  from events window w as (partition by user_id order by ts, event_id))""")
def d29_x9_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a step failed, by an ordered ladder over the step and the one before."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by))
    steps = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), gap.alias("gap_s"), F.lag("event_type").over(by).alias("prior"))
    error = F.col("event_type") == "error"
    ladder = (
        F.when(F.col("event_type") == "purchase", "none").when(error & (F.col("value") >= 100), "overload").when(error & (F.col("k") >= 50), "blocked").when(error, "not_found")
        .when(F.col("gap_s") > 3600, "timeout").when(F.col("event_type") == F.col("prior"), "no_effect").otherwise("moved")
    )
    return steps.select("event_id", ladder.alias("diagnosis"))


@query("d30_side_effects", """with w as (select conv_id, turn, role, list_distinct(string_split(lower(coalesce(text, '')), ' ')) as w from conversations),
  e as (select conv_id, arg_min(w, turn) as a, arg_max(w, turn) as b, arg_min(role, turn) as r from w group by 1)
  select conv_id, cast(len(list_filter(b, lambda x: not list_contains(a, x))) as bigint) as n_new, cast(len(list_filter(a, lambda x: not list_contains(b, x))) as bigint) as n_gone,
  case when r = 'system' then 'unknown' when len(list_filter(b, lambda x: not list_contains(a, x))) > 0 then 'changed' else 'none' end as report from e""")
def d30_side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last state holds that the first doesn't, and the reverse; runs of one kind can't be told and are unknown."""
    states = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), " ", -1)).alias("w"))
    ends = states.groupBy("conv_id").agg(F.min_by("w", "turn").alias("a"), F.max_by("w", "turn").alias("b"), F.min_by("role", "turn").alias("r"))
    new, gone = F.size(F.array_except("b", "a")).cast("long"), F.size(F.array_except("a", "b")).cast("long")
    return ends.select("conv_id", new.alias("n_new"), gone.alias("n_gone"), F.when(F.col("r") == "system", "unknown").when(new > 0, "changed").otherwise("none").alias("report"))


@query("jn15_second_judge", """select d.doc_id, case when l.doc_id is null then null else (d.n_chars > 400) = (l.quality = 1) end as agree from documents d left join labels l on d.doc_id = l.doc_id""")
def jn15_second_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second judge beside the first; null where there is no second opinion."""
    second = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("second"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 400).alias("first")).join(second, "doc_id", "left").select("doc_id", (F.col("first") == F.col("second")).alias("agree"))


@query("jn20_x12_rebind", """with c as (select * from orders where o_orderkey % 2 = 0), x as (select o_custkey, o_orderstatus, min(o_orderkey) as k from c group by 1, 2 having count(*) = 1), s as (select o_custkey, min(o_orderkey) as k from c group by 1 having count(*) = 1)
  select t.o_orderkey, coalesce(x.k, s.k) as bound from (select * from orders where o_orderkey % 2 = 1) t left join x using (o_custkey, o_orderstatus) left join s on s.o_custkey = t.o_custkey""")
def jn20_x12_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target is bound by its exact key if just one candidate has it, else by its tolerant key on the same terms, else not at all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = orders.where("o_orderkey % 2 = 0")

    def single(name: str, *keys: str) -> DataFrame:
        return old.groupBy(*keys).agg(F.min("o_orderkey").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    bound = orders.where("o_orderkey % 2 = 1").join(single("exact", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "left").join(single("stable", "o_custkey"), "o_custkey", "left")
    return bound.select("o_orderkey", F.coalesce("exact", "stable").alias("bound"))


@query("l4_l5_gates", """with e as (select user_id, event_type, row_number() over w as step, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by ts, event_id)),
  g as (select *, row_number() over (partition by user_id, event_type order by step) as nth from e)
  select user_id, count(*) filter (event_type = 'signup' and nth = 1 and step < greatest(2, 0.4 * n)) as n_rejected, min(step) filter (event_type = 'signup' and not (nth = 1 and step < greatest(2, 0.4 * n))) as stop_step from g group by 1""")
def l4_l5_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim to be done is sent back once while budget is ample; the run stops at the first claim that stands."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(by).cast("long").alias("step"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("step"))
    claim = F.col("event_type") == "signup"
    gated = steps.withColumn("sent_back", (nth == 1) & (F.col("step") < F.greatest(F.lit(2.0), 0.4 * F.col("n"))))
    return gated.groupBy("user_id").agg(F.count_if(claim & F.col("sent_back")).alias("n_rejected"), F.min(F.when(claim & ~F.col("sent_back"), F.col("step"))).alias("stop_step"))


@query("l7_replay_bank", """select user_id, k, event_id as banked from (select user_id, cast(props ->> '$.k' as bigint) % 5 as k, event_id, event_type, row_number() over (partition by user_id, cast(props ->> '$.k' as bigint) % 5 order by ts desc, event_id desc) as r
  from events where event_type in ('purchase', 'error')) where r = 1 and event_type = 'purchase'""")
def l7_replay_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banked runs by key: a pass banks, an error takes away; only each key's last event counts."""
    marks = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").withColumn("k", F.get_json_object("props", "$.k").cast("long") % 5)
    last = marks.groupBy("user_id", "k").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("e"))
    return last.where("e.event_type = 'purchase'").select("user_id", "k", F.col("e.event_id").alias("banked"))


@query("l9_queue", """select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by event_id desc) as r from (select event_type, min(event_id) as event_id from events group by event_type, user_id, props)) where r <= 100""")
def l9_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with equal keys run once, and each queue remembers its hundred newest."""
    once = table(spark, sf_dir, "events").groupBy("event_type", "user_id", "props").agg(F.min("event_id").alias("event_id"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return once.select("event_type", "event_id", rank.alias("r")).where("r <= 100").drop("r")


@query("x10_shadow_checks", """select user_id, count(*) as n_checked, round(avg(case when value >= 50 then 1.0 else 0.0 end), 6) as divergence from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r,
  event_type <> coalesce(lag(event_type) over (partition by user_id order by ts, event_id), event_type) and value > 30 as drift from events) where (r - 1) % 5 = 0 or drift group by 1""")
def x10_shadow_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth hit is checked, and each one whose surroundings drifted; the share of those that differ."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    drift = (F.col("event_type") != F.lag("event_type").over(by)) & (F.col("value") > 30)
    hits = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(by).alias("r"), F.coalesce(drift, F.lit(False)).alias("drift"))
    differs = F.when(F.col("value") >= 50, 1.0).otherwise(0.0)
    return hits.where("(r - 1) % 5 = 0 or drift").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_checked"), F.round(F.avg(differs), 6).alias("divergence"))


@query("w10_stagnation", """select event_id, case r when 5 then 'hint' when 8 then 'warn' else 'stop' end as level from (select event_id, row_number() over w as r, count(distinct event_type) over (partition by user_id order by ts, event_id rows between 7 preceding and current row) as d
  from events window w as (partition by user_id order by ts, event_id)) where r in (5, 8, 12) and d <= 3""")
def w10_stagnation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose last eight steps at step 5, 8 or 12 show few different actions, with a sharper word each time."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = table(spark, sf_dir, "events").select("event_id", F.row_number().over(by).alias("r"), F.size(F.collect_set("event_type").over(by.rowsBetween(-7, 0))).alias("d"))
    level = F.when(F.col("r") == 5, "hint").when(F.col("r") == 8, "warn").otherwise("stop")
    return seen.where("r in (5, 8, 12) and d <= 3").select("event_id", level.alias("level"))


@query("u1_u2_vote_merge", """select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(b.vote, a.vote) as vote from (select doc_id, case when n_chars > 400 then 'keep' else 'drop' end as vote from documents) a
  full join (select doc_id, case when quality = 1 then 'keep' else 'drop' end as vote from labels) b on a.doc_id = b.doc_id""")
def u1_u2_vote_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of two sources put together; the later source wins."""
    vote = lambda keep, rank: F.struct(F.lit(rank).alias("rank"), F.when(keep, "keep").otherwise("drop").alias("vote")).alias("v")
    first = table(spark, sf_dir, "documents").select("doc_id", vote(F.col("n_chars") > 400, 1))
    later = table(spark, sf_dir, "labels").select("doc_id", vote(F.col("quality") == 1, 2))
    return first.unionByName(later).groupBy("doc_id").agg(F.max("v").alias("v")).select("doc_id", "v.vote")


@query("u4_f25s_shared_words", """select conv_id, turn, cast(len(list_intersect(w, coalesce(lag(w) over (partition by conv_id order by turn), []))) as bigint) as n_shared from (select conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{6,}')) as w from conversations)""")
def u4_f25s_shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters or more that a turn shares with the one before."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{6,})"), 1))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.select("conv_id", "turn", F.coalesce(F.size(F.array_intersect("w", before)), F.lit(0)).cast("long").alias("n_shared"))


@query("p3_p4_x21_eligible", """select lang, count(*) as n, max(n_chars) as longest from documents join labels using (doc_id) where quality = 1 and toxic = 0 and n_chars >= 300 group by 1""")
def p3_p4_x21_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that all sources agree on and that are long enough for a guard to judge."""
    agreed = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").where("n_chars >= 300").join(agreed, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query("p17_p18_elements", """select page_id, cast(len(list_filter(l, lambda x: length(x) >= 4 and length(x) <= 12)) as bigint) as n_feasible, cast(len(l) as bigint) as n_links from (select page_id, regexp_extract_all(html, '<a href="/([^"]+)"', 1) as l from pages)""")
def p17_p18_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's links, and those of them that an action could take."""
    links = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), 1).alias("l"))
    return links.select("page_id", F.size(F.filter("l", lambda x: F.length(x).between(4, 12))).cast("long").alias("n_feasible"), F.size("l").cast("long").alias("n_links"))
