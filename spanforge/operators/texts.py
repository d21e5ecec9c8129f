"""Normal forms of texts, ordered classifiers, and joins of texts by their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.lines import shingles_of, words_of
from spanforge.plans.registry import query
from spanforge.sources.tables import table


def worded(text: Column) -> Column:
    """Lower case with every run of other characters than letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


_WORDED = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"


@query("f19s_f20s_f41s_norms", f"""select conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g') as alnum, {_WORDED} as worded,
  regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r]+', ' ', 'g') as spaced from conversations""")
def f19s_f20s_f41s_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three normal forms: ASCII letters and digits only, words with single spaces, and single white space. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.regexp_replace(F.lower(text), "[^a-z0-9]+", "").alias("alnum"), worded(text).alias("worded"), F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " ").alias("spaced")
    )


@query("f40s_preview", """select doc_id, coalesce(left(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) >= 8)[1], 70), '') as preview from documents""")
def f40s_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of at least eight characters, cut at 70; empty where there is none."""
    useful = F.filter(F.split("text", "\n", -1), lambda line: F.length(F.trim(line)) >= 8)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.left(F.get(useful, F.lit(0)), F.lit(70)), F.lit("")).alias("preview"))


def robust_contains(needle: Column, hay: Column) -> Column:
    """Whether a worded text holds another: as it stands, by all its tokens (two or more of two letters or more), or without its spaces (five characters or more)."""
    tokens = F.filter(F.split(needle, " "), lambda t: F.length(t) >= 2)
    glued = F.replace(needle, F.lit(" "), F.lit(""))
    by_tokens = (F.size(tokens) >= 2) & (F.size(F.array_except(tokens, F.split(hay, " "))) == 0)
    by_glue = (F.length(glued) >= 5) & F.contains(F.replace(hay, F.lit(" "), F.lit("")), glued)
    return (needle != "") & (F.contains(hay, needle) | by_tokens | by_glue)


@query("f21s_u6_contains", f"""select conv_id, turn, needle <> '' and (contains(hay, needle) or (len(tokens) >= 2 and list_has_all(string_split(hay, ' '), tokens))
  or (length(replace(needle, ' ', '')) >= 5 and contains(replace(hay, ' ', ''), replace(needle, ' ', '')))) as found from (
  select h.conv_id, h.turn, h.w as hay, f.needle, list_filter(string_split(f.needle, ' '), lambda t: length(t) >= 2) as tokens
  from (select conv_id, turn, {_WORDED} as w from conversations) h join (select conv_id, array_to_string(string_split({_WORDED}, ' ')[1:2], ' ') as needle from conversations where turn = 0) f
  on h.conv_id = f.conv_id)""")
def f21s_u6_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns hold the first two words of their conversation in some form."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", worded(F.coalesce("text", F.lit(""))).alias("hay"))
    first = turns.where("turn = 0").select("conv_id", F.array_join(F.slice(F.split("hay", " "), 1, 2), " ").alias("needle"))
    return turns.join(first, "conv_id").select("conv_id", "turn", robust_contains(F.col("needle"), F.col("hay")).alias("found"))


@query("f27s_era", """select o_orderkey, case when o_orderpriority like '1-%' then 'modern' when o_orderpriority like '5-%' then 'legacy'
  when o_orderdate >= timestamp '1996-06-15' then 'modern' when o_orderdate is null then 'unknown' else 'legacy' end as era from orders""")
def f27s_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which schema a record follows: its own words beat the cut-off date."""
    era = (
        F.when(F.col("o_orderpriority").startswith("1-"), "modern").when(F.col("o_orderpriority").startswith("5-"), "legacy")
        .when(F.col("o_orderdate") >= F.lit("1996-06-15").cast("timestamp"), "modern").when(F.col("o_orderdate").isNull(), "unknown").otherwise("legacy")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", era.alias("era"))


@query("f34s_level", """select o_orderkey, case when n <= 2 then 'easy' when n <= 5 then 'medium' else 'hard' end as level
  from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1)""")
def f34s_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty by number of steps; lines are counted before the join, so it moves one row an order."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    steps = table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return steps.select("o_orderkey", F.when(F.col("n") <= 2, "easy").when(F.col("n") <= 5, "medium").otherwise("hard").alias("level"))


#: Signal words of each language.
SIGNALS = {"en": [" the ", " and ", "that ", "with "], "de": [" der ", "ung ", "keit ", " die "]}


def topic_verdict(text: Column, signals: Column) -> Column:
    """One signal is enough for under 400 characters, otherwise two."""
    n = F.size(F.filter(signals, lambda s: F.contains(F.lower(text), s)))
    need = F.when(F.length(text) < 400, 1).otherwise(2)
    return F.when(signals.isNull(), "skipped").when(F.trim(text) == "", "boilerplate").when(n >= need, "consistent").when(n > 0, "weak").otherwise("inconsistent")


@query("p19_topic", """select doc_id, case when s is null then 'skipped' when trim(t) = '' then 'boilerplate' when n >= case when length(t) < 400 then 1 else 2 end then 'consistent' when n > 0 then 'weak' else 'inconsistent' end as verdict
  from (select *, len(list_filter(s, lambda x: contains(lower(t), x))) as n from (select doc_id, coalesce(text, '') as t,
  case lang when 'en' then [' the ', ' and ', 'that ', 'with '] when 'de' then [' der ', 'ung ', 'keit ', ' die '] end as s from documents))""")
def p19_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text speaks as its label says, by signal words."""
    signals = F.lit(None).cast("array<string>")
    for lang, words in SIGNALS.items():
        signals = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(signals)
    return table(spark, sf_dir, "documents").select("doc_id", topic_verdict(F.coalesce("text", F.lit("")), signals).alias("verdict"))


@query("jn6_containment", """with b as (select item_id, unnest(s) as s, len(s) as n from (select item_id, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) as s
  from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark) where len(w) >= 8)),
  d as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) as s from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents) where len(w) >= 8)
  select item_id, doc_id, round(count(*) / max(n), 6) as containment from b join d using (s) group by 1, 2 having count(*) >= 0.5 * max(n)""")
def jn6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an item's runs of eight words: a hash join on the runs, and shorter texts have none."""
    worded_rows = lambda name, key: table(spark, sf_dir, name).select(key, words_of(F.col("text")).alias("w")).where(F.size("w") >= 8)
    items = worded_rows("benchmark", "item_id").select("item_id", shingles_of(F.col("w")).alias("all"))
    items = items.select("item_id", F.size("all").alias("n"), F.explode("all").alias("run"))
    docs = worded_rows("documents", "doc_id").select("doc_id", F.explode(shingles_of(F.col("w"))).alias("run"))
    hits = docs.join(items, "run").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"))
    return hits.where("hits >= 0.5 * n").select("item_id", "doc_id", F.round(F.col("hits") / F.col("n"), 6).alias("containment"))


@query("j4_tail_excerpts", """select conv_id, turn, cast(least(n, 2500 - before) as bigint) as n_kept from (select conv_id, turn, length(coalesce(text, '')) as n, row_number() over w as r,
  coalesce(sum(length(coalesce(text, ''))) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as before
  from conversations window w as (partition by conv_id order by turn desc)) where r <= 10 and before < 2500""")
def j4_tail_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten turns as far as 2500 characters go, the newest first and the last one cut."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    before = F.coalesce(F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sized.select("conv_id", "turn", "n", F.row_number().over(newest).alias("r"), before.alias("before"))
    return ranked.where("r <= 10 and before < 2500").select("conv_id", "turn", F.least("n", 2500 - F.col("before")).cast("long").alias("n_kept"))
