"""Operator 13: audit of how far the sources of a language diverge in their words.

Plain relational. Terms are exploded from regular expression matches and counted by language, source and term; a language's groups are crossed
with the vocabulary it keeps, so that every group has every kept term, absent ones with count 0; each gives a smoothed share of a thousand million.
A self-join on language and term sums the distances of two sources, and a window ranks them; another ranks the terms that a group has more of
than its language.

Scale: matches are counted before any shuffle, with the number of documents they stand in (the first match of a document counts for it), so frequent
terms and large sources move as one row a task. Vocabulary meets groups on language and a part of it that the term's hash gives, so that no language is
one task. The self-join holds each pair of sources once. Its rows are pairs of sources times kept terms, which the sums by pair take in before they move.
Counts are decimals where products may pass 64 bits.

Edge cases: null text, lang and source count as ''; repeated rows count as often as they stand there; ids are not read; other columns are ignored;
a group without terms still has its pairs, and a language without kept terms has pairs of value 0; equal values rank by item; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import table, written

#: Runs of ASCII letters and of characters beyond ASCII, and what stands between them.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term stands in; what is added to each count; terms reported for a group.
LEAST_DOCS, SMOOTHING, TOP_TERMS = 30, 5, 50
SCALE = 1_000_000_000
#: Parts of a language's vocabulary when it meets the groups.
PARTS = 64


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): matches, and documents with one; a group without terms has a row with term null."""
    ascii_only = F.octet_length("text") == F.char_length("text")
    low = F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    words = F.sort_array(F.array_remove(F.split(low, BETWEEN), ""))  # the matches of TERM, seven times as fast as regexp_extract_all
    marked = F.transform("words", lambda w, i: F.struct(w.alias("term"), F.when((i > 0) & (F.get("words", i - 1) == w), 0).otherwise(1).alias("first")))
    return (
        docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
        .select("lang", "source", words.alias("words"))
        .select("lang", "source", F.explode_outer(marked).alias("m"))
        .groupBy("lang", "source", F.col("m.term").alias("term"))
        .agg(F.count("m.term").alias("n"), F.coalesce(F.sum("m.first"), F.lit(0)).alias("df"))
    )


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), exact; 0 where there are no terms."""
    above = (n + F.lit(SMOOTHING)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(SMOOTHING) * terms).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, below)).otherwise(0)


def dense_shares(docs: DataFrame, least_docs: int = LEAST_DOCS, parts: int = PARTS) -> DataFrame:
    """(lang, source, term, n, p, q): each group with each kept term of its language, and with term null, which only says that the group is there.

    p is the share of the term in the group and q the one in the language.
    """
    counts = written(_counts(docs))
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang")).where(F.col("df") >= least_docs)
    vocabulary = written(vocabulary.drop("df"))
    languages = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    kept = counts.join(vocabulary, ["lang", "term"]).drop("n_lang", "df")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "terms", "total_lang"])
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    crossed = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(vocabulary.withColumn("part", part), ["lang", "part"])
    filled = crossed.drop("part").join(kept, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shared = filled.select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"))
    none = F.lit(0).cast("long")
    return shared.unionByName(groups.select("lang", "source", F.lit(None).cast("string").alias("term"), none.alias("n"), none.alias("p"), none.alias("q")))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, parts: int = PARTS) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of each group's language by distance, and the terms it has more of."""
    dense = written(dense_shares(docs, least_docs, parts))
    left = dense.select("lang", F.coalesce("term", F.lit("")).alias("term"), "source", "p")  # no term is empty
    right = left.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"))
    once = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("p2"))).alias("value"))
    both = once.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    first, second = F.when(F.col("side") == 0, F.col("source")).otherwise(F.col("item")), F.when(F.col("side") == 0, F.col("item")).otherwise(F.col("source"))
    pairs = both.select("lang", first.alias("source"), F.lit("pair").alias("part"), second.alias("item"), "value")
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language of all documents, and the terms that set each source apart."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH matches AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words
  FROM documents
),
groups AS (SELECT DISTINCT lang, source FROM matches),
counted AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM matches) GROUP BY ALL),
vocabulary AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM matches) GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN vocabulary t USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
),
shares AS (
  SELECT lang, source, term, n,
    1 + ({SCALE}::HUGEINT * (n + {SMOOTHING})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTHING} * v)::HUGEINT AS p,
    1 + ({SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {SMOOTHING})) // (sum(n) OVER (PARTITION BY lang) + {SMOOTHING} * v)::HUGEINT AS q
  FROM dense JOIN sizes USING (lang)
),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
