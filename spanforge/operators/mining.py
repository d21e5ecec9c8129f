"""Items that several readers of one filing agree on: which filing a record is of, what each reader says of an item, and how far the item can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.registry import query
from spanforge.sources.tables import table

#: Families of forms, and those that records are of; the first day of the later schema, and what the earlier one has not.
FAMILIES = {"10-K": "10K", "10-K405": "10K", "10-KT": "10KT", "10KT405": "10KT", "10-KT405": "10KT", "10KSB": "10KSB", "10-KSB": "10KSB", "10KSB40": "10KSB"}
ANNUAL = ("10K", "10KT")
MODERN_FROM, NOT_EARLIER = "2003-12-15", ("15", "1A", "1B", "9A", "9B")
#: Items of the small business form as items of the annual one.
SMALL_FORM = {"1": "1", "2": "2", "3": "3", "4": "4", "5": "5", "6": "7", "7": "8", "8": "9", "8A": "9A", "8B": "9B", "9": "10", "10": "11", "11": "12", "12": "13", "13": "15"}
#: Words of a shingle, the least share of them in common, the least ratio of lengths, words of furniture, and words of a reserved item.
SHINGLE, LEAST_OVERLAP, LEAST_RATIO, FURNITURE_WORDS, RESERVED_WORDS = 8, 0.6, 0.35, 40, 30
#: Items that a filing must have to be judged, the section and years whose end holds the next item.
LEAST_ITEMS, TAILED, TAILED_YEARS = 5, "section_15", (2016, 2020)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _form(form: Column) -> Column:
    return F.upper(F.trim(F.coalesce(form, F.lit(""))))


def is_amendment(form: Column) -> Column:
    return _form(form).endswith("/A")


def form_family(form: Column) -> Column:
    """The family of a form, amended or not; ``other`` for all that has none."""
    return F.coalesce(F.try_element_at(_map(FAMILIES), F.regexp_replace(_form(form), "/A$", "")), F.lit("other"))


def era_schema(report_date: Column, heading: Column) -> Column:
    """Which items a filing has: what its heading of item 14 speaks of decides, else the day it reports on (ISO)."""
    h = F.lower(F.coalesce(heading, F.lit("")))
    by_day = F.when(F.coalesce(report_date, F.lit("")) >= MODERN_FROM, "MODERN").otherwise("PRE2003")
    return F.when(h.contains("exhibit"), "PRE2003").when(h.contains("accountant") | h.contains("fees"), "MODERN").otherwise(by_day)


def canonical_item(key: Column, schema: Column) -> Column:
    """The item that a column ``section_<item>`` is of under a schema; null where it tells nothing."""
    code = F.upper(F.regexp_extract(F.coalesce(key, F.lit("")), r"(?i)^section_(\d{1,2}[A-C]?)$", 1))
    earlier = F.when(code == "14", "15").when(~code.isin(*NOT_EARLIER), code)
    return F.when(code != "", F.when(schema == "PRE2003", earlier).otherwise(code))


def small_form_item(code: Column) -> Column:
    """The annual form's item for one of the small business form; null where there is none."""
    return F.try_element_at(_map(SMALL_FORM), _form(code))


def without_tail(text: Column, year: Column, key: Column) -> Column:
    """A section's text up to the item 16 that its column holds too in some years."""
    return F.when((F.lower(key) == TAILED) & year.between(*TAILED_YEARS), F.regexp_extract(text, r"(?is)^(.*?)(?:\bitem\s*16\b|\z)", 1)).otherwise(text)


def picked(records: DataFrame, filings: DataFrame) -> DataFrame:
    """The records (rec_id, cik, year, ...) with ``outcome``, ``basis``, ``n_originals``, ``n_amendments`` and, where exactly one original fits, ``one`` (accession, form, report_date).

    A record's year is that of the report, else that of the filing: the first that any annual filing (cik, form, accession, filing_date, report_date) of the company has decides. Originals
    come before amendments; several originals are ambiguous. Filings are counted by company and year before they meet records; dates without a year fit nothing.
    """
    year = lambda c: F.expr(f"try_cast(left({c}, 4) as int)").alias("year")
    usable = filings.where(form_family(F.col("form")).isin(*ANNUAL)).withColumn("amended", is_amendment(F.col("form")))
    dated = usable.select(
        "cik", "accession", "form", "report_date", "amended", F.inline(F.array(F.struct(F.lit(0).alias("by"), year("report_date")), F.struct(F.lit(1).alias("by"), year("filing_date"))))
    ).where("year is not null")
    counted = dated.groupBy("cik", "year", "by").agg(
        F.count_if(~F.col("amended")).alias("n_originals"), F.count_if("amended").alias("n_amendments"), F.min(F.when(~F.col("amended"), F.struct("accession", "form", "report_date"))).alias("one")
    )
    best = counted.groupBy("cik", "year").agg(F.min_by(F.struct("by", "n_originals", "n_amendments", "one"), "by").alias("best"))
    n = F.col("best.n_originals")
    outcome = F.when(F.col("best").isNull(), "not_found").when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("amendment_only")
    return records.join(best, ["cik", "year"], "left").select(
        *records.columns, outcome.alias("outcome"), F.when(F.col("best.by") == 0, "report_date").when(F.col("best.by") == 1, "filing_date").alias("basis"),
        F.coalesce(n, F.lit(0)).alias("n_originals"), F.coalesce("best.n_amendments", F.lit(0)).alias("n_amendments"), F.when(n == 1, F.col("best.one")).alias("one"),
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def _shingles(words: Column) -> Column:
    whole = F.array(F.array_join(words, " "))
    rows = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda k: F.array_join(F.slice(words, k, SHINGLE), " "))
    return F.when(F.size(words) <= SHINGLE, whole).otherwise(F.array_distinct(rows))


def _contained(inner: Column, outer: Column, inner_shingles: Column, outer_shingles: Column) -> Column:
    """The share of a text's shingles that another holds; fewer words than a shingle has must stand there in a row."""
    short = F.contains(F.array_join(outer, " "), F.array_join(inner, " ")).cast("double")
    return F.when(F.size(inner) < SHINGLE, short).otherwise(F.size(F.array_intersect(inner_shingles, outer_shingles)) / F.size(inner_shingles))


def compared(pairs: DataFrame) -> DataFrame:
    """The rows with ``teacher_vote`` and ``engine_vote``: agree, disagree, unavailable or suspect; rows have status, ours, teacher, engine (texts), parsed and suspect.

    A teacher's texts lack tables, so it agrees where our span holds what it has, and only a longer text of it is a cut of ours. An engine must also agree on
    where the item ends. ``suspect`` marks an engine's text as none of the item's; ``parsed`` says that it read the filing, else its vote is null. Null texts are empty.
    """
    sides = ("ours", "teacher", "engine")
    w = {s: F.col(f"_{s}_words") for s in sides}
    sh = {s: F.col(f"_{s}_shingles") for s in sides}
    worded = pairs.select("*", *(_words(F.col(s)).alias(f"_{s}_words") for s in sides))
    rows = worded.select("*", *(_shingles(w[s]).alias(f"_{s}_shingles") for s in sides))
    n = {s: F.size(w[s]) for s in sides}
    inside = lambda a, b: _contained(w[a], w[b], sh[a], sh[b])

    def without(s: str, suspect: Column) -> Column:
        """Where one of the two has no words; null where both have some."""
        ours_only = F.when(n["ours"] == 0, "agree").otherwise("unavailable")
        theirs_only = F.when((F.col("status") == "reserved") & (n[s] < RESERVED_WORDS), "agree").when(suspect, "suspect").otherwise("disagree")
        return F.when(n[s] == 0, ours_only).when(n["ours"] == 0, theirs_only)

    held = F.when(n["teacher"] - n["ours"] > FURNITURE_WORDS, "disagree").when(inside("teacher", "ours") >= LEAST_OVERLAP, "agree").otherwise("disagree")
    shorter, longer = F.least(n["ours"], n["engine"]), F.greatest(n["ours"], n["engine"])
    overlap = F.when(n["ours"] <= n["engine"], inside("ours", "engine")).otherwise(inside("engine", "ours"))
    like = (
        F.when(overlap < LEAST_OVERLAP, F.when(F.col("suspect"), "suspect").otherwise("disagree"))
        .when((shorter / longer < LEAST_RATIO) & (longer - shorter > FURNITURE_WORDS), "disagree").otherwise("agree")
    )
    engine = F.when(F.col("parsed"), F.coalesce(without("engine", F.col("suspect")), like))
    return rows.select(*pairs.columns, F.coalesce(without("teacher", F.lit(False)), held).alias("teacher_vote"), engine.alias("engine_vote"))


def tier(teacher: Column, engine: Column) -> Column:
    """How far an item can be trusted: no agreement of the teacher is no gold, and what an engine cannot tell is no strike."""
    agreed = F.when(engine == "agree", "pseudo_gold_3way").when(engine == "disagree", "hard_case").otherwise("pseudo_gold_2way_corpus_only")
    return F.when(teacher == "disagree", "hard_case").when(teacher == "agree", agreed).otherwise("no_corpus_signal")


def mined(records: DataFrame, filings: DataFrame, items: DataFrame, read: DataFrame) -> DataFrame:
    """What each record's items are worth: (rec_id, outcome, disposition, accession, schema, code, tier, status, teacher_vote, engine_vote, start_offset, end_offset, text_sha256).

    Records are (rec_id, cik, year, sections map<string,string>), filings as in ``picked``, items our own (accession, filing_class, code, status, start_offset, end_offset, heading, text), read those of a
    second engine (accession, code, text, suspect), with a null code for a filing in which it found nothing. Rec_id, and accession with code, are unique. A record without a filing, or whose filing we cannot read
    (no annual form, fewer than five items), is one row with a null code, and so is one that has no item to judge. Offsets and digest are there for gold only.
    """
    found = picked(records, filings).withColumn("accession", F.col("one.accession"))
    own = items.groupBy("accession").agg(F.count(F.lit(1)).alias("n_items"), F.min("filing_class").alias("filing_class"), F.max(F.when(F.col("code") == "14", F.col("heading"))).alias("heading"))
    known = found.join(own, "accession", "left")
    supported = F.coalesce((F.col("filing_class") != "non_10k") & (F.col("n_items") >= LEAST_ITEMS), F.lit(False))
    disposition = F.when(F.col("outcome") != "matched", F.concat(F.lit("hard_case:join_"), "outcome")).when(~supported, "hard_case:our_side_unsupported").otherwise("voted")
    schema = F.when(F.col("outcome") == "matched", era_schema(F.col("one.report_date"), F.col("heading")))
    known = known.select("rec_id", "year", "sections", "outcome", disposition.alias("disposition"), "accession", schema.alias("schema"))
    taught = known.where("disposition = 'voted'").select("rec_id", "year", "accession", "schema", F.explode("sections").alias("key", "said")).where(F.col("said").rlike(r"\S"))
    taught = taught.select("rec_id", "accession", canonical_item(F.col("key"), F.col("schema")).alias("code"), without_tail(F.col("said"), F.col("year"), F.col("key")).alias("teacher")).where("code is not null")
    spans = items.select("accession", "code", "status", "start_offset", "end_offset", F.when(F.col("end_offset") > F.col("start_offset"), F.col("text")).alias("ours"))
    engine = read.where("code is not null").select("accession", "code", F.col("text").alias("engine"), "suspect")
    parsed = read.select("accession").distinct().withColumn("parsed", F.lit(True))
    pairs = taught.join(spans, ["accession", "code"], "left").join(engine, ["accession", "code"], "left").join(parsed, "accession", "left")
    pairs = pairs.fillna({"status": "missing", "suspect": False, "parsed": False})
    voted = compared(pairs).withColumn("tier", tier(F.col("teacher_vote"), F.col("engine_vote")))
    gold = F.col("tier").startswith("pseudo_gold") & (F.col("end_offset") > F.col("start_offset"))
    judged = voted.select(
        "rec_id", "code", "tier", "status", "teacher_vote", "engine_vote", F.when(gold, F.col("start_offset")).alias("start_offset"), F.when(gold, F.col("end_offset")).alias("end_offset"),
        F.when(gold, F.sha2(F.encode("ours", "UTF-8"), 256)).alias("text_sha256"),
    )
    return known.select("rec_id", "outcome", "disposition", "accession", "schema").join(judged, "rec_id", "left")


_CODES = ("1", "1A", "7", "14", "15")


def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, filings, own items and an engine's: the orders as filings of companies, and the documents, each cut in five, as texts of one filing. The tables hold no filings."""
    forms = {"1": "10-K", "2": "10-K/A", "3": "10-K405", "4": "10-KSB", "5": "10-kt "}
    filed = F.add_months(F.col("o_orderdate").cast("date"), 264)
    filings = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("cik"), F.col("o_orderkey").cast("long").alias("accession"), F.try_element_at(_map(forms), F.left("o_orderpriority", F.lit(1))).alias("form"),
        filed.cast("string").alias("filing_date"), F.date_sub(filed, 90).cast("string").alias("report_date"),
    )
    text = F.coalesce("text", F.lit(""))
    width = F.floor(F.length(text) / 5).cast("int")
    parts = F.array(*(F.substring(text, k * width + 1, width) for k in range(4)), F.substring(text, 4 * width + 1, F.length(text)))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("rec_id"), (F.col("doc_id") + 1).cast("long").alias("cik"), (2015 + F.col("doc_id") % 5).cast("int").alias("year"), parts.alias("parts"), width.alias("width"))
    turn = F.col("rec_id") % 4
    told = F.transform("parts", lambda p: F.when(turn == 1, F.replace(p, F.lit(" "), F.lit(" - "))).when(turn == 2, F.reverse(p)).when(turn == 3, F.concat(p, F.lit(" Item 16 "), p)).otherwise(p))
    records = docs.select("rec_id", "cik", "year", F.map_from_arrays(F.array(*(F.lit(f"section_{c}") for c in _CODES)), told).alias("sections"))
    cut = picked(docs, filings).where("outcome = 'matched'").select("rec_id", F.col("one.accession").alias("accession"), "parts", "width", F.posexplode(F.array(*map(F.lit, _CODES))).alias("k", "code"))
    part = F.get("parts", F.col("k"))
    heading = F.when(F.col("rec_id") % 3 == 0, "Exhibits and Reports").when(F.col("rec_id") % 3 == 1, "Principal Accountant Fees")
    start = (F.col("k") * F.col("width")).cast("long")
    items = cut.select(
        "accession", F.when(F.col("rec_id") % 11 == 0, "non_10k").otherwise("standard").alias("filing_class"), "code", F.lit("pass").alias("status"), start.alias("start_offset"),
        (start + F.length(part)).alias("end_offset"), F.when(F.col("code") == "14", heading).alias("heading"), part.alias("text"),
    )
    other = F.when(F.col("rec_id") % 5 == 1, F.get("parts", (F.col("k") + 1) % 5)).otherwise(part)
    read = cut.where("rec_id % 5 <> 0").select("accession", "code", other.alias("text"), ((F.col("rec_id") % 7 == 0) & (F.col("k") >= 3)).alias("suspect"))
    return records, filings, items, read


_SQL = """with f as (select cast(o_custkey as bigint) as cik, cast(o_orderkey as bigint) as accession, left(o_orderpriority, 1) = '2' as amended, cast(cast(o_orderdate as date) + interval 264 month as date) as filed from orders where left(o_orderpriority, 1) <> '4'),
  d as (select *, filed - 90 as report, 0 as b, year(filed - 90) as y from f union all select *, filed - 90, 1, year(filed) from f),
  c as (select cik, y, b, count(*) filter (not amended) as n, min(accession) filter (not amended) as accession, arg_min(report, accession) filter (not amended) as report from d group by 1, 2, 3),
  best as (select * from c qualify row_number() over (partition by cik, y order by b) = 1),
  p as (select cast(doc_id as bigint) as rec_id, coalesce(text, '') as text, length(coalesce(text, '')) // 5 as w, case when n is null then 'not_found' when n = 1 then 'matched' when n > 1 then 'ambiguous' else 'amendment_only' end as outcome,
    case when n = 1 then accession end as accession, 2015 + doc_id % 5 as y, case when n = 1 then case when doc_id % 3 = 0 then 'PRE2003' when doc_id % 3 = 1 or report >= date '2003-12-15' then 'MODERN' else 'PRE2003' end end as schema
    from documents left join best on cik = doc_id + 1 and y = 2015 + doc_id % 5),
  known as (select *, case when outcome <> 'matched' then 'hard_case:join_' || outcome when rec_id % 11 = 0 then 'hard_case:our_side_unsupported' else 'voted' end as disposition from p),
  cut as (select *, [substr(text, 1, w), substr(text, w + 1, w), substr(text, 2 * w + 1, w), substr(text, 3 * w + 1, w), substr(text, 4 * w + 1)] as parts from known where disposition = 'voted'),
  e as (select rec_id, schema, y, w, parts, unnest([1, 2, 3, 4, 5]) as k, unnest(['1', '1A', '7', '14', '15']) as key from cut),
  t as (select *, parts[k] as part, case rec_id % 4 when 1 then replace(parts[k], ' ', ' - ') when 2 then reverse(parts[k]) when 3 then parts[k] || ' Item 16 ' || parts[k] else parts[k] end as told,
    case when schema = 'MODERN' then key when key = '14' then '15' when key not in ('15', '1A') then key end as code from e),
  u as (select rec_id, code, w, case when code = '15' then 5 else k end as own, case when key = '15' and y between 2016 and 2020 then regexp_extract(told, '(?is)^(.*?)(?:\\bitem\\s*16\\b|\\z)', 1) else told end as teacher, parts
    from t where code is not null and regexp_matches(told, '\\S')),
  v as (select rec_id, code, (own - 1) * w as s, parts[own] as ours, rec_id % 5 <> 0 as parsed, rec_id % 7 = 0 and own >= 4 as suspect, [parts[own], teacher, case when rec_id % 5 = 0 then '' when rec_id % 5 = 1 then parts[own % 5 + 1] else parts[own] end] as texts from u),
  ws as (select *, list_transform(texts, lambda x: regexp_extract_all(lower(x), '[a-z0-9]+')) as ww from v),
  sh as (select *, list_transform(ww, lambda x: case when len(x) <= 8 then [array_to_string(x, ' ')] else list_distinct(list_transform(range(1, len(x) - 6), lambda i: array_to_string(x[i:i + 7], ' '))) end) as ss, len(ww[1]) as n1, len(ww[2]) as n2, len(ww[3]) as n3 from ws),
  q as (select *, case when n2 < 8 then contains(array_to_string(ww[1], ' '), array_to_string(ww[2], ' '))::int::double else len(list_intersect(ss[2], ss[1])) / len(ss[2]) end as told_in,
    case when n1 <= n3 then case when n1 < 8 then contains(array_to_string(ww[3], ' '), array_to_string(ww[1], ' '))::int::double else len(list_intersect(ss[1], ss[3])) / len(ss[1]) end
    else case when n3 < 8 then contains(array_to_string(ww[1], ' '), array_to_string(ww[3], ' '))::int::double else len(list_intersect(ss[3], ss[1])) / len(ss[3]) end end as overlap from sh),
  z as (select *, case when n2 = 0 then case when n1 = 0 then 'agree' else 'unavailable' end when n1 = 0 then 'disagree' when n2 - n1 > 40 then 'disagree' when told_in >= 0.6 then 'agree' else 'disagree' end as teacher_vote,
    case when not parsed then null when n3 = 0 then case when n1 = 0 then 'agree' else 'unavailable' end when n1 = 0 then case when suspect then 'suspect' else 'disagree' end when overlap < 0.6 then case when suspect then 'suspect' else 'disagree' end
    when least(n1, n3) / greatest(n1, n3) < 0.35 and abs(n1 - n3) > 40 then 'disagree' else 'agree' end as engine_vote from q),
  g as (select *, case when teacher_vote = 'disagree' then 'hard_case' when teacher_vote <> 'agree' then 'no_corpus_signal' when engine_vote = 'agree' then 'pseudo_gold_3way' when engine_vote = 'disagree' then 'hard_case' else 'pseudo_gold_2way_corpus_only' end as tier from z)
  select known.rec_id, outcome, disposition, accession, schema, code, tier, case when code is not null then 'pass' end as status, teacher_vote, engine_vote, case when gold then s end as start_offset, case when gold then s + length(ours) end as end_offset, case when gold then sha256(ours) end as text_sha256
  from known left join (select *, starts_with(tier, 'pseudo_gold') and length(ours) > 0 as gold from g) g using (rec_id)"""


@query("d22_a5_a56_jn4_mined_gold", _SQL)
def d22_a5_a56_jn4_mined_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold mined from the orders as filings and the documents as their texts."""
    return mined(*_laid_out(spark, sf_dir))
