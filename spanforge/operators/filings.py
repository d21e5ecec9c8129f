"""Rules over filings: bodies that only point elsewhere, headings that stand for two items, declarations by part, later headings inside a body,
officially tagged passages, reported facts, and screens of tasks and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.filings import DECLARATION_ROWS, ITEM_ROWS, declaration_rows, declared_rows
from spanforge.functions.markup import normalized
from spanforge.functions.tags import fragments
from spanforge.operators.references import merged_spans
from spanforge.operators.sections import HEAD_MARGIN, _filed, by_document, candidates, items, plausible
from spanforge.operators.stubs import ELSEWHERE, FEW_NUMBERS, LONG_BODY, NUMBER, POINTS, POINTS_OUTSIDE, SHORT_BODY, TARGETS, stub_target
from spanforge.plans.registry import query
from spanforge.sources.tables import table

#: Openings that make pointers of short documents: the tables hold no filings.
_LEADS = (
    "", "This is incorporated herein by reference to the Proxy Statement. ", "See Note 12 for details. ", "As set forth in Item 7A below. ", "Reference is made to what follows. ",
    "The information appears in our financial statements on pages 12 - 20. ", "Incorporated by reference, with changes, to the Annual Report. ",
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _target_sql() -> str:
    ladder = " ".join(
        f"when regexp_matches(body, {_quoted(p)}, 'i') then "
        + (" || ".join((_quoted(w.partition("{}")[0]), f"regexp_extract(body, {_quoted(p)}, 0, 'i')", _quoted(w.partition("{}")[2]))) if "{}" in w else _quoted(w))
        for p, w in TARGETS
    )
    return (
        f"case when (length(body) <= {SHORT_BODY} and regexp_matches(body, {_quoted(POINTS)}, 'i')) or (length(body) between {SHORT_BODY + 1} and {LONG_BODY} "
        f"and regexp_matches(body, {_quoted(POINTS_OUTSIDE)}, 'i') and len(regexp_extract_all(body, {_quoted(NUMBER)})) < {FEW_NUMBERS}) "
        f"then case {ladder} else {_quoted(ELSEWHERE)} end end"
    )


@query("f14s_stub_targets", f"""select doc_id, {_target_sql()} as target from (select doc_id, [{", ".join(map(_quoted, _LEADS))}][doc_id % {len(_LEADS)} + 1] || text as body from documents)""")
def f14s_stub_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document points at where it is no more than a pointer."""
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("doc_id") % len(_LEADS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", stub_target(F.concat(lead, "text")).alias("target"))


def declarations(docs: DataFrame) -> DataFrame:
    """(doc_id, code, start, end) of the first declaration by part that names an item; the span is the line or lines that it stands in."""
    return by_document(docs, declaration_rows, DECLARATION_ROWS)


def with_declarations(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Sections where a missing item that a declaration names is incorporated by reference, and its span the declaration; no other item changes."""
    named = declarations(docs).withColumnRenamed("start", "_start").withColumnRenamed("end", "_end")
    taken = (F.col("status") == "missing") & F.col("_start").isNotNull()
    pick = lambda new, old: F.when(taken, new).otherwise(F.col(old)).alias(old)
    more = {"provenance": F.lit("cross_reference_pointer"), "needs_review": F.lit(True)}
    return found.join(named, ["doc_id", "code"], "left").select(
        "doc_id", "code", pick(F.lit("incorporated_by_reference"), "status"), pick(F.col("_start"), "start_offset"), pick(F.col("_end"), "end_offset"), "body_chars", "toc_listed",
        *(pick(new, c) for c, new in more.items() if c in found.columns),
    )


def declared_sections(docs: DataFrame) -> DataFrame:
    """``with_declarations`` of the documents' own ``sections``: a narrow map."""
    return by_document(docs, declared_rows, ITEM_ROWS)


@query("d9_part_declarations")
def d9_part_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the documents laid out as filings that end with a declaration; tests hold the rule against known answers."""
    said = "\nPART III\nThe information required by this Part (Items 10, 11, and 12 through 14) is incorporated by reference to the definitive proxy statement.\n"
    filed = _filed(spark, sf_dir).withColumn("text", F.concat("text", F.lit(said)))
    return declared_sections(filed)


def later_headings(spans: DataFrame, margin: int = HEAD_MARGIN) -> DataFrame:
    """(doc_id, code, later, start): the first plausible heading of a later item inside each span (doc_id, code, text); spans without one are left out."""
    key = F.to_json(F.struct("doc_id", "code"))
    keyed = spans.select(key.alias("doc_id"), "text", F.struct("doc_id", "code").alias("span"))
    own = items(spans.sparkSession).select(F.col("code").alias("_code"), F.col("ord").alias("own"))
    hits = plausible(candidates(keyed.select("doc_id", "text"))).where(F.col("start") >= margin).select("doc_id", "ord", "start", F.col("code").alias("later"))
    placed = hits.join(keyed.select("doc_id", "span"), "doc_id").join(F.broadcast(own), F.col("span.code") == F.col("_code")).where("ord > own")
    first = placed.groupBy("span").agg(F.min(F.struct("start", "ord", "later")).alias("first"))
    return first.select("span.doc_id", "span.code", "first.later", "first.start")


@query("p2_x15_later_headings")
def p2_x15_later_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for one item's body, with a heading of the next item put before half of them; tests hold the rule against known answers."""
    text = F.coalesce("text", F.lit(""))
    body = F.concat(F.lit("Item 1. Business\n"), text, F.when(F.col("doc_id") % 2 == 0, "\n\nItem 1A. Risk Factors\n").otherwise("\n\nas in Item 1A. Risk Factors\n"), text)
    return later_headings(table(spark, sf_dir, "documents").select("doc_id", F.lit("1").alias("code"), body.alias("text")))


def text_offset(starts: Column, sources: Column, lengths: Column, raw: Column) -> Column:
    """Where a place in the source falls in the text: at itself where that was kept, else at the next kept character, else at the end.

    Runs are in order, so the first that ends behind the place is found by halving: 31 steps at most, whatever their number.
    """
    n = F.size(sources)
    low = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        behind = F.get(sources, mid) + F.get(lengths, mid) > raw
        narrower = F.struct(F.when(behind, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(behind, mid).otherwise(s["hi"]).alias("hi"))
        return F.when(s["lo"] < s["hi"], narrower).otherwise(s)

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + 1.0)).cast("int") + 1))
    at = F.aggregate(steps, low, halve, lambda s: s["lo"])
    inside = F.get(starts, at) + F.greatest(F.lit(0), raw - F.get(sources, at))
    return F.coalesce(inside, F.get(starts, n - 1) + F.get(lengths, n - 1), F.lit(0)).cast("long")


_PATH = "struct<next:string,path:array<struct<name:string,id:string,next:string,start:bigint,end:bigint,hidden:boolean>>>"


def chains(found: Column) -> Column:
    """For each text block the fragments that its chain of continuations runs through; a chain ends where it would come back to one of its own."""
    steps = F.filter(found, lambda f: f["name"] == "")
    by_id = F.map_from_entries(F.transform(steps, lambda f: F.struct(f["id"], f)))

    def follow(block: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            to = F.when(state["next"] != "", F.try_element_at(by_id, state["next"]))
            seen = F.exists(state["path"], lambda p: (p["name"] == "") & (p["id"] == state["next"]))
            onward = F.struct(to["next"].alias("next"), F.concat(state["path"], F.array(to)).alias("path")).cast(_PATH)
            return F.when(to.isNotNull() & ~seen, onward).otherwise(F.struct(F.lit("").alias("next"), state["path"].alias("path")).cast(_PATH))

        start = F.struct(block["next"].alias("next"), F.array(block).alias("path")).cast(_PATH)
        return F.aggregate(steps, start, step, lambda s: s["path"])

    return F.transform(F.filter(found, lambda f: f["name"] != ""), follow)


def official_spans(pages: DataFrame) -> DataFrame:
    """(page_id, blocks, fragments, hidden, raw_spans, text_spans): the tagged passages that a page shows, merged, in the source and in its text."""
    read = pages.select("page_id", fragments("html").alias("found"), normalized("html").alias("n"))
    linked = read.select("page_id", "n", chains(F.col("found")).alias("chains")).withColumn("parts", F.flatten("chains"))
    shown = merged_spans(F.filter("parts", lambda p: ~p["hidden"] & (p["end"] > p["start"])))
    spans = linked.withColumn("raw_spans", shown)
    place = lambda raw: text_offset(F.col("n.text_start"), F.col("n.raw_start"), F.col("n.length"), raw)
    placed = F.transform("raw_spans", lambda s: F.struct(place(s["start"]).alias("start"), place(s["end"]).alias("end")))
    return spans.select(
        "page_id", F.size("chains").cast("long").alias("blocks"), F.size("parts").cast("long").alias("fragments"), F.size(F.filter("parts", lambda p: p["hidden"])).cast("long").alias("hidden"), "raw_spans", placed.alias("text_spans")
    )


@query("d16_d17_d18_official_spans")
def d16_d17_d18_official_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged passages of the pages, each put into a block with two continuations that lead back, and a hidden block; tests hold the rule against a plain version."""
    opening = F.lit('<ix:nonNumeric name="cyd:RiskTextBlock" id="a" continuedAt="c1">')
    closing = F.lit('</ix:nonNumeric>between<ix:continuation id="c1" continuedAt="c2"><p>more</p></ix:continuation><ix:continuation id="c2" continuedAt="c1">end</ix:continuation>'
                    '<ix:hidden><ix:nonNumeric name="cyd:FlagTextBlock" id="h">unseen</ix:nonNumeric></ix:hidden>')  # fmt: skip
    done = official_spans(table(spark, sf_dir, "pages").select("page_id", F.concat(opening, F.coalesce("html", F.lit("")), closing).alias("html")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return done.select("page_id", "blocks", "fragments", "hidden", joined("raw_spans"), joined("text_spans"))


#: Concepts of each metric, the preferred first, and whether they cover a period or an instant.
CONCEPTS = [
    ("revenue", "RevenueFromContractWithCustomerExcludingAssessedTax", 0, "duration"), ("revenue", "Revenues", 1, "duration"),
    ("revenue", "RevenueFromContractWithCustomerIncludingAssessedTax", 2, "duration"), ("revenue", "SalesRevenueNet", 3, "duration"),
    ("net_income", "NetIncomeLoss", 0, "duration"), ("net_income", "ProfitLoss", 1, "duration"), ("total_assets", "Assets", 0, "instant"),
]


def dashed(accession: Column) -> Column:
    return F.when(accession.contains("-"), accession).otherwise(F.concat_ws("-", F.substring(accession, 1, 10), F.substring(accession, 11, 2), F.substr(accession, F.lit(13))))


def fact_candidates(facts: DataFrame) -> DataFrame:
    """Facts (accn, concept, unit, form, start, ...) in dollars from annual forms and of their concept's kind, with ``metric``; of each filing's
    concepts of a metric only the most preferred one that has any."""
    known = F.broadcast(facts.sparkSession.createDataFrame(CONCEPTS, "metric string, concept string, priority int, kind string"))
    kind = F.when(F.coalesce("start", F.lit("")) != "", "duration").otherwise("instant")
    fit = facts.where((F.col("unit") == "USD") & F.col("form").startswith("10-K")).join(known, "concept").where(kind == F.col("kind"))
    best = F.min("priority").over(Window.partitionBy("accn", "metric"))
    return fit.withColumn("best", best).where("priority = best").drop("best", "priority", "kind")


_CONCEPTS_SQL = "(values " + ", ".join(f"('{m}', '{c}', {p}, '{k}')" for m, c, p, k in CONCEPTS) + ") as k(metric, concept, priority, kind)"
_NAMES = [c for _, c, _, _ in CONCEPTS]


@query("x24_fact_candidates", f"""with f as (select l_orderkey as accn, [{", ".join(map(_quoted, _NAMES))}][l_linenumber] as concept, case l_returnflag when 'R' then 'EUR' else 'USD' end as unit, case when l_quantity < 5 then '10-Q' when l_linestatus = 'O' then '10-K/A' else '10-K' end as form,
  case when l_quantity > 45 then '' else 'known' end as start, l_extendedprice as val from lineitem), c as (select f.*, metric, priority from f join {_CONCEPTS_SQL} on f.concept = k.concept where unit = 'USD' and form like '10-K%' and kind = case when start <> '' then 'duration' else 'instant' end)
  select lpad(cast(accn as varchar), 10, '0') || '-24-000001' as accn, metric, concept, val from c qualify priority = min(priority) over (partition by accn, metric)""")
def x24_fact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as facts of a filing: the tables hold none."""
    names = F.array(*map(F.lit, _NAMES))
    facts = table(spark, sf_dir, "lineitem").select(
        dashed(F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("24000001"))).alias("accn"), F.get(names, (F.col("l_linenumber") - 1).cast("int")).alias("concept"),
        F.when(F.col("l_returnflag") == "R", "EUR").otherwise("USD").alias("unit"), F.when(F.col("l_quantity") < 5, "10-Q").when(F.col("l_linestatus") == "O", "10-K/A").otherwise("10-K").alias("form"),
        F.when(F.col("l_quantity") > 45, "").otherwise("known").alias("start"), F.col("l_extendedprice").alias("val"),
    )
    return fact_candidates(facts).select("accn", "metric", "concept", "val")


#: Words of actions that would enter secrets, and of controls that can't be undone.
SENSITIVE = r"(?i)password|credit\s?card|cvv|card number|\bssn\b|routing number|place order|checkout|pay now"
FINAL_CONTROL = r"(?i)password|checkout|place[-_ ]?order|buy[-_ ]?now|add[-_ ]?to[-_ ]?cart|pay[-_ ]?now|submit[-_ ]?payment"


def screen_action(kind: Column, value: Column, target: Column, typed: Column) -> Column:
    """Category of an action: what it enters, then what it acts on, then "ok". Nulls are empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    enters = kind.isin("fill", "press") & (empty(value).rlike(SENSITIVE) | empty(target).rlike(SENSITIVE))
    keys = (kind == "keyboard") & empty(typed).rlike(SENSITIVE)
    final = kind.isin("click", "download", "press") & empty(target).rlike(FINAL_CONTROL)
    return F.when(enters | keys, "sensitive_input").when(final, "irreversible_action").otherwise("ok")


_ACTIONS = ("fill", "press", "keyboard", "click", "goto")
_WORDS = ("password", "Place Order", "buy now", "checkout", "search")


@query("f37s_action_screen", f"""select category, count(*) as n from (select case when kind in ('fill', 'press') and regexp_matches(blob, {_quoted(SENSITIVE)}) then 'sensitive_input' when kind = 'keyboard' and regexp_matches(blob, {_quoted(SENSITIVE)}) then 'sensitive_input'
  when kind in ('click', 'press') and regexp_matches(blob, {_quoted(FINAL_CONTROL)}) then 'irreversible_action' else 'ok' end as category from (select [{", ".join(map(_quoted, _ACTIONS))}][turn % 5 + 1] as kind, text || ' ' || [{", ".join(map(_quoted, _WORDS))}][conv_id % 5 + 1] as blob from conversations)) group by 1""")
def f37s_action_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as actions of five kinds on five controls: the tables hold none."""
    kind = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("turn") % 5 + 1).cast("int"))
    blob = F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("conv_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "conversations").select(screen_action(kind, F.lit(None).cast("string"), blob, blob).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
