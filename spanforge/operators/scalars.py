"""Scalar forms: slices, code tables, screens by ordered patterns, keys, scores and JSON walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.lines import _LINES, lines_of
from spanforge.plans.registry import query
from spanforge.sources.tables import table

#: Words that carry no meaning of their own.
STOP = ["that", "with", "from", "this", "they", "have", "were", "dans", "pour", "avec", "nicht", "eine", "para", "como"]
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def first_match(text: Column, ladder: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that matches, in the ladder's order."""
    start = F.when(text.rlike(ladder[0][0]), ladder[0][1])
    return reduce(lambda chain, rung: chain.when(text.rlike(rung[0]), rung[1]), ladder[1:], start).otherwise(otherwise)


def _sql_ladder(text: str, ladder: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{p}') then '{n}'" for p, n in ladder) + f" else '{otherwise}' end"


@query("f6s_x17_x20_slices", """select doc_id, text[101:160] as slice, substring(text, greatest(1, n_chars // 2 - 20), 90) as context,
  case when contains(text, chr(10)) then trim(substring(text, instr(text, chr(10)) + 1)) else '' end as body from documents""")
def f6s_x17_x20_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact slice, a window round the middle, and what follows the first line (nothing where there is one line only)."""
    middle = F.greatest(F.lit(1), F.floor(F.col("n_chars") / 2) - 20).cast("int")
    after = F.trim(F.substr("text", F.instr("text", "\n") + 1))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring("text", 101, 60).alias("slice"), F.substr("text", middle, F.lit(90)).alias("context"),
        F.when(F.contains("text", F.lit("\n")), after).otherwise("").alias("body"),
    )


@query("f13s_f15s_f22s_furniture", f"""select doc_id, count(*) filter (regexp_matches(line, '^ *([Pp]age )?[0-9]+ *$') or (length(line) <= 40 and regexp_matches(line, '^[A-Z][A-Z .,&]+$'))) as n_furniture,
  count(*) filter (regexp_matches(lower(trim(line)), '^(none|not applicable|reserved|n/a)[.]?$')) as n_none,
  count(*) filter (len(regexp_extract_all(line, '[0-9]+')) >= 3 and len(regexp_extract_all(line, '[0-9]+')) >= 0.02 * len(regexp_extract_all(line, '[A-Za-z]+'))) as n_junk from {_LINES} group by 1""")
def f13s_f15s_f22s_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page furniture, empty bodies and lines made of references, counted by document."""
    line, numbers, words = F.col("line"), F.regexp_count("line", F.lit("[0-9]+")), F.regexp_count("line", F.lit("[A-Za-z]+"))
    furniture = line.rlike(r"^ *([Pp]age )?[0-9]+ *$") | ((F.length(line) <= 40) & line.rlike("^[A-Z][A-Z .,&]+$"))
    none = F.lower(F.trim(line)).rlike("^(none|not applicable|reserved|n/a)[.]?$")
    return lines_of(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(
        F.count_if(furniture).alias("n_furniture"), F.count_if(none).alias("n_none"), F.count_if((numbers >= 3) & (numbers >= 0.02 * words)).alias("n_junk")
    )


@query("f23s_code_ranges", """with t as (select o_orderkey, o_orderkey % 5 as a, o_orderkey % 7 as b, o_orderkey % 7 + o_orderkey % 4 as c from orders)
  select o_orderkey, cast(code as bigint) as code from (select o_orderkey, a as code from t union select o_orderkey, unnest(range(b, c + 1)) from t)""")
def f23s_code_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerations such as ``Items 4, 1-3``, taken apart into single codes; a range is expanded, and a code named twice counts once."""
    key = F.col("o_orderkey")
    listed = F.concat(F.lit("Items "), key % 5, F.lit(", "), key % 7, F.lit("-"), key % 7 + key % 4)
    parts = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.split(F.regexp_replace(listed, "^Items ", ""), ", ")).alias("part"))
    low, high = F.regexp_extract("part", r"^(\d+)", 1).cast("long"), F.regexp_extract("part", r"(\d+)$", 1).cast("long")
    return parts.select("o_orderkey", F.explode(F.sequence(low, high)).alias("code")).distinct()


#: Family of each priority class.
FAMILIES = {"1-URGENT": "prompt", "2-HIGH": "prompt", "3-MEDIUM": "plain", "5-LOW": "plain"}


@query("f26s_f28s_f31s_f32s_codes", """select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'prompt' when o_orderpriority in ('3-MEDIUM', '5-LOW') then 'plain' else 'other' end as family, o_orderstatus = 'P' as amended,
  cast(case when o_orderkey % 100 >= 50 then 1900 + o_orderkey % 100 else 2000 + o_orderkey % 100 end as bigint) as year,
  case when o_orderkey % 100 between 50 and 99 then 'text' when o_orderkey % 100 < 10 then 'markup' else 'tagged' end as format from orders""")
def f26s_f28s_f31s_f32s_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family by a small code table, amendment mark, year by a pivot of 50, and the format class of that year."""
    pairs = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    short = F.col("o_orderkey") % 100
    year = F.when(short >= 50, 1900 + short).otherwise(2000 + short)
    form = F.when(year < 2000, "text").when(year < 2010, "markup").otherwise("tagged")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.coalesce(F.try_element_at(pairs, "o_orderpriority"), F.lit("other")).alias("family"), (F.col("o_orderstatus") == "P").alias("amended"),
        year.alias("year"), form.alias("format"),
    )


@query("f29s_cut_tail", """select doc_id, case when source in ('src1', 'src2', 'src3') and instr(text, ' the ') > 0 then substring(text, 1, instr(text, ' the ') - 1) else text end as kept from documents""")
def f29s_cut_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polluted sources end where a marker first appears; all others stay whole."""
    at = F.instr("text", " the ")
    cut = F.col("source").isin("src1", "src2", "src3") & (at > 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(cut, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("kept"))


#: Screens in order; the first that matches names the class.
SCREENS = [("[0-9]{3}-[0-9]{4}|@", "contact"), ("https?://", "link"), ("[{}<>;]", "markup"), ("[0-9]", "figures"), ("^[A-Z]", "prose")]


@query("f30s_f37s_f43s_screens", f"""select class, count(*) as n from (select {_sql_ladder("left(text, 500)", SCREENS, "other")} as class from documents) group by 1""")
def f30s_f37s_f43s_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first screen that their head meets."""
    return table(spark, sf_dir, "documents").select(first_match(F.left("text", F.lit(500)), SCREENS, "other").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("f35s_f36s_x5_keywords", f"""select conv_id, turn, case when regexp_extract(text, '"([^"]+)"', 1) <> '' then regexp_extract(text, '"([^"]+)"', 1)
  else array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: not list_contains({_STOP}, w))[1:4], ' ') end as keywords from conversations""")
def f35s_f36s_x5_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quoted phrase, else the first four words that carry meaning."""
    stop = F.array(*map(F.lit, STOP))
    content = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1), lambda w: ~F.array_contains(stop, w))
    quoted = F.regexp_extract("text", '"([^"]+)"', 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(quoted != "", quoted).otherwise(F.array_join(F.slice(content, 1, 4), " ")).alias("keywords"))


@query("f38s_x41_bio_labels", """select item, count(*) as n from (select case when l_linestatus = 'O' then null else upper(l_returnflag || cast(l_linenumber as varchar)) end as item from lineitem) group by 1""")
def f38s_x41_bio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin and inside labels name an item; outside labels name none."""
    marked = F.concat(F.when(F.col("l_linenumber") == 1, "B").otherwise("I"), F.lower("l_returnflag"), F.col("l_linenumber"))
    label = F.when(F.col("l_linestatus") == "O", "O").otherwise(marked)
    item = F.when(label.rlike("^[BI].+"), F.upper(F.substr(label, F.lit(2))))
    return table(spark, sf_dir, "lineitem").select(item.alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("f39s_f42s_page_parts", """select page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1), ''), 'none') as number,
  array_to_string(list_sort(list_filter(regexp_extract_all(html, '<([a-z0-9]+)', 1), lambda t: not regexp_matches(t, '[0-9]') and length(t) <= 5)), ' ') as tags from pages""")
def f39s_f42s_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that an address ends in, and the sorted names of a page's short tags without digits."""
    tags = F.filter(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1), lambda t: ~t.rlike("[0-9]") & (F.length(t) <= 5))
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)(?:[?#].*)?$", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(number, F.lit("none")).alias("number"), F.array_join(F.array_sort(tags), " ").alias("tags"))


@query("f44s_j1_j5_json", """select event_id, cast(props ->> '$.k' as bigint) as k, case when cast(props ->> '$.k' as bigint) % 2 = 0 then event_type else 'none' end as inner_type from events""")
def f44s_j1_j5_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON object in chatter, a path walked in it, and an envelope taken off where there is one."""
    even = F.get_json_object("props", "$.k").cast("long") % 2 == 0
    inner = F.to_json(F.struct(F.col("event_type").alias("type")))
    chatter = F.concat(F.lit("result: "), F.col("props"), F.lit(" done"))
    walked = table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract(chatter, r"(\{[^{}]*\})", 1).alias("object"), F.when(even, F.to_json(F.struct(inner.alias("value")))).otherwise(F.lit('{"type": "none"}')).alias("payload")
    )
    unwrapped = F.coalesce(F.get_json_object("payload", "$.value"), "payload")
    return walked.select("event_id", F.get_json_object("object", "$.k").cast("long").alias("k"), F.get_json_object(unwrapped, "$.type").alias("inner_type"))


@query("j3_j6_key_sets", """select conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(string_split(coalesce(text, ''), '. '), lambda s: lower(left(s, 3))))), '|') as keys from conversations""")
def j3_j6_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct heads of a turn's sentences."""
    heads = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. ", -1), lambda s: F.lower(F.left(s, F.lit(3))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(heads)), "|").alias("keys"))


@query("j7_unnest", """select key, count(*) as n, cast(sum(v) as bigint) as total from (select unnest(['k', 'user']) as key, unnest([cast(props ->> '$.k' as bigint), user_id]) as v from events) group by 1""")
def j7_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's map as rows."""
    fields = F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("long"), F.lit("user"), F.col("user_id"))
    rows = table(spark, sf_dir, "events").select(F.explode(fields).alias("key", "v"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("h2_h3_x8_signatures", """select event_id, left(sha256(event_type || '|' || coalesce(props, '') || '|' || cast(user_id as varchar)), 16) as exact_hash,
  left(sha256(event_type || '|' || regexp_replace(coalesce(props, ''), '[0-9]+', '#', 'g')), 16) as stable_hash, event_type || '|' || cast(cast(floor(value) as bigint) as varchar) as token from events""")
def h2_h3_x8_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact and a drift-tolerant key of 16 hex digits (nulls are empty), and a step's token."""
    props = F.coalesce("props", F.lit(""))
    key = lambda *parts: F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))
    return table(spark, sf_dir, "events").select(
        "event_id", key("event_type", props, F.col("user_id")).alias("exact_hash"), key("event_type", F.regexp_replace(props, "[0-9]+", "#")).alias("stable_hash"),
        F.concat_ws("|", "event_type", F.floor("value")).alias("token"),
    )


@query("m1_heading_score", f"""select doc_id, line_idx, 2.0 * strict + 1.0 * strong + 0.5 * short + 0.25 * upper as score from (select doc_id, line_idx, cast(regexp_matches(line, '^[A-Z][a-z]+[.]$') as int) as strict,
  cast(length(line) between 1 and 40 as int) as strong, cast(length(line) <= 120 as int) as short, cast(regexp_matches(line, '^[A-Z ]+$') as int) as upper from {_LINES}) where strict + strong > 0""")
def m1_heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted signs that a line is a heading, for the lines with one of the two strong signs."""
    sign = lambda c: c.cast("int")
    line = F.col("line")
    signs = lines_of(table(spark, sf_dir, "documents")).select(
        "doc_id", "line_idx", sign(line.rlike(r"^[A-Z][a-z]+[.]$")).alias("strict"), sign(F.length(line).between(1, 40)).alias("strong"),
        sign(F.length(line) <= 120).alias("short"), sign(line.rlike("^[A-Z ]+$")).alias("upper"),
    )
    score = 2.0 * F.col("strict") + 1.0 * F.col("strong") + 0.5 * F.col("short") + 0.25 * F.col("upper")
    return signs.where("strict + strong > 0").select("doc_id", "line_idx", score.alias("score"))


@query("m3_x19_components", """select doc_id, round(sum(score) / sum(top), 6) as confidence, count(*) as n_parts from (select doc_id, unnest(['length', 'start', 'end', 'lines']) as part,
  unnest([case when n_chars between 50 and 3000000 then 1.0 else 0.0 end, case when regexp_matches(text, '^[A-Z]') then 2.0 else 1.0 end, case when regexp_matches(text, '[.]$') then 1.0 else 0.0 end,
  least(3, len(string_split(text, chr(10)))) / 3.0]) as score, unnest([1.0, 2.0, 1.0, 1.0]) as top from documents union all
  select doc_id, 'guard', 0.0, 3.5 from documents where n_chars > 5000) group by 1""")
def m3_x19_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence as points over possible points; a guard that fires adds one component of 3.5 points without any score, once."""
    part = lambda name, score, top: F.struct(F.lit(name).alias("part"), score.cast("double").alias("score"), F.lit(float(top)).alias("top"))
    text = F.col("text")
    parts = F.array(
        part("length", F.when(F.col("n_chars").between(50, 3000000), 1).otherwise(0), 1), part("start", F.when(text.rlike("^[A-Z]"), 2).otherwise(1), 2),
        part("end", F.when(text.rlike("[.]$"), 1).otherwise(0), 1), part("lines", F.least(F.lit(3), F.size(F.split(text, "\n", -1))) / 3, 1),
    )
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.inline(parts)).unionByName(docs.where("n_chars > 5000").select("doc_id", F.inline(F.array(part("guard", F.lit(0), 3.5)))))
    return rows.groupBy("doc_id").agg(F.round(F.sum("score") / F.sum("top"), 6).alias("confidence"), F.count(F.lit(1)).alias("n_parts"))


@query("m8_m9_l11_costs", """select conv_id, turn, round(n * 0.00000015 + m * 0.0000006, 9) as usd, cast(least(600, 60 + 15 * steps) as bigint) as timeout_s, cast(steps as bigint) as steps from (
  select conv_id, turn, length(text) // 4 as n, len(string_split(text, ' ')) as m, case when turn > 5 then turn when role = 'system' then 25 when role = 'user' then 15 else 8 end as steps from conversations where text is not null)""")
def m8_m9_l11_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a turn's tokens, its step budget (own value, else that of its tier, else 8), and a deadline that grows with the budget."""
    tier = F.when(F.col("role") == "system", 25).when(F.col("role") == "user", 15)
    steps = F.coalesce(F.when(F.col("turn") > 5, F.col("turn")), tier, F.lit(8)).cast("long")
    usd = F.floor(F.length("text") / 4) * 0.00000015 + F.size(F.split("text", " ", -1)) * 0.0000006
    priced = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.round(usd, 9).alias("usd"), steps.alias("steps"))
    return priced.withColumn("timeout_s", F.least(F.lit(600), 60 + 15 * F.col("steps")))


@query("x1_x3_history_rows", """select conv_id, turn, left(trim(regexp_replace(replace(coalesce(text, ''), '|', '/'), '[ \\t\\r\\n]+', ' ', 'g')), 120) || ' [' || case when role = 'user' then 'ask' else coalesce(nullif(role, ''), 'none') end || ']' as entry from conversations""")
def x1_x3_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn as one line of history: bars and white space cleaned, capped, with its kind."""
    clean = F.trim(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("/")), r"[ \t\r\n]+", " "))
    kind = F.when(F.col("role") == "user", "ask").otherwise(F.coalesce(F.nullif("role", F.lit("")), F.lit("none")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.left(clean, F.lit(120)), F.lit(" ["), kind, F.lit("]")).alias("entry"))


@query("x16_f5s_clean_slice", f"""select doc_id, string_agg(line, chr(10) order by line_idx) as clean from {_LINES} where not regexp_matches(line, '^[A-Z][a-z]+[.]?$') group by 1""")
def x16_f5s_clean_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a whole text without those of a single word, joined again in order."""
    kept = lines_of(table(spark, sf_dir, "documents")).where(~F.col("line").rlike("^[A-Z][a-z]+[.]?$"))
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("clean"))


@query("x18_following_line", f"""select doc_id, line_idx, lead(line_idx) over (partition by doc_id order by line_idx) as following from {_LINES} where trim(line) <> ''""")
def x18_following_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next line that isn't blank."""
    full = lines_of(table(spark, sf_dir, "documents")).where(F.trim("line") != "")
    return full.select("doc_id", "line_idx", F.lead("line_idx").over(Window.partitionBy("doc_id").orderBy("line_idx")).alias("following"))


#: Hosts left out, with the reason.
DENIED = [("\\.net$", "network"), ("^m\\.", "mobile"), ("^www\\.", "mirror")]


@query("p12_x35_exclusions", f"""select reason, count(*) as n, count(distinct host) as n_hosts from (select host, {_sql_ladder("host", DENIED, "kept")} as reason from (select lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host from pages)) group by 1""")
def p12_x35_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages kept, and pages left out by reason."""
    hosts = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"))
    return hosts.groupBy(first_match(F.col("host"), DENIED, "kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("n_hosts"))


#: Signs of trouble outside the task, in order.
ENVIRONMENT = [("code 4[0-9]$", "blocked"), ("code 5[0-9]$", "server"), ("code [0-9]$", "timeout")]


@query("p13_x43_environment", f"""select user_id, bucket, count(*) as n from (select user_id, case when event_type = 'purchase' then 'none' else {_sql_ladder("event_type || ' code ' || (props ->> '$.k')", ENVIRONMENT, "task")} end as bucket from events) group by 1, 2""")
def p13_x43_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by cause; a pass is never blamed on the environment."""
    message = F.concat_ws(" code ", "event_type", F.get_json_object("props", "$.k"))
    bucket = F.when(F.col("event_type") == "purchase", "none").otherwise(first_match(message, ENVIRONMENT, "task"))
    return table(spark, sf_dir, "events").groupBy("user_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_p16_x2_answers", """select conv_id, turn, lower(trim(coalesce(text, ''))) not in ('', 'none', 'n/a', 'unknown', 'done') as meaningful,
  case when role = 'user' then 'ask' when length(text) > 400 then 'explain' when contains(text, chr(10)) then 'list' else 'reply' end as purpose from conversations""")
def p15_p16_x2_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn says anything, and what it is for."""
    said = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    purpose = F.when(F.col("role") == "user", "ask").when(F.length("text") > 400, "explain").when(F.contains("text", F.lit("\n")), "list").otherwise("reply")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (~said.isin("", "none", "n/a", "unknown", "done")).alias("meaningful"), purpose.alias("purpose"))
