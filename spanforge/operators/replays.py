"""Actions of a run as steps that a later session can take again, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.registry import query
from spanforge.sources.tables import table

#: An element's number of one look at a page, actions on elements, the key of a press without one.
HANDLE, ON_ELEMENTS, DEFAULT_KEY = r'^\[data-aid="(\d+)"\]$', ("click", "fill", "press", "extract_text", "download"), "Enter"

STEP = "struct<action:string,value:string,key:string,selector:string,element_hash:string,element_hash_stable:string,label:string>"
ACTION = "struct<kind:string,url:string,text:string,keys:string,target:string,value:string>"
#: What a look at a page holds of each element.
SEEN = "array<struct<number:int,css:string,hash:string,stable:string,visible:boolean>>"


def step_of(action: Column, seen: Column, label: Column) -> Column:
    """The step of an action (``ACTION``) on a page with these elements (``SEEN``); null for one that cannot be taken again in another session.

    Elements are kept by their lasting selector and two hashes, for their numbers mean nothing later. A target that is none of the elements seen, and an action of
    another kind, give null; a download without a target needs none.
    """
    kind, empty = action["kind"], F.lit("")
    text = lambda c: F.coalesce(action[c], empty)
    number = F.regexp_extract(text("target"), HANDLE, 1)
    element = F.get(F.filter(seen, lambda e: e["number"].cast("string") == F.regexp_replace(number, "^0+(?=.)", "")), F.lit(0))

    def step(value: Column, key: Column, element: Column | None = None) -> Column:
        of = (lambda c: F.coalesce(element[c], empty)) if element is not None else lambda c: empty
        return F.struct(kind, value, key, of("css"), of("hash"), of("stable"), F.coalesce(label, empty)).cast(STEP)

    plain = F.when(kind == "goto", step(text("url"), empty)).when(kind == "keyboard", step(text("text"), text("keys"))).when((kind == "download") & action["target"].isNull(), step(text("url"), empty))
    value = F.when(kind == "fill", text("value")).when(kind == "download", text("url")).otherwise(empty)
    return plain.when(kind.isin(*ON_ELEMENTS) & element.isNotNull(), step(value, F.when(kind == "press", text("keys")).otherwise(empty), element))


def action_of(step: Column, seen: Column) -> Column:
    """The action that takes a step again on a page as it is now, null where nothing addresses its element any more.

    The element is the one visible element with the step's hash, else the one with its stable hash, where there is exactly one; else what its selector finds.
    """
    kind, none = step["action"], F.lit(None).cast("string")

    def only(field: str, want: Column) -> Column:
        hits = F.filter(seen, lambda e: e["visible"] & (e[field] == want))
        return F.when((want != "") & (F.size(hits) == 1), F.concat(F.lit('[data-aid="'), F.get(hits, F.lit(0))["number"].cast("string"), F.lit('"]')))

    selector = F.coalesce(only("hash", step["element_hash"]), only("stable", step["element_hash_stable"]), F.nullif(step["selector"], F.lit("")))

    def action(url: Column = none, text: Column = none, keys: Column = none, target: Column = none, value: Column = none) -> Column:
        return F.struct(kind, url, text, keys, target, value).cast(ACTION)

    whole = F.when(kind == "goto", action(url=step["value"])).when(kind == "keyboard", action(text=step["value"], keys=step["key"]))
    whole = whole.when((kind == "download") & (step["selector"] == "") & (step["element_hash"] == ""), action(url=step["value"]))
    on = F.when(kind == "fill", action(target=selector, value=step["value"])).when(kind == "press", action(target=selector, keys=F.coalesce(F.nullif(step["key"], F.lit("")), F.lit(DEFAULT_KEY))))
    on = on.when(kind == "download", action(target=selector, url=step["value"])).when(kind.isin("click", "extract_text"), action(target=selector))
    return F.when(whole.isNotNull(), whole).when(selector.isNotNull(), on)


def banked(actions: DataFrame) -> DataFrame:
    """(run_id, steps, bankable) of runs of actions (run_id, step, action, seen, label): their steps in order, and whether all of them can be taken again."""
    made = actions.select("run_id", F.struct("step", step_of(F.col("action"), F.col("seen"), F.col("label")).alias("made")).alias("s"))
    return made.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["made"]).alias("steps"), F.bool_and(F.col("s.made").isNotNull()).alias("bankable"))


#: Event types stand for kinds of action: the tables hold none.
_KINDS = {"view": "goto", "click": "click", "signup": "fill", "purchase": "press", "error": "scroll"}
_KIND_SQL = "case event_type " + " ".join(f"when '{e}' then '{k}'" for e, k in _KINDS.items()) + " end"


@query("x11_replay_steps", f"""with e as (select event_id, user_id, {_KIND_SQL} as kind, cast(floor(value) as bigint) % 7 as n, cast(floor(value) as bigint) as v from events),
  s as (select *, kind in ('goto') or (kind in ('click', 'fill', 'press') and n between 1 and 5) as ok, n + 1 as now_n from e)
  select event_id, ok, case when ok then case kind when 'goto' then cast(v as varchar) when 'fill' then 'typed ' || v else '' end end as value, case when ok then case kind when 'press' then case when v % 2 = 0 then 'Tab' else '' end else '' end end as key,
  case when ok and kind <> 'goto' then '#e' || n when ok then '' end as selector, case when ok and kind <> 'goto' then case when n = 3 then '[data-aid="13"]' when n = 4 then '#e4' else '[data-aid="' || (10 + n) || '"]' end end as again,
  bool_and(ok) over (partition by user_id) as bankable from s""")
def x11_replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions: each as a step, the element that the step finds on the page as it is later, and whether its user's run can be banked.

    Later elements have other numbers; two share a hash, of which the stable one tells one apart, and two share both.
    """
    def element(n: int, number: int, h: str, stable: str) -> Column:
        return F.struct(F.lit(number), F.lit(f"#e{n}"), F.lit(h), F.lit(stable), F.lit(True))

    seen = F.array(*(element(n, n, f"h{n}" if n != 2 else "h1x", f"s{n}") for n in range(1, 6))).cast(SEEN)
    later = F.array(
        element(1, 11, "h1", "s1"), element(2, 12, "h1x", "s2"), element(3, 13, "h9", "s3"), element(4, 14, "h4", "s4"), element(4, 15, "h4", "s4"), element(5, 15, "h5", "s5"), element(6, 16, "h6", "s6"),
    ).cast(SEEN)
    v = F.floor("value").cast("long")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), F.col("event_type"))
    target = F.concat(F.lit('[data-aid="'), (v % 7).cast("string"), F.lit('"]'))
    action = F.struct(kind, v.cast("string"), F.lit(""), F.when(v % 2 == 0, "Tab").otherwise(""), F.when(kind.isin(*ON_ELEMENTS), target), F.concat(F.lit("typed "), v.cast("string"))).cast(ACTION)
    steps = table(spark, sf_dir, "events").select("event_id", "user_id", step_of(action, seen, F.lit("")).alias("s"))
    runs = steps.groupBy("user_id").agg(F.bool_and(F.col("s").isNotNull()).alias("bankable")).withColumnRenamed("user_id", "_user")
    joined = steps.join(runs, F.col("user_id").eqNullSafe(F.col("_user")))
    return joined.select("event_id", F.col("s").isNotNull().alias("ok"), "s.value", "s.key", "s.selector", action_of(F.col("s"), later)["target"].alias("again"), "bankable")
