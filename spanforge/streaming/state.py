"""Per-run state: latches, budgets, counters and keyed memories, in batch form and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.plans.registry import query
from spanforge.sources.tables import table


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("l1_latch", """select user_id, event_type, min(r) as first_step from (select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as r from events) where value >= 50 group by 1, 2""")
def l1_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step at which each condition held."""
    steps = table(spark, sf_dir, "events").withColumn("step", F.row_number().over(_by_user()).cast("long"))
    return steps.where("value >= 50").groupBy("user_id", "event_type").agg(F.min("step").alias("first_step"))


@query("l2_budget", """select user_id, min(r) as stop_step from (select user_id, row_number() over w as r, sum(cast(floor(value) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding) as spent
  from events window w as (partition by user_id order by ts, event_id)) where r >= 50 or spent >= 500 group by 1""")
def l2_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step at which a cap on steps or on spending is reached."""
    spent = F.sum(F.floor("value")).over(_by_user().rowsBetween(Window.unboundedPreceding, 0))
    steps = table(spark, sf_dir, "events").select("user_id", F.row_number().over(_by_user()).cast("long").alias("step"), spent.alias("spent"))
    return steps.where("step >= 50 or spent >= 500").groupBy("user_id").agg(F.min("step").alias("stop_step"))


@query("l3_no_effect", """select event_id from (select event_id, row_number() over (partition by user_id, event_type, cast(floor(value) as bigint) order by ts, event_id) as n from events) where n > 2""")
def l3_no_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of one action signature after the second."""
    seen = F.row_number().over(Window.partitionBy("user_id", "event_type", F.floor("value")).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", seen.alias("n")).where("n > 2").select("event_id")


@query("l6_memory", """select user_id, cast(count(*) filter (value >= 20) as bigint) as n_good, cast(count(*) filter (value < 20) as bigint) as n_bad,
  arg_max(event_id, struct_pack(a := ts, b := event_id)) filter (value >= 20) as preferred from events group by 1""")
def l6_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes, failures, and the last success of each key."""
    good = F.col("value") >= 20
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(good).alias("n_good"), F.count_if(F.col("value") < 20).alias("n_bad"), F.max_by(F.when(good, F.col("event_id")), F.when(good, F.struct("ts", "event_id"))).alias("preferred")
    )


@query("l8_error_abort", """select user_id, min(r) as abort_step from (select user_id, row_number() over w as r, sum(case when value < 10 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bad
  from events window w as (partition by user_id order by ts, event_id)) where r >= 3 and bad >= 2 and bad > 0.3 * r group by 1""")
def l8_error_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step with at least three attempts, two errors and an error rate over 0.3."""
    bad = F.sum((F.col("value") < 10).cast("int")).over(_by_user().rowsBetween(Window.unboundedPreceding, 0))
    steps = table(spark, sf_dir, "events").select("user_id", F.row_number().over(_by_user()).cast("long").alias("r"), bad.alias("bad"))
    return steps.where("r >= 3 and bad >= 2 and bad > 0.3 * r").groupBy("user_id").agg(F.min("r").alias("abort_step"))


def latch_stream(steps: DataFrame, late: str = "1 hour") -> DataFrame:
    """``l1_latch`` on a stream of (user_id, event_type, ts, value): first passing time of each condition, by hour, with a bound on lateness."""
    return steps.withWatermark("ts", late).where("value >= 50").groupBy(F.window("ts", "1 hour"), "user_id", "event_type").agg(F.min("ts").alias("first_ts"))


def budget_stream(steps: DataFrame, max_steps: int = 50, max_spent: int = 500) -> DataFrame:
    """``l2_budget`` on a stream of (user_id, event_id, ts, value): each run's stopping step, told once.

    State is three numbers a run and never expires within it. Steps count in order of (ts, event_id) inside a batch, and batches in the order they come.
    """

    def stop(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, spent, stopped = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        if not stopped:
            total = spent + rows["value"].fillna(0).floordiv(1).astype("int64").cumsum()
            count = step + pd.RangeIndex(1, len(rows) + 1).to_series(index=rows.index)
            over = (count >= max_steps) | (total >= max_spent)
            if over.any():
                stopped = int(count[over.to_numpy().argmax() : over.to_numpy().argmax() + 1].iloc[0])
                yield pd.DataFrame({"user_id": [key[0]], "stop_step": [stopped]})
            step, spent = int(count.iloc[-1]), int(total.iloc[-1])
        state.update((step, spent, stopped))

    return steps.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(
        stop, "user_id long, stop_step long", "step long, spent long, stopped long", "append", GroupStateTimeout.NoTimeout
    )


@query("l10_watchdog", """select event_id from (select event_id, event_type, ts, coalesce(lead(ts) over (partition by user_id order by ts, event_id), max(ts) over ()) as till from events) where event_type = 'click' and till > ts + interval 1 hour""")
def l10_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as tasks that the same user's next event ends: those that run over an hour, the last ones up to the newest event."""
    events = table(spark, sf_dir, "events")
    newest = F.broadcast(events.agg(F.max("ts").alias("newest")))
    till = F.coalesce(F.lead("ts").over(_by_user()), "newest")
    tasks = events.join(newest, F.lit(True)).select("event_id", "event_type", "ts", till.alias("till"))
    return tasks.where((F.col("event_type") == "click") & (F.col("till") > F.col("ts") + F.expr("interval 1 hour"))).select("event_id")


def watchdog_stream(marks: DataFrame, deadline_ms: int) -> DataFrame:
    """Tasks of a stream of (task_id, status) that a start mark opens and no other mark ends within the deadline, each told once.

    State is one flag an open task; it goes when the task ends or is told. A task may start again.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "error": ["WatchdogTimeout"]})
            return
        statuses = pd.concat(list(batches))["status"]
        if (statuses != "start").any():
            if state.exists:
                state.remove()
        elif not state.exists:
            state.update((True,))
            state.setTimeoutDuration(deadline_ms)

    return marks.select("task_id", "status").groupBy("task_id").applyInPandasWithState(
        watch, "task_id string, error string", "open boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
