"""Runs: event logs with numbers, states folded from events, reuse of earlier results, snapshots, prompts that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a stage, and the states of a task in the order in which they may follow.
STAGE_EVENTS = {"stage_started": "running", "stage_succeeded": "done", "stage_failed": "failed", "stage_skipped": "skipped"}
TASK_STATES = ("created", "queued", "running", "finishing", "done", "failed")


def number_events(events: DataFrame) -> DataFrame:
    """Events (run, ts, id, ..) with ``seq`` from 1 in order of time within their run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run").orderBy("ts", "id")).cast("long"))


def last_seq(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("run").agg(F.max("seq").alias("last_seq"))


def stage_states(numbered: DataFrame) -> DataFrame:
    """(run, stage, state, attempts, elapsed_ms): the state that the last event of a stage leaves; the time is that of finished attempts."""
    state = F.create_map(*[F.lit(x) for kv in STAGE_EVENTS.items() for x in kv])
    rows = numbered.withColumn("state", F.try_element_at(state, F.col("event"))).where("state is not null")
    order = Window.partitionBy("run", "stage").orderBy("seq")
    begun = F.last(F.when(F.col("state") == "running", F.col("ts_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    took = F.when(F.col("state").isin("done", "failed") & (F.lag("state").over(order) == "running"), F.col("ts_ms") - begun)
    rows = rows.withColumn("took", took)
    return rows.groupBy("run", "stage").agg(F.max_by("state", "seq").alias("state"), F.count_if(F.col("state") == "running").alias("attempts"), F.coalesce(F.sum("took"), F.lit(0)).alias("elapsed_ms"))


def run_metrics(states: DataFrame) -> DataFrame:
    """(run, done, failed, running, skipped, elapsed_ms, first_open): counts by state and the first stage by name that isn't finished."""
    return states.groupBy("run").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "running", "skipped")], F.sum("elapsed_ms").alias("elapsed_ms"), F.min(F.when(F.col("state").isin("running", "failed"), F.col("stage"))).alias("first_open"))


def advance_tasks(requests: DataFrame) -> DataFrame:
    """Requests (task, at, state) with whether each is accepted: a task only moves forward, never out of done or failed.

    So the state before a request is the furthest one asked for before it, up to the first end.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in TASK_STATES]), F.col("state"))
    order = Window.partitionBy("task").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.when(F.col("state").isin("done", "failed"), 1)).over(order), F.lit(0)) == 1
    furthest = F.coalesce(F.max(F.when(F.col("state") != "failed", rank)).over(order), F.lit(0))
    return requests.withColumn("accepted", ~ended & (rank > 0) & ((F.col("state") == "failed") | (rank > furthest)))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, kept apart; null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"), 256)


def reuse(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (request, fingerprint) against a cache (fingerprint, status, artifact_hash, actual_hash): hit, or why a result can't be used again."""
    rows = requests.join(cache, "fingerprint", "left")
    verdict = F.when(F.col("status").isNull(), "miss").when(F.col("status") != "ok", "not_ok").when(~F.col("artifact_hash").eqNullSafe(F.col("actual_hash")), "changed_artifact").otherwise("hit")
    return rows.select("request", verdict.alias("verdict"))


def changed_keys(before: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, changed): which columns of a snapshot differ, by name; null equals null. Keys on one side only are named so."""
    a, b = (df.select(key, F.lit(True).alias(f"_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for df, s in ((before, "a"), (now, "b")))
    rows = a.join(b, key, "full")
    names = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in columns]))
    changed = F.when(F.col("_a").isNull(), "only_now").when(F.col("_b").isNull(), "only_before").otherwise(F.array_join(names, ","))
    return rows.select(key, changed.alias("changed")).where("changed <> ''")


def fill(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` replaced by columns."""
    text = F.lit(template)
    for name, part in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), part)
    return text
