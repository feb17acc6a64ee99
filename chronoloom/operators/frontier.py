"""Retries as frontiers: rounds over only those requests that are still open, with a row of lineage for each attempt.

A round is written to the shared folder before the next one begins, so a lost executor costs its tasks only. The number of rounds has a bound of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.scan import running
from chronoloom.operators.tables import written

Attempt = Callable[[DataFrame], DataFrame]


def split_on_length(items: DataFrame, attempt: Attempt, most_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lineage, outputs) of requests (request_id, pos, ..), one row an item, in the order of ``pos`` from 0.

    ``attempt`` turns the open requests' rows into (request_id, outcome, output). Where the outcome is ``length`` and the
    request has several items and was split fewer than ``most_depth`` times, its first and second half become the requests
    ``ID-split-1`` and ``ID-split-2`` of the next round; requests that succeeded aren't tried again. lineage: (request_id,
    parent_id, depth, n, outcome, final), a row for each attempt. outputs: those of outcome ``ok``. No item is lost or done twice.
    """
    open_ = items.withColumns({"parent_id": F.lit(None).cast("string"), "depth": F.lit(0)})
    told, made = [], []
    for depth in range(most_depth + 1):
        open_ = written(open_, f"open_{depth}")
        sizes = open_.groupBy("request_id").agg(F.max("parent_id").alias("parent_id"), F.count("*").alias("n"))
        tried = attempt(open_.drop("parent_id", "depth"))
        again = (F.col("outcome") == "length") & (F.col("n") > 1) & F.lit(depth < most_depth)
        done = written(sizes.join(tried, "request_id").withColumns({"depth": F.lit(depth), "final": ~again}), f"tried_{depth}")
        told.append(done.select("request_id", "parent_id", "depth", "n", "outcome", "final"))
        made.append(done.where("outcome = 'ok'").select("request_id", "output"))
        halves = done.where(~F.col("final")).select("request_id", F.greatest(F.lit(1), F.floor(F.col("n") / 2)).alias("middle"))
        if halves.isEmpty():
            break
        first = F.col("pos") < F.col("middle")
        open_ = open_.drop("parent_id").join(halves, "request_id").withColumn("parent_id", F.col("request_id"))
        open_ = open_.withColumns({"request_id": F.concat("request_id", F.when(first, "-split-1").otherwise("-split-2")), "pos": F.when(first, F.col("pos")).otherwise(F.col("pos") - F.col("middle")), "depth": F.lit(depth + 1)}).drop("middle")
    return functools.reduce(DataFrame.unionByName, told), functools.reduce(DataFrame.unionByName, made)


def reached(begins: DataFrame, jump: DataFrame) -> DataFrame:
    """(meeting_id, pos): the places that are reached from ``begins`` by following ``jump`` (meeting_id, at, next), by doubling."""
    begins = written(begins, "begins")
    while not jump.isEmpty():
        further = begins.join(jump.withColumnRenamed("at", "pos"), ["meeting_id", "pos"]).select("meeting_id", F.col("next").alias("pos"))
        begins = written(begins.unionByName(further).distinct(), "begins")
        twice = jump.select("meeting_id", "at", F.col("next").alias("middle")).join(jump.select("meeting_id", F.col("at").alias("middle"), "next"), ["meeting_id", "middle"])
        jump = written(twice.select("meeting_id", "at", "next"), "jumps")
    return begins


def budgeted_groups(parts: DataFrame, budget: int) -> DataFrame:
    """Parts (meeting_id, node, cost) with pos (from 1), upto (costs up to and with each) and ``group``: consecutive parts up to a budget each, as greedy packing gives them.

    Where a group begins depends on where the one before began, so each part's next beginning is found by a search in running totals
    and the beginnings are marked by doubling: a round joins those reached with what lies 2**k groups on. No meeting is worked through by one task.
    """
    rows = running(parts.select("meeting_id", "node", "cost"), ["meeting_id"], [F.col("node").asc()], {"upto": "cost"}, count=True, name="costs")
    # the first part that a group beginning here can't hold: the first whose total is beyond the total before this one plus the budget
    probe = rows.select("meeting_id", F.col("pos").alias("at"), (F.col("upto") - F.col("cost") + budget).alias("limit"))
    stream = rows.select("meeting_id", F.col("upto").alias("key"), F.col("pos").alias("end"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("side"))
    stream = stream.unionByName(probe.select("meeting_id", F.col("limit").alias("key"), F.lit(None).cast("long").alias("end"), "at", F.lit(1).alias("side")))
    met = running(stream, ["meeting_id"], [F.col("key").asc(), F.col("side").asc(), F.col("end").asc_nulls_first()], lasts={"last": "end"}, name="next_groups")
    # a part beyond the budget by itself is a group of its own
    jump = met.where("side = 1").select("meeting_id", "at", F.greatest(F.coalesce("last", F.lit(0)), F.col("at")).alias("last"))
    jump = written(jump.select("meeting_id", "at", (F.col("last") + 1).alias("next")), "jumps")
    begins = reached(rows.where("pos = 1").select("meeting_id", "pos"), jump)
    mark = begins.withColumn("fresh", F.lit(1).cast("long"))
    marked = rows.join(mark, ["meeting_id", "pos"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0).cast("long")))
    return running(marked, ["meeting_id"], [F.col("pos").asc()], {"group": "fresh"}, name="groups").select("meeting_id", "node", "cost", "pos", "upto", (F.col("group") - 1).alias("group"))


def merge_in_budget(parts: DataFrame, merge: Callable[[Column], Column], cost: Callable[[Column], Column], budget: int, most_rounds: int = 16) -> tuple[DataFrame, DataFrame]:
    """(roots (meeting_id, round, output), lineage (meeting_id, round, grp, first, last, n, cost)) of outputs (meeting_id, node, output).

    A round packs consecutive outputs into groups whose costs sum up to the budget at most and merges each by a function of its ordered outputs,
    until one is left. A meeting of which a round merges nothing can't be brought within the budget, which is an error, as is more than ``most_rounds`` rounds.
    """
    now, roots, told = written(parts.select("meeting_id", "node", "output"), "outputs"), [], []
    for number in range(most_rounds + 1):
        sizes = now.groupBy("meeting_id").agg((F.count("*") > 1).alias("_several"))
        now = now.join(sizes, "meeting_id")
        roots.append(now.where("not _several").select("meeting_id", F.lit(number).alias("round"), "output"))
        now = written(now.where("_several").drop("_several"), f"round_{number}")
        if now.isEmpty():
            return functools.reduce(DataFrame.unionByName, roots), functools.reduce(DataFrame.unionByName, told) if told else _no_lineage(parts)
        groups = budgeted_groups(now.select("meeting_id", "node", cost(F.col("output")).cast("long").alias("cost")), budget)
        stuck = groups.groupBy("meeting_id").agg(F.count("*").alias("n"), F.count_distinct("group").alias("g")).where("n = g")
        if not stuck.isEmpty():
            raise ValueError("merging can't reduce the number of outputs within the budget")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "output"))), lambda x: x["output"])
        merged = groups.join(now, ["meeting_id", "node"]).groupBy("meeting_id", "group").agg(ordered.alias("parts"), F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"), F.sum("cost").alias("cost"))
        merged = written(merged.select("meeting_id", "group", merge(F.col("parts")).alias("output"), "first", "last", "n", "cost"), f"merged_{number}")
        told.append(merged.select("meeting_id", F.lit(number + 1).alias("round"), F.col("group").alias("grp"), "first", "last", "n", "cost"))
        now = merged.select("meeting_id", F.col("group").alias("node"), "output")
    raise ValueError(f"more than {most_rounds} rounds of merging")


def _no_lineage(parts: DataFrame) -> DataFrame:
    kind = parts.schema["meeting_id"].dataType.simpleString()
    return parts.sparkSession.createDataFrame([], f"meeting_id {kind}, round int, grp long, first long, last long, n long, cost long")
