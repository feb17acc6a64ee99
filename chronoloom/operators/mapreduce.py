"""A map over windows with any column function, and a tree of reductions; results can be resumed by fingerprint."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.tables import new_folder


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def map_windows(windows: DataFrame, function: Callable[[Column], Column], done: DataFrame | None = None) -> DataFrame:
    """(meeting_id, window, fingerprint, output): only windows whose fingerprint isn't among ``done`` are mapped."""
    rows = windows.withColumn("fingerprint", fingerprint("meeting_id", "window", "text"))
    todo = rows if done is None else rows.join(done.select("fingerprint"), "fingerprint", "left_anti")
    fresh = todo.select("meeting_id", "window", "fingerprint", function(F.col("text")).alias("output"))
    return fresh if done is None else fresh.unionByName(done.join(rows.select("fingerprint"), "fingerprint", "left_semi").select(*fresh.columns))


def reduce_tree(parts: DataFrame, function: Callable[[Column], Column], fan_in: int, most_levels: int = 16) -> DataFrame:
    """(meeting_id, level, node, output): one row a meeting. Each level joins up to ``fan_in`` neighbours by a function of their ordered outputs.

    A meeting is reduced at least once and until one output is left, whatever other meetings need. Neighbours go by
    the order of windows, so gaps in their numbers don't matter. Each level is written to the shared folder.
    """
    if fan_in < 2:
        raise ValueError("the tree of reductions doesn't shrink with a fan-in below 2")
    spark = parts.sparkSession
    base = new_folder(spark, "reduce")
    meeting = Window.partitionBy("meeting_id")
    node = (F.row_number().over(meeting.orderBy("window", "output")) - 1).cast("long")
    now, done = parts.select("meeting_id", node.alias("node"), F.count("*").over(meeting).alias("n"), "output"), []
    for level in range(1, most_levels + 1):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", "output"))), lambda x: x["output"])
        # n is the number of a meeting's nodes
        now = now.groupBy("meeting_id", F.floor(F.col("node") / fan_in).alias("parent"), F.ceil(F.col("n") / fan_in).alias("left")).agg(ordered.alias("parts"))
        now = now.select("meeting_id", F.lit(level).alias("level"), F.col("parent").alias("node"), F.col("left").alias("n"), function(F.col("parts")).alias("output"))
        now.write.parquet(f"{base}/{level}")
        now = spark.read.schema(now.schema).parquet(f"{base}/{level}")
        done.append(now.where("n = 1").drop("n"))
        now = now.where("n > 1")
        if now.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
    raise ValueError(f"the tree of reductions has more than {most_levels} levels")
