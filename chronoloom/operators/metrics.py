"""Aggregations of durations, memory, runs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.intervals import shared_time

# Upper ends of the classes of durations, in seconds.
DURATION_BINS = (1, 2, 5, 10, 20, 30)
# Least lengths of summaries in characters, the largest share of retries, and how far characters a token may drift.
SHORT_BLOCK, SHORT_OVERVIEW, RETRY_RATE, TOKEN_DRIFT = 120, 300, 0.15, 0.2


def overlap_matrix(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(label, ref_label, overlap_ms): shared time of each pair of labels, over all keys."""
    return shared_time(rows, reference, keys, ["label"]).groupBy("label", "ref_label").agg(F.sum("ms").alias("overlap_ms"))


def duration_stats(rows: DataFrame, seconds: Column, label: str) -> DataFrame:
    """One row for all, known and unknown rows and for each label: count, sum, mean, quartiles to 3 decimals, and numbers by class."""
    rows = grouped_with_totals(rows.withColumn("_s", seconds), label, "unknown").select("grp", "_s")
    edges = [0, *DURATION_BINS, None]
    inside = [(F.col("_s") >= lo) & (F.lit(True) if hi is None else F.col("_s") < hi) for lo, hi in zip(edges[:-1], edges[1:])]
    told = {"total": F.sum("_s"), "mean": F.avg("_s"), "least": F.min("_s"), "most": F.max("_s")} | {f"p{int(q * 100)}": F.percentile("_s", q) for q in (0.25, 0.5, 0.75, 0.9)}
    return rows.groupBy("grp").agg(F.count("*").alias("n"), *[F.round(c, 3).alias(k) for k, c in told.items()], *[F.count_if(x).alias(f"bin{i}") for i, x in enumerate(inside)])


def grouped_with_totals(rows: DataFrame, label: str, unknown: str) -> DataFrame:
    """Rows once for each overlapping group: all, known or unknown, and their own label."""
    kind = F.when(F.col(label) == unknown, "unknown").otherwise("known")
    return rows.withColumn("grp", F.explode(F.array(F.lit("all"), kind, F.concat(F.lit("label:"), F.col(label)))))


def memory_peaks(samples: DataFrame) -> DataFrame:
    """(key, phase, baseline, peak, least, n) of samples (key, phase, t, value); baseline is the first value."""
    return samples.groupBy("key", "phase").agg(F.min_by("value", F.struct("t", "id")).alias("baseline"), F.max("value").alias("peak"), F.min("value").alias("least"), F.count("*").alias("n"))


def leak_test(samples: DataFrame, threshold: float) -> DataFrame:
    """One row a key of idle samples (key, t, id, available, cached, rss, cma; in kilobytes): medians of up to three first and last ones.

    A leak is suspected if available memory fell by more than the threshold (megabytes), caches that can be given back don't
    explain half of it, and resident or contiguous memory moved by a quarter of it. Fewer than two samples tell nothing.
    """
    order = Window.partitionBy("key")
    n = F.count("*").over(order)
    width = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 2)))
    rows = samples.withColumns({"up": F.row_number().over(order.orderBy("t", "id")), "down": F.row_number().over(order.orderBy(F.desc("t"), F.desc("id"))), "w": width})

    def moved(c: str, sign: int) -> Column:
        first, last = (F.median(F.when(F.col(side) <= F.col("w"), F.col(c))) for side in ("up", "down"))
        return sign * (last - first) / 1024

    out = rows.groupBy("key").agg(F.count("*").alias("n"), moved("available", -1).alias("available_decline"), moved("cached", 1).alias("cached_growth"), moved("rss", 1).alias("rss_growth"), moved("cma", -1).alias("cma_decline"))
    explained = F.col("cached_growth") >= F.greatest(F.lit(0.0), F.col("available_decline") * 0.5)
    few = F.col("n") < 2
    suspected = ~few & (F.col("available_decline") > threshold) & ~explained & ((F.col("rss_growth") > threshold * 0.25) | (F.col("cma_decline") > threshold * 0.25))
    told = [F.when(~few, F.round(c, 3)).alias(c) for c in ("available_decline", "cached_growth", "rss_growth", "cma_decline")]
    return out.select("key", "n", *told, F.when(~few, explained).alias("explained"), suspected.alias("suspected"), F.when(few, "insufficient_samples").when(F.col("n") >= 6, "high").otherwise("low").alias("confidence"))


def run_flags(runs: DataFrame) -> DataFrame:
    """(run, flags) of run reports: which of the rules below a run breaks, in this order.

    short blocks, short overview, overview from chapters, blocks hardly merged, most blocks opened by a change of speaker, a kind of
    request that still thinks, many retries, characters a token off the configured number, empty fields.
    """
    thinks = [F.when(F.col(f"thinking_{k}") > 0, f"thinks:{k}") for k in ("block", "full", "speaker")]
    flags = F.array_compact(F.array(
        F.when(F.col("block_chars") < SHORT_BLOCK, "short_blocks"), F.when((F.col("overview_chars") > 0) & (F.col("overview_chars") < SHORT_OVERVIEW), "short_overview"),
        F.when(F.col("overview_source") == "chapter_summaries", "overview_from_chapters"), F.when((F.col("chapters") > 0) & (F.col("chapters") > F.col("blocks") * 0.7), "hardly_merged"),
        F.when((F.col("by_speaker") > 0) & (F.col("by_speaker") > F.col("blocks") * 0.5), "opened_by_speaker"), *thinks,
        F.when((F.col("retries") > 0) & (F.try_divide("retries", "requests") > RETRY_RATE), "many_retries"),
        F.when((F.col("chars_per_token") > 0) & (F.abs(F.col("chars_per_token") - F.col("configured")) > TOKEN_DRIFT), "token_drift"), F.when(F.col("empty_fields") > 0, "empty_fields"),
    ))
    return runs.select("run", F.array_join(flags, ",").alias("flags"))


def value_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, least, mean to one decimal and most of values that aren't null."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.round(F.avg(value), 1).alias("mean"), F.max(value).alias("most"))
