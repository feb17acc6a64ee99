"""Segment plans: padded and merged known intervals with provenance, uncovered gaps, gap decisions, absorption, pieces.

Times are whole milliseconds, so intervals that touch are found by equality. Every step is partitioned by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.intervals import islands, split_long


def merge_known(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, start_ms, end_ms, source_ids, gap_ids, source): intervals of one label that touch or overlap become one."""
    part = [*keys, "label"]
    order = Window.partitionBy(*part).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("start_ms") <= before, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def all_of(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

    out = marked.groupBy(*part, "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), all_of("source_ids").alias("source_ids"), all_of("gap_ids").alias("gap_ids"), F.count("*").alias("_n"), F.min("source").alias("_source"))
    source = F.when(F.col("_n") == 1, F.col("_source")).when(F.size("gap_ids") > 0, "absorbed_merged").otherwise("merged")
    return out.withColumn("source", source).drop("_run", "_n", "_source")


def uncovered(rows: DataFrame, keys: list[str], first: Column, last: Column) -> DataFrame:
    """(keys, gap_no, start_ms, end_ms): what no interval covers in [first, last], with what lies before and behind all of them."""
    order = Window.partitionBy(*keys).orderBy("start_ms")
    cover = islands(rows, keys)
    inner = cover.withColumn("_from", F.coalesce(F.lag("end_ms").over(order), first)).select(*keys, F.col("_from").alias("start_ms"), F.col("start_ms").alias("end_ms"))
    tail = cover.groupBy(*keys).agg(F.max("end_ms").alias("start_ms")).select(*keys, "start_ms", last.alias("end_ms"))
    return inner.union(tail).where("end_ms > start_ms").withColumn("gap_no", (F.row_number().over(order) - 1).cast("long"))


def decide_gaps(gaps: DataFrame, known: DataFrame, keys: list[str], most: int, first: Column, last: Column) -> DataFrame:
    """Gaps with the labels that end and begin at them, a decision, its reason and the label that takes the gap over."""
    ends = known.groupBy(*keys, F.col("end_ms").alias("start_ms")).agg(F.array_sort(F.collect_set("label")).alias("left_labels"))
    begins = known.groupBy(*keys, F.col("start_ms").alias("end_ms")).agg(F.array_sort(F.collect_set("label")).alias("right_labels"))
    rows = gaps.join(ends, [*keys, "start_ms"], "left").join(begins, [*keys, "end_ms"], "left")
    left, right = F.coalesce(F.size("left_labels"), F.lit(0)), F.coalesce(F.size("right_labels"), F.lit(0))
    reason = (
        F.when(F.col("start_ms") <= first, "leading_gap").when(F.col("end_ms") >= last, "trailing_gap").when(F.col("end_ms") - F.col("start_ms") > most, "over_threshold")
        .when((left < 1) | (right < 1), "missing_boundary").when(left != 1, "ambiguous_left_boundary").when(right != 1, "ambiguous_right_boundary")
        .when(F.col("left_labels")[0] != F.col("right_labels")[0], "different_boundary_speakers").otherwise("same_speaker_bounded_short")
    )
    taken = reason == "same_speaker_bounded_short"
    return rows.select(
        *keys, "gap_no", "start_ms", "end_ms", F.array_join("left_labels", ",").alias("left_labels"), F.array_join("right_labels", ",").alias("right_labels"),
        F.when(taken, "absorbed").otherwise("kept_unknown").alias("decision"), reason.alias("reason"), F.when(taken, F.col("left_labels")[0]).alias("assigned"),
    )


def absorb(known: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Known intervals, merged again with the gaps that are absorbed."""
    gap_id = F.format_string("gap:%04d", F.col("gap_no"))
    bridges = decisions.where("decision = 'absorbed'").select(*keys, F.col("assigned").alias("label"), "start_ms", "end_ms", F.array().cast("array<string>").alias("source_ids"), F.array(gap_id).alias("gap_ids"), F.lit("bridge").alias("source"))
    return merge_known(known.select(*bridges.columns).union(bridges), keys)


def segment_plan(rows: DataFrame, keys: list[str], pad: int, most_absorbed: int, most_known: int, most_unknown: int, first: Column, last: Column) -> DataFrame:
    """(keys, no, label, start_ms, end_ms, source, gap_ids): known intervals and, between them, unknown ones, in pieces, numbered from 0."""
    wide = rows.withColumns({"start_ms": F.greatest(first, F.col("start_ms") - pad), "end_ms": F.least(last, F.col("end_ms") + pad)}).where("end_ms > start_ms")
    known = merge_known(wide, keys)
    decisions = decide_gaps(uncovered(known, keys, first, last), known, keys, most_absorbed, first, last)
    known = absorb(known, decisions, keys)
    unknown = uncovered(known, keys, first, last).select(*keys, F.lit("unknown").alias("label"), "start_ms", "end_ms", F.lit("gap").alias("source"), F.lit("").alias("gap_ids"))
    known = known.select(*keys, "label", "start_ms", "end_ms", "source", F.array_join("gap_ids", ",").alias("gap_ids"))
    pieces = split_long(known, most_known).union(split_long(unknown, most_unknown))
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "label")
    return pieces.withColumn("no", (F.row_number().over(order) - 1).cast("long")).drop("piece")


def check_plan(plan: DataFrame, keys: list[str], most_known: int, most_unknown: int, first: Column, last: Column) -> DataFrame:
    """(keys, no, check): rows of a plan outside its range, empty, too long, or whose number doesn't follow the one before."""
    order = Window.partitionBy(*keys).orderBy("no")
    length = F.col("end_ms") - F.col("start_ms")
    failed = F.array_compact(F.array(
        F.when((F.col("start_ms") < first) | (F.col("end_ms") > last), "outside_range"), F.when(length <= 0, "empty"),
        F.when(length > F.when(F.col("label") == "unknown", most_unknown).otherwise(most_known), "too_long"),
        F.when(F.col("no") != F.coalesce(F.lag("no").over(order) + 1, F.lit(0)), "not_contiguous"),
    ))
    return plan.withColumn("_failed", failed).select(*keys, "no", F.explode("_failed").alias("check"))


def merge_adjacent(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, run, label, start_ms, end_ms, n): neighbours in time of one label at most ``gap`` apart become one, whatever lies further on."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "label", "id")
    rows = rows.withColumn("_change", F.when(F.lag("label").over(order) == F.col("label"), 0).otherwise(1))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_turn", F.sum("_change").over(upto))
    inside = Window.partitionBy(*keys, "_turn").orderBy("start_ms", "end_ms", "label", "id")
    far = F.col("start_ms") - F.max("end_ms").over(inside.rowsBetween(Window.unboundedPreceding, -1)) <= gap
    rows = rows.withColumn("_new", F.when(far, 0).otherwise(1)).withColumn("run", F.sum("_new").over(upto))
    return rows.groupBy(*keys, "run").agg(F.min("label").alias("label"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def asr_pieces(rows: DataFrame, most: int, least: int, least_target: int) -> DataFrame:
    """Rows cut into pieces of ``most`` milliseconds; a last piece that would be too short lengthens the one before it."""
    total = F.col("end_ms") - F.col("start_ms")
    n = F.ceil(total / most)
    tail = total - (n - 1) * most
    n = F.when((n > 1) & ((tail < least_target) | (tail < least)), n - 1).otherwise(n).cast("int")
    out = rows.where("end_ms > start_ms").withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    begin = F.col("start_ms") + (F.col("part") - 1).cast("long") * most
    return out.withColumns({"start_ms": begin, "end_ms": F.when(F.col("part") == F.col("_n"), F.col("end_ms")).otherwise(begin + most)}).drop("_n")
