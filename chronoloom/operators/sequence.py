"""Ordered operators inside a meeting: turns, fills, latest records, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(*more: str):
    return Window.partitionBy("meeting_id").orderBy("idx", *more)


def merge_turns(segments: DataFrame, most_gap: int) -> DataFrame:
    """(meeting_id, turn_no, speaker, start_ms, end_ms, n, text): segments of one speaker with small gaps; blank ones are left out.

    A turn ends where its last segment ends. Texts are stripped before they are joined.
    """
    text = F.btrim("text", F.lit(" \t\n\r\x0b\x0c"))
    rows = segments.withColumn("text", text).where("text <> ''")
    same = (F.lag("speaker").over(_order()) == F.col("speaker")) & (F.col("start_ms") - F.lag("end_ms").over(_order()) <= most_gap)
    rows = rows.withColumn("_new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("turn_no", F.sum("_new").over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return rows.groupBy("meeting_id", "turn_no").agg(
        F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), F.count("*").alias("n"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def fill_speakers(segments: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Unknown speakers take the last known one, or else the next; the given label stays as raw_speaker."""
    known = F.when(F.col("speaker") != unknown, F.col("speaker"))
    before = F.last(known, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the next one is the last one of the order reversed: a frame that ends with the partition would be read anew for every row
    after = F.last(known, ignorenulls=True).over(Window.partitionBy("meeting_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return segments.withColumn("raw_speaker", F.col("speaker")).withColumn("_filled", F.coalesce(before, after, F.lit(unknown))).drop("speaker").withColumnRenamed("_filled", "speaker")


def latest(records: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last record of each key; ties go by the further columns of ``order``."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def first_seen(segments: DataFrame) -> DataFrame:
    """(meeting_id, speaker, number): speakers numbered from 0 as they first appear."""
    first = segments.groupBy("meeting_id", "speaker").agg(F.min("idx").alias("first"))
    return first.select("meeting_id", "speaker", (F.row_number().over(Window.partitionBy("meeting_id").orderBy("first", "speaker")) - 1).alias("number"))


def contiguous_ranges(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Chapters (meeting_id, idx, start_idx) made to cover 0 to the end (meeting_id, last_idx) without gaps."""
    order = Window.partitionBy("meeting_id").orderBy("start_idx", "idx")
    rows = starts.join(ends, "meeting_id")
    first = F.when(F.row_number().over(order) == 1, F.lit(0).cast("long")).otherwise(F.col("start_idx"))
    rows = rows.withColumn("_first", first).withColumn("end_idx", F.coalesce(F.lead("start_idx").over(order) - 1, F.col("last_idx")))
    return rows.where("end_idx >= _first").select("meeting_id", "idx", F.col("_first").alias("start_idx"), "end_idx")


def in_ranges(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments with the ``chapter`` of ranges (meeting_id, idx, start_idx, end_idx) without overlaps that holds them; others go.

    Ranges and segments stand in one ordered stream a meeting, so no pairs are made.
    """
    held = F.struct(F.col("idx").alias("chapter"), "end_idx")
    starts = ranges.select("meeting_id", F.col("start_idx").alias("idx"), F.lit(0).alias("_kind"), held.alias("_range"), F.lit(None).cast("string").alias("segment_id"))
    rows = segments.select("meeting_id", "idx", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_range"].dataType).alias("_range"), "segment_id")
    order = Window.partitionBy("meeting_id").orderBy("idx", "_kind", "_range.chapter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.unionByName(rows).withColumn("_range", F.last("_range", ignorenulls=True).over(order))
    return both.where((F.col("_kind") == 1) & (F.col("idx") <= F.col("_range.end_idx"))).select("meeting_id", "idx", "segment_id", "_range.chapter")


def clip_ranges(candidates: DataFrame) -> DataFrame:
    """Ranges (meeting_id, no, start_idx, end_idx) that don't overlap: reversed ones become points, equal starts one range, ends give way to the next start."""
    rows = candidates.withColumn("end_idx", F.greatest("start_idx", "end_idx"))
    rows = rows.groupBy("meeting_id", "start_idx").agg(F.max("end_idx").alias("end_idx"), F.min(F.struct("end_idx", "no"))["no"].alias("no"), F.count("*").alias("merged"))
    follows = F.lead("start_idx").over(Window.partitionBy("meeting_id").orderBy("start_idx"))
    return rows.withColumn("end_idx", F.least(F.col("end_idx"), F.coalesce(follows - 1, F.col("end_idx"))))


def expand_ranges(ranges: DataFrame, ends: DataFrame) -> DataFrame:
    """Ranges with full_start and full_end, which cover 0 to the end (meeting_id, last_idx) without gaps, and core ends clipped to them; empty ones go."""
    order = Window.partitionBy("meeting_id").orderBy("start_idx")
    rows = ranges.join(ends, "meeting_id")
    last = F.least(F.coalesce(F.lead("start_idx").over(order) - 1, F.col("last_idx")), F.col("last_idx"))
    rows = rows.withColumns({"full_start": F.when(F.row_number().over(order) == 1, F.lit(0).cast("long")).otherwise(F.col("start_idx")), "full_end": last})
    rows = rows.where("full_start <= full_end").withColumn("end_idx", F.least(F.greatest("start_idx", F.least("end_idx", "last_idx")), "full_end"))
    return rows.withColumn("expanded", (F.col("full_start") != F.col("start_idx")) | (F.col("full_end") != F.col("end_idx"))).drop("last_idx")


def loose_turns(segments: DataFrame, most_gap: int) -> DataFrame:
    """(meeting_id, turn_no, speaker, start_ms, end_ms, n): like ``merge_turns``, but a missing end or start never parts segments of one speaker.

    A segment without an end leaves the turn's end as it is, so the last known end within the turn counts.
    """
    rows = segments.where("text <> ''")
    rows = rows.withColumn("_change", F.when(F.lag("speaker").over(_order()) == F.col("speaker"), 0).otherwise(1))
    upto = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_voice", F.sum("_change").over(upto))
    same = Window.partitionBy("meeting_id", "_voice").orderBy("idx")
    # within a voice: gaps part turns, and the end before is the last one that is known since then
    end_before = F.last("end_ms", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start_ms") - end_before > most_gap, F.lit(False))
    rows = rows.withColumn("turn_no", F.sum(F.when((F.col("_change") == 1) | apart, 1).otherwise(0)).over(upto))
    return rows.groupBy("meeting_id", "turn_no").agg(F.min("speaker").alias("speaker"), F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), F.col("idx"))).alias("end_ms"), F.count("*").alias("n"))
