"""Statistics of windows and chapters: what chapters cover, where they overlap, refs in the order of their first citation, sources of an overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.intervals import overlap_join


def covered(places: DataFrame, ranges: DataFrame) -> DataFrame:
    """Places (meeting_id, pos) with ``part``: covered by a range (meeting_id, start_pos, end_pos), or uncovered in the middle or the tail.

    The tail is what lies behind the last covered place. Ranges that end before they begin count for nothing. Covers are found by counting ranges opened and
    closed up to a place, so ranges of any length make two rows each.
    """
    good = ranges.where("start_pos <= end_pos")
    steps = good.select("meeting_id", F.col("start_pos").alias("pos"), F.lit(1).alias("step")).union(good.select("meeting_id", F.col("end_pos") + 1, F.lit(-1)))
    marks = steps.groupBy("meeting_id", "pos").agg(F.sum("step").alias("step"))
    rows = places.select("meeting_id", "pos", F.lit(True).alias("place")).join(marks, ["meeting_id", "pos"], "full")
    depth = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("meeting_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("inside", depth > 0).where("place").drop("step", "place")
    last = rows.where("inside").groupBy("meeting_id").agg(F.max("pos").alias("last"))
    part = F.when(F.col("inside"), "covered").when(F.col("pos") > F.coalesce("last", F.lit(-1)), "tail").otherwise("middle")
    return rows.join(last, "meeting_id", "left").select("meeting_id", "pos", part.alias("part"))


def coverage_counts(parts: DataFrame, carryover: DataFrame) -> DataFrame:
    """(meeting_id, n, covered, middle, tail, completed, carried, open_before, open_after) with a carryover (meeting_id, carryover_pos; null: none)."""
    rows = parts.join(carryover, "meeting_id", "left")
    before = F.coalesce(F.col("pos") < F.col("carryover_pos"), F.lit(True))
    open_ = F.col("part") != "covered"
    return rows.groupBy("meeting_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("part") == p).alias(p) for p in ("covered", "middle", "tail")], F.count_if(before).alias("completed"), F.count_if(~before).alias("carried"),
        F.count_if(open_ & before).alias("open_before"), F.count_if(open_ & ~before).alias("open_after"),
    )


def chapter_overlaps(chapters: DataFrame) -> DataFrame:
    """Chapters (meeting_id, no, start_no, end_no) in the order of their ranges, with those that begin at or before the end of the one before."""
    order = Window.partitionBy("meeting_id").orderBy(F.asc_nulls_last("start_no"), F.asc_nulls_last("end_no"), "no")
    rows = chapters.withColumns({"place": F.row_number().over(order), "before": F.lag("end_no").over(order)})
    return rows.select("meeting_id", "place", "no", "start_no", "end_no", F.coalesce(F.col("start_no") <= F.col("before"), F.lit(False)).alias("overlaps"))


def refs_in_order(cited: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(meeting_id, place, ref): distinct refs of rows (meeting_id, at, refs) in the order of their first citation, those of ``segments`` only if given."""
    flat = cited.select("meeting_id", "at", F.posexplode("refs").alias("k", "ref")).where("ref is not null")
    first = flat.groupBy("meeting_id", "ref").agg(F.min(F.struct("at", "k")).alias("first"))
    if segments is not None:
        first = first.join(segments.select("meeting_id", F.col("segment_id").alias("ref")).distinct(), ["meeting_id", "ref"], "left_semi")
    return first.select("meeting_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy("first")).alias("place"), "ref")


def overview_sources(estimates: DataFrame, budget: int) -> DataFrame:
    """(meeting_id, source, tokens): the time line where it fits (meeting_id, timeline_tokens, chapter_tokens), else the chapters, or that neither does."""
    line, chapters = F.col("timeline_tokens"), F.col("chapter_tokens")
    return estimates.select("meeting_id", F.when(line <= budget, "source_timeline").when(chapters <= budget, "chapter_summaries").otherwise("exceeds_budget").alias("source"), F.when(line <= budget, line).otherwise(chapters).alias("tokens"))


def labels_at(points: DataFrame, rows: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """(keys, id, labels): the labels of half-open intervals that hold each point (keys, id, at_ms), sorted; none is an empty list."""
    one = points.select(*keys, "id", F.col("at_ms").alias("start_ms"), (F.col("at_ms") + 1).alias("end_ms"))
    found = overlap_join(one, rows, keys, bucket).groupBy(*keys, F.col("a_id").alias("id")).agg(F.array_sort(F.collect_set("b_label")).alias("labels"))
    return points.select(*keys, "id").join(found, [*keys, "id"], "left").select(*keys, "id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def chapter_segments(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, chapter, segment_id): the first segment of a chapter, or else the first that begins at or after its start (null if none).

    Chapters (meeting_id, chapter, first_segment, start_ms). Starts and chapters stand in one stream a meeting.
    """
    known = segments.select("meeting_id", F.col("segment_id").alias("first_segment"), F.lit(True).alias("_known"))
    rows = chapters.join(known, ["meeting_id", "first_segment"], "left")
    seg = segments.select("meeting_id", "start_ms", F.lit(None).cast("long").alias("chapter"), F.struct("start_ms", "idx", "segment_id").alias("hit"))
    asked = rows.where("_known is null").select("meeting_id", "start_ms", F.col("chapter").cast("long").alias("chapter"), F.lit(None).cast(seg.schema["hit"].dataType).alias("hit"))
    order = Window.partitionBy("meeting_id").orderBy(F.desc("start_ms"), F.col("chapter").isNotNull(), F.desc("hit.idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_ = seg.unionByName(asked).withColumn("found", F.last("hit", ignorenulls=True).over(order)).where("chapter is not null").select("meeting_id", "chapter", "found.segment_id")
    return rows.where("_known").select("meeting_id", F.col("chapter").cast("long").alias("chapter"), F.col("first_segment").alias("segment_id")).unionByName(next_)


def highlight(text: Column, query: Column) -> list[Column]:
    """before, hit and after of the first match in any case; without one all of it stands before."""
    at = F.instr(F.lower(text), F.lower(query))
    found = (at > 0) & (F.length(query) > 0)
    size = F.length(query)
    return [
        F.when(found, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("before"), F.when(found, F.substring(text, at, size)).otherwise("").alias("hit"),
        F.when(found, F.substring(text, at + size, F.length(text))).otherwise("").alias("after"),
    ]


def window_turns(windows: DataFrame, units: DataFrame) -> DataFrame:
    """(meeting_id, win, place, turn_id, part, problem): units (meeting_id, no, turn_id, part) that windows (meeting_id, win, unit_nos) name, in order; unknown numbers are problems, not errors of the job."""
    flat = windows.select("meeting_id", "win", F.posexplode("unit_nos").alias("place", "no"))
    return flat.join(units, ["meeting_id", "no"], "left").select("meeting_id", "win", "place", "no", "turn_id", "part", F.when(F.col("turn_id").isNull(), "unknown_unit").alias("problem"))
