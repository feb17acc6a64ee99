"""Answers of a model about blocks, tasks and whole meetings: checked, and what holds of them as tables.

An answer is a row with its finish reason, whether its input was cut, and its text. Texts are parsed once into VARIANT values, so a field of a wrong
kind costs that field only. Refs are looked up by equi joins. A bad answer is a row whose ``fault`` says why; all else in it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.modeltext import bullet_list, first_object, without_fence, without_thoughts
from chronoloom.functions.scalars import clean_text
from chronoloom.operators.documents import kind_of

# The shortest summary of a block and overview of a meeting, the most points and anchors of a block, words for true.
BLOCK_CHARS, OVERVIEW_CHARS, POINTS, ANCHORS = 60, 120, 6, 8
TRUE = ("true", "yes", "是")
BLOCK = ["meeting_id", "block"]


def _text(value: Column, path: str) -> Column:
    """A string at a path; null if there is none or something else."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(kind_of(found) == "string", F.try_variant_get(value, path, "string"))


def _list(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _strings(value: Column, path: str) -> Column:
    return F.transform(_list(value, path), lambda x: F.try_variant_get(x, "$", "string"))


def parsed(answers: DataFrame) -> DataFrame:
    """Answers (finish_reason, truncated, content, ..) with ``value``, the first JSON object of the content, and ``fault``: unfinished, cut_input or not_json."""
    value = F.try_parse_json(first_object(without_fence(without_thoughts(F.coalesce("content", F.lit(""))))))
    fault = F.when(~F.coalesce(F.col("finish_reason") == "stop", F.lit(False)), "unfinished").when(F.coalesce("truncated", F.lit(False)), "cut_input")
    rows = answers.withColumn("value", value)
    return rows.withColumn("fault", F.coalesce(fault, F.when(F.coalesce(kind_of(F.col("value")) != "object", F.lit(True)), "not_json"))).drop("content", "finish_reason", "truncated")


def _names(segments: DataFrame) -> DataFrame:
    """(meeting_id, block, name, ref) of segments that say something, by their id and by their short name."""
    said = segments.where("text <> ''")
    return said.select(*BLOCK, F.col("segment_id").alias("name"), F.col("segment_id").alias("ref")).union(said.where("short <> segment_id").select(*BLOCK, F.col("short"), "segment_id"))


def _known(named: DataFrame, keys: list[str], segments: DataFrame) -> DataFrame:
    """(keys, refs) of named (keys, pos, name): what the segments of the block know, each once, in order."""
    first = named.join(_names(segments), [*BLOCK, "name"]).groupBy(*keys, "ref").agg(F.min("pos").alias("pos"))
    both = F.array_sort(F.collect_list(F.struct("pos", "ref")))
    return first.groupBy(*keys).agg(F.transform(both, lambda x: x["ref"]).alias("refs"))


def block_summaries(answers: DataFrame, segments: DataFrame, chars: int = BLOCK_CHARS, points: int = POINTS, anchors: int = ANCHORS) -> DataFrame:
    """(meeting_id, block, fault, title, summary, key_points, anchors, continues_previous, refs, start_ref, end_ref), a row an answer.

    answers: (meeting_id, block, finish_reason, truncated, content); segments: (meeting_id, block, idx, segment_id, short, text). Refs are those of ``key_refs`` that are segments
    of the block with words, by id or short name, else the block's first and last segment. Further faults: no_title_or_summary, short_summary, empty_block (a block without segments).
    """
    v = F.col("value")
    ends = segments.groupBy(*BLOCK).agg(F.min_by("segment_id", "idx").alias("start_ref"), F.max_by("segment_id", "idx").alias("end_ref"))
    goes_on = F.try_variant_get(v, "$.continues_previous", "variant")
    told = F.lower(F.btrim(_text(v, "$.continues_previous"), F.lit(" \n\r\t"))).isin(*TRUE)
    rows = parsed(answers).select(
        *BLOCK, "fault", clean_text(_text(v, "$.title")).alias("title"), clean_text(_text(v, "$.summary")).alias("summary"), bullet_list(_strings(v, "$.key_points"), points).alias("key_points"), bullet_list(_strings(v, "$.anchors"), anchors).alias("anchors"),
        F.when(kind_of(goes_on) == "boolean", F.try_variant_get(v, "$.continues_previous", "boolean")).otherwise(F.coalesce(told, F.lit(False))).alias("continues_previous"), _strings(v, "$.key_refs").alias("names"),
    )
    named = rows.where("fault is null").select(*BLOCK, F.posexplode("names").alias("pos", "name"))
    rows = rows.join(ends, BLOCK, "left").join(_known(named, BLOCK, segments), BLOCK, "left")
    untold = F.col("title").isNull() | F.col("summary").isNull()
    fault = F.coalesce("fault", F.when(untold, "no_title_or_summary").when(F.length("summary") < chars, "short_summary").when(F.col("start_ref").isNull(), "empty_block"))
    rows = rows.withColumn("fault", fault).withColumn("refs", F.coalesce("refs", F.array_distinct(F.array("start_ref", "end_ref"))))
    kept = [F.when(F.col("fault").isNull(), F.col(c)).alias(c) for c in ("title", "summary", "key_points", "anchors", "continues_previous", "refs", "start_ref", "end_ref")]
    return rows.select(*BLOCK, "fault", *kept)


def block_actions(answers: DataFrame, segments: DataFrame, summaries: DataFrame) -> DataFrame:
    """(meeting_id, block, no, task, owner, deadline, refs): tasks of good answers that cite a segment of their block with words; ``no`` is their place in the answer, from 0."""
    v, x = F.col("value"), F.col("item")
    good = parsed(answers).join(summaries.where("fault is null").select(*BLOCK), BLOCK, "left_semi")
    items = good.select(*BLOCK, F.posexplode(_list(v, "$.action_candidates")).alias("no", "item"))
    items = items.select(*BLOCK, "no", clean_text(_text(x, "$.task")).alias("task"), clean_text(_text(x, "$.owner")).alias("owner"), clean_text(_text(x, "$.deadline")).alias("deadline"), _strings(x, "$.refs").alias("names")).where("task is not null")
    keys = [*BLOCK, "no"]
    named = items.select(*keys, F.posexplode("names").alias("pos", "name"))
    return items.drop("names").join(_known(named, keys, segments), keys)


def overviews(answers: DataFrame, chapters: DataFrame, segments: DataFrame, chars: int = OVERVIEW_CHARS) -> DataFrame:
    """(meeting_id, fault, title, text, refs): a row an answer (meeting_id, finish_reason, truncated, content).

    refs: those of chapters (meeting_id, chapter, refs) that are segments with words, each once, in the order of chapters. Further faults: no_overview, no_text, short_text, no_refs.
    """
    v = F.col("value")
    cited = chapters.select("meeting_id", "chapter", F.posexplode("refs").alias("pos", "ref"))
    said = segments.where("text <> ''").select("meeting_id", F.col("segment_id").alias("ref"))
    first = cited.groupBy("meeting_id", "ref").agg(F.min(F.struct("chapter", "pos")).alias("at")).join(said, ["meeting_id", "ref"], "left_semi")
    refs = first.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("refs"))
    holds = F.coalesce(kind_of(F.try_variant_get(v, "$.overview", "variant")) == "object", F.lit(False))
    rows = parsed(answers).select("meeting_id", "fault", holds.alias("holds"), clean_text(_text(v, "$.title")).alias("title"), clean_text(_text(v, "$.overview.text")).alias("text")).join(refs, "meeting_id", "left")
    fault = F.coalesce("fault", F.when(~F.col("holds"), "no_overview").when(F.col("text").isNull(), "no_text").when(F.length("text") < chars, "short_text").when(F.col("refs").isNull(), "no_refs"))
    rows = rows.withColumn("fault", fault)
    return rows.select("meeting_id", "fault", *[F.when(F.col("fault").isNull(), F.col(c)).alias(c) for c in ("title", "text", "refs")])
