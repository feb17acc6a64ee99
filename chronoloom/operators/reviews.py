"""Joins around a review: evidence of candidates, links between evidence and segments, members of chunks, windows of recordings, refs of facts and likeness of summaries."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronoloom.functions.modeltext import source_ids, turn_numbers
from chronoloom.operators.documents import kind_of, whole_json
from chronoloom.operators.scan import running

# The lists of facts whose items name turns and sources.
FACTS = ("participants", "topics", "decisions", "action_items", "risks", "open_questions")


def cited_segments(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, pos, segment_id, speaker, text): segments that candidates (meeting_id, no, refs) cite, each once, numbered from 0 in the order of their first citation; unknown refs are left out."""
    cited = candidates.select("meeting_id", "no", F.posexplode("refs").alias("place", "segment_id"))
    first = cited.groupBy("meeting_id", "segment_id").agg(F.min(F.struct("no", "place")).alias("first"))
    rows = first.join(segments.select("meeting_id", "segment_id", "speaker", "text"), ["meeting_id", "segment_id"])
    rows = running(rows, ["meeting_id"], [F.col("first").asc()], count=True, name="cited")
    return rows.select("meeting_id", (F.col("pos") - 1).alias("pos"), "segment_id", "speaker", "text")


def evidence_links(evidence: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of evidence, of segments): where to go from evidence (meeting_id, evidence_id, refs), and from segments.

    of evidence: (meeting_id, evidence_id, segment_id, start_ms), its first segment by time that is there, else null. of segments: (meeting_id, segment_id, evidence_id, n), the least id of the n that cite it, null and 0 for none.
    """
    cited = evidence.select("meeting_id", "evidence_id", F.explode(F.array_distinct("refs")).alias("segment_id"))
    known = cited.join(segments.select("meeting_id", "segment_id", "start_ms"), ["meeting_id", "segment_id"])
    begin = known.groupBy("meeting_id", "evidence_id").agg(F.min(F.struct("start_ms", "segment_id")).alias("at"))
    there = evidence.select("meeting_id", "evidence_id").join(begin, ["meeting_id", "evidence_id"], "left").select("meeting_id", "evidence_id", "at.segment_id", "at.start_ms")
    by_segment = cited.groupBy("meeting_id", "segment_id").agg(F.min("evidence_id").alias("evidence_id"), F.count_distinct("evidence_id").alias("n"))
    back = segments.select("meeting_id", "segment_id").join(by_segment, ["meeting_id", "segment_id"], "left")
    return there, back.withColumn("n", F.coalesce("n", F.lit(0)))


def chunk_members(chunks: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (meeting_id, chunk, pos, segment_id, text), faults (meeting_id, chunk, missing)) of chunks (meeting_id, chunk, segment_ids).

    A chunk that names a segment which isn't there has no members; its fault is the first such name.
    """
    keys = ["meeting_id", "chunk"]
    named = chunks.select(*keys, F.posexplode("segment_ids").alias("pos", "segment_id"))
    found = named.join(segments.select("meeting_id", "segment_id", "text", F.lit(True).alias("there")), ["meeting_id", "segment_id"], "left")
    faults = found.where("there is null").groupBy(*keys).agg(F.min_by("segment_id", "pos").alias("missing"))
    return found.join(faults, keys, "left_anti").select(*keys, "pos", "segment_id", "text"), faults


def recording_windows(recordings: DataFrame, results: DataFrame, seconds: float) -> DataFrame:
    """(key, window, start, duration, status, text): windows of a fixed length over recordings (key, duration) with their results (key, window, status, text), at most one each.

    The last window ends with the recording; windows without a result are ``missing``, and only those of status ``ok`` have a text. Recordings without a positive duration have no window.
    """
    rows = recordings.where("duration > 0").select("key", "duration", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / seconds) - 1)).alias("window"))
    start = F.col("window") * F.lit(float(seconds))
    rows = rows.select("key", "window", start.alias("start"), F.least(F.lit(float(seconds)), F.col("duration") - start).alias("duration"))
    status = F.coalesce("status", F.lit("missing"))
    return rows.join(results, ["key", "window"], "left").select("key", "window", F.round("start", 3).alias("start"), F.round("duration", 3).alias("duration"), status.alias("status"), F.when(status == "ok", F.col("text")).alias("text"))


def recording_totals(windows: DataFrame) -> DataFrame:
    """(key, windows, failed, missing, chars) of windows; chars: those of the texts, with a line break between texts that say something."""
    said = F.coalesce(F.length("text"), F.lit(0))
    return windows.groupBy("key").agg(F.count("*").alias("windows"), F.count_if(~F.col("status").isin("ok", "missing")).alias("failed"), F.count_if(F.col("status") == "missing").alias("missing"), (F.sum(said) + F.greatest(F.count_if(said > 0) - 1, F.lit(0))).alias("chars"))


def fact_refs(docs: DataFrame, fields: tuple[str, ...] = FACTS) -> DataFrame:
    """(doc, field, pos, turn_ids, source_ids) of the items of documents (doc, json): turns as numbers and sources as ids where they can be told, each once, in order; null where an item has no such list.

    Items that aren't objects and fields that aren't lists have no row.
    """
    value = whole_json(F.col("json"))
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.try_variant_get("value", f"$.{f}", "array<variant>").alias("items")) for f in fields])
    rows = docs.select("doc", value.alias("value")).select("doc", F.explode(lists).alias("x")).select("doc", "x.field", F.posexplode("x.items").alias("pos", "item"))
    rows = rows.where(F.col("item").isNotNull() & (kind_of(F.col("item")) == "object"))

    def named(key: str) -> Column:
        return F.transform(F.try_variant_get("item", f"$.{key}", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))

    return rows.select("doc", "field", "pos", turn_numbers(named("turn_ids")).alias("turn_ids"), source_ids(named("source_ids")).alias("source_ids"))


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for a, b in zip(left, right)], dtype="float64")


def summary_likeness(left: DataFrame, right: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, same, likeness) of two documents (key, json) of each key that both have: whether a field is equal, and how alike its texts are as JSON with sorted keys.

    likeness: twice the matched characters over all, as longest matching blocks find them; a field that one lacks is null there, and both are null then.
    """
    def told(docs: DataFrame, name: str) -> DataFrame:
        value = docs.select("key", whole_json(F.col("json")).alias("v"))
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.try_variant_get("v", f"$.{f}", "variant").cast("string").alias(name)) for f in fields])
        return value.select("key", F.explode(pairs).alias("x")).select("key", "x.*")

    both = told(left, "one").join(told(right, "two"), ["key", "field"])
    alike = both.where("one <> two").select("key", "field", F.lit(False).alias("same"), _ratio("one", "two").alias("likeness"))
    return alike.union(both.where("one = two or one is null or two is null").select("key", "field", F.col("one") == F.col("two"), F.when(F.col("one") == F.col("two"), 1.0)))
