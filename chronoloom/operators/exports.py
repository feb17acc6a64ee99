"""Exports of a meeting as nested documents of fixed field names, put together by Spark: one JSON text a meeting and kind.

Lists are gathered a meeting at a time, since a document is one value; their rows are numbered by scans, so long meetings are split before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.scan import running

# The files of a bundle and what each must hold.
BUNDLE = {
    "transcription.json": {"TaskId": "string", "Transcription": {"AudioInfo": {"Duration": "number|null", "SourceAudio": "string|null"}, "Paragraphs": [{"ParagraphId": "string", "SpeakerId": "string", "Words": [{"Id": "number", "SentenceId": "number", "Start": "number", "End": "number", "Text": "string"}]}]}},
    "auto_chapters.json": {"TaskId": "string", "AutoChapters": [{"Id": "number", "Start": "number", "End": "number", "Headline": "string", "Summary": "string"}]},
    "summarization.json": {"TaskId": "string", "Summarization": {"ParagraphSummary": "string", "ConversationalSummary": [{"SpeakerId": "string", "SpeakerName": "string", "Summary": "string"}]}},
    "meeting_assistance.json": {"TaskId": "string", "MeetingAssistance": {"Keywords": ["string"], "KeySentences": [{"Id": "number", "SentenceId": "number", "Start": "number", "End": "number", "Text": "string"}], "Actions": [{"Id": "number", "SentenceId": "number", "Start": "number", "End": "number", "Text": "string"}]}},
}


def sentence_index(segments: DataFrame) -> DataFrame:
    """Segments that say something, with ``sentence_id`` from 1."""
    return running(segments.where("text <> ''"), ["meeting_id"], [F.col("idx").asc()], count=True, name="sentences").withColumnRenamed("pos", "sentence_id")


def _document(name: str, *fields: Column) -> list[Column]:
    return [F.lit(name).alias("name"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")]


def _listed(rows: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """(meeting_id, name): the items of a meeting in order."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), item.alias("v"))))
    return rows.groupBy("meeting_id").agg(F.transform(both, lambda x: x["v"]).alias(name))


def _with(meetings: DataFrame, part: DataFrame, name: str, like: str) -> DataFrame:
    return meetings.join(part, "meeting_id", "left").withColumn(name, F.coalesce(name, F.array().cast(like)))


_WORD = "struct<Id: bigint, SentenceId: bigint, Start: bigint, End: bigint, Text: string>"


def _word(number: str) -> Column:
    return F.struct(F.col(number).alias("Id"), F.col("sentence_id").alias("SentenceId"), F.col("start_ms").alias("Start"), F.col("end_ms").alias("End"), F.col("text").alias("Text"))


def transcription(meetings: DataFrame, sentences: DataFrame) -> DataFrame:
    """(meeting_id, name, json) of meetings (meeting_id, task_id, duration_ms, source_audio)."""
    item = F.struct(F.col("segment_id").alias("ParagraphId"), F.col("speaker").alias("SpeakerId"), F.array(_word("sentence_id")).alias("Words"))
    rows = _with(meetings, _listed(sentences, "sentence_id", item, "p"), "p", f"array<struct<ParagraphId: string, SpeakerId: string, Words: array<{_WORD}>>>")
    inner = F.struct(F.struct(F.col("duration_ms").alias("Duration"), F.col("source_audio").alias("SourceAudio")).alias("AudioInfo"), F.col("p").alias("Paragraphs"))
    return rows.select("meeting_id", *_document("transcription.json", F.col("task_id").alias("TaskId"), inner.alias("Transcription")))


def auto_chapters(meetings: DataFrame, chapters: DataFrame) -> DataFrame:
    """Of chapters (meeting_id, chapter, title, overview, start_ms, end_ms)."""
    item = F.struct(F.col("chapter").cast("long").alias("Id"), F.col("start_ms").alias("Start"), F.col("end_ms").alias("End"), F.col("title").alias("Headline"), F.col("overview").alias("Summary"))
    rows = _with(meetings, _listed(chapters, "chapter", item, "c"), "c", "array<struct<Id: bigint, Start: bigint, End: bigint, Headline: string, Summary: string>>")
    return rows.select("meeting_id", *_document("auto_chapters.json", F.col("task_id").alias("TaskId"), F.col("c").alias("AutoChapters")))


def summarization(meetings: DataFrame, overviews: DataFrame, speakers: DataFrame) -> DataFrame:
    """Of overviews (meeting_id, overview) and speakers (meeting_id, number, speaker, summary)."""
    item = F.struct(F.col("speaker").alias("SpeakerId"), F.col("speaker").alias("SpeakerName"), F.col("summary").alias("Summary"))
    rows = _with(meetings.join(overviews, "meeting_id", "left"), _listed(speakers, "number", item, "s"), "s", "array<struct<SpeakerId: string, SpeakerName: string, Summary: string>>")
    inner = F.struct(F.coalesce("overview", F.lit("")).alias("ParagraphSummary"), F.col("s").alias("ConversationalSummary"))
    return rows.select("meeting_id", *_document("summarization.json", F.col("task_id").alias("TaskId"), inner.alias("Summarization")))


def assistance(meetings: DataFrame, sentences: DataFrame, items: DataFrame, keywords: DataFrame) -> DataFrame:
    """Of items (meeting_id, kind: sentence or action, no, text, refs) and keywords (meeting_id, no, keyword).

    An item stands at its first cited sentence and lasts from the first beginning to the last end of those it cites; an item that cites none is left out.
    """
    known = sentences.select("meeting_id", F.col("segment_id").alias("ref"), "sentence_id", "start_ms", "end_ms")
    cited = items.select("meeting_id", "kind", "no", "text", F.explode("refs").alias("ref")).join(known, ["meeting_id", "ref"])
    told = cited.groupBy("meeting_id", "kind", "no").agg(F.first("text").alias("text"), F.min_by("sentence_id", F.struct("start_ms", "sentence_id")).alias("sentence_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    told = running(told, ["meeting_id", "kind"], [F.col("no").asc()], count=True, name="export_items")
    rows = meetings
    for kind, name in (("sentence", "k"), ("action", "a")):
        rows = _with(rows, _listed(told.where(F.col("kind") == kind), "pos", _word("pos"), name), name, f"array<{_WORD}>")
    rows = _with(rows, _listed(keywords, "no", F.col("keyword"), "w"), "w", "array<string>")
    inner = F.struct(F.col("w").alias("Keywords"), F.col("k").alias("KeySentences"), F.col("a").alias("Actions"))
    return rows.select("meeting_id", *_document("meeting_assistance.json", F.col("task_id").alias("TaskId"), inner.alias("MeetingAssistance")))


def bundle_faults(bundle: DataFrame) -> DataFrame:
    """(meeting_id, fault): files that lack or are too many, task ids that lack or differ."""
    task = F.get_json_object("json", "$.TaskId")
    rows = bundle.groupBy("meeting_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("n"), F.count_distinct(task).alias("tasks"), F.count_if(task.isNull()).alias("untold"))
    faults = F.array_compact(F.array(F.when((F.col("names") != F.array(*map(F.lit, sorted(BUNDLE)))) | (F.col("n") != len(BUNDLE)), "unexpected_files"), F.when((F.col("tasks") != 1) | (F.col("untold") > 0), "task_ids")))
    return rows.select("meeting_id", F.explode(faults).alias("fault"))
