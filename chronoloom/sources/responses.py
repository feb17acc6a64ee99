"""Responses of recognisers: nested JSON with keys of several names, as flat segments, speakers and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names under which a field may come, the first one that is given counts.
TEXT = ("text", "sentence", "raw_text", "transcript")
START = ("start", "begin", "start_time", "start_ms")
END = ("end", "stop", "end_time", "end_ms")
SPEAKER = ("spk", "speaker", "speaker_id", "source_speaker")
_ITEM = ", ".join([f"{c}: string" for c in (*TEXT, *SPEAKER)] + [f"{c}: double" for c in (*START, *END)] + ["timestamp: array<array<double>>", "timestamps: array<array<double>>"])
SHAPE = f"text string, sentence_info array<struct<{_ITEM}>>"


def first_present(item: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(f"{item}.{c}") for c in names])


def seconds(ms: Column) -> Column:
    return F.round(ms / 1000, 3)


def timestamp_pairs(pairs: Column) -> Column:
    """Pairs of milliseconds in seconds; shorter entries go, and nothing left is null."""
    good = F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: F.array(seconds(p[0]), seconds(p[1])))
    return F.when(F.size(good) > 0, good)


def response_segments(responses: DataFrame) -> DataFrame:
    """(response, id, start, end, text, speaker, source_speaker, timestamps) of responses (response, json); times in seconds.

    Sentences without text go. Speakers are numbered as they first come; sentences without one share a number. A response without sentences is one segment
    of its whole text. Numbers are counted within a response, which is one value.
    """
    read = responses.select("response", F.from_json("json", SHAPE).alias("r"))
    many = read.where(F.size("r.sentence_info") > 0).select("response", F.posexplode("r.sentence_info").alias("pos", "s"))
    many = many.select("response", "pos", F.btrim(F.coalesce(first_present("s", TEXT), F.lit(""))).alias("text"), seconds(first_present("s", START)).alias("start"), seconds(first_present("s", END)).alias("end"), F.nullif(F.btrim(first_present("s", SPEAKER)), F.lit("")).alias("source_speaker"), timestamp_pairs(F.coalesce(F.when(F.size("s.timestamp") > 0, F.col("s.timestamp")), F.col("s.timestamps"))).alias("timestamps"))
    many = many.where("text <> ''").withColumn("id", F.row_number().over(Window.partitionBy("response").orderBy("pos")).cast("long"))
    many = many.withColumn("seen", F.min("id").over(Window.partitionBy("response", "source_speaker")))
    many = many.withColumn("speaker", F.concat(F.lit("speaker_"), F.dense_rank().over(Window.partitionBy("response").orderBy("seen")).cast("string")))
    none = F.lit(None)
    one = read.where(~F.coalesce(F.size("r.sentence_info") > 0, F.lit(False))).select("response", F.btrim(F.coalesce("r.text", F.lit(""))).alias("text")).where("text <> ''")
    one = one.select("response", F.lit(1).cast("long").alias("id"), none.cast("double").alias("start"), none.cast("double").alias("end"), "text", F.lit("speaker_1").alias("speaker"), none.cast("string").alias("source_speaker"), none.cast("array<array<double>>").alias("timestamps"))
    return many.select(*one.columns).unionByName(one)


def response_warnings(responses: DataFrame, segments: DataFrame, with_speakers: bool = True) -> DataFrame:
    """(response, warnings) of responses and their segments: what lacks, in a fixed order."""
    told = segments.groupBy("response").agg(F.max(F.col("start").isNull() | F.col("end").isNull()).alias("no_time"), F.max(F.col("source_speaker").isNull()).alias("no_speaker"))
    rows = responses.select("response", F.coalesce(F.size(F.from_json("json", SHAPE)["sentence_info"]) > 0, F.lit(False)).alias("many")).join(told, "response", "left")
    listed = F.array(F.when(~F.col("many"), "missing_sentence_info"), F.when(F.col("no_time"), "missing_or_partial_sentence_timestamps"), F.when(F.col("no_speaker") & (F.col("many") | F.lit(with_speakers)), "speaker_fallback"))
    return rows.select("response", F.array_compact(listed).alias("warnings"))


def response_speakers(segments: DataFrame) -> DataFrame:
    """(response, speaker, source_speaker, n, seconds) of segments; those without times or whose end lies before their start add no time."""
    length = F.when(F.col("end") >= F.col("start"), F.col("end") - F.col("start")).otherwise(0.0)
    return segments.groupBy("response", "speaker").agg(F.min_by("source_speaker", F.when(F.col("source_speaker").isNotNull(), F.col("id"))).alias("source_speaker"), F.count("*").alias("n"), F.round(F.sum(length), 3).alias("seconds"))
