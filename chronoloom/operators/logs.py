"""Transcripts out of the logs that recognisers print: a grammar of blocks over numbered lines.

A marker opens a block, a line of statistics closes it, and the lines between that look like speech are what was said. Blocks are runs of
lines with the same number of closing lines before them, which is a running total; so a log of any length is split over
tasks, and only lines of the chosen block are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalars import clean_candidate, is_transcript_line, strip_control
from chronoloom.operators.scan import running
from chronoloom.sources.formats import numbered_lines

# What opens a block, what closes it, and what names a result on one line or the next, in order.
OPENING = (r"^text\s+res\s*[:：]\s*(.*)$", r"^Final\s+Commit\s+Result\s*[:：]\s*(.*)$")
CLOSING = (r"^-{5,}", r"^LLM\s+part\s+performance", r"^Stage\s+Total\s+Time", r"^Audio\s+latency", r"^Audio\s+Duration", r"^Total\s+Inference", r"^RTF\s*=", r"^TTFT\s+", r"^-->")
NAMING = (r"Final\s+Result\s*[:：]\s*(.*)", r"ASR\s+Result\s*[:：]\s*(.*)", r"Recognition\s+Result\s*[:：]\s*(.*)", r"Result\s*[:：]\s*(.*)")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line, value) of log files, the source being the file's path."""
    return numbered_lines(spark, path).select(F.col("file").alias("source"), "line", "value")


def log_lines(lines: DataFrame) -> DataFrame:
    """(source, line, part, value) without control sequences and blank lines; a carriage return begins a new line, a part of the old one."""
    parts = F.split(strip_control(F.col("value")), "\n")
    rows = lines.select("source", "line", F.posexplode(parts).alias("part", "value"))
    return rows.withColumn("value", F.btrim("value", F.lit(" \t\r\n\x0b\x0c"))).where("value <> ''")


def blocks(lines: DataFrame) -> DataFrame:
    """Lines (source, line, part, value) with ``block`` (closing lines before), opens, first (what the marker's own line says), candidate and spoken."""
    closing = F.col("value").rlike("(?i)" + "|".join(f"(?:{p})" for p in CLOSING))
    first = F.lit(None).cast("string")
    for pattern in reversed(OPENING):
        first = F.when(F.col("value").rlike("(?i)" + pattern), clean_candidate(F.regexp_extract("value", "(?i)" + pattern, 1))).otherwise(first)
    candidate = clean_candidate(F.col("value"))
    rows = lines.withColumns({"closes": closing.cast("long"), "first": first, "candidate": candidate})
    rows = rows.withColumn("spoken", (F.col("closes") == 0) & (F.col("candidate") != "") & is_transcript_line(F.col("candidate")))
    rows = running(rows, ["source"], [F.col("line").asc(), F.col("part").asc()], {"block": "closes"}, name="log_blocks")
    return rows.withColumns({"block": F.col("block") - F.col("closes"), "opens": F.col("first").isNotNull()})


def transcripts(lines: DataFrame) -> DataFrame:
    """(source, text, how, from_line, to_line) of logs (source, line, value): what the first block that says anything says, or else the first named result.

    how: ``block``, ``named`` (on the line of the name or the next) or ``none`` (text empty, no lines).
    """
    rows = blocks(log_lines(lines))
    at = F.struct("line", "part")
    last = rows.where("spoken").groupBy("source", "block").agg(F.max(at).alias("last_spoken"))
    says = (F.col("first") != "") | F.coalesce(F.col("last_spoken") > at, F.lit(False))
    winner = rows.where("opens").join(last, ["source", "block"], "left").where(says).groupBy("source").agg(F.min_by(F.struct("block", "line", "part", "first"), at).alias("w"))
    inside = rows.join(winner, "source").where((F.col("block") == F.col("w.block")) & F.col("spoken") & (at > F.struct("w.line", "w.part"))).select("source", "line", "part", F.col("candidate").alias("said"))
    own = winner.where("w.first <> ''").select("source", "w.line", "w.part", F.col("w.first").alias("said"))
    said = inside.unionByName(own).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("line", "part", "said"))).alias("said"))
    found = said.select("source", F.array_join(F.transform("said", lambda x: x["said"]), "\n").alias("text"), F.lit("block").alias("how"), F.col("said")[0]["line"].alias("from_line"), F.element_at("said", -1)["line"].alias("to_line"))

    # names of results: on each line in the order of the patterns, then the line after it
    order = Window.partitionBy("source").orderBy("line", "part")
    rest = rows.join(found.select("source"), "source", "left_anti").withColumns({"next": F.lead("candidate").over(order), "next_line": F.lead("line").over(order)})
    tries = []
    for number, pattern in enumerate(NAMING):
        hit = F.col("value").rlike("(?i)" + pattern)
        own_text = clean_candidate(F.regexp_extract("value", "(?i)" + pattern, 1))
        tries += [F.when(hit & (own_text != "") & is_transcript_line(own_text), F.struct(F.lit(2 * number).alias("k"), own_text.alias("text"), F.col("line").alias("to_line")))]
        tries += [F.when(hit & (F.col("next") != "") & is_transcript_line(F.col("next")), F.struct(F.lit(2 * number + 1).alias("k"), F.col("next").alias("text"), F.col("next_line").alias("to_line")))]
    named = rest.withColumn("named", F.coalesce(*tries)).where("named is not null").groupBy("source").agg(F.min_by(F.struct("line", "named"), at).alias("n"))
    named = named.select("source", F.col("n.named.text").alias("text"), F.lit("named").alias("how"), F.col("n.line").alias("from_line"), F.col("n.named.to_line").alias("to_line"))
    out = lines.select("source").distinct().join(found.unionByName(named), "source", "left")
    return out.select("source", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("how", F.lit("none")).alias("how"), "from_line", "to_line")
