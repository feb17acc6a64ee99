"""Readers and writers of the text formats: RTTM, time lines, tolerant JSON lines, CSV manifests, TextGrid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.scan import running


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, source, line, value) of text files: lines are numbered from 1 as they stand in their file, which isn't read as one value.

    A line's place is that of its split (splits of a file are ordered by where they begin) and its number inside it; source is the file's name.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_block_start").alias("_block")]
    rows = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("_row"), "value")
    return running(rows, ["file"], [F.col("_block").asc(), F.col("_row").asc()], count=True, name="lines").select("file", "source", F.col("pos").alias("line"), "value")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(start_ms, end_ms, speaker, source, source_ids) of SPEAKER lines with at least eight fields; source_ids names the line of the file."""
    f = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, path).select(f.alias("f"), "source", "line").where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    ms = [F.rint(F.try_element_at("f", F.lit(i)).try_cast("double") * 1000).cast("long") for i in (4, 5)]
    where = F.array(F.concat(F.lit("rttm:"), F.col("line").cast("string"))).alias("source_ids")
    return rows.select(ms[0].alias("start_ms"), (ms[0] + ms[1]).alias("end_ms"), F.col("f")[7].alias("speaker"), "source", where).where("end_ms > start_ms")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, start_s, end_s, speaker, text, source, line) of lines ``[seg-000001][0m00s-0m05s][speaker_0] text``."""
    pattern = r"^\[(seg-\d+)\]\[(\d+)m(\d+)s-(\d+)m(\d+)s\]\[([^\]]+)\] (.*)$"
    g = [F.regexp_extract("value", pattern, i) for i in range(1, 8)]
    text = numbered_lines(spark, path).withColumn("line", (F.col("line") - 1).cast("int"))
    rows = text.where(F.col("value").rlike(pattern))
    return rows.select("source", "line", g[0].alias("segment_id"), (g[1].cast("long") * 60 + g[2].cast("long")).alias("start_s"), (g[3].cast("long") * 60 + g[4].cast("long")).alias("end_s"), g[5].alias("speaker"), g[6].alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that are malformed or lack the key)."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema).alias("row"))
    good = F.coalesce(F.col("row").isNotNull() & F.col("row")[key].isNotNull(), F.lit(False))
    return rows.where(good).select("row.*"), rows.where(~good).select("value")


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    """(source, tier, start_ms, end_ms, text) of the intervals of each tier; silence and blank ones go."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    tiers = files.select("source", F.explode(F.filter(F.split("value", r"item \[\d+\]:"), lambda x: F.contains(x, F.lit("name =")))).alias("tier"))
    name = F.regexp_extract("tier", r'name = "([^"]*)"', 1)
    part = F.explode(F.filter(F.split("tier", r"intervals \[\d+\]:"), lambda x: F.contains(x, F.lit("xmax")) & F.contains(x, F.lit("text ="))))
    rows = tiers.select("source", name.alias("name"), part.alias("part"))
    text = F.replace(F.regexp_extract("part", r'(?s)text = "((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    ms = {x: F.rint(F.regexp_extract("part", rf"{x} = ([0-9.]+)", 1).try_cast("double") * 1000).cast("long") for x in ("xmin", "xmax")}
    return rows.select("source", F.col("name").alias("tier"), ms["xmin"].alias("start_ms"), ms["xmax"].alias("end_ms"), text.alias("text")).where("trim(text) not in ('', '<sil>')")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end, duration) of a CSV with a header; the duration defaults to end - start."""
    rows = spark.read.csv(path, header=True, schema="file string, start double, end double, duration double")
    return rows.withColumn("duration", F.coalesce("duration", F.col("end") - F.col("start")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime) of all files below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def timeline_line(segment_id: Column, start: Column, end: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), segment_id, F.lit("]["), start, F.lit("-"), end, F.lit("]["), speaker, F.lit("] "), text)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys aren't in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; a document that doesn't parse fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_document_or_null(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(source, doc) of JSON documents; null where one doesn't parse."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.when(F.expr("try_parse_json(value)").isNotNull(), F.from_json("value", schema)).alias("doc"))


def read_strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that doesn't parse fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Turns as they are written, and recognised segments.
TURN = "id long, start double, end double, speaker string, speaker_kind string, text string, chunk_ids array<long>"
ROW = "index long, start double, end double, speaker string, text string, status string, job_id string, audio_name string"


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of a JSON array or of ``{"turns": [...]}``, in milliseconds, as ``validation.check_turns`` takes them."""
    doc = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"struct<turns: array<struct<{TURN.replace(' ', ': ').replace(',:', ',')}>>>")["turns"], F.from_json("value", f"array<struct<{TURN.replace(' ', ': ').replace(',:', ',')}>>")).alias("turns"))
    rows = doc.select(F.posexplode("turns").alias("idx", "t")).select("idx", "t.*")
    ms = {f"{c}_ms": F.rint(F.col(c) * 1000).cast("long") for c in ("start", "end")}
    return rows.withColumns(ms | {"speaker": F.trim("speaker"), "text": F.trim("text"), "speaker_kind": F.coalesce("speaker_kind", F.lit("main"))}).drop("start", "end")


def read_transcript(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Recognised segments of a JSON array a file, or with ``lines`` a line, as canonical segments with their status."""
    from chronoloom.functions.scalars import normalize_speaker, seconds_to_ms

    rows = spark.read.schema(ROW).option("mode", "FAILFAST").json(path, multiLine=not lines)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    return rows.select(
        F.format_string("seg-%06d", F.col("index")).alias("segment_id"), F.col("index").alias("idx"), seconds_to_ms(F.col("start")).alias("start_ms"), seconds_to_ms(F.col("end")).alias("end_ms"),
        normalize_speaker(F.col("speaker")).alias("speaker"), text.alias("text"), F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("job_id", F.lit("")).alias("job_id"), F.coalesce("audio_name", F.lit("")).alias("audio_name"),
    )


def read_plan(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(speaker, start_ms, end_ms) of a segment plan, ``json`` or ``csv``; empty rows go."""
    schema = "start double, end double, duration double, speaker string"
    rows = spark.read.schema(schema).json(path, multiLine=True) if kind == "json" else spark.read.csv(path, header=True, enforceSchema=False).select(F.col("start").try_cast("double").alias("start"), F.col("end").try_cast("double").alias("end"), "speaker")
    ms = [F.rint(F.col(c) * 1000).cast("long").alias(f"{c}_ms") for c in ("start", "end")]
    return rows.select(F.coalesce("speaker", F.lit("unknown")).alias("speaker"), *ms).where("end_ms > start_ms")


def read_diarization(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(speaker, start_ms, end_ms) of JSON (a list or ``segments``) a file, or with ``lines`` a line, the speaker under any of three names; empty rows go."""
    one = "struct<start: double, end: double, speaker: string, label: string, raw_speaker: string>"
    doc = spark.read.text(path, wholetext=not lines).select(F.coalesce(F.from_json("value", f"struct<segments: array<{one}>>")["segments"], F.from_json("value", f"array<{one}>")).alias("s"))
    rows = doc.select(F.explode("s").alias("s")).select(F.coalesce("s.speaker", "s.label", "s.raw_speaker").alias("speaker"), "s.start", "s.end")
    return rows.select("speaker", *[F.rint(F.col(c) * 1000).cast("long").alias(f"{c}_ms") for c in ("start", "end")]).where("end_ms > start_ms")


def segment_of_name(name: Column) -> Column:
    """(idx, speaker, start_s, end_s) of ``seg_<idx>_<speaker>_<start>_<end>.wav``; null for other names."""
    pattern = r"^seg_(\d+)_(.+)_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)\.wav$"
    part = [F.regexp_extract(name, pattern, i) for i in range(1, 5)]
    return F.when(part[0] != "", F.struct(part[0].cast("long").alias("idx"), part[1].alias("speaker"), part[2].cast("double").alias("start_s"), part[3].cast("double").alias("end_s")))


def find_segments(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, ..) with what the manifest (file, start, end) says of them, or else their names."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("file", name).where(name.startswith("seg_") & name.endswith(".wav")).withColumn("_n", segment_of_name(F.col("file"))).join(manifest, "file", "left")
    return rows.select("file", F.col("_n.idx").alias("idx"), F.col("_n.speaker").alias("speaker"), F.coalesce("start", "_n.start_s").alias("start_s"), F.coalesce("end", "_n.end_s").alias("end_s"))


def textgrid_text(intervals: DataFrame, tier: str | None = None) -> DataFrame:
    """(source, text): the texts of a TextGrid's intervals in order of time, a line each; of one tier or of all."""
    rows = intervals if tier is None else intervals.where(F.col("tier") == tier)
    told = F.array_sort(F.collect_list(F.struct("start_ms", "tier", "text")))
    return rows.groupBy("source").agg(F.array_join(F.transform(told, lambda x: x["text"]), "\n").alias("text"))


def check_timeline(rows: DataFrame) -> DataFrame:
    """(segment_id, check) of a read time line of one file: numbers that don't rise, empty ranges, blank texts."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("line")
    why = F.array_compact(F.array(F.when(F.lag("segment_id").over(order) >= F.col("segment_id"), "not_increasing"), F.when(F.col("end_s") <= F.col("start_s"), "end_before_start"), F.when(F.trim("text") == "", "blank_text")))
    return rows.withColumn("_why", why).select("segment_id", F.explode("_why").alias("check"))


def write_lines(rows: DataFrame, line: Column, path: str, order: list[Column]) -> None:
    """A line a row, in order over the files of the folder."""
    rows.orderBy(*order).select(line.alias("value")).write.text(path)


def write_files(rows: DataFrame, path: str, folders: int = 64) -> None:
    """A text file for each ``value``, dealt over folders ``part=..`` by a whole number ``key``.

    Tasks move their own files into place, so nothing goes file by file through the driver; the folder must be new and is read when the job is done.
    """
    placed = rows.select("value", F.pmod("key", F.lit(folders)).alias("part"))
    placed.write.partitionBy("part").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def write_table(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and these columns; columns that are missing are empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.csv(path, header=True)


def write_document(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls written out."""
    rows.write.option("ignoreNullFields", "false").json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")
