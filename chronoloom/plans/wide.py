"""Registered queries of responses, coverage, refs and the small rules, each beside its SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalars as sc
from chronoloom.operators import intervals as iv
from chronoloom.operators import windowstats as ws
from chronoloom.plans.deep import BLOCKS, blocks
from chronoloom.plans.more import KEY, LONG, query
from chronoloom.plans.oracle import SEG, _islands, _iv
from chronoloom.sources import adapters as src
from chronoloom.sources import responses

# ---- responses of recognisers

RESPONSES = f"""{SEG}, r0 AS (SELECT meeting_id AS response, idx, trim(text) AS text, start_ms, end_ms, CASE WHEN idx % 5 = 4 THEN NULL ELSE speaker END AS source_speaker, meeting_id % 7 = 3 AS plain, idx % 6 = 5 AS untimed FROM s),
rs AS (SELECT *, row_number() OVER (PARTITION BY response ORDER BY idx) AS id FROM r0 WHERE NOT plain AND text <> ''),
rk AS (SELECT *, min(id) OVER (PARTITION BY response, source_speaker) AS seen FROM rs),
re AS (SELECT response, id, CASE WHEN NOT untimed THEN round(start_ms / 1000.0::DOUBLE, 3) END AS start, round(end_ms / 1000.0::DOUBLE, 3) AS "end", text, 'speaker_' || dense_rank() OVER (PARTITION BY response ORDER BY seen) AS speaker, source_speaker FROM rk
 UNION ALL SELECT response, 1, NULL, NULL, string_agg(text, ' ' ORDER BY idx), 'speaker_1', NULL FROM r0 WHERE plain GROUP BY response HAVING trim(string_agg(text, ' ' ORDER BY idx)) <> '')"""


def _responses(spark, d) -> DataFrame:
    """What a recogniser would say of each conversation: sentences under several names, some without speaker or start, some responses without sentences."""
    i = F.col("idx")
    rows = src.segments(spark, d).withColumn("text", F.btrim("text"))
    who, begin = F.when(i % 5 != 4, F.col("speaker")), F.when(i % 6 != 5, F.col("start_ms"))

    def named(value, names):
        return [F.when(i % 4 == k, value).alias(n) for k, n in enumerate(names)]

    item = F.struct(*named(F.col("text"), responses.TEXT), *named(begin, responses.START), *named(F.col("end_ms"), responses.END), *named(who, responses.SPEAKER), F.when(i % 3 == 0, F.array(F.array(F.col("start_ms"), F.col("end_ms")), F.array(F.col("start_ms")))).alias("timestamp"))
    told = rows.groupBy(F.col("meeting_id").alias("response")).agg(F.array_sort(F.collect_list(F.struct("idx", "text", item.alias("item")))).alias("all"))
    plain = F.col("response") % 7 == 3
    return told.select("response", F.when(plain, F.to_json(F.struct(F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("text")))).otherwise(F.to_json(F.struct(F.transform("all", lambda x: x["item"]).alias("sentence_info")))).alias("json"))


@query(f'WITH {RESPONSES} SELECT re.response, id, start, "end", text, speaker, source_speaker, CASE WHEN r0.idx % 3 = 0 AND NOT plain THEN 1 ELSE 0 END AS pairs FROM re LEFT JOIN (SELECT response, idx, plain, row_number() OVER (PARTITION BY response ORDER BY idx) AS rid FROM r0 WHERE NOT plain AND text <> \'\') r0 ON r0.response = re.response AND r0.rid = re.id')
def response_segments(spark, d):
    return responses.response_segments(_responses(spark, d)).withColumn("pairs", F.coalesce(F.size("timestamps"), F.lit(0))).withColumn("pairs", F.greatest("pairs", F.lit(0))).drop("timestamps")


@query(f"""WITH {RESPONSES}, w AS (SELECT response, bool_or(start IS NULL OR "end" IS NULL) AS t, bool_or(source_speaker IS NULL) AS k FROM re GROUP BY 1)
 SELECT response, array_to_string(list_filter([CASE WHEN response % 7 = 3 THEN 'missing_sentence_info' END, CASE WHEN t THEN 'missing_or_partial_sentence_timestamps' END, CASE WHEN k THEN 'speaker_fallback' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (SELECT DISTINCT response FROM r0) LEFT JOIN w USING (response)""")
def response_warnings(spark, d):
    r = _responses(spark, d)
    return responses.response_warnings(r, responses.response_segments(r)).select("response", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {RESPONSES} SELECT response, speaker, arg_min(source_speaker, id) FILTER (WHERE source_speaker IS NOT NULL) AS source_speaker, count(*) AS n, round(sum(CASE WHEN "end" >= start THEN "end" - start ELSE 0 END), 3) AS seconds FROM re GROUP BY 1, 2""")
def response_speakers(spark, d):
    return responses.response_speakers(responses.response_segments(_responses(spark, d)))


# ---- coverage of windows

RANGES = "rg AS (SELECT meeting_id, idx // 4 AS no, idx AS a, idx + idx % 5 - 1 AS b FROM s WHERE idx % 4 = 1)"
PARTS = f"""{SEG}, {RANGES}, ps AS (SELECT s.meeting_id, s.idx AS pos, EXISTS (SELECT 1 FROM rg WHERE rg.meeting_id = s.meeting_id AND s.idx BETWEEN a AND b) AS inside FROM s),
pa AS (SELECT *, CASE WHEN inside THEN 'covered' WHEN pos > coalesce(max(CASE WHEN inside THEN pos END) OVER (PARTITION BY meeting_id), -1) THEN 'tail' ELSE 'middle' END AS part FROM ps)"""


def _ranges(spark, d) -> DataFrame:
    i = F.col("idx")
    return src.segments(spark, d).where("idx % 4 = 1").select("meeting_id", F.floor(i / 4).alias("no"), i.alias("start_pos"), (i + i % 5 - 1).alias("end_pos"))


def _parts(spark, d) -> DataFrame:
    return ws.covered(src.segments(spark, d).select("meeting_id", F.col("idx").alias("pos")), _ranges(spark, d))


@query(f"WITH {PARTS} SELECT meeting_id, pos, part FROM pa")
def chapter_coverage(spark, d):
    return _parts(spark, d)


@query(f"""WITH {PARTS}, ca AS (SELECT meeting_id, CASE WHEN meeting_id % 3 > 0 THEN max(idx) - 1 END AS c FROM s GROUP BY 1), q AS (SELECT pa.*, coalesce(pos < c, true) AS bf FROM pa JOIN ca USING (meeting_id))
 SELECT meeting_id, count(*) AS n, count(*) FILTER (WHERE part = 'covered') AS covered, count(*) FILTER (WHERE part = 'middle') AS middle, count(*) FILTER (WHERE part = 'tail') AS tail, count(*) FILTER (WHERE bf) AS completed, count(*) FILTER (WHERE NOT bf) AS carried,
 count(*) FILTER (WHERE bf AND part <> 'covered') AS open_before, count(*) FILTER (WHERE NOT bf AND part <> 'covered') AS open_after FROM q GROUP BY 1""")
def window_stats(spark, d):
    carry = src.segments(spark, d).groupBy("meeting_id").agg(F.max("idx").alias("m")).select("meeting_id", F.when(F.col("meeting_id") % 3 > 0, F.col("m") - 1).alias("carryover_pos"))
    return ws.coverage_counts(_parts(spark, d), carry)


OVER = f"""{SEG}, cx AS (SELECT meeting_id, idx AS no, CASE WHEN idx % 6 = 5 THEN NULL ELSE idx * 5 % 7 END AS a, CASE WHEN idx % 6 = 5 THEN NULL ELSE idx * 5 % 7 + idx % 3 END AS b FROM s)"""


@query(f"WITH {OVER} SELECT meeting_id, row_number() OVER w AS place, no, a AS start_no, b AS end_no, coalesce(a <= lag(b) OVER w, false) AS overlaps FROM cx WINDOW w AS (PARTITION BY meeting_id ORDER BY a NULLS LAST, b NULLS LAST, no)")
def chapter_overlaps(spark, d):
    i = F.col("idx")
    return ws.chapter_overlaps(src.segments(spark, d).select("meeting_id", i.alias("no"), F.when(i % 6 != 5, i * 5 % 7).alias("start_no"), F.when(i % 6 != 5, i * 5 % 7 + i % 3).alias("end_no")))


# ---- refs, chapters and sources

@query(f"""WITH {SEG}, c AS (SELECT meeting_id, idx AS a, unnest([idx + 2, idx, 99, idx]) AS n, unnest([0, 1, 2, 3]) AS k FROM s), f AS (SELECT meeting_id, 'seg-' || lpad(CAST(n AS VARCHAR), 6, '0') AS ref, min(a * 10 + k) AS o FROM c GROUP BY 1, 2)
 SELECT f.meeting_id, row_number() OVER (PARTITION BY f.meeting_id ORDER BY o) AS place, ref FROM f JOIN s ON s.meeting_id = f.meeting_id AND s.segment_id = ref""")
def ordered_refs(spark, d):
    s, i = src.segments(spark, d), F.col("idx")
    return ws.refs_in_order(s.select("meeting_id", i.alias("at"), F.array(*[src.segment_name(n) for n in (i + 2, i, F.lit(99), i)]).alias("refs")), s)


@query(f"WITH {BLOCKS.replace('fo AS', 'fo_ AS').split(', cb AS')[0]}, lo AS (SELECT meeting_id, block, title, start_ref, end_ref, length(summary) AS overview_chars FROM bk) SELECT * FROM lo WHERE overview_chars < 60")
def weak_chapters(spark, d):
    return blocks(spark, d).select("meeting_id", "block", "title", "start_ref", "end_ref", F.length("summary").cast("long").alias("overview_chars")).where("overview_chars < 60")


@query(f"""WITH {SEG}, t AS (SELECT meeting_id, CAST(ceil(sum(length(text) + 40) / 1.3::DOUBLE) AS BIGINT) AS a, CAST(ceil(max(length(text)) / 1.3::DOUBLE) AS BIGINT) AS b FROM s GROUP BY 1)
 SELECT meeting_id, CASE WHEN a <= 600 THEN 'source_timeline' WHEN b <= 600 THEN 'chapter_summaries' ELSE 'exceeds_budget' END AS source, CASE WHEN a <= 600 THEN a ELSE b END AS tokens FROM t""")
def overview_sources(spark, d):
    t = src.segments(spark, d).groupBy("meeting_id").agg(F.ceil(F.sum(F.length("text") + 40) / 1.3).alias("timeline_tokens"), F.ceil(F.max(F.length("text")) / 1.3).alias("chapter_tokens"))
    return ws.overview_sources(t, 600)


@query(f"""WITH {_iv(LONG)}, p AS (SELECT key, id, start_ms + 1800000 AS at_ms FROM i)
 SELECT p.key, p.id, coalesce(array_to_string(list_sort(list(DISTINCT i.label)), ','), '') AS labels FROM p LEFT JOIN i ON i.key = p.key AND i.start_ms <= at_ms AND at_ms < i.end_ms GROUP BY 1, 2""")
def labels_at(spark, d):
    rows = src.intervals(spark, d, LONG)
    points = rows.select("key", "id", (F.col("start_ms") + 1_800_000).alias("at_ms"))
    return ws.labels_at(points, rows, KEY, 3_600_000).select("key", "id", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {SEG}, c AS (SELECT meeting_id, idx AS chapter, CASE WHEN idx % 2 = 0 THEN segment_id ELSE 'none' END AS f, start_ms + 500 AS t FROM s)
 SELECT meeting_id, chapter, CASE WHEN f <> 'none' THEN f ELSE (SELECT arg_min(segment_id, start_ms * 1000 + idx) FROM s WHERE s.meeting_id = c.meeting_id AND start_ms >= t) END AS segment_id FROM c""")
def chapter_segments(spark, d):
    s = src.segments(spark, d)
    return ws.chapter_segments(s.select("meeting_id", F.col("idx").alias("chapter"), F.when(F.col("idx") % 2 == 0, F.col("segment_id")).otherwise("none").alias("first_segment"), (F.col("start_ms") + 500).alias("start_ms")), s)


@query(f"""WITH {SEG}, h AS (SELECT *, instr(lower(text), 'en') AS at FROM s)
 SELECT meeting_id, idx, CASE WHEN at > 0 THEN substring(text, 1, at - 1) ELSE text END AS before, CASE WHEN at > 0 THEN substring(text, at, 2) ELSE '' END AS hit, CASE WHEN at > 0 THEN substring(text, at + 2) ELSE '' END AS after FROM h""")
def highlights(spark, d):
    return src.segments(spark, d).select("meeting_id", "idx", *ws.highlight(F.col("text"), F.lit("EN")))


@query(f"""WITH {SEG}, u AS (SELECT meeting_id, idx AS no, idx + 1 AS turn_id FROM s), w AS (SELECT meeting_id, idx AS win, unnest([idx, idx + 1, idx]) AS no, unnest([0, 1, 2]) AS place FROM s)
 SELECT w.meeting_id, win, CAST(place AS INT) AS place, w.no, turn_id, CASE WHEN turn_id IS NOT NULL THEN 1::BIGINT END AS part, CASE WHEN turn_id IS NULL THEN 'unknown_unit' END AS problem FROM w LEFT JOIN u ON u.meeting_id = w.meeting_id AND u.no = w.no""")
def window_turns(spark, d):
    s, i = src.segments(spark, d), F.col("idx")
    return ws.window_turns(s.select("meeting_id", i.alias("win"), F.array(i, i + 1, i).alias("unit_nos")), s.select("meeting_id", i.alias("no"), (i + 1).alias("turn_id"), F.lit(1).cast("long").alias("part")))


# ---- small rules over whole tables

@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, ['blocks/a', 'requests/full_summary/1', 'requests/action_review', 'requests/speaker_batches/2', 'other/blocks/'][doc_id % 5 + 1] AS p, ['meeting_minutes_vO', ' meeting_minutes_map_vO ', 'meeting_minutes_v0', 'x'][doc_id % 4 + 1] AS v FROM documents)
 SELECT doc_id, sha256(trim(regexp_replace(t, '[\\s\\p{Z}]+', ' ', 'g'))) AS heading, CASE WHEN starts_with(p, 'blocks/') THEN 'block-summary' WHEN starts_with(p, 'requests/full_summary') THEN 'full-summary' WHEN starts_with(p, 'requests/action_review') THEN 'action-review' WHEN starts_with(p, 'requests/speaker_batches') THEN 'speaker-batch' ELSE 'other' END AS kind,
 CASE trim(v) WHEN 'meeting_minutes_vO' THEN 'meeting_minutes_v0' WHEN 'meeting_minutes_map_vO' THEN 'meeting_minutes_map_v0' ELSE trim(v) END AS version, round(length(t) / 1024.0::DOUBLE, 3) AS kb, CASE WHEN doc_id % 3 = 0 THEN 'FALLBACK' ELSE upper(trim(' ' || v)) END AS code FROM x""")
def value_rules(spark, d):
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    path = src.pick(("blocks/a", "requests/full_summary/1", "requests/action_review", "requests/speaker_batches/2", "other/blocks/"), "doc_id % 5")
    version = src.pick(("meeting_minutes_vO", " meeting_minutes_map_vO ", "meeting_minutes_v0", "x"), "doc_id % 4")
    return src.table(spark, d, "documents").select("doc_id", F.sha2(sc.heading(t).cast("binary"), 256).alias("heading"), sc.request_kind(path).alias("kind"), sc.schema_version(version).alias("version"), sc.kilo_to_mega(F.length(t)).alias("kb"), sc.board_error_code(F.when(i % 3 != 0, F.concat(F.lit(" "), version)), "fallback").alias("code"))


@query(f"""WITH {SEG} SELECT meeting_id, CAST(ceil(length(to_json([{{'role': 'user', 'content': string_agg(text, chr(10) ORDER BY idx)}}])) / 1.3::DOUBLE) + 7 AS BIGINT) AS tokens FROM s GROUP BY 1""")
def message_tokens(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    rows = src.segments(spark, d).groupBy("meeting_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("content"))
    return rows.select("meeting_id", sc.message_tokens(F.array(F.struct(F.lit("user").alias("role"), F.col("content").alias("content"))), 1.3, 7).alias("tokens"))


@query("""SELECT user_id AS run, event_type AS metric, greatest(max(CASE WHEN event_id % 2 = 0 THEN value END), max(CASE WHEN event_id % 2 = 1 THEN value END)) AS value FROM events GROUP BY 1, 2""")
def metric_merge(spark, d):
    """The larger of what a result and a server say of each metric."""
    e = src.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "event_id", "value")
    result, server = (e.where(f"event_id % 2 = {k}").groupBy("run", "metric").agg(F.max("value").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return result.join(server, ["run", "metric"], "full").select("run", "metric", F.greatest("a", "b").alias("value"))


@query(f"""WITH {_iv(LONG)}, {_islands('i', 'key')}, a AS (SELECT key, count(*) AS segments, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, count(*) FILTER (WHERE label = 'view') AS views, max(end_ms) - min(start_ms) AS span_ms FROM i GROUP BY 1), u AS (SELECT key, CAST(sum(end_ms - start_ms) AS BIGINT) AS union_ms, count(*) AS runs FROM isl GROUP BY 1)
 SELECT a.*, union_ms, runs, CASE WHEN span_ms > 0 THEN round(union_ms / span_ms, 6) END AS coverage FROM a JOIN u USING (key)""")
def plan_summary(spark, d):
    rows = src.intervals(spark, d, LONG)
    length = F.col("end_ms") - F.col("start_ms")
    all_ = rows.groupBy("key").agg(F.count("*").alias("segments"), F.sum(length).alias("total_ms"), F.count_if(F.col("label") == "view").alias("views"), (F.max("end_ms") - F.min("start_ms")).alias("span_ms"))
    union = iv.islands(rows, KEY).groupBy("key").agg(F.sum(length).alias("union_ms"), F.count("*").alias("runs"))
    return all_.join(union, "key").withColumn("coverage", F.when(F.col("span_ms") > 0, F.round(F.col("union_ms") / F.col("span_ms"), 6)))


@query(f"""WITH {BLOCKS.split(', cb AS')[0]}, p AS (SELECT meeting_id, block, unnest([1, 2]) AS k, unnest(key_points) AS text FROM bk) SELECT meeting_id, 'chapter-' || (row_number() OVER (PARTITION BY p.meeting_id ORDER BY block, k)) AS id, 'block-' || block AS parent, text, 'seg-' || lpad(CAST(block AS VARCHAR), 6, '0') AS evidence FROM p""")
def outline_rows(spark, d):
    """Nested points of blocks as flat rows with ids of their own and the evidence of their block."""
    rows = blocks(spark, d).select("meeting_id", "block", "start_ref", F.posexplode("key_points").alias("k", "text"))
    number = F.row_number().over(Window.partitionBy("meeting_id").orderBy("block", "k"))
    return rows.select("meeting_id", F.concat(F.lit("chapter-"), number.cast("string")).alias("id"), F.concat(F.lit("block-"), F.col("block").cast("string")).alias("parent"), "text", F.col("start_ref").alias("evidence"))


@query("""WITH e AS (SELECT user_id AS run, ['blocks/' || event_id, 'requests/full_summary/' || event_id, 'requests/speaker_batches/' || event_id, 'x/' || event_id][event_id % 4 + 1] AS path, event_id, CAST(round(value * 100) AS BIGINT) AS tokens, event_id % 5 AS f FROM events),
 g AS (SELECT run, CASE WHEN starts_with(path, 'blocks/') THEN 'block-summary' WHEN starts_with(path, 'requests/full_summary') THEN 'full-summary' WHEN starts_with(path, 'requests/speaker_batches') THEN 'speaker-batch' ELSE 'other' END AS kind, tokens, f FROM e WHERE f <> 4)
 SELECT run, coalesce(kind, 'all') AS kind, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE f = 3) AS failed FROM g GROUP BY GROUPING SETS ((run, kind), (run))""")
def run_report(spark, d):
    """Requests of runs by kind and in all: those whose folder has both a status and a final file (a semi join of a listing of files)."""
    e = src.table(spark, d, "events").withColumn("path", F.concat(src.pick(("blocks/", "requests/full_summary/", "requests/speaker_batches/", "x/"), "event_id % 4"), F.col("event_id").cast("string")))
    names = F.when(F.col("event_id") % 5 == 4, F.array(F.lit("status.json"))).otherwise(F.array(F.lit("status.json"), F.lit("final.json")))
    files = e.select("path", F.explode(names).alias("file"))
    whole = files.groupBy("path").agg(F.count_distinct("file").alias("n")).where("n = 2")
    rows = e.join(whole, "path", "left_semi").select(F.col("user_id").alias("run"), sc.request_kind(F.col("path")).alias("kind"), F.rint(F.col("value") * 100).cast("long").alias("tokens"), (F.col("event_id") % 5 == 3).alias("failed"))
    measures = [F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.count_if("failed").alias("failed")]
    return rows.groupBy("run", "kind").agg(*measures).unionByName(rows.groupBy("run").agg(*measures).withColumn("kind", F.lit("all")))


@query(f"""WITH {SEG}, n AS (SELECT meeting_id, idx, start_ms, end_ms, CASE speaker WHEN 'speaker_0' THEN 'Ann' WHEN 'speaker_1' THEN 'Bob' ELSE speaker END AS speaker, text FROM s WHERE trim(text) <> '')
 SELECT meeting_id, string_agg('[' || (start_ms // 60000) || 'm' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || 's-' || (end_ms // 60000) || 'm' || lpad(CAST(end_ms // 1000 % 60 AS VARCHAR), 2, '0') || 's][' || speaker || '] ' || text, chr(10) ORDER BY idx) AS lines FROM n GROUP BY 1""")
def mapped_timeline(spark, d):
    """The time line of each meeting with the names that labels are mapped to."""
    s = src.segments(spark, d).where("trim(text) <> ''")
    names = spark.createDataFrame([("speaker_0", "Ann"), ("speaker_1", "Bob")], "speaker string, name string")
    s = s.join(F.broadcast(names), "speaker", "left")  # a name a label
    line = F.concat(F.lit("["), sc.whole_seconds(F.col("start_ms")), F.lit("-"), sc.whole_seconds(F.col("end_ms")), F.lit("]["), F.coalesce("name", "speaker"), F.lit("] "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return s.groupBy("meeting_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("lines"))


