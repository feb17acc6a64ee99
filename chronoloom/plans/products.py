"""Registered queries of model answers, drafts and exports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import scalars as sc
from chronoloom.operators import answers, diagnostics, drafts, records, reviews
from chronoloom.plans.more import _case, query
from chronoloom.plans.oracle import LIB, SEG
from chronoloom.sources import adapters as src

# ---- answers about blocks of two segments


def _name(n: str) -> str:
    return f"'seg-' || lpad(CAST({n} AS VARCHAR), 6, '0')"


CLEAN = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"
ANSWERS = f"""{SEG}, ab AS (SELECT meeting_id, idx // 2 AS block, min(idx) AS lo, max(idx) AS hi, arg_min(text, idx) <> '' AS ta, arg_max(text, idx) <> '' AS tz, {CLEAN.format("'said ' || string_agg(text, ' ' ORDER BY idx)")} AS said FROM s GROUP BY 1, 2),
an AS (SELECT *, (meeting_id + block) % 9 AS k, {_name('lo')} AS a, {_name('hi')} AS z FROM ab),
af AS (SELECT *, CASE WHEN k = 1 THEN 'unfinished' WHEN k = 2 THEN 'cut_input' WHEN k = 3 THEN 'not_json' WHEN k = 4 THEN 'no_title_or_summary' WHEN length(said) < 60 THEN 'short_summary' END AS fault,
 list_filter([CASE WHEN tz THEN z END, CASE WHEN ta AND lo < hi THEN a END], lambda x: x IS NOT NULL) AS cited, CASE WHEN lo = hi THEN [a] ELSE [a, z] END AS ends FROM an)"""


def _block_segments(spark, d) -> DataFrame:
    return src.segments(spark, d).withColumn("block", F.expr("idx div 2")).withColumn("short", F.concat(F.lit("s"), F.col("idx").cast("string")))


def _json(value: Column) -> Column:
    """A value as it stands in JSON."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _block_answers(spark, d) -> DataFrame:
    """What a model would say of each block: some answers cut, broken, short or with fields of other kinds, some in a code fence."""
    rows = _block_segments(spark, d).groupBy("meeting_id", "block").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("all"))
    k, b = (F.col("meeting_id") + F.col("block")) % 9, F.col("block").cast("string")
    a, z = src.segment_name(F.col("lo")), src.segment_name(F.col("hi"))
    said = F.concat(F.lit("said "), F.array_join(F.transform("all", lambda x: x["text"]), " "))
    refs = F.when(k == 5, _json(a)).when(k == 6, F.lit('["seg-999999",7]')).otherwise(_json(F.array(z, F.lit("seg-999999"), F.concat(F.lit("s"), F.col("lo").cast("string")), z)))
    goes_on = F.when(k == 7, '"continues_previous":" Yes",').when(k == 8, '"continues_previous":true,').when(k == 0, '"continues_previous":"no",').otherwise("")
    task = _json(F.struct(F.concat(F.lit(" task "), b).alias("task"), F.lit("无").alias("owner"), F.concat(F.lit("day "), b).alias("deadline"), F.array(z, a, z).alias("refs")))
    tasks = F.concat(F.lit("[3,"), task, F.lit(',{"task":" ","refs":['), _json(a), F.lit(']},{"task":"t","refs":'), _json(a), F.lit("}]"))
    anchors = F.when(k == 8, "").otherwise('"anchors":["x"],')
    whole = F.concat(F.lit('{"title":'), _json(F.when(k == 4, " 无 ").otherwise(F.concat(F.lit("title "), b))), F.lit(',"key_points":["p"," p "," ","q"],'), anchors, goes_on, F.lit('"key_refs":'), refs, F.lit(',"action_candidates":'), tasks, F.lit(',"summary":'), _json(said), F.lit("}"))
    fenced = F.when(F.col("block") % 2 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    return rows.select("meeting_id", "block", F.when(k == 1, "length").otherwise("stop").alias("finish_reason"), F.when(k == 2, True).alias("truncated"), F.when(k == 3, '{"title": ').otherwise(fenced).alias("content"))


@query(f"""WITH {ANSWERS} SELECT meeting_id, block, fault, CASE WHEN fault IS NULL THEN 'title ' || block END AS title, CASE WHEN fault IS NULL THEN said END AS summary, CASE WHEN fault IS NULL THEN 'p,q' END AS key_points, CASE WHEN fault IS NULL THEN CASE WHEN k = 8 THEN '' ELSE 'x' END END AS anchors,
 CASE WHEN fault IS NULL THEN k IN (7, 8) END AS continues_previous, CASE WHEN fault IS NULL THEN array_to_string(CASE WHEN k IN (5, 6) OR len(cited) = 0 THEN ends ELSE cited END, ',') END AS refs, CASE WHEN fault IS NULL THEN a END AS start_ref, CASE WHEN fault IS NULL THEN z END AS end_ref FROM af""")
def block_summaries(spark, d):
    rows = answers.block_summaries(_block_answers(spark, d), _block_segments(spark, d))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("key_points", "anchors", "refs")})


@query(f"WITH {ANSWERS} SELECT meeting_id, block, 1 AS no, 'task ' || block AS task, CAST(NULL AS VARCHAR) AS owner, 'day ' || block AS deadline, array_to_string(cited, ',') AS refs FROM af WHERE fault IS NULL AND len(cited) > 0")
def block_actions(spark, d):
    said, of = _block_answers(spark, d), _block_segments(spark, d)
    return answers.block_actions(said, of, answers.block_summaries(said, of)).withColumn("refs", F.array_join("refs", ","))


OVERVIEWS = f"""{SEG}, om AS (SELECT meeting_id, meeting_id % 8 AS k, {CLEAN.format("'all ' || string_agg(text, ' ' ORDER BY idx)")} AS said FROM s GROUP BY 1),
oc AS (SELECT meeting_id, idx // 3 AS c, min(idx) AS lo, max(idx) AS hi FROM s GROUP BY 1, 2), orf AS (SELECT meeting_id, c, 0 AS pos, hi AS i FROM oc UNION ALL SELECT meeting_id, c, 1, lo FROM oc WHERE lo < hi),
oj AS (SELECT meeting_id, string_agg(segment_id, ',' ORDER BY c, pos) AS refs FROM orf JOIN s USING (meeting_id) WHERE orf.i = s.idx AND s.text <> '' AND meeting_id % 8 <> 7 GROUP BY 1),
oo AS (SELECT om.meeting_id, said, refs, CASE WHEN k = 1 THEN 'unfinished' WHEN k = 2 THEN 'cut_input' WHEN k = 3 THEN 'not_json' WHEN k = 4 THEN 'no_overview' WHEN k = 5 THEN 'no_text' WHEN length(said) < 120 THEN 'short_text' WHEN refs IS NULL THEN 'no_refs' END AS fault FROM om LEFT JOIN oj USING (meeting_id))"""


@query(f"WITH {OVERVIEWS} SELECT meeting_id, fault, CASE WHEN fault IS NULL THEN 'meeting ' || meeting_id END AS title, CASE WHEN fault IS NULL THEN said END AS text, CASE WHEN fault IS NULL THEN refs END AS refs FROM oo")
def answer_overviews(spark, d):
    segments, k = src.segments(spark, d), F.col("meeting_id") % 8
    chapters = segments.groupBy("meeting_id", F.expr("idx div 3").alias("chapter")).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    unknown = F.lit("seg-999999")
    chapters = chapters.select("meeting_id", "chapter", F.when(k == 7, F.array(unknown)).otherwise(F.array(src.segment_name(F.col("hi")), unknown, src.segment_name(F.col("lo")))).alias("refs"))
    rows = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("all"))
    text = F.when(k == 5, " ").otherwise(F.concat(F.lit("all "), F.array_join(F.transform("all", lambda x: x["text"]), " ")))
    content = F.concat(F.lit('{"title":'), _json(F.concat(F.lit("meeting "), F.col("meeting_id").cast("string"))), F.lit(',"overview":'), F.when(k == 4, '"text"').otherwise(F.to_json(F.struct(text.alias("text")))), F.lit("}"))
    said = rows.select("meeting_id", F.when(k == 1, "length").otherwise("stop").alias("finish_reason"), (k == 2).alias("truncated"), F.when(k == 3, "no object").otherwise(content).alias("content"))
    return answers.overviews(said, chapters, segments).withColumn("refs", F.array_join("refs", ","))


# ---- drafts and exports

DRAFTS = f"""{SEG}, dm AS (SELECT DISTINCT meeting_id, meeting_id % 4 = 0 AS finalized FROM s),
di AS (SELECT s.meeting_id, ['decisions', 'action_items', 'chapters', 'outline'][idx % 4 + 1] AS kind, idx AS pos, CASE WHEN idx % 7 <> 6 THEN 'n' || idx % 5 END AS item_id, text, CASE WHEN finalized THEN 'reviewed' ELSE ['reviewed', 'edited', 'pending', 'pending'][idx // 2 % 4 + 1] END AS mark FROM s JOIN dm USING (meeting_id)),
dk AS (SELECT meeting_id, item_id, arg_max(mark, CASE kind WHEN 'outline' THEN 2 WHEN 'action_items' THEN 1 ELSE 0 END * 1000000000 + pos) AS mark FROM di WHERE kind <> 'chapters' AND item_id IS NOT NULL GROUP BY 1, 2),
dn AS (SELECT meeting_id, speaker AS speaker_id, arg_max(CASE WHEN idx % 3 = 0 THEN speaker ELSE 'N' || idx END, idx) AS name FROM s GROUP BY 1, 2)"""


def _meetings(spark, d) -> DataFrame:
    i = F.col("meeting_id")
    return src.table(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id")).distinct().select("meeting_id", F.concat(F.lit("meeting "), i.cast("string")).alias("title"), (i % 4 == 0).alias("finalized"))


def _items(spark, d) -> DataFrame:
    """A result's items, one a segment, some with ids given twice or not at all and with states that nobody knows."""
    i = F.col("idx")
    return src.segments(spark, d).select(
        "meeting_id", src.pick(("decisions", "action_items", "chapters", "outline"), "idx % 4").alias("kind"), i.alias("pos"), F.when(i % 7 != 6, F.concat(F.lit("n"), (i % 5).cast("string"))).alias("item_id"), "text",
        src.pick(("reviewed", "edited", "odd", None), "idx div 2 % 4").alias("review_status"),
    )


def _speakers(spark, d) -> DataFrame:
    i = F.col("idx")
    return src.segments(spark, d).select("meeting_id", i.alias("pos"), F.col("speaker").alias("speaker_id"), F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("N"), i.cast("string"))).alias("display_name"))


def _contents(spark, d) -> DataFrame:
    overviews = _meetings(spark, d).where("meeting_id % 3 <> 0").select("meeting_id", F.concat(F.lit("about "), "title").alias("overview"))
    return drafts.contents(_meetings(spark, d), _items(spark, d), _speakers(spark, d), overviews)


@query(f"WITH {DRAFTS} SELECT * FROM dk")
def draft_marks(spark, d):
    return drafts.review_marks(_items(spark, d).join(_meetings(spark, d).select("meeting_id", "finalized"), "meeting_id"))


@query(f"WITH {DRAFTS} SELECT * FROM dn")
def draft_names(spark, d):
    return drafts.speaker_names(_speakers(spark, d))


@query(f"""WITH {DRAFTS} SELECT meeting_id, 'meeting ' || meeting_id AS title, CASE WHEN meeting_id % 3 <> 0 THEN 'about meeting ' || meeting_id END AS overview,
 (SELECT coalesce(string_agg(speaker_id || '=' || name, ',' ORDER BY speaker_id), '') FROM dn WHERE dn.meeting_id = dm.meeting_id) AS names, (SELECT coalesce(string_agg(item_id || '=' || mark, ',' ORDER BY item_id), '') FROM dk WHERE dk.meeting_id = dm.meeting_id) AS marks,
 {', '.join(f"(SELECT coalesce(string_agg(coalesce(item_id, '') || ':' || mark || ':' || text, ',' ORDER BY pos), '') FROM di WHERE di.meeting_id = dm.meeting_id AND kind = '{k}') AS {k}" for k in ('decisions', 'action_items', 'chapters'))},
 CASE WHEN meeting_id % 3 <> 0 THEN (SELECT count(*) FROM di WHERE di.meeting_id = dm.meeting_id AND kind = 'outline') END AS outline FROM dm""")
def draft_contents(spark, d):
    """Read back from the nested documents."""
    item = "array<struct<item_id: string, text: string, review_status: string>>"
    c = F.from_json("json", f"title string, speaker_names map<string, string>, minutes struct<overview: string, outline: {item}>, chapters {item}, decisions {item}, action_items {item}, review_marks map<string, string>")

    def pairs(m: Column) -> Column:
        return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")

    def listed(name: str) -> Column:
        return F.array_join(F.transform(c[name], lambda x: F.concat(F.coalesce(x["item_id"], F.lit("")), F.lit(":"), x["review_status"], F.lit(":"), x["text"])), ",").alias(name)

    outline = F.when(c["minutes"].isNotNull(), F.size(c["minutes"]["outline"])).cast("long")
    return _contents(spark, d).select("meeting_id", c["title"].alias("title"), c["minutes"]["overview"].alias("overview"), pairs(c["speaker_names"]).alias("names"), pairs(c["review_marks"]).alias("marks"), *map(listed, ("decisions", "action_items", "chapters")), outline.alias("outline"))


@query(f"""WITH {DRAFTS} SELECT meeting_id, CASE WHEN meeting_id % 5 = 0 THEN 'saved' WHEN meeting_id % 7 <> 3 THEN 'new' ELSE 'not_ready' END AS origin, CASE WHEN meeting_id % 5 = 0 THEN 3 WHEN meeting_id % 7 <> 3 THEN 0 END AS revision,
 CASE WHEN meeting_id % 5 = 0 THEN 1 WHEN meeting_id % 7 <> 3 THEN CASE WHEN meeting_id % 2 = 0 THEN 2 ELSE 1 END END AS base_result_revision, CASE WHEN meeting_id % 5 = 0 THEN 'kept' WHEN meeting_id % 7 <> 3 THEN 'meeting ' || meeting_id END AS title FROM dm""")
def draft_loads(spark, d):
    i, rows = F.col("meeting_id"), _meetings(spark, d)
    saved = rows.where("meeting_id % 5 = 0").select("meeting_id", F.lit(3).alias("revision"), F.lit(1).alias("base_result_revision"), F.lit('{"title": "kept"}').alias("json"))
    results = rows.where("meeting_id % 7 <> 3").select("meeting_id", F.when(i % 2 == 0, 2).alias("result_revision"))
    return drafts.load_drafts(rows, saved, results, _contents(spark, d)).withColumn("title", F.get_json_object("json", "$.title")).drop("json")


@query(f"""WITH {DRAFTS} SELECT meeting_id, unnest(CASE meeting_id % 6 WHEN 1 THEN ['transcript_edits'] WHEN 2 THEN ['title', 'review_marks'] WHEN 3 THEN ['content'] WHEN 4 THEN ['content'] WHEN 5 THEN ['minutes'] ELSE [] END) AS fault FROM dm""")
def draft_faults(spark, d):
    """Faults of new drafts in which five of six have been spoilt."""
    i, c = F.col("meeting_id") % 6, F.col("json")
    other = F.regexp_replace(F.regexp_replace(c, '"title":', '"titel":'), '"review_marks":\\{[^}]*\\}', '"review_marks":3')
    spoilt = F.when(i == 1, F.replace(c, F.lit('"transcript_edits":[]'), F.lit('"transcript_edits":{}'))).when(i == 2, other).when(i == 3, "[1]").when(i == 4, F.expr("substring(json, 1, length(json) - 1)")).when(i == 5, F.regexp_replace(c, '"minutes":(null|\\{)', '"minutes":[],"m":$1')).otherwise(c)
    return drafts.draft_faults(_contents(spark, d).withColumn("json", spoilt))


@query(f"""WITH {LIB}, xf AS (SELECT meeting_id, 'formal_minutes.html' AS name, size FROM lb WHERE meeting_id % 8 = 0 UNION ALL SELECT meeting_id, 'formal_minutes.txt', size + 1 FROM lb WHERE meeting_id % 3 = 0)
 SELECT meeting_id, format, CASE WHEN xf.name IS NULL THEN 'queued' ELSE 'ready' END AS state, xf.name AS file_name, xf.size AS size_bytes, CASE WHEN xf.name IS NOT NULL AND meeting_id % 2 = 0 THEN updated_at END AS created_at
 FROM lb CROSS JOIN (VALUES ('html', 'formal_minutes.html'), ('txt', 'formal_minutes.txt'), ('json', 'formal_result.json')) f(format, wanted) LEFT JOIN xf USING (meeting_id) WHERE xf.name IS NULL OR xf.name = wanted
 UNION ALL SELECT meeting_id, format, 'queued', NULL, NULL, NULL FROM lb CROSS JOIN (VALUES ('html', 'formal_minutes.html'), ('txt', 'formal_minutes.txt'), ('json', 'formal_result.json')) f(format, wanted)
 WHERE EXISTS (SELECT 1 FROM xf WHERE xf.meeting_id = lb.meeting_id) AND NOT EXISTS (SELECT 1 FROM xf WHERE xf.meeting_id = lb.meeting_id AND xf.name = wanted)""")
def export_items(spark, d):
    rows = src.library(spark, d)
    name = F.element_at(F.split("path", "/"), -1)
    files = src.stored_files(spark, d).select("meeting_id", name.alias("name"), "size").union(rows.where("meeting_id % 3 = 0").select("meeting_id", F.lit("formal_minutes.txt"), F.col("size") + 1))
    return drafts.export_items(rows, files, rows.where("meeting_id % 2 = 0").select("meeting_id", F.col("updated_at").alias("finalized_at")))


# ---- failures and artifacts

FAILED = """fe AS (SELECT event_id AS e, event_type AS t, event_id % 3 = 0 AS c, event_id % 7 <> 0 AS k, event_id % 4 AS r, event_id % 5 = 0 AS p FROM events),
fm AS (SELECT *, CASE WHEN r = 0 THEN 'finish_reason is length' WHEN k THEN t || ' input was truncated' ELSE 'processing failed' END AS message, CASE WHEN k THEN 'asr' WHEN c THEN 'export' ELSE 'llm' END AS stage FROM fe)"""


def _failures(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What records, tasks and results tell of each event as a failed run: some lack, some aren't JSON, some wrap what they tell."""
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    rows = src.table(spark, d, "events").withColumn("meeting_id", i)
    error = F.concat(F.lit('"error":{"code":"E_TASK","error":{},"message":'), _json(F.concat("event_type", F.lit(" input was truncated"))), F.lit(',"stage":"asr","return_code":7,"worker_log":"/var/log/w-'), n, F.lit('.log"},'))
    report = F.concat(F.lit('"harness_diagnostics":{"stage":"export","error":{"code":"E_OWN","finish_reason":"length","cause":"oom","context_truncated":false},"identity":{"run_id":"run-'), n, F.lit('"}},'))
    task = F.concat(F.lit("{"), F.when(i % 7 != 0, error).otherwise(""), F.when(i % 3 == 0, report).otherwise('"harness_diagnostics":{},'), F.lit('"return_code":0,"stage":"llm"}'))
    wrapped = F.concat(F.lit('{"result":{"run_id":"r-'), n, F.lit('","errors":[3,{"message":"finish_reason is length"}],"runtime":{"total_elapsed_seconds":12.5}}}'))
    result = F.when(i % 4 == 0, wrapped).when(i % 4 == 1, '{"errors":{"code":"E_SRC"},"stage":"prepare"}').otherwise("no result")
    previous = F.when(i % 5 == 0, '{"return_code":3,"worker_log_ref":"a\\\\b.log","run_id":"old"}')
    return rows.select("meeting_id", previous.alias("previous")), rows.select("meeting_id", task.alias("task")), rows.where("event_id % 4 <> 3").select("meeting_id", result.alias("result"))


@query(f"""WITH {FAILED} SELECT e AS meeting_id, stage, {_case('stage', sc.PHASES, "'transcribing'")} AS phase, CASE WHEN c THEN 'E_OWN' WHEN r = 1 THEN 'E_SRC' WHEN k THEN 'E_TASK' ELSE 'HARNESS_FAILED' END AS code, message, CASE WHEN k THEN 7 WHEN p THEN 3 END AS return_code,
 CASE WHEN r = 0 THEN 12.5 END AS elapsed_seconds, CASE WHEN r = 0 THEN 'r-' || e WHEN c THEN 'run-' || e WHEN p THEN 'old' END AS run_id, CASE WHEN c THEN 'harness_error_report' ELSE 'legacy_task_snapshot' END AS diagnostic_source,
 CASE WHEN c THEN 'oom' WHEN r = 0 THEN 'finish_reason_length' WHEN k THEN 'context_truncated' END AS cause, CASE WHEN c THEN 'length' END AS finish_reason, CASE WHEN c THEN false END AS context_truncated, CAST(NULL AS VARCHAR) AS request_id,
 CASE WHEN k THEN 'w-' || e || '.log' WHEN p THEN 'b.log' END AS worker_log FROM fm""")
def failed_diagnostics(spark, d):
    return diagnostics.failed_diagnostics(*_failures(spark, d))


@query("""WITH n AS (SELECT event_id AS doc, unnest(['a', 'b', 'c', 'e', 'f', 'g']) AS name FROM events) SELECT doc, name, CASE name WHEN 'a' THEN CASE WHEN doc % 2 = 0 THEN 'out/x-' || doc || '.json' ELSE 'side.json' END WHEN 'b' THEN 'sub/y.json' WHEN 'c' THEN 'z.txt' WHEN 'e' THEN 'q.txt' WHEN 'f' THEN 'f.txt' ELSE 'far.json' END AS ref,
 CASE WHEN name = 'b' THEN doc END AS size_bytes, CASE WHEN name = 'b' THEN 'ab' END AS sha256 FROM n WHERE name IN ('a', 'f') OR doc % 2 = 0""")
def artifact_refs(spark, d):
    """What the result tells (of every second run) counts before what lies beside it."""
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    rows = src.table(spark, d, "events").select(i.alias("doc"), F.concat(F.lit("/data/run-"), n).alias("root"), "event_id")
    told = F.concat(F.lit('{"artifacts":{"a":"out/x-'), n, F.lit('.json","b":{"path":"/data/run-'), n, F.lit('/sub/y.json","size_bytes":'), n, F.lit(',"sha256":"ab"},"c":"../z.txt","d":5,"e":"C:\\\\w\\\\q.txt","g":"/else/far.json","h":{"path":7}}}'))
    beside = F.lit('{"artifacts":{"a":"side.json","f":"f.txt"}}')
    return diagnostics.artifact_refs(rows.select("doc", "root", beside.alias("beside"), F.when(i % 2 == 0, told).otherwise('{"artifacts":3}').alias("result")), ("beside", "result"))


# ---- around a review

CANDIDATES = f"{SEG}, ca AS (SELECT meeting_id, -idx AS no, idx, unnest([idx, idx - 3, idx + 2]) AS i, unnest([0, 1, 2]) AS place FROM s WHERE idx % 2 = 1)"


def _candidates(spark, d) -> DataFrame:
    """Candidates told backwards; each cites three segments, some of which aren't there."""
    i = F.col("idx")
    return src.segments(spark, d).where("idx % 2 = 1").select("meeting_id", (-i).alias("no"), i.alias("evidence_id"), F.array(*map(src.segment_name, (i, i - 3, i + 2))).alias("refs"))


@query(f"WITH {CANDIDATES}, cm AS (SELECT s.meeting_id, segment_id, speaker, text, min(no * 10 + place) AS o FROM ca JOIN s ON s.meeting_id = ca.meeting_id AND s.idx = ca.i GROUP BY ALL) SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY o) - 1 AS pos, segment_id, speaker, text FROM cm")
def cited_segments(spark, d):
    return reviews.cited_segments(_candidates(spark, d), src.segments(spark, d))


@query(f"WITH {CANDIDATES}, cj AS (SELECT s.meeting_id, ca.idx AS evidence_id, segment_id, start_ms FROM ca JOIN s ON s.meeting_id = ca.meeting_id AND s.idx = ca.i) SELECT meeting_id, evidence_id, arg_min(segment_id, start_ms) AS segment_id, min(start_ms) AS start_ms FROM (SELECT * FROM cj ORDER BY segment_id) GROUP BY 1, 2")
def evidence_targets(spark, d):
    return reviews.evidence_links(_candidates(spark, d), src.segments(spark, d))[0]


@query(f"WITH {CANDIDATES} SELECT s.meeting_id, s.segment_id, min(ca.idx) AS evidence_id, count(DISTINCT ca.idx) AS n FROM s LEFT JOIN ca ON s.meeting_id = ca.meeting_id AND s.idx = ca.i GROUP BY 1, 2")
def segment_evidence(spark, d):
    return reviews.evidence_links(_candidates(spark, d), src.segments(spark, d))[1]


CHUNKS = f"{SEG}, ck AS (SELECT meeting_id, idx // 4 AS chunk, idx AS i FROM s UNION ALL SELECT DISTINCT meeting_id, idx // 4, 999999 FROM s WHERE (meeting_id + idx // 4) % 3 = 1)"


def _chunks(spark, d) -> DataFrame:
    """Chunks of four segments; a third of them also name one that isn't there."""
    rows = src.segments(spark, d).groupBy("meeting_id", F.expr("idx div 4").alias("chunk")).agg(F.array_sort(F.collect_list("segment_id")).alias("ids"))
    lost = (F.col("meeting_id") + F.col("chunk")) % 3 == 1
    return rows.select("meeting_id", "chunk", F.when(lost, F.concat("ids", F.array(F.lit("seg-999999")))).otherwise(F.col("ids")).alias("segment_ids"))


@query(f"WITH {CHUNKS} SELECT meeting_id, idx // 4 AS chunk, row_number() OVER (PARTITION BY meeting_id, idx // 4 ORDER BY idx) - 1 AS pos, segment_id, text FROM s WHERE (meeting_id + idx // 4) % 3 <> 1")
def chunk_members(spark, d):
    return reviews.chunk_members(_chunks(spark, d), src.segments(spark, d))[0]


@query(f"WITH {CHUNKS} SELECT meeting_id, chunk, 'seg-' || i AS missing FROM ck WHERE i = 999999")
def chunk_faults(spark, d):
    return reviews.chunk_members(_chunks(spark, d), src.segments(spark, d))[1]


RECORDED = f"""{SEG}, rd AS (SELECT meeting_id AS key, max(end_ms) / 1000.0::DOUBLE AS duration FROM s GROUP BY 1 HAVING max(end_ms) > 0),
rw AS (SELECT key, duration, unnest(generate_series(0, CAST(ceil(duration / 10) AS BIGINT) - 1)) AS w FROM rd),
rx AS (SELECT key, w AS "window", round(w * 10.0::DOUBLE, 3) AS start, round(least(10.0::DOUBLE, duration - w * 10.0::DOUBLE), 3) AS duration, CASE WHEN (key + w) % 11 = 3 THEN 'missing' WHEN (key + w) % 5 = 2 THEN 'convert_failed' ELSE 'ok' END AS status FROM rw),
ry AS (SELECT *, CASE WHEN status = 'ok' THEN repeat('w', CAST("window" % 3 AS BIGINT)) END AS text FROM rx)"""


def _recorded(spark, d) -> DataFrame:
    """Recordings of meetings in windows of ten seconds, some of which failed or have no result."""
    rows = src.segments(spark, d).groupBy(F.col("meeting_id").alias("key")).agg((F.max("end_ms") / 1000.0).alias("duration"))
    windows = rows.where("duration > 0").select("key", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / 10) - 1)).alias("window"))
    i = F.col("key") + F.col("window")
    results = windows.where((i % 11) != 3).select("key", "window", F.when(i % 5 == 2, "convert_failed").otherwise("ok").alias("status"), F.repeat(F.lit("w"), (F.col("window") % 3).cast("int")).alias("text"))
    return reviews.recording_windows(rows, results, 10)


@query(f"WITH {RECORDED} SELECT * FROM ry")
def recording_windows(spark, d):
    return _recorded(spark, d)


@query(f"WITH {RECORDED} SELECT key, count(*) AS windows, count(*) FILTER (WHERE status = 'convert_failed') AS failed, count(*) FILTER (WHERE status = 'missing') AS missing, CAST(coalesce(sum(length(text)), 0) + greatest(count(*) FILTER (WHERE text <> '') - 1, 0) AS BIGINT) AS chars FROM ry GROUP BY 1")
def recording_totals(spark, d):
    return reviews.recording_totals(_recorded(spark, d))


@query("""WITH f AS (SELECT doc_id AS doc, unnest(['participants', 'topics', 'decisions', 'risks']) AS field, doc_id % 50 AS n FROM documents)
 SELECT doc, field, 0 AS pos, CASE WHEN n = 7 THEN '7,odd' ELSE n || ',7,odd' END AS turn_ids, 'v2-chapter-' || n || ',other' AS source_ids FROM f WHERE field IN ('participants', 'topics')
 UNION ALL SELECT doc, field, 1, NULL, NULL FROM f WHERE field = 'decisions'""")
def fact_refs(spark, d):
    """Facts of each document: labels of turns and sources in several forms, items that aren't objects, a field that is no list."""
    n = (F.col("doc_id") % 50).cast("string")
    item = F.concat(F.lit('[{"turn_ids":["[Turn 00'), n, F.lit(']",7,"turn:7","odd"],"source_ids":["V02-chapter-0'), n, F.lit('","other","other"]}]'))
    whole = F.concat(F.lit('{"participants":'), item, F.lit(',"topics":'), item, F.lit(',"decisions":["no object",{"turn_ids":3}],"risks":"none"}'))
    rows = reviews.fact_refs(src.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), whole.alias("json")))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("turn_ids", "source_ids")})


def _summaries(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two summaries of each conversation: of what users said and of what assistants said, with equal keywords."""
    rows = src.segments(spark, d).groupBy(F.col("meeting_id").alias("key"), "speaker").agg(F.array_sort(F.collect_list("segment_id")).alias("ids"), F.min("text").alias("text"))
    rows = rows.select("key", "speaker", F.to_json(F.struct(F.col("text").alias("overview"), F.col("ids").alias("key_points"), F.lit("same").alias("keywords"))).alias("json"))
    return tuple(rows.where(F.col("speaker") == s).select("key", "json") for s in ("speaker_0", "speaker_1"))


@query()
def summary_likeness(spark, d):
    """No SQL: longest matching blocks; tests compare it with a plain loop."""
    return reviews.summary_likeness(*_summaries(spark, d), ("overview", "key_points", "keywords", "risks"))


# ---- records

ASKED = """aq AS (SELECT doc_id // 2 AS meeting_id, doc_id AS place, 'title ' || doc_id AS title, ['local_upload', 'pc_record', 'tape', 'board_record'][doc_id % 4 + 1] AS source_type, ['', 'en', NULL][doc_id % 3 + 1] AS language,
 ['a.WAV', 'b.mp3', NULL, 'none', '.wav'][doc_id % 5 + 1] AS file_name FROM documents),
ao AS (SELECT *, CASE WHEN source_type = 'tape' THEN 'unsupported_source' WHEN meeting_id % 5 = 0 OR place <> min(place) FILTER (WHERE source_type <> 'tape') OVER (PARTITION BY meeting_id) THEN 'exists' ELSE 'created' END AS outcome FROM aq)"""


def _created(spark, d) -> DataFrame:
    """Two rows ask for each id; a fifth of the ids are there already."""
    i = F.col("doc_id")
    rows = src.table(spark, d, "documents").select(
        F.expr("doc_id div 2").alias("meeting_id"), i.alias("place"), F.concat(F.lit("title "), i.cast("string")).alias("title"), src.pick(("local_upload", "pc_record", "tape", "board_record"), "doc_id % 4").alias("source_type"), src.pick(("", "en", None), "doc_id % 3").alias("language"),
        src.pick(("a.WAV", "b.mp3", None, "none", ".wav"), "doc_id % 5").alias("file_name"), F.lit("audio").alias("mime_type"), F.col("n_chars").cast("long").alias("size_bytes"), F.lit("2024-01-01T00:00:00Z").alias("now"),
    )
    return records.create_records(rows, rows.where("meeting_id % 5 = 0").select("meeting_id"))


@query(f"""WITH {ASKED} SELECT meeting_id, place, outcome, CASE WHEN outcome = 'created' THEN title END AS title, CASE WHEN outcome = 'created' THEN {_case('source_type', records.SOURCES, "''")} END AS label, CASE WHEN outcome = 'created' THEN coalesce(nullif(language, ''), 'zh-CN') END AS language,
 CASE WHEN outcome = 'created' THEN coalesce(file_name = 'b.mp3', false) END AS converts, CASE WHEN outcome = 'created' THEN 'meetings/' || meeting_id END AS directory FROM ao""")
def created_records(spark, d):
    rows, get = _created(spark, d), lambda path: F.get_json_object("json", path)
    return rows.select("meeting_id", "place", "outcome", get("$.detail.title").alias("title"), get("$.detail.source_label").alias("label"), get("$.detail.language").alias("language"), get("$.detail.source.requires_conversion").cast("boolean").alias("converts"), get("$.directory").alias("directory"))


@query(f"""WITH {ASKED} SELECT meeting_id, CASE meeting_id % 6 WHEN 1 THEN 'not_json' WHEN 2 THEN 'wrong_shape' WHEN 3 THEN 'wrong_shape' END AS fault, CASE WHEN meeting_id % 6 NOT IN (1, 2, 3) THEN title END AS title,
 CASE WHEN meeting_id % 6 NOT IN (1, 2, 3) THEN 'created' END AS state, CASE WHEN meeting_id % 6 NOT IN (1, 2, 3) THEN '2024-01-01T00:00:00Z' END AS updated_at FROM ao WHERE outcome = 'created'""")
def decoded_records(spark, d):
    """Stored records, half of them spoilt."""
    i, c = F.col("meeting_id") % 6, F.col("json")
    spoilt = F.when(i == 1, F.expr("substring(json, 2)")).when(i == 2, "[]").when(i == 3, '{"detail":"text"}').otherwise(c)
    return records.decode_records(_created(spark, d).where("outcome = 'created'").select("meeting_id", spoilt.alias("json")))


@query("""WITH f AS (SELECT event_id AS doc, event_type, unnest(['$.status', '$.error.code', '$.errors[0].code', '$.errors[1].code', '$.return_code']) AS path FROM events)
 SELECT doc, path, CASE path WHEN '$.return_code' THEN 'number' ELSE 'string' END AS kind, CASE path WHEN '$.status' THEN left(event_type, 3) WHEN '$.error.code' THEN 'E' || doc % 10 WHEN '$.errors[0].code' THEN 'a' WHEN '$.errors[1].code' THEN 'b' ELSE CAST(doc % 7 AS VARCHAR) END AS value FROM f""")
def allowed_fields(spark, d):
    """What may be told of each event's details; prompts, logs and other texts are left out."""
    i = F.col("event_id")
    whole = F.concat(F.lit('{"status":'), _json(F.col("event_type")), F.lit(',"return_code":'), (i % 7).cast("string"), F.lit(',"prompt":"secret","error":{"code":"E'), (i % 10).cast("string"), F.lit('","raw":"secret"},"errors":[{"code":"a"},{"code":"b","raw":1},"x"]}'))
    docs = src.table(spark, d, "events").select(i.alias("doc"), whole.alias("json"))
    return records.allowed_fields(docs, ("$.status", "$.return_code", "$.error.code", "$.errors[].code", "$.error"), 3)


@query("SELECT DISTINCT 'llm/r' || event_id // 3 AS folder FROM events GROUP BY event_id // 3 HAVING bool_or(event_id % 3 = 0) AND bool_or(event_id % 3 = 1 AND event_id % 4 <> 0)")
def complete_requests(spark, d):
    files = src.table(spark, d, "events").select(F.concat(F.lit("llm/r"), F.expr("event_id div 3").cast("string"), F.lit("/"), F.expr("CASE event_id % 3 WHEN 0 THEN 'status.json' WHEN 1 THEN IF(event_id % 4 <> 0, 'final_json.txt', 'raw.txt') ELSE 'x/status.json' END")).alias("path"))
    return records.complete_requests(files)
