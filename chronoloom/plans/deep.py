"""Registered queries of folds, frontiers, ledgers, logs and wavefronts, each beside its SQL where SQL can express it."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scalars as sc
from chronoloom.operators import carryover, documents, exports, frontier, ledger, logs, report, units
from chronoloom.operators.tables import new_folder, written
from chronoloom.plans.more import QUERIES, SQL, query  # noqa: F401
from chronoloom.plans.oracle import SEG, _grams, _jaccard
from chronoloom.sources import adapters as src
from chronoloom.streaming import events as streams
from chronoloom.streaming import products

# ---- units of recognition

VOICES = """v0 AS (SELECT user_id AS meeting_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, CASE WHEN event_id % 13 = 5 THEN 'unknown_boundary' WHEN event_id % 17 = 3 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'unknown_fragment' ELSE 'speaker_' || (event_id % 10 // 7) END AS speaker,
 event_id * 7 % 800 AS gap, CASE WHEN event_id % 3 = 1 THEN event_id % 350 ELSE event_id * 31 % 4000 + 200 END AS dur FROM events),
vo AS (SELECT *, CAST(sum(gap + dur) OVER (PARTITION BY meeting_id ORDER BY idx) - dur AS BIGINT) AS start_ms, CAST(sum(gap + dur) OVER (PARTITION BY meeting_id ORDER BY idx) AS BIGINT) AS end_ms, 'seg-' || lpad(CAST(idx AS VARCHAR), 6, '0') AS segment_id,
 CASE WHEN speaker = 'unknown_boundary' THEN 'boundary' WHEN speaker = 'unknown_fragment' THEN 'fragment' WHEN starts_with(speaker, 'speaker_') THEN 'main' ELSE 'unknown' END AS kind FROM v0)"""
_BEFORE = "OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UNITS = f"""{VOICES}, u1 AS (SELECT *, CASE WHEN kind = 'main' THEN dur >= 500 WHEN kind = 'boundary' THEN dur >= 1500 ELSE false END AS wanted FROM vo),
u2 AS (SELECT *, last_value(CASE WHEN wanted AND kind = 'main' THEN idx END IGNORE NULLS) {_BEFORE} AS lm, last_value(CASE WHEN wanted AND kind = 'main' THEN end_ms END IGNORE NULLS) {_BEFORE} AS le, last_value(CASE WHEN wanted AND kind = 'main' THEN speaker END IGNORE NULLS) {_BEFORE} AS ls FROM u1),
u3 AS (SELECT *, NOT (wanted AND kind = 'main') AND NOT (kind = 'fragment' AND coalesce(dur <= 300 AND start_ms - le <= 500, false)) AS stops FROM u2),
u4 AS (SELECT *, last_value(CASE WHEN stops THEN idx END IGNORE NULLS) {_BEFORE} AS lx, last_value(CASE WHEN kind = 'fragment' THEN idx END IGNORE NULLS) {_BEFORE} AS lf, last_value(CASE WHEN kind = 'fragment' THEN end_ms END IGNORE NULLS) {_BEFORE} AS lfe FROM u3),
u5 AS (SELECT *, wanted AND kind = 'main' AND coalesce(ls = speaker AND start_ms - CASE WHEN coalesce(lf > lm, false) THEN lfe ELSE le END <= 500 AND coalesce(lx, -1) < lm, false) AS goes_on FROM u4),
u6 AS (SELECT *, CAST(sum(CASE WHEN wanted AND NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY idx) AS BIGINT) AS unit FROM u5),
um AS (SELECT meeting_id, unit, idx, segment_id, speaker, kind, start_ms, end_ms, false AS bridged FROM u6 WHERE wanted
 UNION ALL SELECT b.meeting_id, a.unit, b.idx, b.segment_id, b.speaker, b.kind, b.start_ms, b.end_ms, true FROM u6 a JOIN u6 b ON a.goes_on AND a.lf > a.lm AND b.meeting_id = a.meeting_id AND b.idx = a.lf)"""


def voices(spark, d) -> DataFrame:
    """Events of a user as neighbouring segments of main speakers, boundaries, fragments and unknown ones."""
    i = F.col("event_id")
    rows = src.table(spark, d, "events").select(
        F.col("user_id").alias("meeting_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("idx"),
        F.when(i % 13 == 5, "unknown_boundary").when(i % 17 == 3, "unknown").when(i % 3 == 1, "unknown_fragment").otherwise(F.concat(F.lit("speaker_"), F.floor(i % 10 / 7).cast("string"))).alias("speaker"),
        (i * 7 % 800).alias("gap"), F.when(i % 3 == 1, i % 350).otherwise(i * 31 % 4000 + 200).alias("dur"),
    )
    rows = rows.withColumn("end_ms", F.sum(F.col("gap") + F.col("dur")).over(Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select("meeting_id", "idx", src.segment_name(F.col("idx")).alias("segment_id"), "speaker", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


@query(f"""WITH {UNITS} SELECT meeting_id, unit, arg_min(speaker, idx) FILTER (WHERE NOT bridged) AS speaker, arg_min(kind, idx) FILTER (WHERE NOT bridged) AS kind, arg_min(start_ms, idx) FILTER (WHERE NOT bridged) AS start_ms,
 arg_max(end_ms, idx) FILTER (WHERE NOT bridged) AS end_ms, string_agg(segment_id, ',' ORDER BY idx) AS source_ids, coalesce(string_agg(segment_id, ',' ORDER BY idx) FILTER (WHERE bridged), '') AS bridged_ids, count(*) AS n FROM um GROUP BY 1, 2""")
def asr_units(spark, d):
    return units.unit_rows(units.mark_units(voices(spark, d)))


# ---- chapters from blocks

BLOCKS = f"""{SEG}, bk AS (SELECT meeting_id, idx AS block, 'title ' || idx AS title, CASE WHEN idx % 4 = 2 THEN coalesce(lag(text) OVER (PARTITION BY meeting_id ORDER BY idx), text) ELSE text END AS summary, ['point ' || idx % 3, 'point ' || (idx + 1) % 3] AS key_points, ['at ' || idx % 2] AS anchors,
 'seg-' || lpad(CAST(idx AS VARCHAR), 6, '0') AS start_ref, 'seg-' || lpad(CAST(idx + 1 AS VARCHAR), 6, '0') AS end_ref, idx % 5 <> 3 AS continues, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS k FROM s),
cb AS (SELECT *, CAST(sum(CASE WHEN continues AND k > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY k) AS BIGINT) AS chapter FROM bk),
cf AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, chapter ORDER BY k) AS j FROM cb),
fo AS (SELECT meeting_id, chapter, j, summary AS overview FROM cf WHERE j = 1 UNION ALL SELECT cf.meeting_id, cf.chapter, cf.j, CASE WHEN length(regexp_replace(fo.overview, '[\\s\\p{{Z}}]+', '', 'g')) > 1 AND length(regexp_replace(cf.summary, '[\\s\\p{{Z}}]+', '', 'g')) > 1
 AND {_jaccard(_grams('fo.overview'), _grams('cf.summary'))} >= 0.8 THEN fo.overview ELSE fo.overview || '；' || cf.summary END FROM fo JOIN cf ON cf.meeting_id = fo.meeting_id AND cf.chapter = fo.chapter AND cf.j = fo.j + 1)"""


def blocks(spark, d) -> DataFrame:
    i = F.col("idx")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("meeting_id").orderBy("idx")), F.col("text"))

    def name(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    return src.segments(spark, d).select(
        "meeting_id", i.alias("block"), name("title ", i).alias("title"), F.when(i % 4 == 2, before).otherwise(F.col("text")).alias("summary"), F.array(name("point ", i % 3), name("point ", (i + 1) % 3)).alias("key_points"),
        F.array(name("at ", i % 2)).alias("anchors"), src.segment_name(i).alias("start_ref"), src.segment_name(i + 1).alias("end_ref"), F.array(src.segment_name(i), src.segment_name(i + 1)).alias("refs"), (i % 5 != 3).alias("continues_previous"),
    )


@query(f"""WITH RECURSIVE {BLOCKS}, la AS (SELECT meeting_id, chapter, arg_max(overview, j) AS overview FROM fo GROUP BY 1, 2),
 kp AS (SELECT meeting_id, chapter, string_agg(p, ',' ORDER BY o) AS key_points FROM (SELECT meeting_id, chapter, p, min(k * 2 + q) AS o FROM (SELECT meeting_id, chapter, k, unnest(key_points) AS p, unnest([0, 1]) AS q FROM cb) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 rf AS (SELECT DISTINCT meeting_id, chapter, unnest([start_ref, end_ref]) AS ref FROM cb), sp AS (SELECT rf.meeting_id, chapter, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers FROM rf JOIN s ON s.meeting_id = rf.meeting_id AND s.segment_id = rf.ref GROUP BY 1, 2),
 ch AS (SELECT meeting_id, chapter, count(*) AS blocks, arg_min(title, k) AS title, arg_min(start_ref, k) AS start_ref, arg_max(end_ref, k) AS end_ref FROM cb GROUP BY 1, 2),
 n AS (SELECT meeting_id, chapter, count(*) AS n_refs FROM rf GROUP BY 1, 2)
 SELECT ch.*, overview, key_points, n_refs, coalesce(speakers, '') AS speakers, coalesce(a.start_ms, 0) AS start_ms, coalesce(z.end_ms, 0) AS end_ms FROM ch JOIN la USING (meeting_id, chapter) JOIN kp USING (meeting_id, chapter) JOIN n USING (meeting_id, chapter) LEFT JOIN sp USING (meeting_id, chapter)
 LEFT JOIN s a ON a.meeting_id = ch.meeting_id AND a.segment_id = start_ref LEFT JOIN s z ON z.meeting_id = ch.meeting_id AND z.segment_id = end_ref""")
def chapter_fold(spark, d):
    rows = units.fold_chapters(blocks(spark, d), src.segments(spark, d))
    return rows.select("meeting_id", "chapter", "blocks", "title", "start_ref", "end_ref", "overview", F.array_join("key_points", ",").alias("key_points"), F.size("refs").cast("long").alias("n_refs"), F.array_join("speakers", ",").alias("speakers"), "start_ms", "end_ms")


# ---- splits and merges

SPLITS = f"""{SEG}, it AS (SELECT 'batch-' || meeting_id AS root, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) - 1 AS p, length(text) AS chars, text FROM s),
rq AS (SELECT root, root AS request_id, NULL::VARCHAR AS parent_id, 0 AS depth, 0::BIGINT AS a, count(*) AS n, count(*) > 1 AND sum(chars) > 300 AS again, sum(chars) > 300 AS long FROM it GROUP BY root
 UNION ALL SELECT root, request_id || '-split-' || h, request_id, depth + 1, b, m, depth + 1 < 3 AND m > 1 AND c > 300, c > 300 FROM (SELECT x.root, x.request_id, x.depth, h, b, m, (SELECT sum(chars) FROM it WHERE it.root = x.root AND it.p >= b AND it.p < b + m) AS c
 FROM (SELECT root, request_id, depth, h, CASE WHEN h = 1 THEN a ELSE a + greatest(1, n // 2) END AS b, CASE WHEN h = 1 THEN greatest(1, n // 2) ELSE n - greatest(1, n // 2) END AS m FROM rq, (SELECT unnest([1, 2]) AS h) WHERE again) x))"""


def _batches(spark, d) -> tuple[DataFrame, DataFrame]:
    items = src.segments(spark, d).select(F.concat(F.lit("batch-"), F.col("meeting_id").cast("string")).alias("request_id"), "idx", "text")
    items = items.withColumn("pos", (F.row_number().over(Window.partitionBy("request_id").orderBy("idx")) - 1).cast("long")).drop("idx")

    def attempt(rows: DataFrame) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("pos", F.sha2(F.col("text").cast("binary"), 256).alias("h"))))
        told = rows.groupBy("request_id").agg(F.sum(F.length("text")).alias("chars"), parts.alias("parts"))
        output = F.sha2(F.array_join(F.transform("parts", lambda x: x["h"]), "").cast("binary"), 256)
        return told.select("request_id", F.when(F.col("chars") > 300, "length").otherwise("ok").alias("outcome"), F.when(F.col("chars") <= 300, output).alias("output"))

    return frontier.split_on_length(items, attempt)


@query(f"WITH RECURSIVE {SPLITS} SELECT request_id, parent_id, depth, n, CASE WHEN long THEN 'length' ELSE 'ok' END AS outcome, NOT again AS final FROM rq")
def split_lineage(spark, d):
    return _batches(spark, d)[0]


@query(f"""WITH RECURSIVE {SPLITS} SELECT request_id, sha256(string_agg(sha256(text), '' ORDER BY p)) AS output FROM rq JOIN it ON it.root = rq.root AND p >= a AND p < a + n WHERE NOT long GROUP BY request_id""")
def split_outputs(spark, d):
    return _batches(spark, d)[1]


@query(f"""WITH RECURSIVE {SEG}, c AS (SELECT meeting_id, idx, length(text) AS cost, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS k FROM s),
 g AS (SELECT meeting_id, k, idx, cost, 0 AS grp, cost AS used FROM c WHERE k = 1 UNION ALL SELECT c.meeting_id, c.k, c.idx, c.cost, CASE WHEN g.used + c.cost <= 500 THEN g.grp ELSE g.grp + 1 END, CASE WHEN g.used + c.cost <= 500 THEN g.used + c.cost ELSE c.cost END FROM g JOIN c ON c.meeting_id = g.meeting_id AND c.k = g.k + 1)
 SELECT meeting_id, idx AS node, CAST(cost AS BIGINT) AS cost, CAST(grp AS BIGINT) AS "group" FROM g""")
def budgeted_groups(spark, d):
    return frontier.budgeted_groups(src.segments(spark, d).select("meeting_id", F.col("idx").alias("node"), F.length("text").cast("long").alias("cost")), 500).select("meeting_id", "node", "cost", "group")


def _grouped(cost: str, where: str, budget: int) -> str:
    """Rows in order with the group that greedy packing puts them into."""
    fits = f"g.used + c.cost <= {budget}"
    return f"""c AS (SELECT meeting_id, idx, CAST({cost} AS BIGINT) AS cost, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS k FROM s WHERE {where}),
 g AS (SELECT meeting_id, k, idx, cost, 0::BIGINT AS grp, cost AS used FROM c WHERE k = 1 UNION ALL SELECT c.meeting_id, c.k, c.idx, c.cost, CASE WHEN {fits} THEN g.grp ELSE g.grp + 1 END, CASE WHEN {fits} THEN g.used + c.cost ELSE c.cost END FROM g JOIN c ON c.meeting_id = g.meeting_id AND c.k = g.k + 1)"""


SQL["consecutive_groups"] = f"""WITH RECURSIVE {SEG}, {_grouped('length(text)', 'true', 500)} SELECT meeting_id, grp, min(idx) AS first_idx, max(idx) AS last_idx, CAST(sum(cost) AS BIGINT) AS cost, sum(cost) > 500 AS oversize FROM g GROUP BY 1, 2"""
SQL["chunk_plan"] = f"""WITH RECURSIVE {SEG}, {_grouped('length(text) + 1', "trim(text) <> ''", 2000)}, t AS (SELECT meeting_id, grp, min(k) AS k, min(idx) AS first_idx, max(idx) AS last_idx, CAST(sum(cost) AS BIGINT) AS own FROM g GROUP BY 1, 2),
 n AS (SELECT t.*, own > 2000 AS oversize, CAST(sum(CASE WHEN own > 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY t.meeting_id ORDER BY grp) AS BIGINT) - 1 AS chunk, p.idx AS pi, p.cost AS pc FROM t LEFT JOIN c p ON p.meeting_id = t.meeting_id AND p.k = t.k - 1)
 SELECT meeting_id, CASE WHEN NOT oversize THEN chunk END AS chunk, first_idx, last_idx, CASE WHEN NOT oversize AND own + pc <= 2000 THEN pi ELSE first_idx END AS context_idx, CASE WHEN NOT oversize AND own + pc <= 2000 THEN own + pc ELSE own END AS cost, oversize FROM n"""


def _merged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Texts merged until a meeting has one; a merged text is its parts' digest, so merging shortens."""
    parts = src.segments(spark, d).select("meeting_id", F.col("idx").alias("node"), F.sha2(F.col("text").cast("binary"), 256).alias("output"))
    return frontier.merge_in_budget(parts, lambda x: F.sha2(F.array_join(x, "|").cast("binary"), 256), F.length, 200)


@query()
def merge_roots(spark, d):
    return _merged(spark, d)[0]


@query()
def merge_lineage(spark, d):
    return _merged(spark, d)[1]


# ---- maps with a ledger

def digest_of(text: str) -> str:
    """What the mapped windows become; some fail."""
    if len(text) % 7 == 0:
        raise ValueError("a multiple of seven")
    return hashlib.sha256(text.encode()).hexdigest()


def _windows(spark, d) -> DataFrame:
    return src.segments(spark, d).select("meeting_id", F.col("idx").alias("window"), "text")


LEDGER = f"{SEG}, w AS (SELECT meeting_id, idx AS win, text, length(text) % 7 = 0 AS failed FROM s)"
_TOLD = """meeting_id, win AS "window", CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status, CASE WHEN NOT failed THEN sha256(text) END AS output, CASE WHEN failed THEN 'ValueError' END AS error_type, CASE WHEN failed THEN 'MAP window ' || win || ' failed: a multiple of seven (digest_of)' END AS placeholder"""


@query(f"WITH {LEDGER} SELECT {_TOLD}, CASE WHEN failed THEN 2::BIGINT ELSE 1 END AS attempts FROM w")
def map_ledger(spark, d):
    done = ledger.map_with_ledger(_windows(spark, d), digest_of, new_folder(spark, "ledger"), "1", attempts=2, slices=2)
    return done.select("meeting_id", "window", "status", "output", "error_type", "placeholder", "attempts")


@query(f"WITH {LEDGER} SELECT {_TOLD}, 1::BIGINT AS attempts FROM w")
def map_resume(spark, d):
    """A run that ended after half of the meetings, resumed over all of them: what it had done isn't done again."""
    folder, windows = new_folder(spark, "ledger"), _windows(spark, d)
    ledger.map_with_ledger(windows.where("meeting_id % 2 = 0"), digest_of, folder, "1", slices=2)
    done = ledger.map_with_ledger(windows, digest_of, folder, "1", slices=2)
    return done.select("meeting_id", "window", "status", "output", "error_type", "placeholder", "attempts")


@query(f"WITH {LEDGER} SELECT meeting_id, CASE WHEN bool_or(failed) THEN 'partial' ELSE 'pass' END AS status, count(*) AS map_results, count(*) FILTER (WHERE failed) AS failed FROM w GROUP BY 1")
def map_totals(spark, d):
    return ledger.totals(ledger.map_with_ledger(_windows(spark, d), digest_of, new_folder(spark, "ledger"), "1", slices=2))


# ---- logs

_LOOKS = f"""(NOT (regexp_matches(lower(c), '{"|".join(sc.LOG_WORDS)}') AND NOT regexp_matches(c, '[一-鿿]')) AND NOT regexp_matches(c, '^[\\[(]?[IEWDF]\\s') AND (regexp_matches(c, '[一-鿿]') OR (length(regexp_replace(c, '[^A-Za-z]', '', 'g')) >= 8 AND length(c) >= 12)))"""


def _clean(x: str) -> str:
    name = r"^(?:result|asr result|recognition result|final result|final commit result)\s*[:：]\s*"
    return f"trim(regexp_replace(trim({x}), '{name}', '', 'i'), ' ' || chr(9) || chr(10) || chr(13) || '\"''')"


LOGS = f"""{SEG}, l0 AS (SELECT CAST(meeting_id AS VARCHAR) AS source, idx + 1 AS line, CASE idx % 6 WHEN 0 THEN '[I] rknn init model' WHEN 1 THEN CASE WHEN meeting_id % 3 = 0 THEN 'Result: ' ELSE 'text res: ' END || text WHEN 3 THEN '-----------' WHEN 5 THEN 'RTF = 0.3' ELSE text END AS v FROM s),
l1 AS (SELECT source, line, unnest(range(0, len(string_split(v, chr(10))))) AS part, unnest(string_split(v, chr(10))) AS v FROM l0),
l2 AS (SELECT source, line, part, trim(v) AS v FROM l1 WHERE trim(v) <> ''),
l3 AS (SELECT *, CASE WHEN regexp_matches(v, '^-{{5,}}') OR regexp_matches(v, '^RTF\\s*=') THEN 1 ELSE 0 END AS closes, CASE WHEN regexp_matches(v, '^text\\s+res\\s*[:：]', 'i') THEN {_clean("regexp_extract(v, '^text\\s+res\\s*[:：]\\s*(.*)$', 1, 'i')")} END AS first, {_clean('v')} AS c FROM l2),
l4 AS (SELECT *, closes = 0 AND c <> '' AND {_LOOKS} AS spoken, sum(closes) OVER (PARTITION BY source ORDER BY line, part) - closes AS block, line * 100000 + part AS o FROM l3),
ls AS (SELECT source, block, max(o) AS last FROM l4 WHERE spoken GROUP BY 1, 2),
wi AS (SELECT source, arg_min(block, o) AS block, min(o) AS o, arg_min(first, o) AS first FROM l4 LEFT JOIN ls USING (source, block) WHERE first IS NOT NULL AND (first <> '' OR coalesce(last > o, false)) GROUP BY 1),
sa AS (SELECT l4.source, l4.line, l4.o, c FROM l4 JOIN wi ON wi.source = l4.source AND wi.block = l4.block AND spoken AND l4.o > wi.o UNION ALL SELECT source, o // 100000, o, first FROM wi WHERE first <> ''),
fb AS (SELECT source, string_agg(c, chr(10) ORDER BY o) AS text, 'block' AS how, min(line) AS from_line, max(line) AS to_line FROM sa GROUP BY 1),
nx AS (SELECT *, lead(c) OVER (PARTITION BY source ORDER BY o) AS nc, lead(line) OVER (PARTITION BY source ORDER BY o) AS nl, {_clean("regexp_extract(v, 'Result\\s*[:：]\\s*(.*)', 1, 'i')")} AS own FROM l4 WHERE source NOT IN (SELECT source FROM fb)),
na AS (SELECT *, own <> '' AND {_LOOKS.replace('(c', '(own')} AS a, coalesce(nc <> '' AND {_LOOKS.replace('(c', '(nc')}, false) AS b FROM nx WHERE regexp_matches(v, 'Result\\s*[:：]', 'i')),
fn AS (SELECT source, CASE WHEN a THEN own ELSE nc END AS text, 'named' AS how, line AS from_line, CASE WHEN a THEN line ELSE nl END AS to_line FROM na WHERE a OR b QUALIFY row_number() OVER (PARTITION BY source ORDER BY o) = 1),
al AS (SELECT * FROM fb UNION ALL SELECT * FROM fn)"""


@query(f"WITH {LOGS} SELECT l.source, coalesce(text, '') AS text, coalesce(how, 'none') AS how, from_line, to_line FROM (SELECT DISTINCT source FROM l0) l LEFT JOIN al ON al.source = l.source")
def log_transcripts(spark, d):
    i = F.col("idx")
    said = F.when(i % 6 == 0, "[I] rknn init model").when(i % 6 == 1, F.concat(F.when(F.col("meeting_id") % 3 == 0, "Result: ").otherwise("text res: "), "text")).when(i % 6 == 3, "-----------").when(i % 6 == 5, "RTF = 0.3").otherwise(F.col("text"))
    return logs.transcripts(src.segments(spark, d).select(F.col("meeting_id").cast("string").alias("source"), (i + 1).alias("line"), said.alias("value")))


# ---- windows with carryover

def model(window: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters of two segments each, some with faults; what begins in the last segment of a window is carried over."""
    p = F.col("window_pos")
    last = p == F.col("window_n") - 1
    rows = window.where((p % 2 == 0) & (~last | F.col("final")))
    end = F.when(p % 10 == 4, src.segment_name(F.col("idx") + 100)).when(p + 1 < F.col("window_n"), src.segment_name(F.col("idx") + 1)).otherwise(F.col("segment_id"))
    chapters = rows.select("meeting_id", p.alias("no"), F.when(p % 8 == 6, " ").otherwise(F.concat(F.lit("about "), "segment_id")).alias("title"), F.col("text").alias("summary"), F.col("segment_id").alias("start_ref"), end.alias("end_ref"))
    carried = F.when((F.col("window_n") % 2 == 1) & (F.col("window_n") > 1), F.col("segment_id")).otherwise("null")
    answers = window.where(last).select("meeting_id", F.when(F.col("meeting_id") % 23 == 7, "length").otherwise("stop").alias("finish_reason"), carried.alias("carryover_ref"))
    return chapters, answers


@query()
def carryover_windows(spark, d):
    return carryover.wavefront(src.segments(spark, d), model, 700, 20)["windows"]


@query()
def carryover_chapters(spark, d):
    return carryover.wavefront(src.segments(spark, d), model, 700, 20)["chapters"]


@query()
def carryover_repairs(spark, d):
    return carryover.wavefront(src.segments(spark, d), model, 700, 20)["repairs"]


# ---- nested documents

SCHEMA = {"id": "number", "tags": ["string"], "meta": {"lang": "string|null", "n": "number"}, "note?": "string"}


def _nested(spark, d) -> DataFrame:
    """Documents of a schema with faults: keys that lack, keys too many, wrong kinds, texts that aren't JSON."""
    i = F.col("doc_id")
    tags = F.concat(F.lit("["), F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < i % 4), lambda k: F.when((k == 1) & (i % 7 == 0), "7").otherwise('"t"')), ","), F.lit("]"))
    meta = F.concat(F.when(i % 6 == 1, "").otherwise('"lang":null,'), F.lit('"n":'), F.when(i % 5 == 2, '"five"').otherwise("5"), F.when(i % 9 == 4, ',"more":{"a":1}').otherwise(""))
    told = F.concat(F.lit('{"id":'), i.cast("string"), F.lit(',"tags":'), F.when(i % 13 == 6, "null").otherwise(tags), F.when(i % 8 == 3, "").otherwise(F.concat(F.lit(',"meta":{'), meta, F.lit("}"))), F.when(i % 10 == 0, ',"note":false').otherwise(""), F.when(i % 11 == 3, "").otherwise("}"))
    return src.table(spark, d, "documents").select(i.alias("doc"), told.alias("json"))


@query("""WITH g AS (SELECT doc_id AS doc FROM documents WHERE doc_id % 11 <> 3), m AS (SELECT doc FROM g WHERE doc % 8 <> 3)
 SELECT doc_id AS doc, '$' AS path, 'not_json' AS fault, NULL AS told FROM documents WHERE doc_id % 11 = 3
 UNION ALL SELECT doc, '$.tags', 'wrong_type', 'null' FROM g WHERE doc % 13 = 6 UNION ALL SELECT doc, '$.tags[1]', 'wrong_type', 'number' FROM g WHERE doc % 13 <> 6 AND doc % 7 = 0 AND doc % 4 > 1
 UNION ALL SELECT doc, '$.meta.n', 'wrong_type', 'string' FROM m WHERE doc % 5 = 2 UNION ALL SELECT doc, '$.note', 'wrong_type', 'boolean' FROM g WHERE doc % 10 = 0
 UNION ALL SELECT doc, '$.meta.more', 'extra', 'object' FROM m WHERE doc % 9 = 4 UNION ALL SELECT doc, '$.meta', 'missing', 'object' FROM g WHERE doc % 8 = 3 UNION ALL SELECT doc, '$.meta.lang', 'missing', 'string|null' FROM m WHERE doc % 6 = 1""")
def document_faults(spark, d):
    return documents.violations(_nested(spark, d), SCHEMA)


def _large(spark, d) -> DataFrame:
    """Documents with whole texts, long lists and deep values."""
    i, inner = F.col("doc_id"), F.struct(F.struct(F.col("n_chars").alias("c")).alias("b"))
    rows = src.table(spark, d, "documents")
    items = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")), lambda k: k < i % 30)
    return rows.select(i.alias("doc"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), items.alias("list"), inner.alias("a"))).alias("json"))


@query("""WITH t AS (SELECT doc_id AS doc, coalesce(text, '') AS text, unnest(range(0, 30)) AS k FROM documents)
 SELECT doc_id AS doc, '$' AS path, 'object' AS kind, NULL AS value FROM documents UNION ALL SELECT doc_id, '$.a', 'object', NULL FROM documents UNION ALL SELECT doc_id, '$.a.b', 'object', NULL FROM documents
 UNION ALL SELECT doc_id, '$.list', 'array', NULL FROM documents UNION ALL SELECT doc, '$.list[' || k || ']', 'number', CAST(k AS VARCHAR) FROM t WHERE k < doc % 30 AND k < 16 UNION ALL SELECT doc_id, '$.text', 'string', substring(coalesce(text, ''), 1, 600) FROM documents""")
def document_kept(spark, d):
    return documents.bounded(_large(spark, d))[0]


@query("""SELECT doc_id AS doc, '$.a.b' AS path, 'depth' AS cut, NULL::BIGINT AS n FROM documents WHERE n_chars IS NOT NULL UNION ALL SELECT doc_id, '$.list', 'items', doc_id % 30 - 16 FROM documents WHERE doc_id % 30 > 16
 UNION ALL SELECT doc_id, '$.text', 'text', length(text) - 600 FROM documents WHERE length(text) > 600""")
def document_cuts(spark, d):
    return documents.bounded(_large(spark, d))[1]


@query("SELECT doc_id AS doc, '$.list' AS path, doc_id % 30 AS n FROM documents WHERE doc_id % 30 > 8")
def document_lists(spark, d):
    return documents.long_lists(_large(spark, d), {"$.list": 8})


# ---- exports

def _bundle(spark, d) -> DataFrame:
    s = src.segments(spark, d)
    sentences = exports.sentence_index(s)
    meetings = s.groupBy("meeting_id").agg(F.max("end_ms").alias("duration_ms")).select("meeting_id", F.concat(F.lit("task-"), F.col("meeting_id").cast("string")).alias("task_id"), "duration_ms", F.lit(None).cast("string").alias("source_audio"))
    chapters = units.fold_chapters(blocks(spark, d), s)
    speakers = s.groupBy("meeting_id", "speaker").agg(F.min("idx").alias("number"), F.min_by("text", "idx").alias("summary"))
    items = s.where("text <> ''").select("meeting_id", F.when(F.col("idx") % 2 == 0, "sentence").otherwise("action").alias("kind"), F.col("idx").alias("no"), "text", F.array("segment_id", src.segment_name(F.col("idx") + 1)).alias("refs"))
    words = s.select("meeting_id", F.col("idx").alias("no"), F.col("speaker").alias("keyword"))
    overviews = s.groupBy("meeting_id").agg(F.max_by("text", "idx").alias("overview"))
    parts = [exports.transcription(meetings, sentences), exports.auto_chapters(meetings, chapters), exports.summarization(meetings, overviews, speakers), exports.assistance(meetings, sentences, items, words)]
    return functools.reduce(DataFrame.unionByName, parts)


_WORDS = "{{'Id': {n}, 'SentenceId': sentence_id, 'Start': a, 'End': b, 'Text': text}}"


@query(f"""WITH RECURSIVE {BLOCKS}, sn AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS sentence_id FROM s WHERE text <> ''), me AS (SELECT meeting_id, 'task-' || meeting_id AS task, max(end_ms) AS dur, arg_max(text, idx) AS ov FROM s GROUP BY 1),
 p AS (SELECT meeting_id, list({{'ParagraphId': segment_id, 'SpeakerId': speaker, 'Words': [{{'Id': sentence_id, 'SentenceId': sentence_id, 'Start': start_ms, 'End': end_ms, 'Text': text}}]}} ORDER BY sentence_id) AS l FROM sn GROUP BY 1),
 la AS (SELECT meeting_id, chapter, arg_max(overview, j) AS overview FROM fo GROUP BY 1, 2), cc AS (SELECT meeting_id, chapter, arg_min(title, k) AS title, arg_min(start_ref, k) AS sr, arg_max(end_ref, k) AS er FROM cb GROUP BY 1, 2),
 ch AS (SELECT cc.meeting_id, list({{'Id': cc.chapter, 'Start': coalesce(a.start_ms, 0), 'End': coalesce(z.end_ms, 0), 'Headline': title, 'Summary': overview}} ORDER BY cc.chapter) AS l FROM cc JOIN la ON la.meeting_id = cc.meeting_id AND la.chapter = cc.chapter
 LEFT JOIN s a ON a.meeting_id = cc.meeting_id AND a.segment_id = sr LEFT JOIN s z ON z.meeting_id = cc.meeting_id AND z.segment_id = er GROUP BY 1),
 sk AS (SELECT meeting_id, list({{'SpeakerId': speaker, 'SpeakerName': speaker, 'Summary': summary}} ORDER BY n) AS l FROM (SELECT meeting_id, speaker, min(idx) AS n, arg_min(text, idx) AS summary FROM s GROUP BY 1, 2) GROUP BY 1),
 it AS (SELECT x.meeting_id, x.idx % 2 AS kind, x.idx, x.text, x.sentence_id, x.start_ms AS a, greatest(x.end_ms, coalesce(y.end_ms, 0)) AS b, row_number() OVER (PARTITION BY x.meeting_id, x.idx % 2 ORDER BY x.idx) AS n FROM sn x LEFT JOIN sn y ON y.meeting_id = x.meeting_id AND y.idx = x.idx + 1),
 il AS (SELECT meeting_id, list({_WORDS.format(n='n')} ORDER BY n) FILTER (WHERE kind = 0) AS ks, list({_WORDS.format(n='n')} ORDER BY n) FILTER (WHERE kind = 1) AS ac FROM it GROUP BY 1), kw AS (SELECT meeting_id, list(speaker ORDER BY idx) AS l FROM s GROUP BY 1),
 js AS (SELECT meeting_id, 'transcription.json' AS name, to_json({{'TaskId': task, 'Transcription': {{'AudioInfo': {{'Duration': dur, 'SourceAudio': NULL}}, 'Paragraphs': coalesce(p.l, [])}}}}) AS j FROM me LEFT JOIN p USING (meeting_id)
 UNION ALL SELECT meeting_id, 'auto_chapters.json', to_json({{'TaskId': task, 'AutoChapters': ch.l}}) FROM me JOIN ch USING (meeting_id) UNION ALL SELECT meeting_id, 'summarization.json', to_json({{'TaskId': task, 'Summarization': {{'ParagraphSummary': ov, 'ConversationalSummary': sk.l}}}}) FROM me JOIN sk USING (meeting_id)
 UNION ALL SELECT meeting_id, 'meeting_assistance.json', to_json({{'TaskId': task, 'MeetingAssistance': {{'Keywords': kw.l, 'KeySentences': coalesce(ks, []), 'Actions': coalesce(ac, [])}}}}) FROM me LEFT JOIN il USING (meeting_id) JOIN kw USING (meeting_id))
 SELECT meeting_id, name, sha256(CAST(j AS VARCHAR)) AS sha256, length(CAST(j AS VARCHAR)) AS chars FROM js""")
def export_documents(spark, d):
    return _bundle(spark, d).select("meeting_id", "name", F.sha2(F.col("json").cast("binary"), 256).alias("sha256"), F.length("json").cast("long").alias("chars"))


@query(f"WITH {SEG} SELECT DISTINCT CAST(meeting_id AS VARCHAR) AS key, unnest({sorted(exports.BUNDLE)}) AS name, true AS same, 0 AS faults FROM s")
def export_files(spark, d):
    """The bundle written as files and read again; whether each is what was written, and its faults against its schema."""
    folder, bundle = new_folder(spark, "exports"), written(_bundle(spark, d), "bundle")
    documents.write_documents(bundle.select(F.col("meeting_id").alias("key"), "name", "json"), folder, packed=True)
    again = written(documents.read_documents(spark, folder), "again")
    # Parquet packs texts and paths so well that Spark would take them for small: none of them is broadcast
    same = bundle.select(F.col("meeting_id").cast("string").alias("key"), "name", F.col("json").alias("own")).join(again.hint("merge"), ["key", "name"], "left")
    found = documents.violations_by_name(again.withColumnRenamed("key", "doc"), exports.BUNDLE)
    faults = found.select(F.col("doc").alias("key"), "name").unionByName(exports.bundle_faults(bundle).select(F.col("meeting_id").cast("string").alias("key"), F.lit("transcription.json").alias("name")))
    faults = faults.groupBy("key", "name").agg(F.count("*").cast("int").alias("faults"))
    return same.join(faults, ["key", "name"], "left").select("key", "name", F.col("own").eqNullSafe(F.col("json")).alias("same"), F.coalesce("faults", F.lit(0)).alias("faults"))


# ---- streams with state

@query("""SELECT user_id AS product, arg_max(event_type, {'t': ts, 'i': event_id}) AS state, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, arg_max(event_id, {'t': ts, 'i': event_id}) AS last_id FROM events GROUP BY 1""")
def product_stream(spark, d):
    """Records of users folded by the stream, all events within its horizon."""
    base = new_folder(spark, "products")
    events = streams.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("product"), "event_id", "event_type", "ts")
    out = products.run_updates(products.product_records(events, "60 days", 40 * 86_400), f"{base}/out", f"{base}/checkpoint")
    return out.select("product", "state", "n", "first_us", "last_us", "last_id")


# ---- reports over artifacts

@query("""WITH e AS (SELECT user_id AS run, event_id AS i, CAST(round(value * 100) AS BIGINT) AS v FROM events),
 m AS (SELECT run, 'artifacts' AS section, 'documents' AS measure, count(*) AS value FROM e GROUP BY 1 UNION ALL SELECT run, 'artifacts', 'broken', count(*) FILTER (WHERE i % 11 = 7) FROM e GROUP BY 1
 UNION ALL SELECT run, 'requests', 'requests', count(*) FILTER (WHERE i % 11 <> 7 AND i % 4 = 0) FROM e GROUP BY 1 UNION ALL SELECT run, 'requests', 'tokens', coalesce(sum(v) FILTER (WHERE i % 11 <> 7 AND i % 4 = 0), 0) FROM e GROUP BY 1
 UNION ALL SELECT run, 'requests', 'prompt_tokens', coalesce(sum(v // 2) FILTER (WHERE i % 11 <> 7 AND i % 4 = 0 AND i % 12 = 0), 0) FROM e GROUP BY 1 UNION ALL SELECT run, 'stages', 'done', count(*) FILTER (WHERE i % 11 <> 7 AND i % 4 = 1) FROM e GROUP BY 1
 UNION ALL SELECT run, 'stages', 'failed', count(*) FILTER (WHERE i % 11 <> 7 AND i % 4 = 1 AND i % 3 = 0) FROM e GROUP BY 1 UNION ALL SELECT run, 'stages', 'elapsed', coalesce(sum(v) FILTER (WHERE i % 11 <> 7 AND i % 4 = 1), 0) FROM e GROUP BY 1
 UNION ALL SELECT run, 'memory', 'samples', 2 * count(*) FILTER (WHERE i % 11 <> 7 AND i % 4 = 2) FROM e GROUP BY 1 UNION ALL SELECT run, 'memory', 'peak', coalesce(max(v + 5) FILTER (WHERE i % 11 <> 7 AND i % 4 = 2), 0) FROM e GROUP BY 1
 UNION ALL SELECT run, 'errors', 'errors', count(*) FILTER (WHERE i % 11 <> 7 AND i % 4 = 3) FROM e GROUP BY 1) SELECT run, section, measure, CAST(value AS DOUBLE) AS value FROM m""")
def artifact_report(spark, d):
    """Artifacts of four kinds, one an event, some broken, with keys that drift from version to version."""
    i, v = F.col("i"), F.col("v")
    rows = src.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("i"), F.rint(F.col("value") * 100).cast("long").alias("v"))
    usage = F.when(i % 12 == 0, F.to_json(F.struct(F.struct(v.alias("total_tokens"), F.floor(v / 2).alias("prompt_tokens")).alias("usage")))).when(i % 12 == 4, F.to_json(F.struct(F.struct(v.alias("total")).alias("usage")))).otherwise(F.to_json(F.struct(v.alias("tokens"), F.lit("x").alias("note"))))
    failed = F.struct(F.when(i % 3 == 0, "failed").otherwise("skipped").alias("status"))
    stages = F.to_json(F.struct(F.struct(F.struct(F.lit("done").alias("status"), v.alias("elapsed")).alias("asr"), failed.alias("llm")).alias("stages")))
    rss = "rss"
    memory = F.when(i % 8 == 2, F.to_json(F.struct(F.array(F.struct(v.alias(rss)), F.struct((v + 5).alias(rss))).alias("samples")))).otherwise(F.to_json(F.struct(F.array(F.struct((v + 5).alias("rss_kb")), F.struct(v.alias("rss_kb"))).alias("samples"))))
    told = F.when(i % 4 == 0, usage).when(i % 4 == 1, stages).when(i % 4 == 2, memory).otherwise(F.to_json(F.struct(F.lit("failed").alias("code"))))
    artifacts = rows.select("run", src.pick(("usage", "status", "memory", "error"), "i % 4").alias("artifact"), i.cast("string").alias("file"), F.when(i % 11 == 7, F.substring(told, F.lit(1), F.length(told) - 1)).otherwise(told).alias("json"))
    return report.report(report.facts(artifacts))
