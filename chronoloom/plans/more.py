"""More registered queries, each beside the SQL that returns the same rows: plans, evaluation, checks, runs, model text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import modeltext as mt
from chronoloom.functions import scalars as sc
from chronoloom.functions import text as tx
from chronoloom.operators import evaluation as ev
from chronoloom.operators import library as lib
from chronoloom.operators import metrics, packing, plan, runs, sequence, validation
from chronoloom.plans.oracle import FILES, LIB, PAIRS, REF, SEG, _islands, _iv
from chronoloom.sources import adapters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY, HOUR, LONG = ["key"], 3_600_000, 6000
#: The range that plans cover.
FIRST, LAST = 1_704_067_200_000, 1_706_745_600_000


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = re.sub(r"(?<!['\"\w.])at(?!['\"\w])", '"at"', sql)  # a word of DuckDB's
        return function

    return add


# ---- times, texts, labels

@query(f"""WITH {SEG}, d AS (SELECT *, start_ms // 1000 AS s1, CAST(round_even(start_ms / 1000.0::DOUBLE, 0) AS BIGINT) AS s2 FROM s)
 SELECT meeting_id, idx, lpad(CAST(start_ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s1 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s1 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') AS clock,
 lpad(CAST(s2 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s2 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s2 % 60 AS VARCHAR), 2, '0') AS hms,
 CASE WHEN start_ms < 6000000 THEN lpad(CAST(start_ms // 60000 AS VARCHAR), 2, '0') ELSE CAST(start_ms // 60000 AS VARCHAR) END || ':' || lpad(CAST(s1 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') AS minute_clock,
 s1 // 60 || 'm' || lpad(CAST(s1 % 60 AS VARCHAR), 2, '0') || 's' AS cut, round(start_ms / 1000.0::DOUBLE, 3) AS seconds, start_ms AS parsed, '--:--' AS none, '??:??:??' AS no_hms FROM d""")
def time_formats(spark, d):
    ms, null = F.col("start_ms"), F.lit(None).cast("long")
    return src.segments(spark, d).select(
        "meeting_id", "idx", sc.clock(ms).alias("clock"), sc.hms(ms).alias("hms"), sc.minute_clock(ms).alias("minute_clock"), sc.whole_seconds(ms).alias("cut"), sc.seconds_of(ms.cast("string")).alias("seconds"),
        sc.parse_minute_clock(sc.minute_clock(ms)).alias("parsed"), sc.whole_seconds(null).alias("none"), sc.hms(null).alias("no_hms"),
    )


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, coalesce(text, '') AS text, source, lang FROM documents)
 SELECT doc_id, sha256(coalesce(CASE WHEN t <> '' AND lower(t) NOT IN ('none', 'null', 'n/a') THEN t END, '-')) AS cleaned, CASE WHEN length(t) <= 180 THEN t ELSE substring(t, 1, 180) || '...' END AS preview, right(text, 100) AS last_part,
 CASE WHEN trim(regexp_replace(coalesce(source, '?'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') = '' THEN 'x' ELSE trim(regexp_replace(coalesce(source, '?'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') END AS name,
 lang IN ('en') AS flag FROM c""")
def text_rules(spark, d):
    t = F.coalesce("text", F.lit(""))
    flag = F.coalesce(sc.bool_of(F.when(F.col("lang") == "en", "Yes").when(F.col("lang") == "de", " F ").otherwise("maybe")), F.lit(False))
    return src.table(spark, d, "documents").select(
        "doc_id", F.sha2(F.coalesce(sc.clean_text(t), F.lit("-")).cast("binary"), 256).alias("cleaned"), sc.preview(t).alias("preview"), sc.last_chars(t, 100).alias("last_part"), sc.safe_name(F.coalesce("source", F.lit("?"))).alias("name"), flag.alias("flag"),
    )


@query(r"""WITH l AS (SELECT event_id, ['', 'unknown_boundary', 'unknown_fragment', 'speaker_' || event_id % 12, 'guest'][event_id % 5 + 1] AS speaker, event_id % 4000 AS ms FROM events)
 SELECT event_id, CASE WHEN speaker = 'unknown_boundary' THEN 'boundary' WHEN speaker = 'unknown_fragment' THEN 'fragment' WHEN starts_with(speaker, 'speaker_') THEN 'main' ELSE 'unknown' END AS kind,
 CASE WHEN starts_with(speaker, 'speaker_') THEN ms >= 500 WHEN speaker = 'unknown_boundary' THEN ms >= 1500 ELSE false END AS wanted,
 CASE WHEN speaker = 'speaker_3' THEN 'Ann' WHEN speaker = '' THEN '未指定' WHEN starts_with(speaker, 'speaker_') THEN '发言人' || substring(speaker, 9) ELSE speaker END AS label FROM l""")
def speaker_rules(spark, d):
    spoken = F.when(F.col("event_id") % 5 == 3, F.concat(F.lit("speaker_"), (F.col("event_id") % 12).cast("string"))).otherwise(src.pick(("", "unknown_boundary", "unknown_fragment", "", "guest"), "event_id % 5"))
    names = F.create_map(F.lit("speaker_3"), F.lit("Ann"))
    return src.table(spark, d, "events").select("event_id", spoken.alias("speaker"), (F.col("event_id") % 4000).alias("ms")).select(
        "event_id", sc.speaker_kind(F.col("speaker")).alias("kind"), sc.wanted_for_asr(F.col("speaker"), F.col("ms"), 500, 1500, 700).alias("wanted"), sc.speaker_label(F.col("speaker"), names).alias("label"),
    )


STAGES = ("awaiting_audio", "audio_upload", "segmentation", "batch_asr", "transcript_prepare", "llm_summary", "compat_export", "meeting_ready", "other")
CODES = ("process_failed", "invalid_json", "validation_failed", None, "request_failed", "strange", "missing_speaker_summaries")
MESSAGES = ("finish_reason was length", "the input was truncated", "content is not valid JSON", "Missing speaker summaries", "nothing")


def _case(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


@query(f"""WITH e AS (SELECT event_id, {list(STAGES)}[event_id % 9 + 1] AS stage, {str(list(CODES)).replace('None', 'NULL')}[event_id % 7 + 1] AS code, {list(MESSAGES)}[event_id % 5 + 1] AS message FROM events),
 c AS (SELECT *, coalesce({_case('code', sc.CODE_CATEGORIES, 'NULL')}, {_case('stage', sc.STAGE_CATEGORIES, "'unknown'")}) AS category,
 CASE WHEN contains(lower(message), 'finish_reason') AND contains(lower(message), 'length') THEN 'finish_reason_length' WHEN contains(lower(message), 'input was truncated') THEN 'context_truncated'
 WHEN code = 'invalid_json' OR contains(lower(message), 'not valid json') THEN 'invalid_json' WHEN code = 'missing_speaker_summaries' OR contains(lower(message), 'missing speaker summaries') THEN 'missing_speaker_summaries' END AS cause FROM e)
 SELECT event_id, {_case('stage', sc.PHASES, "'transcribing'")} AS phase, CAST({_case('stage', sc.PROGRESS, '10')} AS INT) AS progress, category, cause, upper(coalesce(code, 'fallback')) AS code,
 CASE WHEN event_id % 10 = 0 THEN false ELSE category IN ('environment', 'resource', 'segmentation', 'asr', 'llm', 'export', 'unknown') OR coalesce(cause IN ('finish_reason_length', 'context_truncated', 'invalid_json', 'missing_speaker_summaries'), false) END AS retryable FROM c""")
def error_rules(spark, d):
    e = src.table(spark, d, "events").select("event_id", src.pick(STAGES, "event_id % 9").alias("stage"), src.pick(CODES, "event_id % 7").alias("code"), src.pick(MESSAGES, "event_id % 5").alias("message"))
    e = e.withColumns({"category": sc.error_category(F.col("stage"), F.col("code")), "cause": sc.error_cause(F.col("code"), F.col("message"))})
    return e.select(
        "event_id", sc.lookup(F.col("stage"), sc.PHASES, "transcribing").alias("phase"), sc.lookup(F.col("stage"), sc.PROGRESS, 10).alias("progress"), "category", "cause", F.upper(F.coalesce("code", F.lit("fallback"))).alias("code"),
        sc.retryable(F.col("category"), F.col("cause"), F.when(F.col("event_id") % 10 == 0, False)).alias("retryable"),
    )


@query(f"""WITH {SEG}, k AS (SELECT meeting_id, speaker, min(idx) AS f FROM s GROUP BY 1, 2), n AS (SELECT meeting_id, speaker, row_number() OVER (PARTITION BY meeting_id ORDER BY f, speaker) AS no FROM k)
 SELECT s.meeting_id, s.idx, 'r' || s.idx AS ref, 'sp' || CASE WHEN starts_with(s.speaker, 'speaker_') THEN substring(s.speaker, 9) ELSE CAST(no AS VARCHAR) END AS sp,
 '[r' || s.idx || '] sp' || CASE WHEN starts_with(s.speaker, 'speaker_') THEN substring(s.speaker, 9) ELSE CAST(no AS VARCHAR) END || ': ' || s.text AS line, s.segment_id AS back FROM s JOIN n USING (meeting_id, speaker)""")
def compact_refs(spark, d):
    s = src.segments(spark, d)
    rows = s.join(sequence.first_seen(s), ["meeting_id", "speaker"])
    ref, sp = sc.compact_ref(F.col("segment_id"), F.col("idx") + 1), sc.compact_speaker(F.col("speaker"), F.col("number") + 1)
    back = src.segment_name(F.regexp_extract(ref, r"^r(\d+)$", 1).cast("long"))
    return rows.select("meeting_id", "idx", ref.alias("ref"), sp.alias("sp"), F.concat(F.lit("["), ref, F.lit("] "), sp, F.lit(": "), F.col("text")).alias("line"), back.alias("back"))


# ---- segment plans

IVS = f"{_iv(600)}, w AS (SELECT key, label, greatest({FIRST}, start_ms - 500) AS start_ms, least({LAST}, end_ms + 500) AS end_ms, id FROM i WHERE least({LAST}, end_ms + 500) > greatest({FIRST}, start_ms - 500))"


def _uncovered(source: str, name: str) -> str:
    return f"""{_islands(f'(SELECT key, start_ms, end_ms FROM {source})', 'key', 0, name + 'c')}, {name}a AS (SELECT key, coalesce(lag(end_ms) OVER (PARTITION BY key ORDER BY start_ms), {FIRST}) AS a, start_ms AS b FROM {name}c UNION ALL SELECT key, max(end_ms), {LAST} FROM {name}c GROUP BY 1),
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY a) - 1 AS gap_no, a AS start_ms, b AS end_ms FROM {name}a WHERE b > a)"""


DECIDED = f"""{_islands('w', 'key, label', 0, 'kn')}, {_uncovered('kn', 'ga')},
le AS (SELECT key, end_ms AS start_ms, list_sort(list(DISTINCT label)) AS l FROM kn GROUP BY 1, 2), ri AS (SELECT key, start_ms AS end_ms, list_sort(list(DISTINCT label)) AS r FROM kn GROUP BY 1, 2),
gd AS (SELECT ga.*, coalesce(l, []) AS l, coalesce(r, []) AS r FROM ga LEFT JOIN le ON le.key = ga.key AND le.start_ms = ga.start_ms LEFT JOIN ri ON ri.key = ga.key AND ri.end_ms = ga.end_ms),
de AS (SELECT *, CASE WHEN start_ms <= {FIRST} THEN 'leading_gap' WHEN end_ms >= {LAST} THEN 'trailing_gap' WHEN end_ms - start_ms > {6 * HOUR} THEN 'over_threshold' WHEN len(l) < 1 OR len(r) < 1 THEN 'missing_boundary' WHEN len(l) <> 1 THEN 'ambiguous_left_boundary'
 WHEN len(r) <> 1 THEN 'ambiguous_right_boundary' WHEN l[1] <> r[1] THEN 'different_boundary_speakers' ELSE 'same_speaker_bounded_short' END AS reason FROM gd)"""
PLAN = f"""br AS (SELECT key, label, start_ms, end_ms, NULL AS g FROM kn UNION ALL SELECT key, l[1], start_ms, end_ms, gap_no FROM de WHERE reason = 'same_speaker_bounded_short'),
{_islands('br', 'key, label', 0, 'kb')}, kg AS (SELECT kb.key, kb.label, kb.start_ms, kb.end_ms, CASE WHEN count(g) > 0 THEN 'absorbed_merged' ELSE 'x' END AS source, array_to_string(list_sort(list('gap:' || lpad(CAST(g AS VARCHAR), 4, '0')) FILTER (WHERE g IS NOT NULL)), ',') AS gap_ids
 FROM kb JOIN br ON br.key = kb.key AND br.label = kb.label AND br.start_ms >= kb.start_ms AND br.end_ms <= kb.end_ms GROUP BY 1, 2, 3, 4), {_uncovered('kb', 'gu')},
al AS (SELECT key, label, start_ms, end_ms, coalesce(gap_ids, '') AS gap_ids, {3 * HOUR} AS most FROM kg UNION ALL SELECT key, 'unknown', start_ms, end_ms, '', {24 * HOUR} FROM gu),
pc AS (SELECT *, unnest(range(0, greatest((end_ms - start_ms + most - 1) // most, 1))) AS k FROM al),
pl AS (SELECT key, label, start_ms + k * most AS start_ms, least(end_ms, start_ms + (k + 1) * most) AS end_ms, gap_ids FROM pc)"""


def _named(spark, d) -> DataFrame:
    rows = src.intervals(spark, d)
    return rows.withColumns({"source_ids": F.array(F.concat(F.lit("rttm:"), F.col("id").cast("string"))), "gap_ids": F.array().cast("array<string>"), "source": F.lit("padded")})


def _wide(spark, d) -> DataFrame:
    return _named(spark, d).withColumns({"start_ms": F.greatest(F.lit(FIRST), F.col("start_ms") - 500), "end_ms": F.least(F.lit(LAST), F.col("end_ms") + 500)}).where("end_ms > start_ms")


@query(f"""WITH {IVS}, {_islands('w', 'key, label', 0, 'kn')} SELECT kn.key, kn.label, kn.start_ms, kn.end_ms, array_to_string(list_sort(list('rttm:' || w.id)), ',') AS source_ids, CASE WHEN count(*) = 1 THEN 'padded' ELSE 'merged' END AS source
 FROM kn JOIN w ON w.key = kn.key AND w.label = kn.label AND w.start_ms >= kn.start_ms AND w.end_ms <= kn.end_ms GROUP BY 1, 2, 3, 4""")
def known_intervals(spark, d):
    return plan.merge_known(_wide(spark, d), KEY).select("key", "label", "start_ms", "end_ms", F.array_join("source_ids", ",").alias("source_ids"), "source")


@query(f"WITH {IVS}, {_uncovered('w', 'gp')} SELECT * FROM gp")
def uncovered_gaps(spark, d):
    return plan.uncovered(_wide(spark, d), KEY, F.lit(FIRST), F.lit(LAST)).select("key", "gap_no", "start_ms", "end_ms")


@query(f"WITH {IVS}, {DECIDED} SELECT key, gap_no, start_ms, end_ms, array_to_string(l, ',') AS left_labels, array_to_string(r, ',') AS right_labels, CASE WHEN reason = 'same_speaker_bounded_short' THEN 'absorbed' ELSE 'kept_unknown' END AS decision, reason, CASE WHEN reason = 'same_speaker_bounded_short' THEN l[1] END AS assigned FROM de")
def gap_decisions(spark, d):
    known = plan.merge_known(_wide(spark, d), KEY)
    return plan.decide_gaps(plan.uncovered(known, KEY, F.lit(FIRST), F.lit(LAST)), known, KEY, 6 * HOUR, F.lit(FIRST), F.lit(LAST)).na.fill("", ["left_labels", "right_labels"])


def _plan(spark, d) -> DataFrame:
    return plan.segment_plan(_named(spark, d), KEY, 500, 6 * HOUR, 3 * HOUR, 24 * HOUR, F.lit(FIRST), F.lit(LAST))


@query(f"WITH {IVS}, {DECIDED}, {PLAN} SELECT key, row_number() OVER (PARTITION BY key ORDER BY start_ms, end_ms, label) - 1 AS no, label, start_ms, end_ms, gap_ids FROM pl")
def segment_plan(spark, d):
    return _plan(spark, d).select("key", "no", "label", "start_ms", "end_ms", "gap_ids")


@query(f"WITH {IVS}, {DECIDED}, {PLAN}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_ms, end_ms, label) - 1 AS no FROM pl) SELECT key, no, 'too_long' AS \"check\" FROM n WHERE end_ms - start_ms > CASE WHEN label = 'unknown' THEN {2 * HOUR} ELSE {HOUR} END")
def plan_checks(spark, d):
    return plan.check_plan(_plan(spark, d), KEY, HOUR, 2 * HOUR, F.lit(FIRST), F.lit(LAST))


@query(f"""WITH {_iv(600)}, o AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS change FROM i WINDOW w AS (PARTITION BY key ORDER BY start_ms, end_ms, label, id)),
 t AS (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY start_ms, end_ms, label, id) AS turn FROM o),
 u AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY key, turn ORDER BY start_ms, end_ms, label, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM t),
 r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY key ORDER BY start_ms, end_ms, label, id) AS BIGINT) AS run FROM u)
 SELECT key, run, min(label) AS label, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM r GROUP BY 1, 2""")
def merge_adjacent(spark, d):
    return plan.merge_adjacent(src.intervals(spark, d), KEY, 12 * HOUR)


@query(f"""WITH {SEG}, z AS (SELECT *, end_ms - start_ms AS t, (end_ms - start_ms + 2999) // 3000 AS n FROM s WHERE end_ms > start_ms), y AS (SELECT *, t - (n - 1) * 3000 AS tail FROM z),
 x AS (SELECT *, CASE WHEN n > 1 AND (tail < 900 OR tail < 400) THEN n - 1 ELSE n END AS m FROM y), v AS (SELECT *, unnest(range(1, m + 1)) AS part FROM x)
 SELECT meeting_id, idx, CAST(part AS INT) AS part, start_ms + (part - 1) * 3000 AS start_ms, CASE WHEN part = m THEN end_ms ELSE start_ms + part * 3000 END AS end_ms FROM v""")
def asr_pieces(spark, d):
    return plan.asr_pieces(src.segments(spark, d), 3000, 400, 900).select("meeting_id", "idx", "part", "start_ms", "end_ms")


# ---- evaluation

MAPPED = f"""{_iv(LONG)}, {REF}, {PAIRS}, ms AS (SELECT key, label, ref_label, CAST(sum(ms) AS BIGINT) AS ms FROM p GROUP BY 1, 2, 3),
pl AS (SELECT key, list_sort(list(DISTINCT label)) AS ls FROM i GROUP BY 1), rl AS (SELECT key, list_sort(list(DISTINCT label)) AS rs FROM r GROUP BY 1),
sd AS (SELECT key, ls, rs, len(ls) <= len(rs) AS own, CASE WHEN len(ls) <= len(rs) THEN ls ELSE rs END AS a, CASE WHEN len(ls) <= len(rs) THEN rs ELSE ls END AS b FROM pl JOIN rl USING (key)),
va AS (SELECT sd.key, x.i AS i, y.j AS j, coalesce(ms.ms, 0) AS v FROM sd, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) x, LATERAL (SELECT unnest(range(1, len(b) + 1)) AS j) y
 LEFT JOIN ms ON ms.key = sd.key AND ms.label = CASE WHEN own THEN a[i] ELSE b[j] END AND ms.ref_label = CASE WHEN own THEN b[j] ELSE a[i] END),
pm AS (SELECT key, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS js, CAST(0 AS BIGINT) AS v FROM sd UNION ALL SELECT pm.key, pm.i + 1, list_append(pm.js, va.j), pm.v + va.v FROM pm JOIN va ON va.key = pm.key AND va.i = pm.i + 1 WHERE NOT list_contains(pm.js, va.j)),
be AS (SELECT key, js FROM pm JOIN sd USING (key) WHERE i = len(a) QUALIFY row_number() OVER (PARTITION BY key ORDER BY v DESC, js) = 1),
ma AS (SELECT q.key, q.label, q.ref_label, coalesce(ms.ms, 0) AS ms FROM (SELECT key, CASE WHEN own THEN a[k] ELSE b[js[k]] END AS label, CASE WHEN own THEN b[js[k]] ELSE a[k] END AS ref_label FROM (SELECT sd.*, js, unnest(range(1, len(js) + 1)) AS k FROM be JOIN sd USING (key))) q LEFT JOIN ms USING (key, label, ref_label))"""
QUALITY = f"""{MAPPED}, sh AS (SELECT p.key, p.id, CAST(sum(CASE WHEN p.ref_label = ma.ref_label THEN p.ms ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN p.ref_label = ma.ref_label THEN 0 ELSE p.ms END) AS BIGINT) AS o FROM p LEFT JOIN ma ON ma.key = p.key AND ma.label = p.label GROUP BY 1, 2),
qu AS (SELECT i.key, i.id, i.label, ma.ref_label AS mapped, i.end_ms - i.start_ms AS duration_ms, coalesce(c, 0) AS correct_ms, coalesce(o, 0) AS other_ms FROM i LEFT JOIN ma ON ma.key = i.key AND ma.label = i.label LEFT JOIN sh ON sh.key = i.key AND sh.id = i.id)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    return src.intervals(spark, d, LONG), src.reference_intervals(spark, d, LONG)


def _mapping(spark, d) -> DataFrame:
    return ev.label_mapping(ev.by_labels(*_sides(spark, d), KEY), KEY)


@query(f"WITH RECURSIVE {MAPPED} SELECT key, label, ref_label, ms FROM ma")
def label_mapping(spark, d):
    return _mapping(spark, d)


@query(f"""WITH RECURSIVE {QUALITY} SELECT key, id, label, mapped, duration_ms, correct_ms, other_ms, greatest(0, duration_ms - correct_ms - other_ms) AS silence_ms,
 CASE WHEN correct_ms + other_ms > 0 THEN round(correct_ms / (correct_ms + other_ms), 6) END AS purity, CASE WHEN correct_ms + other_ms > 0 THEN round(other_ms / (correct_ms + other_ms), 6) END AS leak FROM qu""")
def segment_quality(spark, d):
    rows, reference = _sides(spark, d)
    overlaps = ev.label_overlaps(rows, reference, KEY)
    return ev.segment_quality(rows, reference, ev.label_mapping(ev.by_labels(rows, reference, KEY, overlaps), KEY), KEY, overlaps)


@query(f"""WITH RECURSIVE {QUALITY}, t AS (SELECT key, CAST(sum(correct_ms) AS BIGINT) AS c, CAST(sum(other_ms) AS BIGINT) AS o, CAST(sum(greatest(0, duration_ms - correct_ms - other_ms)) AS BIGINT) AS s, CAST(sum(duration_ms) AS BIGINT) AS d FROM qu GROUP BY 1)
 SELECT key, c AS correct_ms, o AS other_ms, s AS silence_ms, d AS duration_ms, CASE WHEN c + o > 0 THEN round(c / (c + o), 6) END AS purity, CASE WHEN c + o > 0 THEN round(o / (c + o), 6) END AS leak, CASE WHEN d > 0 THEN round(s / d, 6) END AS silence_ratio FROM t""")
def quality_totals(spark, d):
    return ev.quality_totals(segment_quality(spark, d), KEY)


COVERED = f"""{MAPPED}, pr AS (SELECT r.key, r.id, i.label, i.start_ms AS s, i.end_ms AS e, i.id AS iid, least(i.end_ms, r.end_ms) - greatest(i.start_ms, r.start_ms) AS ms FROM r JOIN i ON r.key = i.key AND i.start_ms < r.end_ms AND r.start_ms < i.end_ms AND i.end_ms > i.start_ms AND r.end_ms > r.start_ms),
ks AS (SELECT key, id, CAST(sum(ms) AS BIGINT) AS known FROM pr GROUP BY 1, 2), lb AS (SELECT key, id, label, CAST(sum(ms) AS BIGINT) AS ms, min({{'s': s, 'e': e, 'i': iid}}) AS at FROM pr GROUP BY 1, 2, 3),
bs AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY key, id ORDER BY ms DESC, at) = 1),
cv AS (SELECT r.key, r.id, r.label AS ref_label, r.end_ms - r.start_ms AS duration_ms, least(r.end_ms - r.start_ms, coalesce(known, 0)) AS known_ms, bs.label AS best_label, coalesce(bs.ms, 0) AS best_ms FROM r LEFT JOIN ks ON ks.key = r.key AND ks.id = r.id LEFT JOIN bs ON bs.key = r.key AND bs.id = r.id)"""


def _coverage(spark, d) -> DataFrame:
    return ev.coverage_rows(*_sides(spark, d), _mapping(spark, d), KEY)


@query(f"""WITH RECURSIVE {COVERED} SELECT cv.key, cv.id, cv.ref_label, duration_ms, known_ms, 0 AS unknown_ms, known_ms AS all_ms, CASE WHEN duration_ms > 0 THEN round(known_ms / duration_ms, 6) END AS known_coverage, CASE WHEN duration_ms > 0 THEN round(known_ms / duration_ms, 6) END AS all_coverage, best_label, best_ms, ma.ref_label AS mapped
 FROM cv LEFT JOIN ma ON ma.key = cv.key AND ma.label = best_label""")
def coverage_rows(spark, d):
    return _coverage(spark, d)


@query(f"""WITH RECURSIVE {COVERED} SELECT key, round(avg(known_ms / duration_ms), 6) AS avg_coverage, count(*) FILTER (WHERE known_ms / duration_ms < 0.95) AS under_95, CAST(coalesce(sum(duration_ms) FILTER (WHERE known_ms / duration_ms < 0.95), 0) AS BIGINT) AS under_95_ms,
 count(*) FILTER (WHERE known_ms / duration_ms < 0.5) AS missed, CAST(coalesce(sum(duration_ms) FILTER (WHERE known_ms / duration_ms < 0.5), 0) AS BIGINT) AS missed_ms, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM cv WHERE duration_ms > 0 GROUP BY 1""")
def interval_metrics(spark, d):
    return ev.interval_metrics(_coverage(spark, d), KEY, 0.5)


def _grid(name: str) -> str:
    return f"(SELECT key, CAST(sum((end_ms + 59999) // 60000 - (start_ms + 59999) // 60000) AS BIGINT) AS n FROM {name} GROUP BY 1)"


def _meet(a: str, b: str, more: str = "") -> str:
    return f"SELECT {a}.key, greatest({a}.start_ms, {b}.start_ms) AS start_ms, least({a}.end_ms, {b}.end_ms) AS end_ms FROM {a} JOIN {b} ON {a}.key = {b}.key AND {a}.start_ms < {b}.end_ms AND {b}.start_ms < {a}.end_ms {more}"


@query(f"""WITH RECURSIVE {MAPPED}, {_islands('i', 'key', 0, 'ki')}, {_islands('r', 'key', 0, 'ri')}, kr AS ({_meet('ki', 'ri')}), im AS (SELECT i.key, i.start_ms, i.end_ms, ma.ref_label FROM i JOIN ma ON ma.key = i.key AND ma.label = i.label WHERE i.end_ms > i.start_ms),
 h0 AS ({_meet('im', 'r', 'AND im.ref_label = r.label AND r.end_ms > r.start_ms')}), {_islands('h0', 'key', 0, 'hi')},
 t AS (SELECT k.key, coalesce(x.n, 0) AS n_ref, coalesce(k.n, 0) AS n_known, coalesce(y.n, 0) AS n_both, coalesce(z.n, 0) AS n_hit FROM {_grid('ki')} k LEFT JOIN {_grid('ri')} x USING (key) LEFT JOIN {_grid('kr')} y USING (key) LEFT JOIN {_grid('hi')} z USING (key))
 SELECT key, n_ref, n_known, n_known AS n_everything, n_both AS n_known_ref, n_both AS n_all_ref, n_hit, CASE WHEN n_ref > 0 THEN round(n_both / n_ref, 6) END AS known_recall, CASE WHEN n_ref > 0 THEN round(n_both / n_ref, 6) END AS all_recall,
 CASE WHEN n_known > 0 THEN round(n_both / n_known, 6) END AS known_precision, CASE WHEN n_known > 0 THEN round(n_both / n_known, 6) END AS all_precision, CASE WHEN n_both > 0 THEN round(n_hit / n_both, 6) END AS accuracy FROM t""")
def sample_metrics(spark, d):
    return ev.sample_metrics(*_sides(spark, d), _mapping(spark, d), KEY, 60_000)


TEXTS = f"""{SEG}, rf AS (SELECT meeting_id, idx AS id, start_ms + 1500 AS start_ms, end_ms + 1500 AS end_ms, text FROM s),
tr AS (SELECT s.meeting_id, s.idx AS id, s.speaker, s.start_ms, s.end_ms, s.text, count(rf.id) AS n_ref, CAST(coalesce(sum(CASE WHEN rf.id IS NOT NULL THEN least(s.end_ms, rf.end_ms) - greatest(s.start_ms, rf.start_ms) END), 0) AS BIGINT) AS ref_ms, trim(regexp_replace(coalesce(string_agg(rf.text, ' ' ORDER BY rf.start_ms, rf.id), ''), '\\s+', ' ', 'g')) AS ref_text
 FROM s LEFT JOIN rf ON rf.meeting_id = s.meeting_id AND s.start_ms < rf.end_ms AND rf.start_ms < s.end_ms AND s.end_ms > s.start_ms AND rf.end_ms > rf.start_ms GROUP BY ALL)"""
DISTANCE = "regexp_replace(lower(regexp_replace({}, '<[^>]+>', '', 'g')), '[^0-9a-z一-鿿]', '', 'g')"


def _text_rows(spark, d) -> DataFrame:
    s = src.segments(spark, d).select("meeting_id", F.col("idx").alias("id"), "speaker", "start_ms", "end_ms", "text")
    ref = s.select("meeting_id", "id", (F.col("start_ms") + 1500).alias("start_ms"), (F.col("end_ms") + 1500).alias("end_ms"), "text")
    return ev.text_rows(s, ref, ["meeting_id"], 60_000)


@query(f"WITH {TEXTS}, n AS (SELECT *, {DISTANCE.format('text')} AS h, {DISTANCE.format('ref_text')} AS rr FROM tr) SELECT meeting_id, id, n_ref, ref_ms, length(ref_text) AS ref_chars, round(CASE WHEN length(rr) > 0 THEN levenshtein(h, rr) / length(rr) END, 6) AS cer FROM n")
def segment_text_rows(spark, d):
    return _text_rows(spark, d).select("meeting_id", "id", "n_ref", "ref_ms", F.length("ref_text").cast("long").alias("ref_chars"), F.round(tx.char_error_rate(F.col("text"), F.col("ref_text"), None), 6).alias("cer"))


@query(f"""WITH {TEXTS} SELECT meeting_id, count(*) AS segments, count(*) FILTER (WHERE speaker = 'unknown') AS unknown, round(count(*) FILTER (WHERE speaker = 'unknown') / count(*), 6) AS unknown_ratio, count(*) FILTER (WHERE trim(text) = '') AS empty, CAST(sum(length(text)) AS BIGINT) AS chars,
 CAST(coalesce(sum(length(text)) FILTER (WHERE speaker = 'unknown'), 0) AS BIGINT) AS unknown_chars, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, CASE WHEN sum(end_ms - start_ms) > 0 THEN round(coalesce(sum(ref_ms) FILTER (WHERE speaker = 'unknown'), 0) / sum(end_ms - start_ms), 6) END AS unknown_ref_ratio FROM tr GROUP BY 1""")
def evaluation_ratios(spark, d):
    u = F.col("speaker") == "unknown"
    return _text_rows(spark, d).groupBy("meeting_id").agg(
        F.count("*").alias("segments"), F.count_if(u).alias("unknown"), F.round(F.count_if(u) / F.count("*"), 6).alias("unknown_ratio"), F.count_if(F.trim("text") == "").alias("empty"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(u, F.length("text")).otherwise(0)).alias("unknown_chars"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.round(F.try_divide(F.sum(F.when(u, F.col("ref_ms")).otherwise(0)), F.sum(F.col("end_ms") - F.col("start_ms"))), 6).alias("unknown_ref_ratio"),
    )


# ---- checks and repairs

def _violations(source: str, keys: str, *rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{name}' AS \"check\" FROM {source} WHERE {rule}" for name, rule in rules)


ROWS = f"""{SEG}, q AS (SELECT meeting_id, CASE WHEN idx % 6 = 5 THEN -idx WHEN idx % 4 = 3 THEN idx - 1 ELSE idx END AS idx, start_ms, CASE WHEN idx % 5 = 1 THEN start_ms ELSE end_ms END AS end_ms, ['ok', 'transcript_empty', 'failed', NULL][idx % 4 + 1] AS status FROM s),
q1 AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, idx) AS n FROM q)"""


@query(f"WITH {ROWS} " + _violations("q1", "meeting_id, idx", ("negative_index", "idx < 0"), ("duplicate_index", "n > 1"), ("end_before_start", "end_ms <= start_ms"), ("failed_status", "coalesce(status, 'unknown') NOT IN ('ok', 'transcript_empty')")))
def segment_checks(spark, d):
    i = F.col("idx")
    rows = src.segments(spark, d).select("meeting_id", F.when(i % 6 == 5, -i).when(i % 4 == 3, i - 1).otherwise(i).alias("idx"), "start_ms", F.when(i % 5 == 1, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), src.pick(("ok", "transcript_empty", "failed", None), "idx % 4").alias("status"))
    return validation.check_segments(rows)


TURNS = f"""{SEG}, q AS (SELECT meeting_id, idx, CASE WHEN idx % 5 = 4 THEN idx ELSE idx + 1 END - CASE WHEN meeting_id % 7 = 0 THEN 1 ELSE 0 END AS id, CASE WHEN idx % 6 = 2 THEN NULL ELSE start_ms END AS start_ms, CASE WHEN idx % 7 = 3 THEN start_ms - 1 ELSE end_ms END AS end_ms, CASE WHEN idx % 3 = 1 THEN ' ' ELSE speaker END AS speaker, text, idx % 4 AS chunk FROM s),
q1 AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, id ORDER BY idx) AS n FROM q)"""


@query(f"WITH {TURNS} " + _violations("q1", "meeting_id, idx", ("id_not_positive", "id < 1"), ("duplicate_id", "n > 1"), ("range_missing", "start_ms IS NULL OR end_ms IS NULL"), ("invalid_range", "start_ms < 0 OR end_ms < start_ms"), ("blank_speaker", "trim(speaker) = ''"), ("blank_text", "trim(text) = ''"), ("bad_chunk_ids", "chunk < 1")))
def turn_checks(spark, d):
    i = F.col("idx")
    rows = src.segments(spark, d).select(
        "meeting_id", "idx", (F.when(i % 5 == 4, i).otherwise(i + 1) - F.when(F.col("meeting_id") % 7 == 0, 1).otherwise(0)).alias("id"), F.when(i % 6 != 2, F.col("start_ms")).alias("start_ms"), F.when(i % 7 == 3, F.col("start_ms") - 1).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(i % 3 == 1, " ").otherwise(F.col("speaker")).alias("speaker"), "text", F.array(i % 4).alias("chunk_ids"),
    )
    return validation.check_turns(rows)


def _ref(number: str) -> str:
    return f"'seg-' || lpad(CAST({number} AS VARCHAR), 6, '0')"


FACTS = f"""{SEG}, fa AS (SELECT meeting_id, ['chapters', 'speakers', 'key_points', 'decisions', 'action_items'][idx % 5 + 1] AS field, idx // 5 AS pos, CASE WHEN idx % 7 = 3 THEN NULL ELSE 'item ' || idx % 4 END AS text, CASE WHEN idx % 11 <> 5 THEN 'about ' || idx % 3 END AS overview, idx, speaker,
 CASE WHEN idx % 2 = 0 THEN 'speaker_1' ELSE 'somebody' END AS owner, CASE WHEN meeting_id % 3 = 0 THEN text ELSE 'never said' END AS deadline0, CASE WHEN meeting_id % 13 = 0 THEN 'seg-999999' END AS start_ref FROM s),
rr AS (SELECT fa.meeting_id, fa.field, fa.pos, fa.idx, unnest([fa.idx, fa.idx + 1]) AS n, unnest([0, 1]) AS at FROM fa), rs AS (SELECT rr.*, s.speaker AS sp, s.text AS st, s.start_ms, s.end_ms, s.segment_id AS ref, CASE WHEN s.text IS NULL THEN 1 ELSE 0 END AS miss, CASE WHEN s.text = '' THEN 1 ELSE 0 END AS emp FROM rr LEFT JOIN s ON s.meeting_id = rr.meeting_id AND s.idx = n),
tl AS (SELECT fa.*, nullif(trim(regexp_replace(deadline0, '\\s+', ' ', 'g')), '') AS deadline, coalesce(list({{'at': at, 'ref': ref, 'sp': sp, 'st': st}} ORDER BY at) FILTER (WHERE miss = 0 AND emp = 0), []) AS c, 1 + sum(miss) AS n_missing, sum(emp) + sum(CASE WHEN at = 0 THEN emp ELSE 0 END) AS n_empty FROM fa JOIN rs USING (meeting_id, field, pos, idx) GROUP BY ALL),
ow AS (SELECT *, CASE WHEN field = 'speakers' THEN list_filter(c, lambda x: x.sp = speaker) ELSE c END AS own FROM tl),
rg AS (SELECT ow.*, a.start_ms AS first_ms, b.start_ms AS last_ms, b.end_ms AS last_end, CASE WHEN field = 'chapters' THEN coalesce(start_ref, own[1].ref) END AS sref, CASE WHEN field = 'chapters' THEN own[-1].ref END AS eref FROM ow
 LEFT JOIN s a ON a.meeting_id = ow.meeting_id AND a.segment_id = CASE WHEN field = 'chapters' THEN coalesce(start_ref, own[1].ref) END LEFT JOIN s b ON b.meeting_id = ow.meeting_id AND b.segment_id = CASE WHEN field = 'chapters' THEN own[-1].ref END),
us AS (SELECT *, text IS NULL OR len(own) = 0 OR (field = 'chapters' AND overview IS NULL) AS unsup FROM rg),
br AS (SELECT *, NOT unsup AND field = 'chapters' AND coalesce(first_ms > last_ms, true) AS badr, NOT unsup AND field = 'action_items' AND len(list_filter(own, lambda x: x.sp = owner)) = 0 AS bado,
 NOT unsup AND field = 'action_items' AND deadline IS NOT NULL AND NOT contains(array_to_string(list_transform(own, lambda x: x.st), ' '), deadline) AS badd, field = 'speakers' AND len(own) <> len(c) AS crossed FROM us),
fx AS (SELECT * EXCLUDE (owner, deadline), CASE WHEN field = 'action_items' AND NOT bado THEN owner END AS owner, CASE WHEN field = 'action_items' AND NOT badd THEN deadline END AS deadline, array_to_string(list_transform(own, lambda x: x.ref), ',') AS refs FROM br),
ag AS (SELECT *, NOT (unsup OR badr) AND row_number() OVER (PARTITION BY meeting_id, field, unsup OR badr, text, overview, speaker, owner, deadline, sref, eref, refs ORDER BY pos) > 1 AS again FROM fx)"""


@query(f"""WITH {FACTS} SELECT meeting_id, field, pos, text, owner, deadline, refs, array_to_string(list_sort(list_distinct(list_transform(own, lambda x: x.sp))), ',') AS speakers, CASE WHEN field = 'chapters' THEN first_ms END AS start_ms, CASE WHEN field = 'chapters' THEN last_end END AS end_ms
 FROM ag WHERE NOT (unsup OR badr) AND NOT again""")
def summary_facts(spark, d):
    return validation.repair_summary(src.summary_facts(spark, d), src.segments(spark, d))[0]


@query(f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT meeting_id, field, pos, '{name}' AS repair, CAST({n} AS BIGINT) AS n FROM ag WHERE {n} > 0" for name, n in (
    ("drop_empty_text_ref", "n_empty"), ("drop_invalid_refs", "n_missing"), ("drop_cross_speaker_refs", "CAST(crossed AS INT)"), ("drop_unsupported_item", "CAST(unsup AS INT)"), ("drop_invalid_chapter_range", "CAST(badr AS INT)"), ("clear_unsupported_owner", "CAST(bado AS INT)"),
    ("clear_unsupported_deadline", "CAST(badd AS INT)"), ("drop_duplicate", "CAST(again AS INT)"))))
def summary_repairs(spark, d):
    return validation.repair_summary(src.summary_facts(spark, d), src.segments(spark, d))[1]


ITEMS = f"""{SEG}, tu AS (SELECT meeting_id, idx + 1 AS turn_id, speaker, start_ms, end_ms, text FROM s WHERE trim(text) <> ''),
it AS (SELECT meeting_id, ['decisions', 'risks'][idx % 2 + 1] AS field, idx AS pos, CASE WHEN idx % 5 = 2 THEN '' ELSE text END AS text, CASE WHEN idx % 4 = 1 THEN '未明确' END AS owner, CASE WHEN idx % 5 = 4 THEN CAST([] AS BIGINT[]) WHEN idx % 3 = 0 THEN [idx + 1, idx + 2, 999] ELSE [idx + 1, idx + 2] END AS ids FROM s),
fl AS (SELECT meeting_id, field, pos, unnest(ids) AS turn_id FROM it)"""


@query(f"WITH {ITEMS} " + _violations("it", "meeting_id, field, pos", ("empty_text", "text = ''"), ("owner_must_be_null", "owner = '未明确'"), ("no_turn_ids", "len(ids) < 1")) + " UNION ALL SELECT fl.meeting_id, field, pos, 'unknown_turn' FROM fl LEFT JOIN tu USING (meeting_id, turn_id) WHERE tu.turn_id IS NULL")
def item_checks(spark, d):
    return validation.check_items(src.map_items(spark, d), src.turns(spark, d))


@query(f"WITH {ITEMS}, o AS (SELECT DISTINCT fl.meeting_id, field, pos, speaker, start_ms, end_ms FROM fl JOIN tu USING (meeting_id, turn_id)) SELECT meeting_id, field, pos, count(*) AS n, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM o GROUP BY 1, 2, 3")
def item_evidence(spark, d):
    return validation.materialize_evidence(src.map_items(spark, d), src.turns(spark, d))


@query(f"""WITH {ITEMS}, e AS (SELECT meeting_id, 'risks' AS field, idx AS pos, 0 AS at, CASE WHEN idx % 6 = 5 THEN '' ELSE 'speaker_1' END AS speaker, CASE WHEN idx % 4 = 3 THEN NULL ELSE end_ms + 100 END AS a, CASE WHEN idx % 7 = 6 THEN end_ms ELSE end_ms + 300 END AS b FROM s),
 c AS (SELECT *, CASE WHEN speaker = '' THEN 'speaker_missing' WHEN a IS NULL OR b IS NULL THEN 'range_missing' WHEN a < 0 OR b < a THEN 'invalid_range' WHEN NOT EXISTS (SELECT 1 FROM tu WHERE tu.meeting_id = e.meeting_id AND tu.speaker = e.speaker AND b + 250 >= tu.start_ms AND a - 250 <= tu.end_ms) THEN 'no_such_turn' END AS why FROM e)
 SELECT meeting_id, field, pos, at, why AS "check" FROM c WHERE why IS NOT NULL""")
def evidence_checks(spark, d):
    i = F.col("idx")
    e = src.segments(spark, d).select("meeting_id", F.lit("risks").alias("field"), i.alias("pos"), F.lit(0).alias("at"), F.when(i % 6 == 5, "").otherwise("speaker_1").alias("speaker"), F.when(i % 4 != 3, F.col("end_ms") + 100).alias("start_ms"), F.when(i % 7 == 6, F.col("end_ms")).otherwise(F.col("end_ms") + 300).alias("end_ms"))
    return validation.check_evidence(e, src.turns(spark, d), 250)


@query(f"""WITH {SEG}, c AS (SELECT meeting_id, idx // 3 AS no, CASE WHEN idx % 2 = 1 THEN ' ' ELSE 't' END AS title, CASE WHEN idx // 3 % 2 = 1 THEN [idx + 1, idx + 2, idx + 3, idx] ELSE [idx + 1, idx + 2, idx + 3] END AS ids, start_ms, end_ms FROM s WHERE idx % 3 = 0),
 tu AS (SELECT meeting_id, idx + 1 AS turn_id, start_ms AS t0, end_ms AS t1, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, idx) AS rank FROM s WHERE trim(text) <> ''),
 f0 AS (SELECT meeting_id, no, unnest(ids) AS turn_id, unnest(range(0, len(ids))) AS at FROM c), f1 AS (SELECT f0.*, rank, t0, t1 FROM f0 LEFT JOIN tu USING (meeting_id, turn_id)),
 f2 AS (SELECT *, coalesce(rank <= lag(rank) OVER (PARTITION BY meeting_id, no ORDER BY at), false) AS back, min(no) OVER (PARTITION BY meeting_id, turn_id) AS fst FROM f1),
 g AS (SELECT meeting_id, no, count(*) FILTER (WHERE rank IS NULL) AS unk, bool_or(back) AS back, bool_or(rank IS NOT NULL AND fst < no) AS reused, min(t0) AS t0, max(t1) AS t1 FROM f2 GROUP BY 1, 2),
 h AS (SELECT c.*, unk, back, reused, t0, t1, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM c JOIN g USING (meeting_id, no) WINDOW w AS (PARTITION BY meeting_id ORDER BY no)) """
 + _violations("h", "meeting_id, no", ("empty_title", "trim(title) = ''"), ("unknown_turn", "unk > 0"), ("turn_order", "back"), ("reused_turn", "reused"), ("times_of_turns", "start_ms <> t0 OR end_ms <> t1"), ("not_chronological", "start_ms < ps OR (start_ms = ps AND end_ms < pe)")))
def chapter_checks(spark, d):
    i = F.col("idx")
    ids = F.when(F.floor(i / 3) % 2 == 1, F.array(i + 1, i + 2, i + 3, i)).otherwise(F.array(i + 1, i + 2, i + 3))
    c = src.segments(spark, d).where("idx % 3 = 0").select("meeting_id", F.floor(i / 3).alias("no"), F.when(i % 2 == 1, " ").otherwise("t").alias("title"), ids.alias("turn_ids"), "start_ms", "end_ms")
    return validation.check_chapters(c, src.turns(spark, d))


@query(f"""WITH {SEG}, so AS (SELECT meeting_id, 'v1-chapter-' || idx AS source_id, idx AS rank FROM s), c AS (SELECT meeting_id, idx // 3 AS no, CASE WHEN idx % 2 = 1 THEN CAST([] AS VARCHAR[]) ELSE ['v1-chapter-' || idx, 'v1-chapter-' || (idx + 1), 'v1-chapter-' || (idx + 4), 'v1-chapter-' || idx] END AS ids FROM s WHERE idx % 3 = 0),
 f0 AS (SELECT meeting_id, no, unnest(ids) AS source_id, unnest(range(0, len(ids))) AS at FROM c), f1 AS (SELECT f0.*, rank, row_number() OVER (PARTITION BY f0.meeting_id, no, source_id ORDER BY at) AS k, min(no) OVER (PARTITION BY f0.meeting_id, source_id) AS fst FROM f0 LEFT JOIN so USING (meeting_id, source_id)),
 f2 AS (SELECT *, CASE WHEN k > 1 THEN 'duplicate_source' WHEN rank IS NULL THEN 'unknown_source' WHEN fst < no THEN 'reused_source' END AS why FROM f1)
 SELECT meeting_id, no, why AS "check", source_id FROM f2 WHERE why IS NOT NULL
 UNION ALL SELECT meeting_id, no, 'not_contiguous', NULL FROM f1 WHERE rank IS NOT NULL GROUP BY 1, 2 HAVING max(rank) - min(rank) + 1 <> count(DISTINCT rank)
 UNION ALL SELECT meeting_id, no, 'no_source_ids', NULL FROM c WHERE len(ids) < 1
 UNION ALL SELECT meeting_id, NULL, 'missing_source', source_id FROM so WHERE NOT EXISTS (SELECT 1 FROM f0 WHERE f0.meeting_id = so.meeting_id AND f0.source_id = so.source_id)""")
def reduce_checks(spark, d):
    i = F.col("idx")
    name = lambda n: F.concat(F.lit("v1-chapter-"), n.cast("string"))
    s = src.segments(spark, d)
    ids = F.when(i % 2 == 1, F.array().cast("array<string>")).otherwise(F.array(name(i), name(i + 1), name(i + 4), name(i)))
    return validation.check_reduce(s.where("idx % 3 = 0").select("meeting_id", F.floor(i / 3).alias("no"), ids.alias("source_ids")), s.select("meeting_id", name(i).alias("source_id"), i.alias("rank")))


def _sources(spark, d) -> DataFrame:
    return validation.reduce_sources(src.map_items(spark, d).withColumn("value", F.col("pos") % 2 + 1))


def _outputs(spark, d) -> DataFrame:
    i = F.col("pos")
    named = lambda n: F.concat(F.lit("v"), (n % 2 + 1).cast("string"), F.lit("-"), F.when(n % 2 == 0, "decisions").otherwise("risks"), F.lit("-"), n.cast("string"))
    return src.map_items(spark, d).select("meeting_id", "field", "pos", F.array(named(i), named(i + 2), named(i + 1), F.lit("v9-risks-9")).alias("source_ids"))


EVIDENCE = f"""{ITEMS}, so AS (SELECT *, 'v' || (pos % 2 + 1) || '-' || field || '-' || pos AS source_id FROM it), n0 AS (SELECT meeting_id, field, pos, unnest([pos, pos + 2, pos + 1, -1]) AS n, unnest([0, 1, 2, 3]) AS at FROM it),
n1 AS (SELECT *, CASE WHEN n < 0 THEN 'v9-risks-9' ELSE 'v' || (n % 2 + 1) || '-' || CASE WHEN n % 2 = 0 THEN 'decisions' ELSE 'risks' END || '-' || n END AS source_id FROM n0),
n2 AS (SELECT n1.*, so.field AS sf, so.ids, CASE WHEN so.field IS NULL THEN 'unknown_source' WHEN so.field <> n1.field THEN 'wrong_field' END AS why FROM n1 LEFT JOIN so ON so.meeting_id = n1.meeting_id AND so.source_id = n1.source_id),
n3 AS (SELECT meeting_id, field, pos, at, unnest(ids) AS turn_id, unnest(range(0, len(ids))) AS k FROM n2 WHERE why IS NULL), n4 AS (SELECT meeting_id, field, pos, turn_id, min(at * 100 + k) AS f FROM n3 GROUP BY 1, 2, 3, 4),
n5 AS (SELECT meeting_id, field, pos, string_agg(turn_id, ',' ORDER BY f) AS turn_ids FROM n4 GROUP BY 1, 2, 3)"""


@query(f"WITH {EVIDENCE} SELECT * FROM n5")
def reduce_evidence(spark, d):
    good = validation.reduce_evidence(_outputs(spark, d), _sources(spark, d))[0]
    return good.select("meeting_id", "field", "pos", F.array_join("turn_ids", ",").alias("turn_ids"))


@query(f"WITH {EVIDENCE} SELECT meeting_id, field, pos, why AS \"check\", source_id FROM n2 WHERE why IS NOT NULL UNION ALL SELECT it.meeting_id, it.field, it.pos, 'no_evidence', NULL FROM it LEFT JOIN n5 USING (meeting_id, field, pos) WHERE turn_ids IS NULL")
def reduce_errors(spark, d):
    return validation.reduce_evidence(_outputs(spark, d), _sources(spark, d))[1]


@query("""WITH m AS (SELECT doc_id AS meeting_id, CASE WHEN doc_id % 4 = 0 THEN 'v9' ELSE 'meeting_minutes_v0' END AS v, CASE WHEN doc_id % 3 <> 0 THEN 't' END AS title, ['discussion', 'chat', NULL][doc_id % 3 + 1] AS kind, CASE WHEN doc_id % 5 <> 0 THEN 's' END AS summary, doc_id % 6 AS k FROM documents)
 SELECT meeting_id, 'schema_version' AS "check" FROM m WHERE v <> 'meeting_minutes_v0' UNION ALL SELECT meeting_id, 'title_missing' FROM m WHERE title IS NULL UNION ALL SELECT meeting_id, 'summary_missing' FROM m WHERE summary IS NULL
 UNION ALL SELECT meeting_id, 'meeting_type' FROM m WHERE coalesce(kind, '') NOT IN ('discussion', 'decision', 'planning', 'review', 'training', 'other') UNION ALL SELECT meeting_id, 'missing_key:warnings' FROM m WHERE k = 0 UNION ALL SELECT meeting_id, 'extra_key:notes' FROM m WHERE k = 1""")
def minutes_checks(spark, d):
    i = F.col("doc_id")
    keys = ("schema_version", "meeting_title", "meeting_type", "executive_summary", "participants", "topics", "decisions", "action_items", "risks", "open_questions")
    fields = F.array_compact(F.array(*[F.lit(k) for k in keys], F.when(i % 6 != 0, "warnings"), F.when(i % 6 == 1, "notes")))
    return validation.check_minutes(src.table(spark, d, "documents").select(i.alias("meeting_id"), F.when(i % 4 == 0, "v9").otherwise("meeting_minutes_v0").alias("schema_version"), F.when(i % 3 != 0, "t").alias("title"), src.pick(("discussion", "chat", None), "doc_id % 3").alias("kind"), F.when(i % 5 != 0, "s").alias("summary"), fields.alias("fields")))


@query(f"""WITH {SEG}, w AS (SELECT meeting_id, idx AS win, start_ms AS w0, end_ms AS w1 FROM s), o AS (SELECT *, CASE WHEN win % 4 = 3 THEN win + 1 ELSE win END AS said, CASE WHEN win % 3 = 1 THEN w1 + 2000 ELSE w0 END AS a, CASE WHEN win % 3 = 1 THEN w1 + 2500 WHEN win % 5 = 4 THEN w0 - 1 ELSE w1 END AS b FROM w) """
 + _violations("o", "meeting_id, win", ("window_id", "said <> win"), ("invalid_range", "b < a"), ("outside_window", "b >= a AND (b < w0 - 1000 OR a > w1 + 1000)")))
def window_checks(spark, d):
    w = src.segments(spark, d).select("meeting_id", F.col("idx").alias("win"), "start_ms", "end_ms")
    i = F.col("win")
    o = w.select("meeting_id", "win", F.when(i % 4 == 3, i + 1).otherwise(i).alias("said_win"), F.when(i % 3 == 1, F.col("end_ms") + 2000).otherwise(F.col("start_ms")).alias("start_ms"), F.when(i % 3 == 1, F.col("end_ms") + 2500).when(i % 5 == 4, F.col("start_ms") - 1).otherwise(F.col("end_ms")).alias("end_ms"))
    return validation.check_windows(o, w, 1000)


# ---- ranges, windows, packing

CORE = f"""{SEG}, ca AS (SELECT meeting_id, idx AS no, idx // 2 * 2 AS a, idx // 2 * 2 + (idx * 5 + meeting_id) % 6 - 1 AS b FROM s WHERE idx % 4 <> 3), c0 AS (SELECT *, greatest(a, b) AS e FROM ca),
c1 AS (SELECT meeting_id, a, max(e) AS e, count(*) AS merged FROM c0 GROUP BY 1, 2), c2 AS (SELECT *, least(e, coalesce(lead(a) OVER (PARTITION BY meeting_id ORDER BY a) - 1, e)) AS e2 FROM c1)"""


def _core(spark, d) -> DataFrame:
    i = F.col("idx")
    start = F.floor(i / 2) * 2
    return sequence.clip_ranges(src.segments(spark, d).where("idx % 4 <> 3").select("meeting_id", i.alias("no"), start.alias("start_idx"), (start + (i * 5 + F.col("meeting_id")) % 6 - 1).alias("end_idx")))


@query(f"WITH {CORE} SELECT meeting_id, a AS start_idx, e2 AS end_idx, merged FROM c2")
def core_ranges(spark, d):
    return _core(spark, d).select("meeting_id", "start_idx", "end_idx", "merged")


@query(f"""WITH {CORE}, en AS (SELECT meeting_id, max(idx) AS last FROM s GROUP BY 1), x AS (SELECT c2.*, last, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE a END AS fs, least(coalesce(lead(a) OVER w - 1, last), last) AS fe FROM c2 JOIN en USING (meeting_id) WINDOW w AS (PARTITION BY meeting_id ORDER BY a)),
 y AS (SELECT *, least(greatest(a, least(e2, last)), fe) AS ee FROM x WHERE fs <= fe) SELECT meeting_id, a AS start_idx, ee AS end_idx, fs AS full_start, fe AS full_end, fs <> a OR fe <> ee AS expanded FROM y""")
def full_ranges(spark, d):
    ends = src.segments(spark, d).groupBy("meeting_id").agg(F.max("idx").alias("last_idx"))
    return sequence.expand_ranges(_core(spark, d), ends).select("meeting_id", "start_idx", "end_idx", "full_start", "full_end", "expanded")


def _units(spark, d) -> DataFrame:
    return packing.units(src.turns(spark, d), 400)


@query()
def window_units(spark, d):
    return _units(spark, d)


@query()
def window_plan(spark, d):
    return packing.plan_windows(_units(spark, d), 900, 4, 1)


@query(f"""WITH {SEG}, w AS (SELECT meeting_id, idx + 1 AS win, idx * 3 AS a, idx * 3 + idx % 4 AS b, length(text) AS chars FROM s), q AS (SELECT *, chars > 60 AND b > a AS sp, max(win) OVER (PARTITION BY meeting_id) AS last FROM w),
 k AS (SELECT *, CAST(last + 2 * sum(CAST(sp AS INT)) OVER (PARTITION BY meeting_id ORDER BY win) - 1 AS BIGINT) AS nx, a + (b - a + 1) // 2 AS mid FROM q)
 SELECT meeting_id, win, NULL::BIGINT AS parent, a AS first_no, b AS last_no, NOT sp AS active FROM k UNION ALL SELECT meeting_id, nx, win, a, mid - 1, true FROM k WHERE sp UNION ALL SELECT meeting_id, nx + 1, win, mid, b, true FROM k WHERE sp""")
def split_windows(spark, d):
    i = F.col("idx")
    return packing.split_windows(src.segments(spark, d).select("meeting_id", (i + 1).alias("win"), (i * 3).alias("first_no"), (i * 3 + i % 4).alias("last_no"), F.length("text").alias("chars")), 60)


@query(f"""WITH {SEG}, t AS (SELECT *, sum(length(text)) OVER (PARTITION BY meeting_id, speaker ORDER BY idx) - length(text) AS before FROM s), u AS (SELECT *, CAST(least(length(text), 150 - before) AS BIGINT) AS kept FROM t)
 SELECT meeting_id, speaker, idx, kept, substring(text, 1, kept) AS text FROM u WHERE kept > 0""")
def truncated_documents(spark, d):
    return packing.truncate_documents(src.segments(spark, d), 150, ["meeting_id", "speaker"]).select("meeting_id", "speaker", "idx", "kept", "text")


@query()
def consecutive_groups(spark, d):
    return packing.consecutive_groups(src.segments(spark, d).select("meeting_id", "idx", F.length("text").cast("long").alias("cost")), 500)


@query(f"""WITH {SEG}, n AS (SELECT *, CASE WHEN idx % 4 = 2 THEN NULL ELSE end_ms END AS e FROM s WHERE text <> ''), c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS ch FROM n WINDOW w AS (PARTITION BY meeting_id ORDER BY idx)),
 v AS (SELECT *, sum(ch) OVER (PARTITION BY meeting_id ORDER BY idx) AS vo FROM c), x AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY meeting_id, vo ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v),
 y AS (SELECT *, CAST(sum(CASE WHEN ch = 1 OR coalesce(start_ms - pe > 1000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY idx) AS BIGINT) AS turn_no FROM x)
 SELECT meeting_id, turn_no, min(speaker) AS speaker, arg_min(start_ms, idx) AS start_ms, arg_max(e, idx) FILTER (WHERE e IS NOT NULL) AS end_ms, count(*) AS n FROM y GROUP BY 1, 2""")
def loose_turns(spark, d):
    s = src.segments(spark, d)
    return sequence.loose_turns(s.withColumn("end_ms", F.when(F.col("idx") % 4 != 2, F.col("end_ms"))), 1000)


# ---- result tables

CHAPTER_TIMES = f"{SEG}, ch AS (SELECT meeting_id, idx // 3 AS no, min(start_ms) AS a, max(end_ms) AS b FROM s WHERE idx % 3 < 2 GROUP BY 1, 2)"


@query(f"WITH {CHAPTER_TIMES} SELECT s.meeting_id, s.idx, min(no) AS chapter FROM s LEFT JOIN ch ON ch.meeting_id = s.meeting_id AND s.start_ms < b AND s.end_ms > a AND s.end_ms > s.start_ms GROUP BY 1, 2")
def chapter_by_time(spark, d):
    """The first chapter that overlaps each segment in time."""
    from chronoloom.operators.intervals import overlap_join

    s = src.segments(spark, d)
    c = s.where("idx % 3 < 2").groupBy("meeting_id", F.floor(F.col("idx") / 3).alias("no")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    hit = overlap_join(s.select("meeting_id", "idx", "start_ms", "end_ms"), c, ["meeting_id"], 60_000).groupBy("meeting_id", F.col("a_idx").alias("idx")).agg(F.min("b_no").alias("chapter"))
    return s.select("meeting_id", "idx").join(hit, ["meeting_id", "idx"], "left")


@query(f"""WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS sentence FROM s WHERE text <> ''), r AS (SELECT meeting_id, idx AS owner, unnest([idx, idx + 2]) AS ref FROM s),
 j AS (SELECT r.meeting_id, r.owner, n.sentence, n.start_ms, n.end_ms, n.idx FROM r JOIN n ON n.meeting_id = r.meeting_id AND n.idx = r.ref) SELECT meeting_id, owner, arg_min(sentence, start_ms * 1000 + idx) AS sentence, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM j GROUP BY 1, 2""")
def evidence_ranges(spark, d):
    s = src.segments(spark, d)
    said = s.where("text <> ''").withColumn("sentence", F.row_number().over(Window.partitionBy("meeting_id").orderBy("idx")).cast("long"))
    refs = s.select("meeting_id", F.col("idx").alias("owner"), F.explode(F.array(F.col("idx"), F.col("idx") + 2)).alias("idx"))
    return refs.join(said, ["meeting_id", "idx"]).groupBy("meeting_id", "owner").agg(F.min_by("sentence", F.struct("start_ms", "idx")).alias("sentence"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("""WITH m AS (SELECT doc_id AS meeting_id, unnest(['decision-1', 'action-1', 'chapter-1']) AS item, unnest([doc_id % 3, doc_id % 4, doc_id % 2]) AS k FROM documents), s AS (SELECT *, ['pending', 'reviewed', 'edited', 'strange'][k + 1] AS st FROM m)
 SELECT meeting_id, count(*) FILTER (WHERE st NOT IN ('reviewed', 'edited')) AS pending, count(*) FILTER (WHERE st IN ('reviewed', 'edited')) AS reviewed, string_agg(item || '=' || CASE WHEN st IN ('reviewed', 'edited') THEN st ELSE 'pending' END, ',' ORDER BY item) AS marks FROM s GROUP BY 1""")
def review_summary(spark, d):
    states = ("pending", "reviewed", "edited", "strange")
    rows = src.table(spark, d, "documents").select(F.col("doc_id").alias("meeting_id"), *[src.pick(states, f"doc_id % {k}").alias(n) for n, k in (("decision-1", 3), ("action-1", 4), ("chapter-1", 2))])
    mark = lambda c: F.when(F.col(c).isin("pending", "reviewed", "edited"), F.col(c)).otherwise("pending")
    marks = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns[1:]]), F.array(*[mark(f"`{c}`") for c in rows.columns[1:]]))
    values = F.map_values("marks")
    pending = F.size(F.filter(values, lambda x: x == "pending")).cast("long")
    told = F.array_join(F.array_sort(F.transform(F.map_entries("marks"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rows.select("meeting_id", marks.alias("marks")).select("meeting_id", pending.alias("pending"), (F.size(values) - pending).alias("reviewed"), told.alias("marks"))


@query(f"""WITH {LIB}, {FILES}, au AS (SELECT meeting_id, arg_min(size, path) AS fs FROM fi WHERE starts_with(path, 'source.') AND regexp_matches(name, '\\.(wav|mp3|m4a|flac|aac|ogg)$') GROUP BY 1)
 SELECT lf.meeting_id, title, state, CASE WHEN audio_state = 'deleted' THEN 'deleted' WHEN fs IS NOT NULL THEN 'available' ELSE coalesce(audio_state, 'pending') END AS audio_state, coalesce(fs, size) AS audio_size,
 state = 'finalized' AND coalesce(audio_state <> 'deleted', true) AND (fs IS NOT NULL OR coalesce(audio_state = 'available', false)) AND lf.meeting_id % 11 <> 0 AS deletable FROM lf LEFT JOIN au USING (meeting_id)""")
def storage_items(spark, d):
    rows = src.library(spark, d)
    return lib.storage_items(rows, src.stored_files(spark, d), rows.where("meeting_id % 11 = 0"))


@query(f"""WITH {LIB}, n AS (SELECT meeting_id, CASE WHEN meeting_id % 5 = 0 THEN 'gone' ELSE 'finalized' END AS ns FROM lf WHERE meeting_id % 2 = 0 AND NOT meeting_id % 6 = 0)
 SELECT lf.meeting_id, coalesce(CASE WHEN ns = 'finalized' THEN ns END, state) AS state, 1 + CAST(coalesce(ns = 'finalized', false) AS BIGINT) AS seq FROM lf LEFT JOIN n USING (meeting_id)""")
def record_updates(spark, d):
    rows = src.library(spark, d).withColumn("seq", F.lit(1).cast("long"))
    i = F.col("meeting_id")
    new = rows.where("meeting_id % 2 = 0").select("meeting_id", F.when(i % 5 == 0, "gone").otherwise("finalized").alias("new_state"))
    new = new.union(new.where("meeting_id % 6 = 0")).union(new.where("meeting_id % 10 = 2").select((-i - 1).alias("meeting_id"), "new_state"))
    return lib.upsert_records(rows, new, src.STATES)[0].select("meeting_id", "state", "seq")


@query(f"""WITH {LIB} SELECT meeting_id, CASE WHEN meeting_id % 7 = 0 THEN 'not_found' WHEN meeting_id % 3 = 0 THEN 'base_conflict' WHEN meeting_id % 4 = 0 THEN 'draft_conflict' ELSE 'saved' END AS verdict,
 CASE WHEN meeting_id % 7 = 0 THEN NULL WHEN meeting_id % 3 = 0 OR meeting_id % 4 = 0 THEN meeting_id % 5 ELSE meeting_id % 5 + 1 END AS revision FROM lf""")
def draft_saves(spark, d):
    i, rows = F.col("meeting_id"), src.library(spark, d)
    drafts = rows.where("meeting_id % 7 <> 0").select("meeting_id", (i % 5).alias("revision"), F.lit(1).alias("base"))
    asked = rows.select("meeting_id", F.when(i % 4 == 0, -1).otherwise(i % 5).alias("expected_revision"), F.when(i % 3 == 0, 2).otherwise(1).alias("expected_base"))
    return lib.save_drafts(drafts, asked)


# ---- runs

EVENTS = """ev AS (SELECT user_id AS run, event_id AS id, ts, epoch_us(ts) // 1000 AS ts_ms, ['stage_started', 'stage_succeeded', 'stage_started', 'stage_failed', 'stage_skipped', 'note'][event_id % 6 + 1] AS event, ['asr', 'llm', 'export'][event_id // 6 % 3 + 1] AS stage FROM events),
ne AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, id) AS seq FROM ev),
st AS (SELECT *, CASE event WHEN 'stage_started' THEN 'running' WHEN 'stage_succeeded' THEN 'done' WHEN 'stage_failed' THEN 'failed' ELSE 'skipped' END AS state FROM ne WHERE event <> 'note'),
tk AS (SELECT *, CASE WHEN state IN ('done', 'failed') AND lag(state) OVER w = 'running' THEN ts_ms - lag(ts_ms) OVER w END AS took FROM st WINDOW w AS (PARTITION BY run, stage ORDER BY seq)),
ss AS (SELECT run, stage, arg_max(state, seq) AS state, count(*) FILTER (WHERE state = 'running') AS attempts, CAST(coalesce(sum(took), 0) AS BIGINT) AS elapsed_ms FROM tk GROUP BY 1, 2)"""


def _events(spark, d) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return runs.number_events(src.table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("id"), "ts", ms.alias("ts_ms"), src.pick(("stage_started", "stage_succeeded", "stage_started", "stage_failed", "stage_skipped", "note"), "event_id % 6").alias("event"),
        src.pick(("asr", "llm", "export"), "floor(event_id / 6) % 3").alias("stage"),
    ))


@query(f"WITH {EVENTS} SELECT run, id, seq FROM ne")
def event_log(spark, d):
    return _events(spark, d).select("run", "id", "seq")


@query(f"WITH {EVENTS} SELECT * FROM ss")
def stage_states(spark, d):
    return runs.stage_states(_events(spark, d))


@query(f"""WITH {EVENTS} SELECT run, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'skipped') AS skipped, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms,
 min(stage) FILTER (WHERE state IN ('running', 'failed')) AS first_open FROM ss GROUP BY 1""")
def run_metrics(spark, d):
    return runs.run_metrics(runs.stage_states(_events(spark, d)))


@query("""WITH q AS (SELECT user_id AS task, event_id AS at, ['created', 'queued', 'running', 'finishing', 'done', 'failed', 'odd'][CASE WHEN event_id % 31 = 0 THEN 5 WHEN event_id % 37 = 0 THEN 6 WHEN event_id % 13 = 0 THEN 7 ELSE event_id % 4 + 1 END] AS state FROM events),
 r AS (SELECT *, coalesce(list_position(['created', 'queued', 'running', 'finishing', 'done', 'failed'], state), 0) AS rank FROM q),
 b AS (SELECT *, coalesce(max(CASE WHEN state IN ('done', 'failed') THEN 1 END) OVER w, 0) = 1 AS ended, coalesce(max(CASE WHEN state <> 'failed' THEN rank END) OVER w, 0) AS far FROM r WINDOW w AS (PARTITION BY task ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT task, at, state, NOT ended AND rank > 0 AND (state = 'failed' OR rank > far) AS accepted FROM b""")
def task_states(spark, d):
    i = F.col("event_id")
    state = F.when(i % 31 == 0, "done").when(i % 37 == 0, "failed").when(i % 13 == 0, "odd").otherwise(src.pick(runs.TASK_STATES, "event_id % 4"))
    return runs.advance_tasks(src.table(spark, d, "events").select(F.col("user_id").alias("task"), i.alias("at"), state.alias("state")))


@query(f"""WITH {SEG}, q AS (SELECT meeting_id, idx, sha256(concat_ws(chr(31), meeting_id, idx, text)) AS fp FROM s), c AS (SELECT fp, CASE WHEN idx % 5 = 1 THEN 'failed' ELSE 'ok' END AS st, idx AS a, CASE WHEN idx % 7 = 2 THEN NULL ELSE idx END AS b FROM q WHERE idx % 3 <> 0)
 SELECT meeting_id * 1000 + idx AS request, CASE WHEN st IS NULL THEN 'miss' WHEN st <> 'ok' THEN 'not_ok' WHEN a IS DISTINCT FROM b THEN 'changed_artifact' ELSE 'hit' END AS verdict FROM q LEFT JOIN c USING (fp)""")
def reuse_decisions(spark, d):
    i = F.col("idx")
    q = src.segments(spark, d).select("meeting_id", "idx", runs.fingerprint(F.col("meeting_id"), i, F.col("text")).alias("fingerprint"))
    cache = q.where("idx % 3 <> 0").select("fingerprint", F.when(i % 5 == 1, "failed").otherwise("ok").alias("status"), i.alias("artifact_hash"), F.when(i % 7 != 2, i).alias("actual_hash"))
    return runs.reuse(q.select((F.col("meeting_id") * 1000 + i).alias("request"), "fingerprint"), cache)


@query(f"""WITH {LIB}, a AS (SELECT * FROM lf WHERE meeting_id % 10 <> 0), b AS (SELECT meeting_id, CASE WHEN meeting_id % 4 = 0 THEN 'x' ELSE state END AS state, CASE WHEN meeting_id % 3 = 0 THEN NULL ELSE audio_state END AS audio_state, size FROM lf WHERE meeting_id % 11 <> 0),
 j AS (SELECT coalesce(a.meeting_id, b.meeting_id) AS meeting_id, CASE WHEN a.meeting_id IS NULL THEN 'only_now' WHEN b.meeting_id IS NULL THEN 'only_before' ELSE array_to_string(list_filter([CASE WHEN a.state IS DISTINCT FROM b.state THEN 'state' END, CASE WHEN a.audio_state IS DISTINCT FROM b.audio_state THEN 'audio_state' END], lambda x: x IS NOT NULL), ',') END AS changed FROM a FULL JOIN b ON a.meeting_id = b.meeting_id)
 SELECT * FROM j WHERE changed <> ''""")
def snapshot_changes(spark, d):
    i, rows = F.col("meeting_id"), src.library(spark, d)
    now = rows.where("meeting_id % 11 <> 0").withColumns({"state": F.when(i % 4 == 0, "x").otherwise(F.col("state")), "audio_state": F.when(i % 3 != 0, F.col("audio_state"))})
    return runs.changed_keys(rows.where("meeting_id % 10 <> 0"), now, "meeting_id", ["state", "audio_state", "size"])


@query("SELECT l_shipmode AS kind, count(l_suppkey) AS n, CAST(min(l_suppkey) AS BIGINT) AS least, round(avg(l_suppkey), 1) AS mean, CAST(max(l_suppkey) AS BIGINT) AS most FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem) GROUP BY 1")
def request_stats(spark, d):
    rows = src.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_suppkey")).cast("long").alias("v"))
    return metrics.value_stats(rows, ["kind"], "v")


@query(f"""WITH {SEG}, p AS (SELECT meeting_id, idx, 'Window ' || idx || ' from ' || start_ms || ': ' || text AS prompt FROM s) SELECT meeting_id, idx, sha256(prompt) AS sha256, CAST(ceil((length(prompt) + 20) / 1.3::DOUBLE) AS BIGINT) AS tokens, ceil((length(prompt) + 20) / 1.3::DOUBLE) <= 100 AS fits FROM p""")
def window_prompts(spark, d):
    prompt = runs.fill("Window {id} from {start}: {text}", id=F.col("idx").cast("string"), start=F.col("start_ms").cast("string"), text=F.col("text"))
    rows = src.segments(spark, d).select("meeting_id", "idx", prompt.alias("prompt"))
    tokens = F.ceil((F.length("prompt") + 20) / F.lit(1.3)).cast("long")
    return rows.select("meeting_id", "idx", F.sha2(F.col("prompt").cast("binary"), 256).alias("sha256"), tokens.alias("tokens"), (tokens <= 100).alias("fits"))


@query("""WITH t AS (SELECT item_id, length(text) AS n, CAST(item_id % 40 * 60 AS DOUBLE) AS dur, CAST(item_id % 7 AS DOUBLE) AS took, item_id % 3 * 200 AS ref FROM benchmark)
 SELECT item_id, CASE WHEN dur > 0 THEN round(took / dur, 6) END AS rtf, CASE WHEN ref > 0 THEN round(n / ref, 6) END AS ratio, array_to_string(list_filter([CASE WHEN dur >= 600 AND n < 1500 THEN 'long_audio_short_transcript' END, CASE WHEN ref > 0 AND round(n / ref, 6) < 0.5 THEN 'transcript_much_shorter_than_reference' END,
 CASE WHEN dur >= 600 AND round(took / dur, 6) < 0.03 THEN 'very_low_rtf_for_long_audio' END], lambda x: x IS NOT NULL), ',') AS reasons FROM t""")
def completeness_flags(spark, d):
    i = F.col("item_id")
    t = src.table(spark, d, "benchmark").select("item_id", F.length("text").alias("n"), (i % 40 * 60).cast("double").alias("dur"), (i % 7).cast("double").alias("took"), (i % 3 * 200).alias("ref"))
    t = t.withColumns({"rtf": F.round(F.try_divide("took", "dur"), 6), "ratio": F.round(F.try_divide("n", "ref"), 6)})
    why = F.array_compact(F.array(F.when((F.col("dur") >= 600) & (F.col("n") < 1500), "long_audio_short_transcript"), F.when(F.col("ratio") < 0.5, "transcript_much_shorter_than_reference"), F.when((F.col("dur") >= 600) & (F.col("rtf") < 0.03), "very_low_rtf_for_long_audio")))
    return t.select("item_id", "rtf", "ratio", F.array_join(why, ",").alias("reasons"))


# ---- model text

WRITTEN = "CASE item_id % 4 WHEN 0 THEN '<think>why not</think>' || chr(10) || '{\"a\": ' || item_id || '}' WHEN 1 THEN 'so {\"a\": ' || item_id || '} it is seg-000001, seg-000002, seg-000001' WHEN 2 THEN 'a thought</think> {\"a\": 5}' ELSE '<think>open, input truncated' END"


def _written(spark, d) -> DataFrame:
    i = F.col("item_id")
    n = i.cast("string")
    said = F.when(i % 4 == 0, F.concat(F.lit('<think>why not</think>\n{"a": '), n, F.lit("}"))).when(i % 4 == 1, F.concat(F.lit('so {"a": '), n, F.lit("} it is seg-000001, seg-000002, seg-000001"))).when(i % 4 == 2, 'a thought</think> {"a": 5}').otherwise("<think>open, input truncated")
    return src.table(spark, d, "benchmark").select("item_id", said.alias("t"))


@query(f"""WITH t AS (SELECT item_id, {WRITTEN} AS t FROM benchmark) SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'why not' WHEN 2 THEN 'a thought' ELSE '' END AS thoughts, CASE item_id % 4 WHEN 0 THEN '{{"a": ' || item_id || '}}' WHEN 2 THEN '{{"a": 5}}' ELSE t END AS said, item_id % 4 = 3 AS open,
 nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') AS widest, CASE item_id % 4 WHEN 2 THEN 5 WHEN 3 THEN NULL ELSE item_id END AS a, contains(t, 'input truncated') AS cut, CASE WHEN item_id % 4 = 1 THEN 'seg-000001,seg-000002' ELSE '' END AS refs FROM t""")
def model_texts(spark, d):
    t = F.col("t")
    return _written(spark, d).select(
        "item_id", mt.thoughts(t).alias("thoughts"), mt.without_thoughts(t).alias("said"), mt.unclosed_thoughts(t).alias("open"), mt.widest_object(t).alias("widest"), mt.parsed(mt.first_object(mt.ascii_marks(mt.without_thoughts(t))), "a long")["a"].alias("a"),
        mt.reports_truncation(t).alias("cut"), F.array_join(mt.refs_in(t), ",").alias("refs"),
    )


@query("""SELECT item_id, CASE WHEN item_id = 12 THEN '12,[turn x]' ELSE item_id || ',12,[turn x]' END AS turns, 'v1-chapter-3,odd' AS sources, 'a b,c' AS bullets FROM benchmark""")
def id_lists(spark, d):
    n = F.col("item_id").cast("string")
    return src.table(spark, d, "benchmark").select(
        "item_id", F.array_join(mt.turn_numbers(F.array(n, F.lit("[turn 0012]"), F.lit("Turn:12"), F.lit("[turn x]"))), ",").alias("turns"), F.array_join(mt.source_ids(F.array(F.lit("V01-chapter03"), F.lit("v1-chapter-3"), F.lit("odd"))), ",").alias("sources"),
        F.array_join(mt.bullet_list(F.array(F.lit(" a  b "), F.lit("none"), F.lit("a b"), F.lit("c"), F.lit("d")), 2), ",").alias("bullets"),
    )


# ---- nested recognition results

@query(f"""WITH {SEG}, k AS (SELECT meeting_id, idx, 'S' || (idx % 3) AS src, start_ms, end_ms, trim(text) AS text FROM s WHERE trim(text) <> ''), f AS (SELECT meeting_id, src, min(idx) AS f FROM k GROUP BY 1, 2), n AS (SELECT meeting_id, src, row_number() OVER (PARTITION BY meeting_id ORDER BY f) AS no FROM f)
 SELECT k.meeting_id, idx, 'speaker_' || no AS speaker, round(start_ms / 1000.0::DOUBLE, 3) AS start_s, round(end_ms / 1000.0::DOUBLE, 3) AS end_s, text FROM k JOIN n USING (meeting_id, src)""")
def sentence_rows(spark, d):
    """Nested results flattened: the first key that has a value, speakers numbered as they are first heard, blank sentences left out."""
    i = F.col("idx")
    one = F.struct(i.alias("idx"), F.when(i % 2 == 0, F.col("text")).alias("text"), F.when(i % 2 == 1, F.col("text")).alias("sentence"), F.when(i % 3 == 0, F.lit("S0")).alias("spk"), F.when(i % 3 != 0, F.concat(F.lit(" S"), (i % 3).cast("string"))).alias("speaker"), F.col("start_ms").cast("string").alias("start"), F.when(i % 2 == 0, F.col("end_ms")).alias("end"), F.when(i % 2 == 1, F.col("end_ms")).alias("end_time"))
    nested = src.segments(spark, d).groupBy("meeting_id").agg(F.collect_list(one).alias("sentence_info"))
    rows = nested.select("meeting_id", F.explode_outer("sentence_info").alias("x")).select(
        "meeting_id", "x.idx", F.trim(F.coalesce("x.text", "x.sentence", F.lit(""))).alias("text"), F.nullif(F.trim(F.coalesce("x.spk", "x.speaker")), F.lit("")).alias("src"), sc.seconds_of(F.col("x.start")).alias("start_s"), sc.seconds_of(F.coalesce("x.end", "x.end_time").cast("string")).alias("end_s"),
    ).where("text <> ''")
    number = sequence.first_seen(rows.withColumnRenamed("src", "speaker")).select("meeting_id", F.col("speaker").alias("src"), "number")
    return rows.join(number, ["meeting_id", "src"]).select("meeting_id", "idx", F.concat(F.lit("speaker_"), (F.col("number") + 1).cast("string")).alias("speaker"), "start_s", "end_s", "text")
