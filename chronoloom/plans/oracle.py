"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

SEG = """seg0 AS (SELECT conv_id AS meeting_id, CAST(turn AS BIGINT) AS idx, coalesce(text, '') AS text,
 CASE role WHEN 'user' THEN 'speaker_0' WHEN 'assistant' THEN 'speaker_1' ELSE 'unknown' END AS speaker,
 CAST(length(coalesce(text, '')) * 60 AS BIGINT) AS dur, CAST(((conv_id * 7 + turn * 13) % 5) * 700 AS BIGINT) AS gap FROM conversations),
seg1 AS (SELECT *, CAST(sum(gap + dur) OVER (PARTITION BY meeting_id ORDER BY idx) AS BIGINT) AS end_ms FROM seg0),
s AS (SELECT meeting_id, idx, 'seg-' || lpad(CAST(idx AS VARCHAR), 6, '0') AS segment_id, text, speaker, end_ms - dur AS start_ms, end_ms FROM seg1)"""


def _iv(scale: int, name: str = "i") -> str:
    return f"""{name} AS (SELECT user_id AS key, event_id AS id, event_type AS label, epoch_us(ts) // 1000 AS start_ms,
 epoch_us(ts) // 1000 + CAST(round_even(value * 100, 0) AS BIGINT) * {scale} AS end_ms FROM events)"""


REF = "r AS (SELECT key, id, label, start_ms + id % 7 * 60000 AS start_ms, end_ms + id % 7 * 60000 AS end_ms FROM i)"


def _islands(source: str, keys: str, gap: int = 0, name: str = "isl") -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}1 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM {name}0),
{name} AS (SELECT {keys}, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM {name}1 GROUP BY {keys}, island)"""


def _gaps(least: int) -> str:
    return f"""{_islands('i', 'key')}, gp0 AS (SELECT key, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY key ORDER BY start_ms) AS end_ms FROM isl),
gp AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY start_ms) AS gap_no, start_ms, end_ms FROM gp0 WHERE end_ms - start_ms >= {least})"""


PAIRS = """p AS (SELECT i.key, i.id, i.label, r.label AS ref_label, least(i.end_ms, r.end_ms) - greatest(i.start_ms, r.start_ms) AS ms
 FROM i JOIN r ON i.key = r.key AND i.start_ms < r.end_ms AND r.start_ms < i.end_ms WHERE i.end_ms > i.start_ms AND r.end_ms > r.start_ms)"""
REFS = """refs AS (SELECT meeting_id, idx AS owner, unnest([idx, idx + 2, idx, 999999]) AS n, unnest([0, 1, 2, 3]) AS pos FROM s),
rf AS (SELECT meeting_id, owner, pos, 'seg-' || lpad(CAST(n AS VARCHAR), 6, '0') AS ref FROM refs),
rv AS (SELECT rf.*, s.start_ms, s.end_ms, s.speaker, CASE WHEN s.text IS NULL THEN 'missing' WHEN trim(s.text) = '' THEN 'empty_text'
 WHEN row_number() OVER (PARTITION BY rf.meeting_id, owner, ref ORDER BY pos) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict
 FROM rf LEFT JOIN s ON s.meeting_id = rf.meeting_id AND s.segment_id = rf.ref)"""
CHAPTERS = """ch AS (SELECT meeting_id, idx // 3 AS idx, idx AS start_idx FROM s WHERE idx % 3 = 1),
en AS (SELECT meeting_id, max(idx) AS last_idx FROM s GROUP BY 1),
cr0 AS (SELECT ch.meeting_id, idx, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE start_idx END AS start_idx, coalesce(lead(start_idx) OVER w - 1, last_idx) AS end_idx
 FROM ch JOIN en ON ch.meeting_id = en.meeting_id WINDOW w AS (PARTITION BY ch.meeting_id ORDER BY start_idx, idx)),
cr AS (SELECT * FROM cr0 WHERE end_idx >= start_idx)"""
RES = "res AS (SELECT l_orderkey AS job_id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status, l_suppkey AS text_chars FROM lineitem WHERE l_orderkey % 3 <> 0)"
LATEST = f"{RES}, lt AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY line DESC, status DESC, text_chars DESC) = 1)"
LIB = """lb AS (SELECT doc_id AS meeting_id, concat_ws(' ', lang, source, doc_id) AS title,
 ['created', 'recording', 'uploading', 'processing', 'review_ready', 'finalizing', 'finalized', 'failed', 'cancelled'][doc_id % 9 + 1] AS state, ['available', 'deleted', NULL][doc_id // 9 % 3 + 1] AS audio_state,
 CAST(n_chars AS BIGINT) AS size, doc_id * 7919 % 100003 AS created_at, doc_id * 104729 % 100003 AS updated_at FROM documents),
lf AS (SELECT *, CASE WHEN state = 'failed' THEN 'failed' WHEN state IN ('created', 'recording', 'uploading', 'processing', 'finalizing') THEN 'processing' WHEN state = 'review_ready' THEN 'review'
 WHEN state = 'finalized' AND audio_state = 'deleted' THEN 'deleted' WHEN state = 'finalized' THEN 'confirmed' ELSE 'all' END AS facet FROM lb)"""
FILES = """f0 AS (SELECT doc_id AS meeting_id, ['exports/formal_minutes.html', 'source.wav', 'upload.part', 'result.json', 'processing.wav', 'notes.txt', 'source.MP3', 'a/Exports/x.bin'][doc_id % 8 + 1] AS path, CAST(n_chars AS BIGINT) AS size FROM documents),
fi AS (SELECT *, string_split(lower(path), '/')[-1] AS name FROM f0)"""
POINTS = "pt AS (SELECT meeting_id, start_ms + idx * 1000 - 1500 AS at_ms, idx AS point FROM s)"


def _grams(column: str) -> str:
    t = f"regexp_replace({column}, '[\\s\\p{{Z}}]+', '', 'g')"
    return f"CASE WHEN length({t}) > 0 THEN list_transform(range(1, CAST(greatest(length({t}) - 1, 1) + 1 AS BIGINT)), lambda k: substring({t}, k, 2)) ELSE [] END"


def _jaccard(a: str, b: str) -> str:
    a, b = f"list_distinct({a})", f"list_distinct({b})"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


# a position's bigrams of the windows before and from it, counted per side
COHESION = r"""ne AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS ct FROM s WHERE trim(text) <> ''),
wi AS (SELECT *, array_to_string(list(ct) OVER b, '') AS tb, array_to_string(list(ct) OVER a, '') AS ta,
 CASE WHEN sum(length(text)) OVER b >= 12 AND sum(length(text)) OVER a >= 12 THEN 1 END AS told FROM ne
 WINDOW b AS (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
gr AS (SELECT meeting_id, idx, x, substring(t, i, 2) AS g FROM (SELECT meeting_id, idx, 1 AS x, tb AS t, unnest(range(1, greatest(length(tb), 2))) AS i FROM wi WHERE told = 1
 UNION ALL SELECT meeting_id, idx, 0, ta, unnest(range(1, greatest(length(ta), 2))) FROM wi WHERE told = 1)),
gn AS (SELECT meeting_id, idx, g, sum(x) AS x, count(*) - sum(x) AS y FROM gr GROUP BY 1, 2, 3),
gc AS (SELECT meeting_id, idx, CASE WHEN sum(x * x) * sum(y * y) > 0 THEN sum(x * y) / (sqrt(CAST(sum(x * x) AS DOUBLE)) * sqrt(CAST(sum(y * y) AS DOUBLE))) ELSE 0 END AS cs FROM gn GROUP BY 1, 2),
co AS (SELECT wi.*, CASE WHEN told = 1 THEN coalesce(cs, 0.0) END AS cohesion FROM wi LEFT JOIN gc USING (meeting_id, idx)),
va AS (SELECT *, last_value(cohesion IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc, first_value(cohesion IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rc,
 coalesce(max(cohesion) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), cohesion) AS lp, coalesce(max(cohesion) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), cohesion) AS rp,
 lag(speaker) OVER w AS ps, lag(end_ms) OVER w AS pe, row_number() OVER w AS rn FROM co WINDOW w AS (PARTITION BY meeting_id ORDER BY idx)),
bo AS (SELECT *, CASE WHEN cohesion IS NULL OR lc < cohesion OR rc < cohesion THEN 0.0 ELSE greatest(0.0, lp - cohesion) + greatest(0.0, rp - cohesion) END AS depth FROM va),
bs AS (SELECT *, coalesce(start_ms - pe >= 1500, false) AS g, coalesce(ps <> speaker AND ps <> 'unknown' AND speaker <> 'unknown', false) AS c, rn > 1 AND depth >= 0.30 AS l FROM bo),
bt AS (SELECT *, CAST(g AS INT) * 1.0::DOUBLE + CAST(c AS INT) * 0.25::DOUBLE + CAST(l AS INT) * 1.0::DOUBLE AS score,
 array_to_string(list_filter([CASE WHEN g THEN 'gap' END, CASE WHEN c THEN 'speaker' END, CASE WHEN l THEN 'cohesion' END], lambda x: x IS NOT NULL), ',') AS reasons FROM bs),
k0 AS (SELECT *, sum(CASE WHEN rn = 1 OR score >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY idx) AS cut FROM bt),
k1 AS (SELECT meeting_id, cut, sum(length(text)) AS chars, arg_min(reasons, idx) AS opened FROM k0 GROUP BY 1, 2),
k2 AS (SELECT *, sum(CASE WHEN chars >= 400 OR cut = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY cut) AS grp FROM k1),
k3 AS (SELECT *, greatest(grp - CASE WHEN sum(CASE WHEN grp = 1 THEN chars ELSE 0 END) OVER (PARTITION BY meeting_id) < 400 THEN 1 ELSE 0 END, 1) AS block FROM k2),
k4 AS (SELECT *, CASE WHEN block = 1 THEN 'start' ELSE first_value(opened) OVER (PARTITION BY meeting_id, block ORDER BY cut) END AS opened_by FROM k3),
bl AS (SELECT k0.meeting_id, CAST(block AS BIGINT) AS block, min(idx) AS first_idx, max(idx) AS last_idx, arg_min(start_ms, idx) AS start_ms, arg_max(end_ms, idx) AS end_ms, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers,
 CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n, min(opened_by) AS opened_by FROM k0 JOIN k4 USING (meeting_id, cut) GROUP BY 1, 2)"""
ITEMS = "b AS (SELECT x.item_id, x.text AS a, y.text AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)"
BINS = [0, 1, 2, 5, 10, 20, 30, None]


def _bin(lo: int, hi: int | None) -> str:
    return f"count(*) FILTER (WHERE d >= {lo}" + (f" AND d < {hi})" if hi else ")")


SQL = {
    "interval_islands": f"WITH {_iv(600)}, {_islands('i', 'key')} SELECT * FROM isl",
    "merge_same_label": f"WITH {_iv(6000)}, {_islands('i', 'key, label', 60000)} SELECT * FROM isl",
    "coverage_gaps": f"WITH {_iv(600)}, {_gaps(1000)} SELECT * FROM gp",
    "pad_and_split": f"""WITH {_iv(600)}, w AS (SELECT key, id, greatest(1704067200000, start_ms - 500) AS a, least(1706745600000, end_ms + 500) AS b FROM i),
 v AS (SELECT *, unnest(range(0, greatest((b - a + 599999) // 600000, 1))) AS piece FROM w WHERE b > a)
 SELECT key, id, CAST(piece AS INT) AS piece, a + piece * 600000 AS start_ms, least(b, a + piece * 600000 + 600000) AS end_ms FROM v""",
    "overlap_matrix": f"WITH {_iv(6000)}, {REF}, {PAIRS} SELECT label, ref_label, CAST(sum(ms) AS BIGINT) AS overlap_ms FROM p GROUP BY 1, 2",
    "interval_coverage": f"""WITH {_iv(6000)}, {REF}, {_islands('r', 'key')},
 c AS (SELECT i.key, i.id, CAST(sum(least(i.end_ms, isl.end_ms) - greatest(i.start_ms, isl.start_ms)) AS BIGINT) AS ms FROM i JOIN isl ON i.key = isl.key AND i.start_ms < isl.end_ms AND isl.start_ms < i.end_ms GROUP BY 1, 2)
 SELECT i.*, coalesce(ms, 0) AS covered_ms FROM i LEFT JOIN c ON c.key = i.key AND c.id = i.id""",
    "overlapping_groups": f"WITH {SEG}, g AS (SELECT *, unnest(['all', CASE WHEN speaker = 'unknown' THEN 'unknown' ELSE 'known' END, 'label:' || speaker]) AS grp FROM s) SELECT grp, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM g GROUP BY 1",
    "canonical_transcript": f"WITH {SEG} SELECT meeting_id, idx, segment_id, speaker, start_ms, end_ms, length(text) AS chars FROM s",
    "transcript_stats": f"WITH {SEG} SELECT meeting_id, count(*) AS n, count(*) FILTER (WHERE trim(text) = '') AS n_empty, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1",
    "timeline_text": f"""WITH {SEG}, f AS (SELECT *, (start_ms + 500) // 1000 AS x, (end_ms + 500) // 1000 AS y FROM s WHERE trim(text) <> '')
 SELECT meeting_id, idx, '[' || segment_id || '][' || (x // 60) || 'm' || lpad(CAST(x % 60 AS VARCHAR), 2, '0') || 's-' || (y // 60) || 'm' || lpad(CAST(y % 60 AS VARCHAR), 2, '0') || 's][' || speaker || '] ' || text AS line FROM f""",
    "merge_turns": f"""WITH {SEG}, m0 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w <= 2000 THEN 0 ELSE 1 END AS fresh FROM s WHERE trim(text) <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY idx)),
 m1 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY meeting_id ORDER BY idx) AS BIGINT) AS turn_no FROM m0)
 SELECT meeting_id, turn_no, min(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, idx) AS end_ms, count(*) AS n, string_agg(text, '' ORDER BY idx) AS text FROM m1 GROUP BY 1, 2""",
    "speaker_fill": f"""WITH {SEG}, k AS (SELECT *, nullif(speaker, 'unknown') AS known FROM s)
 SELECT meeting_id, idx, speaker AS raw_speaker, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(known IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'unknown') AS speaker FROM k""",
    "speaker_stats": f"""WITH {SEG}, g AS (SELECT meeting_id, speaker, count(*) AS n, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS total_ms, min(idx) AS f FROM s GROUP BY 1, 2)
 SELECT meeting_id, speaker, n, total_ms, row_number() OVER (PARTITION BY meeting_id ORDER BY f, speaker) - 1 AS number FROM g""",
    "speaker_documents": f"WITH {SEG} SELECT meeting_id, speaker, CAST(sum(length(text)) AS BIGINT) AS chars, min(idx) AS first_idx, string_agg(text, chr(10) ORDER BY idx) AS text FROM s WHERE speaker <> 'unknown' GROUP BY 1, 2 HAVING sum(length(text)) >= 80",
    "top2_evidence": f"WITH {SEG} SELECT meeting_id, speaker, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY length(text) DESC, idx) AS place, segment_id FROM s QUALIFY place <= 2",
    "ref_repairs": f"WITH {SEG}, {REFS} SELECT meeting_id, owner, pos, ref, verdict FROM rv",
    "evidence_table": f"""WITH {SEG}, {REFS}, f AS (SELECT meeting_id, ref, min(owner * 10 + pos) AS first, min(start_ms) AS start_ms, min(end_ms) AS end_ms, min(speaker) AS speaker FROM rv WHERE verdict IN ('ok', 'duplicate') GROUP BY 1, 2)
 SELECT meeting_id, ref, row_number() OVER (PARTITION BY meeting_id ORDER BY first) AS place, start_ms, end_ms, speaker FROM f""",
    "first_claim": f"WITH {SEG}, {REFS} SELECT meeting_id, ref, min(owner) AS owner FROM rf GROUP BY 1, 2",
    "evidence_tolerance": f"""WITH {SEG}, c AS (SELECT meeting_id, idx, 'speaker_0' AS speaker, end_ms + 200 AS start_ms, end_ms + 400 AS end_ms FROM s)
 SELECT * FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.meeting_id = c.meeting_id AND s.speaker = c.speaker AND s.start_ms - 250 <= c.end_ms AND c.start_ms <= s.end_ms + 250)""",
    "contiguous_ranges": f"WITH {SEG}, {CHAPTERS} SELECT * FROM cr",
    "chapter_assign": f"WITH {SEG}, {CHAPTERS} SELECT s.meeting_id, s.segment_id, min(cr.idx) AS chapter FROM s JOIN cr ON s.meeting_id = cr.meeting_id AND s.idx BETWEEN cr.start_idx AND cr.end_idx GROUP BY 1, 2",
    "job_join": f"WITH {LATEST} SELECT o_orderkey AS job_id, o_orderpriority AS audio, coalesce(status, 'missing_result') AS status, text_chars FROM orders LEFT JOIN lt ON job_id = o_orderkey",
    "latest_record": f"WITH {LATEST.replace(' WHERE l_orderkey % 3 <> 0', '')} SELECT * FROM lt WHERE status = 'success'",
    "identity_diff": f"WITH {RES} SELECT *, 'missing' AS side FROM (SELECT o_orderkey AS job_id FROM orders EXCEPT SELECT job_id FROM res) UNION ALL SELECT *, 'extra' AS side FROM (SELECT job_id FROM res EXCEPT SELECT o_orderkey FROM orders)",
    "transcript_search": f"WITH {SEG} SELECT meeting_id, segment_id, CAST(instr(lower(text), 'the') AS INT) AS at FROM s WHERE contains(lower(text), 'the') OR contains(lower(speaker), 'the')",
    "draft_overlay": f"WITH {SEG} SELECT meeting_id, segment_id, (meeting_id + idx) % 4 = 0 AS edited, CASE WHEN (meeting_id + idx) % 4 = 0 THEN length('* ' || text) ELSE length(text) END AS chars FROM s",
    "asof_active": f"WITH {SEG}, {POINTS} SELECT pt.meeting_id, point, at_ms, (SELECT arg_max(segment_id, start_ms * 1000 + idx) FROM s WHERE s.meeting_id = pt.meeting_id AND start_ms <= at_ms) AS segment_id FROM pt",
    "asof_next": f"WITH {SEG}, {POINTS} SELECT pt.meeting_id, point, at_ms, (SELECT arg_min(segment_id, start_ms * 1000 + idx) FROM s WHERE s.meeting_id = pt.meeting_id AND start_ms >= at_ms) AS segment_id FROM pt",
    "bigram_jaccard": f"WITH {ITEMS} SELECT item_id, round({_jaccard('x', 'y')}, 6) AS similarity FROM (SELECT item_id, {_grams('a')} AS x, {_grams('b')} AS y FROM b)",
    "bigram_cosine": f"""WITH {ITEMS}, u AS (SELECT item_id, unnest({_grams('a')}) AS g, 1 AS x, 0 AS y FROM b UNION ALL SELECT item_id, unnest({_grams('b')}) AS g, 0, 1 FROM b),
 n AS (SELECT item_id, g, sum(x) AS x, sum(y) AS y FROM u GROUP BY 1, 2)
 SELECT item_id, round(CASE WHEN sum(x * x) * sum(y * y) > 0 THEN sum(x * y) / sqrt(sum(x * x) * sum(y * y)) ELSE 0.0 END, 6) AS similarity FROM n GROUP BY 1""",
    "cohesion_curve": f"WITH {SEG}, {COHESION} SELECT meeting_id, idx, round(cohesion, 6) AS cohesion FROM co",
    "token_estimate": "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 1.25::DOUBLE) + 3 AS BIGINT) AS tokens FROM documents",
    "content_hash": f"""WITH {SEG} SELECT meeting_id, idx, sha256('{{"segment_id":"' || segment_id || '","speaker":"' || speaker || '","start_ms":' || start_ms || '}}') AS sha256 FROM s""",
    "memory_peaks": "SELECT user_id AS key, event_type AS phase, first(value ORDER BY ts, event_id) AS baseline, max(value) AS peak, min(value) AS least, count(*) AS n FROM events GROUP BY 1, 2",
    "budget_prefix": f"WITH {SEG} SELECT * FROM (SELECT meeting_id, idx, CAST(sum(length(text) + 1) OVER (PARTITION BY meeting_id ORDER BY idx) AS BIGINT) AS used FROM s) WHERE used <= 2000",
    "stream_counts": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_s, event_type, count(*) AS n, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "duration_stats": f"WITH {_iv(6)}, x AS (SELECT unnest(['all', CASE WHEN label = 'unknown' THEN 'unknown' ELSE 'known' END, 'label:' || label]) AS grp, (end_ms - start_ms) / 1000 AS d FROM i) SELECT grp, count(*) AS n, round(sum(d), 3) AS total, round(avg(d), 3) AS mean, round(min(d), 3) AS least, round(max(d), 3) AS most, "
    + ", ".join(f"round(quantile_cont(d, {q}), 3) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9)) + ", " + ", ".join(f"{_bin(lo, hi)} AS bin{k}" for k, (lo, hi) in enumerate(zip(BINS[:-1], BINS[1:]))) + " FROM x GROUP BY grp",
    "library_list": f"WITH {LIB} SELECT meeting_id, title, state, updated_at FROM lf WHERE contains(lower(title), 'en') AND facet = 'processing'",
    "library_facets": f"WITH {LIB} SELECT count(*) AS all_rows, " + ", ".join(f"count(*) FILTER (WHERE facet = '{f}') AS {f}" for f in ("processing", "failed", "review", "confirmed", "deleted")) + " FROM lf",
    "library_page": f"WITH {LIB}, t AS (SELECT count(*) AS total FROM lf) SELECT meeting_id, state, size, total, total > 100 AS has_more FROM lf, t ORDER BY size DESC NULLS LAST, meeting_id LIMIT 50 OFFSET 50",
    "storage_categories": f"""WITH {FILES}, c AS (SELECT *, CASE WHEN list_contains(string_split(lower(path), '/'), 'exports') OR name IN ('formal_minutes.html', 'formal_minutes.txt', 'formal_result.json', 'manifest.json') THEN 'exports'
 WHEN name IN ('result.json', 'board_result.json', 'diagnostics.json', 'error_report.json') THEN 'results' WHEN regexp_matches(name, '\\.(part|staging|tmp)$') THEN 'temp'
 WHEN regexp_matches(name, '\\.(wav|mp3|m4a|flac|aac|ogg)$') AND (starts_with(name, 'source.') OR name = 'processing.wav') THEN 'audio' ELSE 'other' END AS category FROM fi),
 g AS (SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM c GROUP BY 1)
 SELECT *, CASE WHEN 20000000 - bytes < 19500000 THEN 'insufficient' WHEN 20000000 - bytes < 19900000 THEN 'warning' ELSE 'ok' END AS status FROM g""",
    "topic_boundaries": f"WITH {SEG}, {COHESION} SELECT meeting_id, idx, round(depth, 6) AS depth, score, reasons FROM bt",
    "topic_blocks": f"WITH {SEG}, {COHESION} SELECT * FROM bl",
    "boundary_reasons": f"WITH {SEG}, {COHESION} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(opened_by, ',')) AS reason FROM bl) GROUP BY 1",
    "char_error_rate": f"""WITH {ITEMS}, c AS (SELECT item_id, regexp_replace(lower(regexp_replace(a, '<[^>]+>', '', 'g')), '[^0-9a-z一-鿿]', '', 'g') AS r, regexp_replace(lower(regexp_replace(b, '<[^>]+>', '', 'g')), '[^0-9a-z一-鿿]', '', 'g') AS h FROM b)
 SELECT item_id, round(CASE WHEN length(r) > 0 THEN levenshtein(h, r) / length(r) END, 6) AS cer FROM c""",
    "tumbling_context": f"""WITH {SEG}, m AS (SELECT *, (start_ms + end_ms) // 2 AS mid, greatest(CAST(ceil(max(end_ms) OVER (PARTITION BY meeting_id) / 60000) AS BIGINT) - 1, 0) AS last FROM s),
 n AS (SELECT *, least((mid + 15000) // 60000, last) AS hi, CASE WHEN mid < 15000 THEN 0 ELSE (mid - 15000) // 60000 END AS lo FROM m), w AS (SELECT *, unnest(range(least(lo, hi), hi + 1)) AS win FROM n)
 SELECT meeting_id, win, segment_id, least(mid // 60000, last) = win AS is_core FROM w""",
    "leak_test": """WITH e AS (SELECT user_id AS key, value * 1024 AS available, CAST(event_id % 97 * 100 AS DOUBLE) AS cached, CAST(event_id % 89 * 500 AS DOUBLE) AS rss, value * 300 AS cma, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down, least(3, greatest(1, count(*) OVER (PARTITION BY user_id) // 2)) AS w FROM events),
 m AS (SELECT key, count(*) AS n, -(median(available) FILTER (WHERE down <= w) - median(available) FILTER (WHERE up <= w)) / 1024 AS a, (median(cached) FILTER (WHERE down <= w) - median(cached) FILTER (WHERE up <= w)) / 1024 AS c,
 (median(rss) FILTER (WHERE down <= w) - median(rss) FILTER (WHERE up <= w)) / 1024 AS r, -(median(cma) FILTER (WHERE down <= w) - median(cma) FILTER (WHERE up <= w)) / 1024 AS x FROM e GROUP BY 1)
 SELECT key, n, CASE WHEN n >= 2 THEN round(a, 3) END AS available_decline, CASE WHEN n >= 2 THEN round(c, 3) END AS cached_growth, CASE WHEN n >= 2 THEN round(r, 3) END AS rss_growth, CASE WHEN n >= 2 THEN round(x, 3) END AS cma_decline,
 CASE WHEN n >= 2 THEN c >= greatest(0.0, a * 0.5) END AS explained, n >= 2 AND a > 10 AND NOT c >= greatest(0.0, a * 0.5) AND (r > 2.5 OR x > 2.5) AS suspected, CASE WHEN n < 2 THEN 'insufficient_samples' WHEN n >= 6 THEN 'high' ELSE 'low' END AS confidence FROM m""",
    "run_flags": """WITH r AS (SELECT l_orderkey AS run, count(*) AS blocks, CAST(sum(l_partkey) AS BIGINT) AS p, CAST(sum(l_suppkey) AS BIGINT) AS s, max(l_linenumber) AS requests, count(*) FILTER (WHERE l_returnflag = 'R') AS retries FROM lineitem GROUP BY 1)
 SELECT run, array_to_string(list_filter([CASE WHEN p % 300 < 120 THEN 'short_blocks' END, CASE WHEN s % 900 > 0 AND s % 900 < 300 THEN 'short_overview' END, CASE WHEN p % 4 = 0 THEN 'overview_from_chapters' END,
 CASE WHEN s % 6 > 0 AND s % 6 > blocks * 0.7 THEN 'hardly_merged' END, CASE WHEN p % 5 > 0 AND p % 5 > blocks * 0.5 THEN 'opened_by_speaker' END, CASE WHEN p % 2 > 0 THEN 'thinks:block' END, CASE WHEN p % 3 > 0 THEN 'thinks:full' END,
 CASE WHEN s % 2 > 0 THEN 'thinks:speaker' END, CASE WHEN retries > 0 AND retries / requests > 0.15 THEN 'many_retries' END, CASE WHEN s % 20 > 0 AND abs(s % 20 / 10::DOUBLE - 1.3::DOUBLE) > 0.2 THEN 'token_drift' END,
 CASE WHEN p % 7 - 3 > 0 THEN 'empty_fields' END], lambda x: x IS NOT NULL), ',') AS flags FROM r""",
}
