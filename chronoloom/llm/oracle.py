"""DuckDB SQL of the corpus queries that SQL can express. The rest (op3, op4, op9, op10, op11) is tested against brute force and held-out rows."""

from __future__ import annotations

from chronoloom.llm.license_scan import AGREE, ANCHORS, SHIFT, index_rows, vocabulary

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, kind: str, *more: str) -> str:
    return f"SELECT row_number() OVER () AS r, {', '.join(more)}, regexp_extract_all({LOWER}, '{kind}') AS w FROM {table}"


OP1 = f"""WITH RECURSIVE d AS MATERIALIZED ({_words('documents', SPACED, 'doc_id')}),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
e AS MATERIALIZED (SELECT r, len(sh) AS n, unnest(sh) AS x FROM s),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS m FROM s UNION SELECT l.b, reach.m FROM reach JOIN both_ways l ON l.a = reach.r)
SELECT s.doc_id, CAST(len(any_value(s.sh)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN reach ON reach.r = s.r JOIN s t ON t.r = reach.m GROUP BY s.r, s.doc_id"""

OP2 = f"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS x
 FROM (SELECT item, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS MATERIALIZED ({_words('documents', PLAIN, 'doc_id')}),
dw AS (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS x FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw))),
hits AS MATERIALIZED (SELECT DISTINCT r, i, l, item FROM dw JOIN bw USING (l, x)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS listed FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)"""

OP5 = """WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS MATERIALIZED (SELECT *, e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 AS valid FROM v),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.r < b.r AND len(a.e) = len(b.e) WHERE a.valid AND b.valid AND list_cosine_similarity(a.e, b.e) >= 0.9),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS m FROM s UNION SELECT l.b, reach.m FROM reach JOIN both_ways l ON l.a = reach.r),
c AS (SELECT reach.r, min(t.vec_id) AS component_id FROM reach JOIN s t ON t.r = reach.m GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT s.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(s.vec_id = component_id, false) AS kept FROM s JOIN c USING (r) LEFT JOIN n USING (r)"""


def _escaped(c: str, *marks: str) -> str:
    return f"length({c})" + "".join(f" + length({c}) - length(replace({c}, '{m}', ''))" for m in marks)


OP6 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(15 + {_escaped('role', chr(92), '<', '>')} + {_escaped('text', chr(92), '<')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

_VOCABULARY = ", ".join(f"'{w}'" for w in vocabulary())
_INDEX = ", ".join(f"('{t}', '{lab}', {i}, '{w}', '{k}', {str(m).lower()})" for t, lab, i, w, k, m in index_rows())
OP7 = f"""WITH d AS MATERIALIZED ({_words('documents', PLAIN, 'doc_id')}),
hits AS MATERIALIZED (SELECT * FROM (SELECT r, unnest(range(0, len(w))) AS spot, unnest(w) AS word FROM d) WHERE word IN ({_VOCABULARY})),
idx AS (SELECT * FROM (VALUES {_INDEX}) t(template, label, pos, word, kind, must)),
df AS (SELECT word, count(DISTINCT r) AS df FROM hits GROUP BY word),
ranked AS (SELECT idx.*, row_number() OVER (PARTITION BY template ORDER BY coalesce(df, 0), pos) AS rank FROM idx LEFT JOIN df USING (word)),
post AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY template) AS anchors, count(*) FILTER (WHERE must) OVER (PARTITION BY template) AS musts FROM ranked WHERE must OR rank <= {ANCHORS}),
votes AS MATERIALIZED (SELECT r, template, label, kind, pos, must, anchors, musts, spot - pos AS start FROM hits JOIN post USING (word)),
exact AS MATERIALIZED (SELECT r, template, label, kind, start, anchors, musts FROM votes WHERE must GROUP BY ALL HAVING count(*) = musts),
agree AS (SELECT e.r, e.template, e.label, e.start, count(DISTINCT v.pos) / e.anchors AS share FROM exact e
 JOIN votes v ON v.r = e.r AND v.template = e.template AND abs(v.start - e.start) <= {SHIFT} WHERE e.kind = 'notice'
 GROUP BY e.r, e.template, e.label, e.start, e.anchors HAVING count(DISTINCT v.pos) >= {AGREE} * e.anchors),
found AS (SELECT r, label, start, 1.0 AS share, true AS base FROM exact WHERE kind = 'phrase' UNION ALL SELECT r, label, start, share, false FROM agree),
f AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
 array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN f USING (r)"""

OP8 = f"""WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS size,
 substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS key FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
s1 AS (SELECT *, source_size * 3 AS cap, row_number() OVER o AS k, sum(source_size) OVER () AS total, coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
 sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s0 WINDOW o AS (ORDER BY source_size * 3 / weight, source NULLS LAST)),
first AS (SELECT k, total - full_ AS rest, open_weight FROM s1 WHERE cap * open_weight >= (total - full_) * weight ORDER BY k LIMIT 1),
s AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN s1.k < f.k THEN CAST(cap AS DOUBLE) ELSE CAST(rest AS DOUBLE) * weight / f.open_weight END AS target FROM s1, first f),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM s),
p AS (SELECT d.*, b.source_size, target, epochs, budget - epochs * b.source_size - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
 FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + greatest(0, least(size, rest)) AS BIGINT) AS taken FROM p"""



def _crc32(x: str) -> str:
    """crc32 of a value's decimal digits: a byte, then eight shifts, each time."""
    shift = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {shift}), 4294967295)"


OP12 = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, md5(strlen(r) || ':' || r || t)) AS pos, r, t
 FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations)),
c AS MATERIALIZED (SELECT conv_id, max(pos) AS own, conv_id - conv_id % 20 AS first, {_crc32('conv_id')} % 4 AS h FROM o GROUP BY conv_id),
k AS (SELECT c.*, c.h - least(c.h, coalesce(f.own, 0)) AS shift FROM c LEFT JOIN c f ON f.conv_id = c.first),
b AS (SELECT c.conv_id, o.pos AS d, r, t FROM c JOIN o ON o.conv_id = c.first AND o.pos <= c.h UNION ALL SELECT k.conv_id, pos - shift, r, t FROM o JOIN k ON o.conv_id = k.conv_id AND o.pos > k.h),
p AS MATERIALIZED (SELECT conv_id, d, md5(string_agg(strlen(r) || ':' || r || strlen(t) || ':' || t, '') OVER w) AS k, len(regexp_extract_all(t, '{SPACED}')) AS words FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY d)
 UNION ALL SELECT conv_id, 0, '', 0 FROM c),
q AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS pk, max(d) OVER (PARTITION BY conv_id) AS n FROM p),
v AS MATERIALIZED (SELECT d, k, any_value(pk) AS pk, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends FROM q GROUP BY d, k),
w AS MATERIALIZED (SELECT v.*, (SELECT count(*) FROM v x WHERE x.d = v.d + 1 AND x.pk = v.k) AS n_children FROM v),
u AS (SELECT d, k, pk, n_convs, words, n_children, d AS ad, k AS ak, pk AS apk FROM w UNION ALL SELECT u.d, u.k, u.pk, u.n_convs, u.words, u.n_children, w.d, w.k, w.pk FROM u JOIN w ON u.ad > 0 AND w.d = u.ad - 1 AND w.k = u.apk),
t AS (SELECT ad, ak, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved FROM u GROUP BY ad, ak)
SELECT w.conv_id, w.d AS depth, y.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN t ON t.ad = w.d AND t.ak = w.k LEFT JOIN w y ON y.d = w.d - 1 AND y.k = w.pk"""


def _leaf(n_chars: str) -> str:
    def told(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"

    return f"sha256({' || '.join(map(told, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_RUNS = "sha256(string_agg(h, '' ORDER BY pos))"
_FOLD = "sha256(CASE WHEN pos % 2 = 1 THEN coalesce(s.h, '') ELSE '' END || acc || CASE WHEN pos % 2 = 1 THEN '' ELSE coalesce(s.h, '') END)"
OP13 = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
 FROM (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc32('doc_id')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS changed FROM documents)),
n AS MATERIALIZED (SELECT lang, 0 AS k, pos, leaf AS h FROM l UNION ALL SELECT lang, k + 1, pos // 2, {_RUNS} FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS several FROM n) WHERE several > 1 GROUP BY lang, k, pos // 2),
g AS MATERIALIZED (SELECT lang, max(k) AS top, arg_max(h, k) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM n GROUP BY lang),
m AS MATERIALIZED (SELECT 0 AS k, pos, subroot AS h FROM g UNION ALL SELECT k + 1, pos // 2, {_RUNS} FROM (SELECT *, count(*) OVER () AS several FROM m) WHERE several > 1 GROUP BY k, pos // 2),
a AS MATERIALIZED (SELECT r, lang, 0 AS k, pos, changed AS acc, '' AS proof FROM l UNION ALL SELECT r, a.lang, a.k + 1, a.pos // 2, {_FOLD.replace('pos', 'a.pos')}, proof || coalesce(s.h, '')
 FROM a JOIN g ON g.lang IS NOT DISTINCT FROM a.lang AND a.k < g.top LEFT JOIN n s ON s.lang IS NOT DISTINCT FROM a.lang AND s.k = a.k AND s.pos = xor(a.pos, 1)),
z AS MATERIALIZED (SELECT r, 0 AS k, g.pos AS pos, acc, proof FROM a JOIN g ON g.lang IS NOT DISTINCT FROM a.lang AND a.k = g.top UNION ALL SELECT r, z.k + 1, z.pos // 2, {_FOLD.replace('pos', 'z.pos')}, proof || coalesce(s.h, '')
 FROM z LEFT JOIN m s ON s.k = z.k AND s.pos = xor(z.pos, 1) WHERE z.k < (SELECT max(k) FROM m))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang JOIN z ON z.r = l.r AND z.k = (SELECT max(k) FROM m), (SELECT h AS root FROM m ORDER BY k DESC LIMIT 1)"""

SQL = {
    "op1_ngram_jaccard_join": OP1, "op2_benchmark_decontamination": OP2, "op5_embedding_near_dedup": OP5, "op6_chat_formatting": OP6,
    "op7_license_scan": OP7, "op8_source_mixing": OP8,
    "op12_conversation_prefix_trie": OP12, "op13_merkle_manifest": OP13,
}
