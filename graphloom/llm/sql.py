"""The same queries in DuckDB's SQL, for those that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH parts AS (
  SELECT page_id, html, url,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
split AS (
  SELECT page_id, coalesce(html, '') AS html, url,
    regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\d*\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS q
  FROM parts),
p AS (
  SELECT page_id, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key,
    md5(html) AS md5, length(html)::BIGINT AS n FROM split),
probes AS (
  SELECT page_id * 3 + i AS record_id, page_id * 3 + i AS at, key, md5 FROM p, (VALUES (0), (2)) v(i)),
bases AS (SELECT page_id * 3 + 1 AS base_id, page_id * 3 + 1 AS base_at, key AS base_key, md5 AS base_md5, n FROM p),
found AS (
  SELECT r.*, b.* FROM probes r ASOF LEFT JOIN bases b ON r.key = b.base_key AND r.at > b.base_at)
SELECT record_id, key AS canonical_url, base_id,
  CASE WHEN base_id IS NULL THEN 'no_base' WHEN md5 = base_md5 THEN 'resolved' ELSE 'mismatch' END AS verdict,
  CASE WHEN md5 = base_md5 THEN base_md5 END AS digest,
  CASE WHEN md5 = base_md5 THEN n END AS n_bytes,
  CASE WHEN md5 = base_md5 THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: t' || record_id || chr(10) || 'etag: "' || base_md5 || '"' END AS headers
FROM found
"""


def _fill(parents: str, name: str, source: str, out: str) -> str:
    """CTEs that share `given` among the children in `source`; the children are sorted by capacity per weight."""
    by = f"PARTITION BY {parents or '0'}"
    order = f"ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
{out}_a AS (
  SELECT *, given - coalesce(sum(cap) OVER ({by} {order} 1 PRECEDING), 0) AS room,
    sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} {order} 1 PRECEDING), 0) AS heft FROM {source}),
{out}_b AS (
  SELECT *, min((cap::HUGEINT * heft::HUGEINT <= weight::HUGEINT * room::HUGEINT)::INT)
    OVER ({by} {order} CURRENT ROW) = 1 AS filled FROM {out}_a),
{out}_c AS (
  SELECT *, given - coalesce(sum(cap) FILTER (filled) OVER ({by}), 0) AS spare,
    coalesce(sum(weight) FILTER (NOT filled) OVER ({by}), 0) AS open_weight FROM {out}_b),
{out}_d AS (
  SELECT *, CASE WHEN filled THEN cap ELSE weight::HUGEINT * spare::HUGEINT // open_weight END AS base FROM {out}_c),
{out}_e AS (
  SELECT *, sum(base) OVER ({by}) AS given_out, sum((NOT filled)::INT) OVER ({by} {order} CURRENT ROW) AS nth FROM {out}_d),
{out} AS (
  SELECT *, (base + CASE WHEN NOT filled AND nth <= given - given_out THEN 1 ELSE 0 END)::BIGINT AS share FROM {out}_e)"""


OP5 = rf"""
WITH toks AS (
  SELECT coalesce(['web', 'books', 'code', 'news'][(coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+'), '') AS BIGINT), 0) % 4 + 1)::INT], '') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT * FROM toks WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens, (sum(n_tokens) * 2)::BIGINT AS leaf_cap FROM t GROUP BY ALL),
n1 AS (
  SELECT domain, sum(leaf_cap)::BIGINT AS cap,
    CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS weight,
    least((sum(sum(leaf_tokens)) OVER ())::HUGEINT * 600 // 1000, sum(sum(leaf_cap)) OVER ()) AS given FROM leaves GROUP BY domain),
{_fill('', 'domain', 'n1', 's1')},
n2 AS (
  SELECT domain, lang, c.cap, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight, s1.share AS given
  FROM (SELECT domain, lang, sum(leaf_cap)::BIGINT AS cap FROM leaves GROUP BY ALL) c JOIN s1 USING (domain)),
{_fill('domain', 'lang', 'n2', 's2')},
n3 AS (
  SELECT domain, lang, source, leaf_cap AS cap, 1 AS weight, s2.share AS given FROM leaves JOIN s2 USING (domain, lang)),
{_fill('domain, lang', 'source', 'n3', 's3')},
d AS (
  SELECT t.*, s3.share AS quota, s3.share // leaf_tokens AS rounds, s3.share % leaf_tokens AS rest
  FROM t JOIN leaves USING (domain, lang, source) JOIN s3 USING (domain, lang, source)),
part AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('42|' || rounds || '|' || coalesce(doc_id::VARCHAR, '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d)
SELECT domain, lang, source, doc_id, e.epoch::BIGINT AS epoch, n_tokens, n_tokens AS taken, quota
FROM d, unnest(range(rounds)) e(epoch) WHERE rounds > 0
UNION ALL
SELECT domain, lang, source, doc_id, rounds::BIGINT, n_tokens, least(n_tokens, rest - start)::BIGINT, quota FROM part WHERE start < rest
"""

OP9 = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
laid AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER w AS joined,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) AS role_chars
  FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN joined THEN 10 ELSE role_chars + 12 + 1 + 11 END)::BIGINT AS formatted_chars
FROM laid GROUP BY conv_id
"""

#: Words of a text, A-Z lower-cased.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id::VARCHAR AS item, array_to_string(w[i + 1:i + 13], ' ') AS gram, least(len(w), 13) AS n
  FROM items, unnest(range(greatest(len(w) - 13, 0) + 1)) u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS gram
  FROM docs, sizes, unnest(range(greatest(len(w) - n + 1, 0))) u(i)),
hits AS (SELECT doc_id, i, places.n, item FROM places JOIN grams USING (gram, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


OP3 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
  FROM docs WHERE len(w) > 0),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets GROUP BY list_sort(s)),
member AS (SELECT doc_id, rep FROM sets JOIN classes ON list_sort(sets.s) = classes.s),
toks AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM classes),
common AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM toks a JOIN toks b USING (t) WHERE a.rep < b.rep GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS root FROM classes UNION SELECT b, root FROM reach JOIN both_ways ON node = a),
comp AS (SELECT node, min(root) AS comp FROM reach GROUP BY node)
SELECT docs.doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, coalesce(comp, docs.doc_id) AS component_id
FROM docs LEFT JOIN sets ON sets.doc_id = docs.doc_id LEFT JOIN member ON member.doc_id = docs.doc_id LEFT JOIN comp ON comp.node = member.rep
"""

OP4 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n
  FROM docs, unnest(range(greatest(len(w) - 2, 0))) u(i)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM grams, unnest(range(i, i + 3)) u(p) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, line, lw, array_to_string(lw, ' ') AS key FROM (
    SELECT doc_id, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
    FROM docs, unnest(string_split(text, chr(10))) u(line)) WHERE len(lw) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
sizes AS (SELECT host, count(DISTINCT doc_id) AS n FROM docs GROUP BY host),
often AS (
  SELECT host, key FROM lines JOIN sizes USING (host) GROUP BY host, key, n
  HAVING count(DISTINCT doc_id) >= 10 AND (count(DISTINCT doc_id) * 1000 >= n * 10 OR count(DISTINCT doc_id) >= 100)),
gone AS (SELECT doc_id, sum(len(lw)) AS n FROM lines JOIN often USING (host, key) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed
  FROM docs LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT * EXCLUDE (fine), NOT fine AS base_failed, fine AND (n_words - n_removed) * 100 >= n_words * 30 AS kept FROM (
  SELECT *, n_words >= 50 AND n_repeat_words * 100 <= n_words * 50 AS fine FROM counts)
"""


def _op8() -> str:
    from .licences import PHRASES, TEMPLATES, need_of, plain_words, span_of

    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    phrases = ", ".join(f"({listed(plain_words(p))}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(
        f"({listed(sorted(set(w)))}, {need_of(len(set(w)))}, {span_of(w)}, {listed(x.must)}, {listed(x.bar)}, '{x.label}')" for x in TEMPLATES for w in [plain_words(x.text)]
    )
    return rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
base AS (SELECT doc_id, i, label FROM docs, phrases, unnest(range(len(w))) u(i) WHERE w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
templates(t, need, span, must, bar, label) AS (VALUES {templates}),
near AS (SELECT doc_id, w, templates.* FROM docs, templates WHERE len(list_intersect(t, w)) >= need AND len(list_intersect(must, w)) = len(must)),
spans AS (
  SELECT doc_id, label, t, need, must, bar, w[i + 1:i + span] AS s, list_concat([coalesce(w[i], '')], w[i + 1:i + span + 1]) AS e, span
  FROM near, unnest(range(len(w))) u(i) WHERE list_contains(t, w[i + 1])),
met AS (
  SELECT doc_id, label, max(len(list_intersect(t, s)) / len(t)) AS s FROM spans
  WHERE len(list_intersect(t, s)) >= need AND len(list_intersect(must, s)) = len(must) AND (NOT list_has_any(e, bar) OR len(list_distinct(list_transform(
    list_filter(range(2, span + 2), lambda k: coalesce(list_contains(must, e[k]), false) AND NOT coalesce(list_contains(bar, e[k - 1]), false) AND NOT coalesce(list_contains(bar, e[k + 1]), false)),
    lambda k: e[k]))) = len(must)) GROUP BY doc_id, label),
b AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY doc_id),
a AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(s) AS s
  FROM (SELECT doc_id, label, 1.0 AS s FROM base UNION ALL SELECT doc_id, label, s FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(b.l, '') AS base_labels, coalesce(a.l, '') AS labels, coalesce(a.s, 0)::DOUBLE AS score
FROM docs LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


OP12 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_warc_revisits": OP1,
    "op3_ngram_jaccard_join": OP3,
    "op4_line_frequency": OP4,
    "op5_mixing": OP5,
    "op6_decontamination": OP6,
    "op8_licence_scan": _op8(),
    "op9_chat_format": OP9,
    "op12_vector_search": OP12,
}
