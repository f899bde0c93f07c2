"""SQL twins of this subpackage's queries, for DuckDB."""

from __future__ import annotations

from tidemark.llm import licenses, warc

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _templates() -> str:
    rows = [(label, 100, phrase, True) for label, phrase in licenses.PHRASES.items()]
    rows += [(label, percent, text, False) for label, percent, text in licenses.NOTICES]
    out = []
    for n, (label, percent, text, exact) in enumerate(rows):
        words = [w.decode() for w in licenses.words_of(text.encode())]
        step = licenses.LEAST_STEP
        while step < len(words):
            step *= 2
        out.append(f"({n}, '{label}', {percent}, {exact}, {step}, {words})")
    return ", ".join(out)


_LICENSES = f"""
WITH template(t, label, percent, exact, step, words) AS (VALUES {_templates()}),
needed AS (SELECT t, word, size, (size * percent + 99) // 100 AS need, step, label, exact
  FROM (SELECT *, len(list_distinct(words)) AS size, unnest(list_distinct(words)) AS word FROM template)),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_TERM}) AS words FROM documents),
word AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM doc),
block AS (SELECT r, t, label, b, size, count(DISTINCT w.word) AS held, need
  FROM (SELECT *, unnest([pos // step, pos // step - 1]) AS b FROM word JOIN needed USING (word) WHERE NOT exact) w
  WHERE b >= 0 GROUP BY r, t, label, b, size, need HAVING count(DISTINCT w.word) >= need),
place AS (SELECT r, label, pos FROM template t JOIN word w ON w.word = t.words[1] JOIN doc USING (r)
  WHERE exact AND doc.words[pos + 1 : pos + len(t.words)] = t.words),
based AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM (SELECT r, label, 1.0::DOUBLE AS share FROM place UNION ALL SELECT r, label, held::DOUBLE / size FROM block) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(based.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(based.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, coalesce(share, 0.0) AS score
FROM doc LEFT JOIN based USING (r) LEFT JOIN every USING (r)
"""

_NEGATIVES = """
WITH row_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM row_ a JOIN row_ b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
"""

_SEARCH = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_TERM}) AS words FROM documents),
size AS (SELECT count(*) AS n, sum(len(words))::BIGINT AS l FROM doc WHERE len(words) > 0),
item AS (SELECT item_id, regexp_extract_all({_FOLD}, {_TERM}) AS words FROM benchmark),
term AS (SELECT item_id, unnest(words) AS word FROM item),
tf AS (SELECT r, doc_id, n, word, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS word FROM doc) GROUP BY ALL),
weight AS (SELECT word, floor(1000 * ln((2 * any_value(size.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY word),
score AS (SELECT item_id, r, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * tf.n * size.n // size.l))))::BIGINT AS score
  FROM term JOIN tf USING (word) JOIN weight USING (word), size GROUP BY ALL)
SELECT item_id, row_number() OVER w AS rank, doc_id, score FROM score WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 20
"""

_REACH = "reach(id, root) AS (SELECT {0}, {0} FROM {1} UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.root)"

_NEAR_TEXTS = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN size m ON m.doc_id = x.doc_id JOIN size n ON n.doc_id = y.doc_id
  WHERE 100 * least(m.n, n.n) >= 80 * greatest(m.n, n.n) GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
{_REACH.format("doc_id", "doc")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM doc JOIN (SELECT id, min(root) AS c FROM reach GROUP BY 1) ON id = doc_id LEFT JOIN size USING (doc_id)
"""

_NEAR_VECTORS = f"""
WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{_REACH.format("vec_id", "embeddings")}
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT id, min(root) AS c FROM reach GROUP BY 1) ON id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY 1) ON a = vec_id
"""

_HEADERS = ("content-type", "date", "etag", "expires", "last-modified")
_OWN = dict(zip(_HEADERS, ("ct", "dt", "et", "ex", "lm")))


def _written(pick) -> str:
    return "concat_ws(';', " + ", ".join(f"'{h}=' || {pick(c)}" for h, c in _OWN.items()) + ")"


_REVISITS = f"""
WITH page AS (SELECT *, '"' || length(coalesce(html, ''))::VARCHAR || '"' AS tag, 'day ' || (page_id % 28)::VARCHAR AS day FROM pages),
capture AS (SELECT page_id * 2 AS id, url, page_id * 2 AS time, 200 AS status, coalesce(html, '') AS body, 'text/html' AS ct, page_id::VARCHAR AS dt,
    CASE WHEN page_id % 2 = 1 THEN 'W/' ELSE '' END || tag AS et, NULL AS ex, day AS lm FROM page
  UNION ALL SELECT page_id * 2 + 1, regexp_replace(url, '^http://', 'https://'), page_id * 2 + 385, 304, '', CASE WHEN page_id % 16 <> 5 THEN 'text/plain' END,
    CASE WHEN page_id % 16 = 5 OR page_id % 15 <> 7 THEN 'later' END, CASE WHEN page_id % 16 = 5 THEN '"old"' WHEN page_id % 15 <> 7 THEN tag END,
    CASE WHEN page_id % 16 <> 5 AND page_id % 15 <> 7 THEN day END, CASE WHEN page_id % 16 <> 5 AND page_id % 15 = 7 THEN day END FROM page),
cut AS (SELECT *, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '(?i)^https?://', '') AS rest FROM capture),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\\.', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
  list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '{warc.NOISE}'))) AS args FROM cut),
named AS (SELECT *, place || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS key FROM keyed),
met AS (SELECT *, CASE WHEN status = 304 AND key <> '' THEN last_value(CASE WHEN status = 200 THEN id END IGNORE NULLS) OVER (
  PARTITION BY key ORDER BY time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS earlier FROM named),
judged AS (SELECT m, o, CASE WHEN m.status = 200 THEN 'response' WHEN o.id IS NULL THEN 'orphan'
  WHEN CASE WHEN m.et IS NOT NULL AND o.et IS NOT NULL THEN replace(m.et, 'W/', '') = replace(o.et, 'W/', '') ELSE coalesce(m.lm = o.lm, FALSE) END THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM met m LEFT JOIN named o ON o.id = m.earlier)
SELECT m.id AS capture_id, m.key AS key, outcome, CASE WHEN outcome = 'resolved' THEN o.id END AS source_id,
  CASE WHEN outcome = 'resolved' THEN {_written(lambda c: "o.ct" if c == "ct" else f"coalesce(m.{c}, o.{c})")} ELSE {_written(lambda c: f"m.{c}")} END AS headers,
  sha256(CASE WHEN outcome = 'resolved' THEN o.body ELSE m.body END) AS body_sha256, length(CASE WHEN outcome = 'resolved' THEN o.body ELSE m.body END) AS body_length
FROM judged
"""

SQL = {
    "op3_revisits": _REVISITS,
    "op4_near_duplicates": _NEAR_TEXTS, "op7_near_vectors": _NEAR_VECTORS, "op11_license_scan": _LICENSES, "op12_hard_negatives": _NEGATIVES, "op13_lexical_search": _SEARCH,
}
