"""Registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from . import collocations, concurrency, embeddings, fingerprints, huffman, jaccard, langid, mixing, passages, sharding, tokens, urls, wordtrie

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_byte_bpe": tokens.op3_byte_bpe,
    "op4_huffman": huffman.op4_huffman,
    "op5_langid": langid.op5_langid,
    "op6_sharding": sharding.op6_sharding,
    "op7_substring_dedup": passages.op7_substring_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_word_bpe": wordtrie.op11_word_bpe,
    "op12_collocations": collocations.op12_collocations,
    "op13_peak_concurrency": concurrency.op13_peak_concurrency,
}

#: DuckDB. Redirect and canonical edges as a recursive closure; rules by longest fit.
_URLS = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
page AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END AS node
  FROM pages
), found AS (
  SELECT node, url, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?\s*canonical\b'))[1], '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM page WHERE node IS NOT NULL
  UNION ALL
  SELECT node, url, regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?\s*refresh\b'))[1], '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM page WHERE node IS NOT NULL
), resolved AS (
  SELECT node AS u, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN link LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link WHEN link LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    WHEN link LIKE '#%' THEN NULL WHEN link LIKE '?%' THEN regexp_extract(url, '(?s)^([^?#]*)', 1) || link
    ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || link END AS target
  FROM (SELECT node, url, replace(link, '&amp;', '&') AS link FROM found) WHERE link <> ''
), edge AS (
  SELECT u, translate(regexp_extract(target, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS v
  FROM resolved WHERE target IS NOT NULL
), pairs AS (SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v
), reach(a, b) AS (SELECT u, u FROM pairs UNION SELECT reach.a, pairs.v FROM reach JOIN pairs ON reach.b = pairs.u
), root AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a
), member AS (SELECT node, component, regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM root
), judged AS (
  SELECT component, (SELECT arg_max(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS verdict FROM member
), carried AS (SELECT component, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict FROM judged GROUP BY component
), fit AS (
  SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM page) x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url
)
SELECT page.page_id, host, path, fit.rule, coalesce(fit.verdict, carried.verdict, 'allow') AS verdict, root.component
FROM page LEFT JOIN fit ON fit.page_id = page.page_id AND fit.url IS NOT DISTINCT FROM page.url LEFT JOIN root ON root.node = page.node LEFT JOIN carried ON carried.component = root.component
"""

#: DuckDB. All pairs of a label by cosine, components as a recursive closure.
_EMBEDDINGS = """
WITH RECURSIVE vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
near AS (SELECT a.vec_id AS u, b.vec_id AS v FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT u, u FROM near UNION SELECT reach.a, near.v FROM reach JOIN near ON reach.b = near.u),
root AS (SELECT a, min(b) AS r FROM reach GROUP BY a), deg AS (SELECT u, count(*) AS n FROM near GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(r, vec_id) AS component_id, vec_id = coalesce(r, vec_id) AS kept
FROM embeddings LEFT JOIN root ON root.a = vec_id LEFT JOIN deg ON deg.u = vec_id
"""

#: DuckDB. Five-word shingles as texts, pairs by shared shingles, groups as a closure.
_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[\x{a0}«»¡¿·–—‘’“”„…、。！，？]', ' ', 'g'), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM words, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), size AS (SELECT words.doc_id, count(s) AS n FROM words LEFT JOIN shingle ON shingle.doc_id = words.doc_id GROUP BY words.doc_id
), shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), near AS (
  SELECT u, v, c = x.n AND c = y.n AS same FROM shared JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE c * 10 >= 8 * (x.n + y.n - c)
  UNION ALL SELECT x.doc_id, y.doc_id, true FROM size x JOIN size y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id
), reach(a, b) AS (SELECT u, u FROM near UNION SELECT reach.a, near.v FROM reach JOIN near ON reach.b = near.u
), root AS (SELECT a, min(b) AS r FROM reach GROUP BY a
), deg AS (SELECT u, count(*) AS n, min(v) FILTER (same) AS twin FROM near GROUP BY u)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, coalesce(n, 0) AS n_links, coalesce(r, doc_id) AS group_id, doc_id = coalesce(r, doc_id) AS kept
FROM documents LEFT JOIN root ON root.a = doc_id LEFT JOIN deg ON deg.u = doc_id
"""

#: DuckDB. All phrases as texts, the worst cut by window, one-word extensions by their two ends.
_COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM words, unnest(range(1, 4)) AS x(k), unnest(range(1, len(w) - k + 2)) AS y(i)
), freq AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM freq WHERE k = 1 GROUP BY lang
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2 AND f >= 10
), cuts AS (
  SELECT cand.lang, cand.k, cand.phrase, a, j, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cand, unnest(range(1, cand.k)) AS z(j) JOIN freq x ON x.lang = cand.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN freq y ON y.lang = cand.lang AND y.phrase = array_to_string(w[j + 1:], ' ')
), worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts
), longer AS (
  SELECT lang, part, max(a) AS f FROM (SELECT lang, array_to_string(w[1:2], ' ') AS part, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY ALL
), kept AS (SELECT worst.* FROM worst LEFT JOIN longer ON longer.lang = worst.lang AND part = phrase WHERE o = 1 AND (longer.f IS NULL OR 100 * longer.f < 50 * a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""

#: DuckDB. Changes summed up in order of time.
_CONCURRENCY = """
WITH shipped AS (SELECT sale_id, min(shipped_at) AS s FROM sale_lines GROUP BY sale_id),
nation_of AS (SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id),
spans AS (
  SELECT coalesce(nation_id, -1) AS nation_id, CAST(floor(epoch(sold_at)) AS BIGINT) AS b, CAST(floor(epoch(s)) AS BIGINT) + 86400 AS e, coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents
  FROM sales LEFT JOIN shipped USING (sale_id) LEFT JOIN nation_of USING (client_id) WHERE sold_at IS NOT NULL
), kept AS (SELECT * FROM spans WHERE e IS NULL OR e > b), doubled AS (SELECT * FROM kept UNION ALL SELECT -2, b, e, cents FROM kept),
change AS (SELECT nation_id, b AS t, 1 AS dn, cents AS dc FROM doubled UNION ALL SELECT nation_id, e, -1, -cents FROM doubled WHERE e IS NOT NULL),
moment AS (SELECT nation_id, t, sum(dn) AS dn, sum(dc) AS dc FROM change GROUP BY ALL HAVING sum(dn) <> 0 OR sum(dc) <> 0),
run AS (SELECT nation_id, t, lead(t) OVER w AS t2, sum(dn) OVER w AS n, sum(dc) OVER w AS c FROM moment WINDOW w AS (PARTITION BY nation_id ORDER BY t))
SELECT CAST(nation_id AS INTEGER) AS nation_id, t AS from_s, t2 AS to_s, CAST(n AS BIGINT) AS n_open, CAST(c AS BIGINT) AS open_cents,
  CAST(max(n) OVER (PARTITION BY nation_id ORDER BY t) AS BIGINT) AS high_open, c = max(c) OVER (PARTITION BY nation_id) AS is_peak FROM run
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": _URLS, "op9_embeddings": _EMBEDDINGS, "op10_jaccard_join": _JACCARD, "op12_collocations": _COLLOCATIONS, "op13_peak_concurrency": _CONCURRENCY}
