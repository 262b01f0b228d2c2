"""SQL for the operators that SQL can express, run on the same tables."""

WORD = r"[^\x20\x09-\x0D]+"
A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Words inside any occurrence of a benchmark window, per document.
DECONTAMINATE = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), doc_windows AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, lengths WHERE len(ws) >= n)
), hits AS (
  SELECT rid, item_id, i, n FROM doc_windows JOIN windows USING (n, w)
), hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rid
)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

#: Keys of lines, the smallest document that holds each, and what stays of each text.
LINE_DEDUP = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each_line AS (
  SELECT rid, doc, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM docs
), keyed AS (
  SELECT rid, doc, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {A_Z}) AS key FROM each_line
), firsts AS (
  SELECT key, min(doc) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc) < max(doc)
), marked AS (
  SELECT rid, line, pos, first_doc IS NOT NULL AND doc > first_doc AS gone FROM keyed LEFT JOIN firsts USING (key)
), kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text FROM marked GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM docs JOIN kept USING (rid)
"""


def _near_duplicates(words: int, percent: int, more: str = "") -> str:
    """Shingle sets, links between them, and the smallest id that is reachable."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '{WORD}') AS ws FROM documents
), each_gram AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + {words - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 2}, 2))) AS i FROM words WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM each_gram GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each_gram a JOIN each_gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a
), comps AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id{more}
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN comps USING (doc_id)
"""

_KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = rf"""({_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALLOW = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|example|sample|dummy|placeholder|your[_-]|x{6}|0{8}|abcdefgh|12345678"


def _found(kind: int, pattern: str) -> str:
    return f"SELECT rid, {kind} AS kind, regexp_extract_all(t, '{pattern}', 0) AS ms, string_split_regex(t, '{pattern}') AS gs FROM docs WHERE regexp_matches(t, '{pattern}')"


#: Matches of the patterns by position, and windows of 20 characters whose entropy is over the bound of their class.
SECRETS = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), found AS (
  {_found(0, _ASSIGN)} UNION ALL {_found(1, "AKIA[A-Z0-9]+")} UNION ALL {_found(2, "[0-9a-f]+")} UNION ALL {_found(3, "[A-Za-z0-9+/_=-]{20,}")}
), each_match AS (
  SELECT rid, kind, unnest(ms) AS m, unnest(gs[1 : len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM found
), placed AS (
  SELECT rid, kind, m, sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM each_match WINDOW w AS (PARTITION BY rid, kind ORDER BY i)
), base AS (
  SELECT rid, kind, s, s + length(m) AS e FROM placed
  WHERE kind = 0 AND length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6 OR kind = 1 AND length(m) >= 20 OR kind = 2 AND length(m) >= 24
), cut AS (
  SELECT rid, s, string_split_regex(m, '{_ALLOW}') AS ps, list_concat([0], list_transform(regexp_extract_all(m, '{_ALLOW}', 0), lambda x: length(x))) AS ks FROM placed WHERE kind = 3
), strings AS (
  SELECT rid, s + list_sum(ks[1 : j]) + coalesce(list_sum(list_transform(ps[1 : j - 1], lambda x: length(x))), 0) AS s, ps[j] AS m FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM cut) WHERE length(ps[j]) >= 20
), windows AS (
  SELECT rid, s, i, w, CASE WHEN regexp_full_match(w, '[0-9a-f]+') THEN 3.05 WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN 3.75 ELSE 3.85 END AS bits
  FROM (SELECT rid, s, i, substr(m, i, 20) AS w FROM (SELECT *, unnest(range(1, length(m) - 18)) AS i FROM strings))
), symbols AS (
  SELECT rid, s, bits, i, substr(w, k, 1) AS c, count(*) AS n FROM (SELECT *, unnest(range(1, 21)) AS k FROM windows) GROUP BY ALL
), over AS (
  SELECT rid, s, i FROM symbols GROUP BY rid, s, bits, i HAVING round(-sum(n / 20 * log2(n / 20)), 9) >= bits
), added AS (
  SELECT rid, 3 AS kind, s + min(i) - 1 AS s, s + max(i) + 19 AS e FROM over GROUP BY rid, over.s
), met AS (
  SELECT a.rid, a.s AS a_s, a.e AS a_e, b.s AS b_s, b.e AS b_e, b.kind FROM added a JOIN base b ON b.rid = a.rid AND b.s < a.e AND a.s < b.e
), gaps AS (
  SELECT rid, greatest(a_s, max(b_e) OVER (PARTITION BY rid, a_s ORDER BY b_s, kind, b_e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS s, b_s AS e FROM met
  UNION ALL SELECT rid, greatest(a_s, max(b_e)), a_e FROM met GROUP BY rid, a_s, a_e
), spans AS (
  SELECT * FROM base UNION ALL SELECT rid, 3, s, e FROM gaps WHERE e - s >= 20
  UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = a.rid AND b.s < a.e AND a.s < b.e)
), shown AS (
  SELECT rid, kind, s, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || cast(s AS BIGINT) || ':' || cast(e AS BIGINT) AS x FROM spans
), joined AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base_x, string_agg(x, ',' ORDER BY s, kind) AS all_x FROM shown GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_x, '')) AS base_sha256, coalesce(all_x, '') AS spans
FROM docs LEFT JOIN joined USING (rid)
"""

#: Counts of phrases of one to three words within pieces, candidates that no longer one covers, and their lowest cuts.
COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {A_Z}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), counts AS (
  SELECT lang, k, g, count(*) AS a
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS g FROM words, (SELECT unnest([1, 2, 3]) AS k))
  GROUP BY ALL
), candidates AS (
  SELECT *, string_split(g, ' ') AS ws FROM counts WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.k, c.g, c.a, c.ws, cut, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.k = cut AND l.g = array_to_string(c.ws[1 : cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - cut AND r.g = array_to_string(c.ws[cut + 1 : c.k], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, cut) = 1
), covered AS (
  SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS g FROM candidates WHERE k = 3) GROUP BY ALL
), ranked AS (
  SELECT lang, g AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank
  FROM lowest LEFT JOIN covered USING (lang, g) WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE = {
    "op4_secret_scan": SECRETS,
    "op6_ngram_jaccard": _near_duplicates(5, 75),
    "op7_decontaminate": DECONTAMINATE,
    "op8_line_dedup": LINE_DEDUP,
    "op11_collocations": COLLOCATIONS,
    "op12_minhash_forest": _near_duplicates(2, 80, ", coalesce(component_id, w.doc_id) = w.doc_id AS kept"),
}
