"""The text queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from shelfwise.llm.license_scan import LICENCE_NAME, TEMPLATES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _fold(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_RULE_ROWS = ", ".join(f"('{h}{p}', '{v}', '{h}', '{p}')" for v, h, p in _RULES)

URL_FILTERS = f"""
WITH rules(rule, verdict, rule_host, rule_path) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT row_number() OVER () AS n, page_id, url,
         coalesce({_fold("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '') AS query
  FROM pages),
canonical AS (
  SELECT *, CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params FROM parts)),
unwanted AS (
  SELECT DISTINCT key FROM canonical WHERE key IS NOT NULL
  AND list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
fitting AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict
  FROM canonical c JOIN rules r ON (c.host = rule_host OR ends_with(c.host, '.' || rule_host)) AND starts_with(c.path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN u.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       u.key IS NOT NULL AS listed
FROM canonical c LEFT JOIN fitting f USING (n) LEFT JOIN unwanted u ON c.key = u.key
"""

#: ``documents`` with its lines: n numbers the rows, pos the lines.
_LINES = f"""
rows_ AS (SELECT row_number() OVER () AS n, * FROM {{docs}}),
lines AS (
  SELECT n, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM rows_),
keyed AS (SELECT *, {_fold(f"trim(line, {BLANKS})")} AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r USING (key)),
cleaned AS (
  SELECT n, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY n)"""

LINE_DEDUP = f"""
WITH {_LINES.format(docs="documents")}
SELECT r.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM cleaned JOIN rows_ r USING (n)
"""

_NGRAM_SHARES = [(5, 0.40), (8, 0.35), (10, 0.30)]
_LATER = "".join(
    f"""
later_{k} AS (
  SELECT n, i FROM (SELECT n, i, row_number() OVER (PARTITION BY n, g ORDER BY i) AS time FROM (
    SELECT n, i, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT n, unnest(range(1, len(w) - {k - 2})) AS i, w FROM split WHERE len(w) > {k})))
  WHERE time > 1),
inside_{k} AS (
  SELECT n, sum(length(w[p]))::BIGINT AS dup_chars_{k}
  FROM (SELECT DISTINCT n, i + unnest(range(0, {k})) AS p FROM later_{k}) JOIN split USING (n) GROUP BY n),"""
    for k, _ in _NGRAM_SHARES
)
_INSIDE = ", ".join(f"coalesce(dup_chars_{k}, 0) AS dup_chars_{k}" for k, _ in _NGRAM_SHARES)
_JOINS = " ".join(f"LEFT JOIN inside_{k} USING (n)" for k, _ in _NGRAM_SHARES)
_KEPT = " AND ".join(f"dup_chars_{k} <= {share}::DOUBLE * word_chars" for k, share in _NGRAM_SHARES)

QUALITY_RULES = rf"""
WITH rows_ AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM rows_),
windows AS (SELECT n, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
grams AS (SELECT n, i, [w[i], w[i + 1], w[i + 2]] AS g FROM windows),
twice AS (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS times FROM grams),
covered AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS t(k) WHERE times > 1 GROUP BY n),
{_LATER}
lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM rows_),
dups AS (SELECT n, sum(times - 1)::BIGINT AS n_dup_lines, sum((times - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS chars FROM (
  SELECT n, line, count(*) AS times FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n, line) GROUP BY n),
figures AS (
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words,
       coalesce(chars, 0) AS dup_line_chars, {_INSIDE},
       len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM split LEFT JOIN dups USING (n) LEFT JOIN covered USING (n) {_JOINS})
SELECT *, NOT base_failed AND dup_line_chars <= 0.4::DOUBLE * word_chars AND n_symbols <= 0.1::DOUBLE * n_words AND {_KEPT} AS kept FROM figures
"""

_NOTICES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


def _terms(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: t <> '')"


#: Each distinct (doc_id, text) is weighed once: r numbers the rows, d the texts. A unit of its own is u; -1 is the whole text.
LICENSE_SCANS = rf"""
WITH templates(t, license, text) AS (VALUES {_NOTICES}),
rows_ AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, text) AS d, doc_id,
         concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS text FROM documents),
template_terms AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest({_terms('text')}) AS term FROM templates) GROUP BY ALL),
total AS (SELECT count(*) AS N FROM rows_),
found AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_terms('text')})) AS term FROM rows_) GROUP BY term),
idf AS (
  SELECT term, ln((1 + N)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN found USING (term), total),
template_norms AS (SELECT t, sqrt(sum((tf * idf) ** 2)) AS norm FROM template_terms JOIN idf USING (term) GROUP BY t),
weights AS (SELECT t, license, term, tf * idf / norm AS weight FROM template_terms JOIN idf USING (term) JOIN template_norms USING (t)),
texts AS (SELECT d, any_value(text) AS text FROM rows_ GROUP BY d),
paragraphs AS (SELECT d, unnest(string_split_regex(text, '
[^a-zA-Z0-9]*
')) AS unit FROM texts),
units AS (
  SELECT d, unnest(string_split(regexp_replace(text, '([.!?])[ 	]+', '' || chr(10), 'g'), chr(10))) AS unit, false AS whole FROM texts
  UNION SELECT d, unit, false FROM paragraphs
  UNION SELECT d, unnest(string_split(regexp_replace(unit, '([.!?])[ 	
]+', '' || chr(1), 'g'), chr(1))), false FROM paragraphs WHERE contains(unit, chr(10))
  UNION SELECT d, text, true FROM texts),
numbered AS (SELECT row_number() OVER () AS u, d, whole, {_terms('unit')} AS terms FROM units),
tfs AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(terms) AS term FROM numbered) GROUP BY ALL),
weighed AS (SELECT u, term, tf * coalesce(idf, ln((1 + N)::DOUBLE) + 1) AS w FROM tfs LEFT JOIN idf USING (term), total),
norms AS (SELECT u, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY u),
dots AS (SELECT u, t, license, sum(w * weight) AS dot FROM weighed JOIN weights USING (term) GROUP BY ALL),
near AS (
  SELECT d, whole, license, round(dot / norm, 9) AS similarity FROM dots JOIN norms USING (u) JOIN numbered USING (u)
  WHERE round(dot / norm, 9) >= 0.6
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY similarity DESC, license DESC) = 1),
own AS (
  SELECT d, license, similarity FROM near WHERE similarity >= 0.75
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY license <> 'proprietary' DESC, similarity DESC, license DESC) = 1),
whole AS (SELECT d, license FROM near WHERE whole),
marked AS (
  SELECT r, doc_id, path, regexp_replace(regexp_replace(path, '[^/]*$', ''), '/+$', '') AS dir, own.license AS own, similarity, whole.license AS whole
  FROM rows_ LEFT JOIN own USING (d) LEFT JOIN whole USING (d)),
licensed AS (
  SELECT dir AS licence_dir, coalesce(whole, own) AS dir_license FROM marked
  WHERE whole IS NOT NULL OR (own IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_NAME}'))
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path, dir_license) = 1),
above AS (
  SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:n], '/') AS licence_dir
  FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM marked))),
nearest AS (
  SELECT dir, licence_dir, dir_license FROM above JOIN licensed USING (licence_dir)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(licence_dir) DESC) = 1)
SELECT doc_id, path, coalesce(own, dir_license) AS license,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' END AS origin, similarity,
       CASE WHEN own IS NULL THEN licence_dir END AS licence_dir
FROM marked LEFT JOIN nearest USING (dir)
"""

_TERMS = f"regexp_extract_all({_fold('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL_SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
full_docs AS (SELECT d, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS N_docs, sum(n)::BIGINT AS L FROM full_docs),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS terms FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT i, item_id, unnest(terms) AS term FROM items),
tfs AS (
  SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM full_docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * N_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, N_docs),
impacts AS (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * N_docs) // L)))) AS impact
  FROM tfs JOIN weights USING (term), totals),
scored AS (SELECT i, item_id, d, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

ORACLES = {
    "op1_url_filters": URL_FILTERS,
    "op3_line_dedup": LINE_DEDUP,
    "op5_license_scans": LICENSE_SCANS,
    "op9_quality_rules": QUALITY_RULES,
    "op12_lexical_search": LEXICAL_SEARCH,
}
