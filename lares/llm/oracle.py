"""DuckDB SQL of the queries that SQL can express, written out independently of the operators."""

from __future__ import annotations

_SPACES = r"[\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
cut AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACES}'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM cut),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
twice AS (SELECT doc_id, i FROM windows QUALIFY COUNT(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(COALESCE(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
    CAST(len(list_filter(w, lambda x: x IN (
      'the', 'of', 'and', 'to', 'in', 'that', 'is', 'was', 'for', 'on', 'are', 'with', 'as', 'it', 'be', 'by', 'this',
      'from', 'or', 'an', 'at', 'a', 'he', 'der', 'die', 'das', 'und', 'zu', 'den', 'von', 'mit', 'sich', 'des', 'auf',
      'für', 'ist', 'im', 'dem', 'nicht', 'ein', 'eine', 'de', 'la', 'que', 'el', 'en', 'y', 'los', 'se', 'del', 'las',
      'un', 'por', 'con', 'una', 'su', 'para', 'es', 'al', 'le', 'et', 'les', 'du', 'une', 'dans', 'au', 'pour', 'est',
      'qui', 'il', 'sur', 'ce', 'pas', 'avec'))) AS BIGINT) AS n_stop
  FROM cut LEFT JOIN covered USING (doc_id)
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND n_symbols <= 0.25 * n_words
  AND n_bangs <= 0.5 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_stop >= 0.02 * n_words AS kept
FROM failed"""

JACCARD_JOIN = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM cut)
),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = other
)
SELECT doc_id, CAST(COALESCE(ANY_VALUE(n), 0) AS BIGINT) AS n_shingles, MIN(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS t
  FROM documents
),
sums AS (SELECT COUNT(*) AS n_docs, CAST(SUM(len(t)) AS BIGINT) AS n_terms FROM cut WHERE len(t) > 0),
tf AS (
  SELECT doc_id, n, term, COUNT(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM cut) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, n_docs
),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term
  FROM benchmark
),
repeated AS (SELECT item_id, term, COUNT(*) AS repeats FROM asked GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
    CAST(SUM(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM repeated JOIN weights USING (term) JOIN tf USING (term), sums GROUP BY item_id, doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
