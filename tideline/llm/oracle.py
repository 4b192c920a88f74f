"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

_QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
often AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS at FROM windows JOIN often USING (doc_id, win)),
repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_alpha, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM d LEFT JOIN repeated r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 7 * word_chars AND NOT (2 * n_upper > n_alpha AND n_alpha > 0)
         AND 2 * n_bangs <= n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 2 * n_dup_lines <= n_lines AS kept
FROM b
"""

_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id != b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * common >= 75 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_LLOYD_START = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(x, p * (len(x) // 8) + 1, (p + 1) * (len(x) // 8)) AS z FROM kept, (SELECT unnest(generate_series(0, 7)) AS p)),
c0 AS MATERIALIZED (SELECT p, e, z AS c FROM (SELECT p, z, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 16)"""
_LLOYD_ROUND = """,
a{k} AS MATERIALIZED (
  SELECT vec_id, p, z, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d
  FROM (SELECT vec_id, p, z, e, list_sum(list_transform(list_zip(z, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM parts JOIN c{k} USING (p))
  GROUP BY vec_id, p, z)"""
_LLOYD_UPDATE = """,
s{k} AS MATERIALIZED (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, e, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM a{k}) GROUP BY p, e, i),
m{k} AS MATERIALIZED (SELECT p, e, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY p, e),
c{next} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m ON m.p = o.p AND m.e = o.e)"""
_LLOYD_END = """,
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (vec_id)),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM labelled, books
"""
#: Six rounds of assignment and update, then the last assignment.
_LLOYD = _LLOYD_START + "".join(_LLOYD_ROUND.format(k=k) + _LLOYD_UPDATE.format(k=k, next=k + 1) for k in range(6)) + _LLOYD_ROUND.format(k=6) + _LLOYD_END

ORACLE_SQL: dict[str, str] = {"op12_vector_codes": _LLOYD, "op7_quality_rules": _QUALITY, "op9_ngram_jaccard_join": _JACCARD}
