"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
dup AS (
  SELECT rid, i FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
  QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
ln AS (
  SELECT rid, source, u, lower(array_to_string(lw, ' ')) AS norm, len(lw) AS n
  FROM (SELECT rid, source, u, regexp_extract_all(u, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS u FROM d))
  WHERE len(lw) > 0),
frequent AS (SELECT source, norm FROM ln GROUP BY source, norm HAVING count(DISTINCT rid) > 30),
gone AS (
  SELECT ln.rid, count(*) AS k, sum(ln.n) AS n FROM ln JOIN frequent f ON ln.norm = f.norm AND ln.source IS NOT DISTINCT FROM f.source GROUP BY ln.rid),
per AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT u) AS dups FROM ln GROUP BY rid),
base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(per.dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(per.n_lines, 0)::BIGINT AS n_lines, coalesce(gone.k, 0)::BIGINT AS removed_lines, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN per USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_lines, removed_lines, removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= 50 * n_words AS kept
FROM base
"""

PHRASES = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
runs AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3, 4]) AS m FROM pieces WHERE len(ws) > 0)),
found AS (
  SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM runs) GROUP BY lang, m, phrase HAVING count(*) >= 30),
cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM found WHERE m > 1),
subs AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS covering
  FROM (SELECT lang, ws, a, m, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT lang, ws, a, m, unnest(range(2, m)) AS s FROM cand WHERE m > 2)) GROUP BY ALL),
alone AS (SELECT c.* FROM cand c LEFT JOIN subs s ON s.lang = c.lang AND s.phrase = c.phrase WHERE s.covering IS NULL OR 100::HUGEINT * s.covering < 80::HUGEINT * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT lang, phrase, a, ws, m, unnest(range(1, m)) AS k FROM alone) c
  JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN total USING (lang) WHERE rank <= 2000
"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codebooks and codes by comparing every part with every entry."""
    head = f"""
WITH v AS (
  SELECT *, len(x) // {parts} AS width FROM (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
c AS (SELECT rid, (i - 1) // width AS part, (i - 1) % width AS pos, x[i] AS val FROM (SELECT rid, x, width, unnest(range(1, len(x) + 1)) AS i FROM v)),
book0 AS (
  SELECT part, entry, pos, val FROM (SELECT rid, row_number() OVER (ORDER BY vec_id, x) - 1 AS entry FROM v) s JOIN c USING (rid) WHERE entry < {entries})"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
to{k} AS (
  SELECT rid, part, entry, d FROM (SELECT c.rid, c.part, b.entry, sum((c.val - b.val) * (c.val - b.val)) AS d FROM c JOIN book{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS (
  SELECT b.part, b.entry, b.pos, coalesce(m.val, b.val) AS val FROM book{k} b
  LEFT JOIN (SELECT part, entry, pos, ((s - ((s % n) + n) % n) // n)::BIGINT AS val
    FROM (SELECT c.part, t.entry, c.pos, sum(c.val) AS s, count(*) AS n FROM c JOIN to{k} t ON c.rid = t.rid AND c.part = t.part GROUP BY ALL)) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    return head + ",".join(["", *steps]) + f""",
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM to{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (rid), digest
"""
