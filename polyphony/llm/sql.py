"""SQL twins of the text queries that SQL can express on whole tables.

``p1_found`` is exact set arithmetic and is written out by prefix filtering: two sets of similarity 0.6 or more share
twenty (or all they share) among the rarest shingles of each, as many as a set can lack plus twenty.  The other queries rest on fitted models, merges in
order of rank, sequential packing or alignments, and are tested against brute force, exact round trips or held-out
labels in ``tests/llm``.
"""

from __future__ import annotations

P1_FOUND = r"""
WITH norm AS (
  SELECT gen_id, trim(regexp_replace(lower(response_text), '[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+', ' ', 'g')) AS t
  FROM responses WHERE gen_id IS NOT NULL AND response_text IS NOT NULL
),
rec AS (SELECT DISTINCT gen_id, t FROM norm WHERE length(t) >= 300),
cls AS (SELECT t, row_number() OVER () AS c FROM (SELECT DISTINCT t FROM rec)),
grams AS (SELECT DISTINCT c, hash(substring(t, i, 8)) AS g FROM cls, unnest(range(1, length(t) - 6)) AS u(i)),
ranked AS (
  SELECT c, g, row_number() OVER (PARTITION BY c ORDER BY f, g) AS k, count(*) OVER (PARTITION BY c) AS n
  FROM (SELECT c, g, count(*) OVER (PARTITION BY g) AS f FROM grams)
),
head AS (SELECT c, g, n FROM ranked WHERE k <= n - ceil(0.6 * n) + 20),
cand AS (
  SELECT a.c AS a, b.c AS b FROM head a JOIN head b ON a.g = b.g AND a.c < b.c AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n
  GROUP BY a.c, b.c HAVING count(*) >= least(20, ceil(0.6 * greatest(any_value(a.n), any_value(b.n))))
),
sets AS (SELECT c, list(g) AS s FROM grams GROUP BY c),
near AS (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS common, len(x.s) + len(y.s) AS total FROM cand JOIN sets x ON x.c = a JOIN sets y ON y.c = b)
  WHERE common >= 0.6 * (total - common)
),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near UNION ALL SELECT c, c FROM cls),
mem AS (SELECT gen_id, c FROM rec JOIN cls USING (t))
SELECT DISTINCT x.gen_id AS gen_id_a, y.gen_id AS gen_id_b FROM links JOIN mem x ON x.c = a JOIN mem y ON y.c = b WHERE x.gen_id < y.gen_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND}
