r"""The same results in plain SQL (DuckDB), where SQL can express an operator.

Each states the contract directly, by comparing everything that its tables
hold, and not the operator's method; it is for checks on small tables.
"""

WORDS = r"'[^\x20\x09-\x0D]+'"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM per),
shared AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget, sum(cap) OVER up - cap AS capped, sum(weight) OVER () - sum(weight) OVER up + weight AS open_weight
  FROM ranked WINDOW up AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT cap / weight AS ratio, (budget - capped) / open_weight AS level FROM shared WHERE (budget - capped) / open_weight * weight <= cap ORDER BY 1, 2 LIMIT 1),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM levels) * weight, cap)) AS target FROM shared),
queue AS (
  SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT *, CAST(done + round * source_size AS DOUBLE) / target AS finish FROM queue, range(0, 2) r(round)
  WHERE size > 0 AND target > 0 AND CAST(done + round * source_size AS DOUBLE) / target <= 1 + CAST(size AS DOUBLE) / target),
lined AS (SELECT *, sum(size) OVER (ORDER BY finish, doc_id, source, size, round ROWS UNBOUNDED PRECEDING) AS total FROM entries),
got AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM lined WHERE total <= (SELECT sum(size) * 3 // 2 FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(taken, 0) AS taken FROM queue q LEFT JOIN got USING (doc_id)
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT x.doc_id, i + k AS i FROM x JOIN f USING (h), range(0, 50) r(k) WHERE least < x.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM g),
often AS (SELECT t, row_number() OVER () AS k FROM (SELECT t FROM e GROUP BY t HAVING count(*) > 1)),
p AS (SELECT doc_id, n, k FROM e JOIN often USING (t)),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.k = y.k AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, s.b FROM reach r JOIN both_ways s ON r.b = s.a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(m.b, g.doc_id)) AS component_id
FROM g LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = g.doc_id
"""

ORACLES = {"op2_source_mixing": OP2, "op3_substring_dedup": OP3, "op4_ngram_jaccard_join": OP4}
