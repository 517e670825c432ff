"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _clustering(k: int, rounds: int) -> str:
    """Lloyd's rounds in whole numbers, one step of the query after the other."""
    steps = [
        "vec AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY name, v) - 1 AS cluster, v AS c FROM (SELECT sha256('3:' || vec_id) AS name, v FROM vec ORDER BY name, v LIMIT {k}))",
    ]
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(distance := d, cluster := cluster)) AS best"
            f" FROM (SELECT vec_id, n, v, cluster, {apart} AS d FROM (SELECT *, row_number() OVER () AS n FROM vec), c{r}) GROUP BY vec_id, n)"
        )
        # The floor of the mean: division of integers cuts towards zero, so the remainder is taken off first.
        mean = "list((s - ((s % n) + n) % n) // n ORDER BY d)"
        sums = f"SELECT best.cluster AS cluster, d, sum(v[d])::BIGINT AS s, count(*) AS n FROM (SELECT best, v, unnest(range(1, 65)) AS d FROM a{r}) GROUP BY ALL"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT cluster, {mean} AS c FROM ({sums}) GROUP BY cluster) m USING (cluster))")
    return f"""
WITH {", ".join(steps[:-1])}
SELECT vec_id, best.cluster::INT AS cluster, best.distance AS distance,
       sum(best.distance) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia, sum(best.distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


ORACLE: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACES}') AS ws FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p + 1 : p + 50], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS p FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, list(win.p) AS ps FROM win JOIN least USING (h) WHERE first_doc < win.doc_id GROUP BY win.doc_id),
gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) AS g FROM hit),
gone_word AS (SELECT doc_id, unnest(g) AS p FROM gone),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM word ANTI JOIN gone_word USING (doc_id, p) GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_line_dedup": rf"""
WITH line AS (
  SELECT doc_id, p, ls[p] AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
keyed AS (SELECT *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM line),
many AS (
  SELECT key, max(doc_id) AS keep_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, keep_doc IS NOT NULL AND keep_doc <> doc_id AS gone FROM keyed LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS ws FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[p + 1 : p + least(13, len(ws))], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(0, len(ws) - least(13, len(ws)) + 1)) AS p FROM b WHERE len(ws) > 0)),
win AS (
  SELECT doc_id, m, p, array_to_string(ws[p + 1 : p + m], ' ') AS s
  FROM (SELECT doc_id, m, ws, unnest(range(0, len(ws) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM pat) WHERE len(ws) >= m)),
found AS (SELECT doc_id, item_id, m, p FROM win JOIN pat USING (m, s)),
hit AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS w FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACES}') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(0, len(ws) - 3), lambda p: array_to_string(ws[p + 1 : p + 4], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sets USING (doc_id) GROUP BY w.doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, y AS r FROM reach JOIN link ON reach.r = link.x)
SELECT n.doc_id, n AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n""",
    "op11_centroid_clustering": _clustering(8, 10),
    "op13_chat_formatting": rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + length('<|im_start|><|im_end|>') + 2
           + len(regexp_extract_all(text, '<\\*(\||s>|/s>|<SYS>>|</SYS>>)|\[\\*/?INST\]')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id""",
}
