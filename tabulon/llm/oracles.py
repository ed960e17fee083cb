"""Checking SQL of the queries that DuckDB can express."""

from __future__ import annotations

from tabulon.llm import licenses

OP1 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS nth
  FROM p LEFT JOIN rules r ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)),
best AS (SELECT * FROM judged WHERE nth = 1),
alias AS (
  SELECT page_id, CASE WHEN host = '' THEN NULL ELSE
         regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?|/+)$', '') END AS k
  FROM best),
hit AS (SELECT DISTINCT k FROM alias JOIN best USING (page_id) WHERE rule_verdict = 'block' AND k IS NOT NULL)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN k IN (SELECT k FROM hit) THEN 'block' END, 'allow') AS verdict,
       coalesce(k IN (SELECT k FROM hit), false) AS component_blocked
FROM best JOIN alias USING (page_id)
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, len(s) AS k FROM sh),
g AS (SELECT doc_id, unnest(s) AS t FROM sh),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.k + y.k - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r)
SELECT n.doc_id, CAST(k AS BIGINT) AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2
"""

OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(t, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT)
         AS formatted_chars,
       regexp_full_match(string_agg(role, ',' ORDER BY turn, role, t), '(system,)?user,assistant((,tool)?,assistant|,user,assistant)*')
         AND NOT regexp_matches(string_agg(role, ',' ORDER BY turn, role, t), 'assistant,assistant') AS valid
FROM c GROUP BY conv_id
"""

OP6 = r"""
WITH templates AS (SELECT * FROM (VALUES {templates}) t(template, license, notice)),
files AS (
  SELECT doc_id, text,
         concat_ws('/', source, lang, 'part' || (doc_id % 40),
                   CASE WHEN regexp_matches(split_part(text, chr(10), 1), '{signal}') THEN 'LICENSE.' ELSE 'text.' END || doc_id) AS path
  FROM documents),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM files),
tt AS (SELECT template, license, unnest(list_filter(string_split_regex(lower(notice), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM templates),
tf AS (SELECT template, license, term, count(*) AS tf FROM tt GROUP BY ALL),
voc AS (SELECT DISTINCT term FROM tf),
docterms AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM files),
df AS (SELECT term, count(*) AS df FROM docterms SEMI JOIN voc USING (term) GROUP BY term),
idf AS (SELECT term, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf FROM voc LEFT JOIN df USING (term), total),
tw AS (SELECT template, license, term, tf * idf AS w FROM tf JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1),
sent AS (
  SELECT path, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS s,
         generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), 1) AS place
  FROM files WHERE regexp_matches(text, '{signal}')),
terms AS (SELECT path, place, unnest(list_filter(string_split_regex(lower(s), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM sent WHERE regexp_matches(s, '{signal}')),
sw AS (SELECT path, place, term, count(*) * coalesce(any_value(idf), (SELECT ln(1 + n) + 1 FROM total)) AS w FROM terms LEFT JOIN idf USING (term) GROUP BY 1, 2, 3),
sn AS (SELECT path, place, sqrt(sum(w * w)) AS norm FROM sw GROUP BY 1, 2),
sim AS (
  SELECT path, license, round(sum(sw.w * tw.w) / (any_value(sn.norm) * any_value(tn.norm)), 6) AS cosine
  FROM sw JOIN tw USING (term) JOIN sn USING (path, place) JOIN tn USING (template) GROUP BY path, place, template, license),
own AS (
  SELECT path, license, cosine FROM sim WHERE cosine >= 0.7
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1),
dirs AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, cosine FROM own WHERE regexp_matches(path, '/LICENSE[^/]*$')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY cosine DESC, license) = 1)
SELECT f.doc_id, f.path, coalesce(own.license, dirs.license) AS license, coalesce(own.cosine, dirs.cosine) AS cosine,
       CASE WHEN own.license IS NOT NULL THEN 'notice' WHEN dirs.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.license IS NULL THEN dirs.dir END AS license_dir
FROM files f LEFT JOIN own ON f.path = own.path LEFT JOIN dirs ON regexp_replace(f.path, '/[^/]*$', '') = dirs.dir
""".replace("{templates}", ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))).replace("{signal}", licenses.SIGNAL)

def _clustering(rounds: int = 5, k: int = 40) -> str:
    """Lloyd's algorithm with every round written out; a mean's floor is that of an exact integer quotient."""
    steps = ["""
e AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(CAST(c AS DOUBLE)))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, v FROM e
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) <= {k})""".format(k=k)]
    distance = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT vec_id, v, j, CAST(d AS BIGINT) AS d FROM (SELECT row, vec_id, e.v AS v, c.j, {distance} AS d
                                   FROM (SELECT row_number() OVER () AS row, * FROM e) e, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, j) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
  FROM (SELECT j, i, sum(x) AS s, count(*) AS n
        FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY j, i) GROUP BY j),
c{r + 1} AS (SELECT c.j, list_transform(coalesce(m.v, c.v), lambda x: CAST(x AS BIGINT)) AS v FROM c{r} c LEFT JOIN m{r} m ON c.j = m.j)""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j
"""


OP12 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v
        FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
         translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
kinds AS (SELECT doc, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY doc, run),
bytes AS (
  SELECT doc, run, times,
         flatten(list_transform(string_split(doc || ':' || run, ''),
                 lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS b
  FROM kinds),
hashed AS (
  SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM bytes, crc_table),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
        FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, left(word, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS rest FROM places),
near AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
judged AS (
  SELECT w.word, CASE WHEN m >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
follow(word, last, step) AS (
  SELECT word, word, 0 FROM judged
  UNION ALL SELECT f.word, j.form, step + 1 FROM follow f JOIN judged j ON f.last = j.word WHERE j.form IS NOT NULL)
SELECT j.word, form, root, n, n_near, form_n
FROM judged j JOIN (SELECT word, arg_max(last, step) AS root FROM follow GROUP BY word) r ON j.word = r.word
"""

OP13 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
starts AS (SELECT row, doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS s FROM d),
windows AS (SELECT row, coalesce(doc_id, 9223372036854775807) AS doc, s, array_to_string(ws[s:s + 19], ' ') AS w FROM starts),
repeated AS (
  SELECT row, s FROM (SELECT row, s, doc > min(doc) OVER (PARTITION BY w) OR s > min(s) OVER (PARTITION BY w, row) AS again FROM windows) WHERE again),
gone AS (SELECT row, list_distinct(flatten(list(range(s, s + 20)))) AS places FROM repeated GROUP BY row),
marked AS (SELECT d.row, doc_id, ws, places FROM d LEFT JOIN gone g ON d.row = g.row),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT row, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) x
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT row, unnest(places) AS i FROM gone) g WHERE g.row = x.row AND g.i = x.i) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM marked m LEFT JOIN kept k ON m.row = k.row
"""

SQL = {
    "op1_url_filter": OP1, "op4_exact_top_k": OP4, "op6_license_scan": OP6, "op7_ngram_jaccard": OP7, "op10_chat_format": OP10,
    "op11_centroid_clustering": _clustering(), "op12_spelling_variants": OP12, "op13_substring_dedup": OP13,
}
