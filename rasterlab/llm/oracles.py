"""DuckDB statements for the queries whose whole result SQL can express."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 2 THEN ws[k] || ' ' || ws[k + 1] ELSE ws[k] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""

OP7_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7 = f"""
WITH i AS (SELECT item_id, {OP7_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
d AS (SELECT doc_id, {OP7_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, sizes WHERE len(ws) >= size)),
hit AS (SELECT doc_id, size, k, item_id FROM dw JOIN iw USING (size, win)),
word AS (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM (SELECT DISTINCT doc_id, size, k FROM hit)),
found AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN per USING (doc_id)"""

OP8 = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, k, ls[k] AS line, {_LOW.format("trim(ls[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM t)),
held AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, held.key IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
      [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS d FROM t),
c AS (SELECT *, len(us)::BIGINT AS n, least(d[1] % (len(us) + 1), d[2] % (len(us) + 1)) AS a, greatest(d[1] % (len(us) + 1), d[2] % (len(us) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
           WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


def _kmeans(k: int = 16, rounds: int = 3) -> str:
    """Plain assignment and update steps, one pair of tables for each round."""
    steps = ["""
v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
      WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
e AS (SELECT vec_id, unnest(x) AS x, unnest(range(64)) AS i FROM v),
c0 AS (SELECT c, unnest(x) AS x, unnest(range(64)) AS i FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c FROM v) WHERE c < %d)""" % k]
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, c, sum((e.x - m.x) * (e.x - m.x))::BIGINT AS d FROM e JOIN c{r} m USING (i) GROUP BY ALL),
a{r} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY ALL),
c{r + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, o.x) AS x FROM c{r} o LEFT JOIN m{r} USING (c, i))""")
    return "WITH" + ",".join(steps) + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN h USING (c)"""


OP13 = _kmeans()

ORACLES = {
    "op1_tensored_minhash": OP1, "op7_suffix_automaton": OP7, "op8_shared_lines": OP8, "op11_fill_in_middle": OP11, "op13_shallot_clusters": OP13,
}
