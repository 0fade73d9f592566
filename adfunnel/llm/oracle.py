"""DuckDB SQL of the operators that SQL can express, each written from the operator's definition."""

from __future__ import annotations

from adfunnel.llm import quality

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Least id reachable over links (a, b both ways), for ids in v.
_REACH = """
reach(id, root) AS (
  SELECT id, id FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b
),
component AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
"""


def op1(k: int = 2, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' '))) END AS s FROM d),
v AS (SELECT id, len(s) AS n FROM sets),
shingle AS (SELECT id, unnest(s) AS x FROM sets),
shared AS (SELECT p.id AS a, q.id AS b, count(*) AS m FROM shingle p JOIN shingle q ON p.x = q.x AND p.id < q.id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)),
links AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
{_REACH}
SELECT v.id AS doc_id, v.n::BIGINT AS n_shingles, root AS component_id, v.id = root AS kept FROM v JOIN component USING (id)
"""


OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.id <> q.id AND len(p.e) = len(q.e) WHERE list_inner_product(p.e, q.e) / (p.n * q.n) >= 0.9),
{_REACH}
SELECT v.id AS vec_id, (SELECT count(*) FROM links WHERE a = v.id) AS n_links, root AS component_id, v.id = root AS kept FROM v JOIN component USING (id)
"""


def _em() -> str:
    """The estimation, a pair of common tables per round, over the counted vote patterns."""
    names = [n for n, _, _ in quality.RULES]
    good = " + ".join(f"(v_{n} > 0)::INT" for n in names)
    cast = " + ".join(f"(v_{n} <> 0)::INT" for n in names)
    out = [f"q0 AS MATERIALIZED (SELECT *, (1.0::DOUBLE + {good}) / (2.0 + {cast}) AS q FROM pattern)"]
    for i in range(quality.ROUNDS):
        sums = ", ".join(f"sum(n * q) FILTER (v_{n} = {v}) AS g_{n}_{v + 1}, sum(n * (1 - q)) FILTER (v_{n} = {v}) AS b_{n}_{v + 1}" for n in names for v in (-1, 0, 1))
        out.append(f"m{i} AS MATERIALIZED (SELECT sum(n * q) AS g, sum(n * (1 - q)) AS b, {sums} FROM q{i})")
        score = "ln((g + 1) / (b + 1)) + " + " + ".join("CASE v_" + n + " " + " ".join(f"WHEN {v} THEN ln((coalesce(g_{n}_{v + 1}, 0) + 1) / (g + 3)) - ln((coalesce(b_{n}_{v + 1}, 0) + 1) / (b + 3))" for v in (-1, 0, 1)) + " END" for n in names)
        out.append(f"q{i + 1} AS MATERIALIZED (SELECT {', '.join('v_' + n for n in names)}, n, 1 / (1 + exp(-({score}))) AS q FROM q{i}, m{i})")
    return ",\n".join(out)


def op3() -> str:
    names = [n for n, _, _ in quality.RULES]
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{n}" for n, bad, good in quality.RULES)
    on = ", ".join("v_" + n for n in names)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
window3 AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS x FROM d WHERE len(w) >= 3),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, x) AS n FROM window3),
covered AS (SELECT row, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY row),
feats AS (SELECT d.row, doc_id, len(w)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  (length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper, (length(text) - length(translate(text, '!', '')))::BIGINT AS n_exclaims,
  (length(text) - length(translate(text, '0123456789', '')))::BIGINT AS n_digits, len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?')))::BIGINT AS n_ends,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered ON covered.row = d.row),
voted AS (SELECT *, {votes} FROM feats),
pattern AS MATERIALIZED (SELECT {on}, count(*)::DOUBLE AS n FROM voted GROUP BY {on}),
{_em()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND q >= {quality.MIN_POSTERIOR} AS kept
FROM voted JOIN q{quality.ROUNDS} USING ({on})
"""


OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i : i + 19], ' '))) AS x FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: min_lines 2
OP10 = """
WITH line AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
full_line AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
run AS (SELECT p.doc_id, p.j, row_number() OVER (PARTITION BY p.x, q.x ORDER BY p.doc_id, p.j) AS k FROM full_line p JOIN full_line q ON p.doc_id = q.doc_id AND q.j = p.j + 1),
gone AS (SELECT DISTINCT doc_id, i FROM full_line JOIN (SELECT doc_id, unnest([j, j + 1]) AS j FROM run WHERE k > 1) USING (doc_id, j)),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text, coalesce((SELECT count(*) FROM full_line f WHERE f.doc_id = d.doc_id), 0) AS n_lines, coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""


_PLAIN_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_PLAIN_WORDS} AS w FROM benchmark),
size AS (SELECT DISTINCT least(10, len(w)) AS k FROM b WHERE len(w) > 0),
test AS (SELECT DISTINCT item, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
place AS (SELECT row, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS x FROM d, size WHERE len(w) >= k),
hit AS (SELECT row, i, k, item FROM place JOIN test USING (k, x)),
word AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + k)) AS p FROM hit) GROUP BY row),
item AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (row) LEFT JOIN item USING (row)
"""

#: Prefixes are named by the digest of their length and all their turns, each with the lengths of its parts.
OP13 = """
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
byte AS (SELECT unnest(range(256)) AS b),
crc AS (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM byte),
crcs AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM crc),
conv AS (SELECT DISTINCT conv_id FROM own),
conv_h AS (SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS source, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM conv, crcs),
turn AS (SELECT c.conv_id, o.place, o.role, o.text FROM conv_h c JOIN own o ON o.conv_id = c.source AND o.place < c.h
  UNION ALL SELECT c.conv_id, o.place, o.role, o.text FROM conv_h c JOIN own o ON o.conv_id = c.conv_id AND o.place >= c.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, sha256(length(role) || ':' || role || text) AS x, strlen(text) AS bytes FROM turn),
prefix AS (SELECT conv_id, depth, bytes, sha256(depth || ':' || string_agg(x, '' ) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS p FROM numbered
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM conv),
node AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM prefix GROUP BY p, depth),
top AS (SELECT conv_id, max(depth) AS depth FROM prefix GROUP BY conv_id),
ends AS (SELECT p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM prefix JOIN top USING (conv_id, depth) GROUP BY p),
edge AS (SELECT DISTINCT a.p AS parent, b.p AS child FROM prefix a JOIN prefix b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
kids AS (SELECT parent AS p, count(*) AS n FROM edge GROUP BY parent),
under AS (SELECT DISTINCT a.p AS top, b.p AS p FROM prefix a JOIN prefix b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
below AS (SELECT top AS p, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((node.n - 1) * node.bytes) AS saved FROM under JOIN node USING (p) LEFT JOIN kids USING (p) GROUP BY top)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p) LEFT JOIN edge ON edge.child = node.p LEFT JOIN node up ON up.p = edge.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": op1(), "op2_embedding_near_dedup": OP2, "op3_quality_rules": op3(), "op5_substring_dedup": OP5, "op10_line_dedup": OP10, "op11_benchmark_decontamination": OP11, "op13_conversation_trie": OP13}
