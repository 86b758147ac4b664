"""DuckDB SQL of the corpus queries that SQL can express, written from their definitions."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""

_FILL = """
{name}_n AS (SELECT *, coalesce(sum(cap) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, row_number() OVER t AS pos
       FROM ({nodes}) WINDOW t AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / weight::DOUBLE, {leaf})),
{name}_f AS (SELECT *, min(CASE WHEN cap * ahead > greatest(budget - filled, 0) * weight THEN pos END) OVER (PARTITION BY {parent}) AS open_at
       FROM {name}_n),
{name} AS (SELECT f.{cols}, CASE WHEN f.open_at IS NULL OR f.pos < f.open_at THEN f.cap
           ELSE (greatest(o.budget - o.filled, 0) * f.weight) // o.ahead END AS budget
       FROM {name}_f f LEFT JOIN {name}_f o ON {same} AND o.pos = f.open_at)"""

OP10 = f"""
WITH docs AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         coalesce('d' || (('0x' || substr(md5(source), 1, 2))::INT % 4), '(none)') AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 3 * sum(n_tokens)::HUGEINT AS cap FROM docs GROUP BY ALL),
{_FILL.format(name="top", parent="1", leaf="domain", cols="domain", same="true", nodes="""
  SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) FROM leaves) // 2 AS budget,
         CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY domain""")},
{_FILL.format(name="mid", parent="domain", leaf="lang", cols="domain, f.lang", same="o.domain = f.domain", nodes="""
  SELECT domain, lang, sum(cap) AS cap, any_value(top.budget) AS budget,
         CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight
  FROM leaves JOIN top USING (domain) GROUP BY domain, lang""")},
{_FILL.format(name="low", parent="domain, lang", leaf="source", cols="domain, f.lang, f.source",
              same="o.domain = f.domain AND o.lang = f.lang", nodes="""
  SELECT domain, lang, source, cap, mid.budget AS budget, 1 AS weight FROM leaves JOIN mid USING (domain, lang)""")},
plan AS (SELECT domain, lang, source, tokens, low.budget AS budget,
                CASE WHEN tokens > 0 THEN least(low.budget // tokens, 3) ELSE 0 END AS whole
         FROM leaves JOIN low USING (domain, lang, source)),
ordered AS (SELECT docs.*, tokens, budget, whole, sum(n_tokens) OVER (
              PARTITION BY domain, lang, source ORDER BY md5('7:' || whole || ':' || doc_id), doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM docs JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, whole + CASE WHEN budget - whole * tokens > 0 AND upto <= budget - whole * tokens THEN 1 ELSE 0 END AS copies FROM ordered)
SELECT doc_id, domain, lang, source, unnest(range(0, copies::BIGINT))::INT AS epoch, n_tokens::BIGINT AS n_tokens,
       tokens::BIGINT AS leaf_tokens, budget::BIGINT AS leaf_budget
FROM taken WHERE copies > 0
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

#: CRC-32 of a decimal number's ASCII digits
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))))"""

OP11 = f"""
WITH own AS (SELECT conv_id, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS id, length(coalesce(text, '')) AS chars,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
             FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format(x='conv_id')} % 6 AS h FROM own GROUP BY conv_id),
turns AS (SELECT c.conv_id, 0 AS tail, pos, id, chars FROM c JOIN own ON own.conv_id = base AND pos <= h
          UNION ALL SELECT conv_id, 1, pos, id, chars FROM c JOIN own USING (conv_id) WHERE pos > h),
lists AS (SELECT conv_id, list(id ORDER BY tail, pos) AS ids, list(chars ORDER BY tail, pos) AS chars FROM turns GROUP BY conv_id
          UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM turns)),
path AS (SELECT conv_id, unnest(range(0, len(ids) + 1)) AS depth, ids, chars FROM lists),
member AS (SELECT conv_id, depth, md5(array_to_string(ids[1:depth], ',')) AS node, md5(array_to_string(ids[1:depth - 1], ',')) AS up,
             CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END AS chars, depth = len(ids) AS ends FROM path),
node AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
           coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ids
         FROM member GROUP BY depth, node),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM node n LEFT JOIN node p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.up),
born AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN born USING (depth, node)),
sums AS (SELECT m.depth, m.node, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
         FROM counted v JOIN member m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(ids) AS ends_sha256
FROM counted JOIN sums USING (depth, node)
"""

OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT uid, doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT uid) >= 3),
j AS (SELECT k.*, f.key IS NOT NULL AND doc_id IS DISTINCT FROM keep AS dropped FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY uid
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS terms FROM documents),
corpus AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS big_n, greatest(sum(len(terms)), 1)::BIGINT AS big_l FROM d),
tf AS (SELECT uid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
posting AS (SELECT uid, doc_id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM posting, corpus GROUP BY term),
b AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS terms FROM benchmark),
q AS (SELECT qid, item_id, unnest(terms) AS term FROM b),
s AS (SELECT qid, item_id, uid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN posting USING (term), corpus GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST, uid)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op13_lexical_search": OP13, "op12_line_dedup": OP12, "op11_prefix_trie": OP11, "op8_maxscore_topk": OP8, "op6_exact_dedup": OP6, "op10_source_mixing": OP10}
