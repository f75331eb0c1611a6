"""DuckDB SQL for the queries that SQL can express over whole tables."""

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS r, a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.r <> b.r
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""

OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM lines
), often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(often.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.key = often.key GROUP BY doc_id
"""


def op3(rules, terms, min_soft: float) -> str:
    host = f"CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END"
    path = "CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    word = lambda t: f"(regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])'))"
    strict_hit = " OR ".join(word(t) for t, kind, _ in terms if kind == "strict")
    soft_hits = " + ".join(f"{weight}::DOUBLE * {word(t)}::INTEGER" for t, kind, weight in terms if kind == "soft")
    return f"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {values}),
p AS (SELECT page_id, url, {host} AS host, {path} AS path, CASE WHEN {strict_hit} OR {soft_hits} >= {min_soft} THEN 'block' ELSE 'allow' END AS words FROM pages),
fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM p JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, words) AS verdict FROM p LEFT JOIN fit ON p.page_id = fit.page_id
"""


OP7 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), last AS (SELECT hex, max(page_id) AS m FROM p GROUP BY hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(p.hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < m THEN m END AS refers_to
FROM p JOIN last ON p.hex = last.hex
"""


OP11 = """
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.r AS r, a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.r <> b.r
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""


def crc32(byte_list: str) -> str:
    """Unsigned CRC-32 of a list of BIGINT bytes, bit by bit."""
    step = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte))"
    return f"xor(list_reduce({byte_list}, lambda crc, byte: {step}, 4294967295::BIGINT), 4294967295)"


OP12 = f"""
WITH t AS (
  SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, {crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, r, x FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, r, x FROM convs c JOIN t ON t.conv_id = c.conv_id AND pos > h
), seqs AS (
  SELECT c.conv_id, coalesce(list({{'r': r, 'x': x}} ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS seq FROM convs c LEFT JOIN rebuilt ON rebuilt.conv_id = c.conv_id GROUP BY c.conv_id
), starts AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM seqs
), nodes AS (
  SELECT list_slice(seq, 1, d) AS p, d, min(conv_id) AS m, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = d) AS ends FROM starts GROUP BY 1, 2
), below AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), told AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n - 1) * strlen(nodes.p[d].x) ELSE 0 END AS w FROM nodes LEFT JOIN below ON nodes.p = below.p
), above AS (SELECT p, w, n_children, unnest(range(0, d + 1)) AS a FROM told
), sums AS (SELECT list_slice(p, 1, a) AS p, sum(w) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY 1)
SELECT told.m AS conv_id, told.d::BIGINT AS depth, up.m AS parent_conv_id, told.n AS n_convs, told.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(told.ends, '')) AS ends_sha256
FROM told JOIN sums ON told.p = sums.p LEFT JOIN nodes up ON told.d > 0 AND up.p = list_slice(told.p, 1, told.d - 1)
"""

_RUNS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_RUNS} AS words FROM documents
), own AS (SELECT r, unnest(words) AS w FROM docs
), told AS (SELECT unnest({_RUNS}) AS w FROM benchmark
), buckets AS (
  SELECT w, {crc32("list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)")} % 10000 AS b FROM (SELECT w FROM own UNION SELECT w FROM told)
), s AS (SELECT b, count(*)::DOUBLE AS s FROM own JOIN buckets ON own.w = buckets.w GROUP BY b
), t AS (SELECT b, count(*)::DOUBLE AS t FROM told JOIN buckets ON told.w = buckets.w GROUP BY b
), gain AS (
  SELECT s.b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS g FROM s LEFT JOIN t ON s.b = t.b
), weights AS (
  SELECT r, count(*) AS n_features, sum(g) AS weight FROM own JOIN buckets ON own.w = buckets.w JOIN gain ON gain.b = buckets.b GROUP BY r
), scored AS (
  SELECT docs.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights ON docs.r = weights.r
), ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked ON scored.r = ranked.r
"""
