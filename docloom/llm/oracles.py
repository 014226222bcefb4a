"""DuckDB SQL of the queries that SQL can express: the plain definition of each result, over whole tables."""

from __future__ import annotations

from docloom.llm.line_dedup import MIN_LINES, MIN_WORDS, RUN_CHARS, RUN_WORDS
from docloom.llm.neighbours import COSINE
from docloom.llm.suffix_dedup import LENGTH

# Every window of every text as hexadecimal digits; its first document; runs of covered bytes; what is left between them.
SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substring(h, CAST(2 * p + 1 AS BIGINT), {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - {LENGTH - 1}, 0))) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
hit AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + {LENGTH} THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE low < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM hit),
r AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM g GROUP BY doc_id, k),
q AS (SELECT r.doc_id, a, b, h, n, lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) AS before FROM r JOIN d USING (doc_id)),
c AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substring(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substring(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
  FROM q GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

_BLANK = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _runs(n: int) -> str:
    """Runs of n lines that have an earlier copy and enough in them."""
    key = " || chr(10) || ".join(f"t{k}" for k in range(n))
    words, chars = ("+".join(f"{c}{k}" for k in range(n)) for c in "wc")
    enough = "true" if n == MIN_LINES else f"({words} >= {RUN_WORDS} OR {chars} >= {RUN_CHARS}{f' OR {words} >= {MIN_WORDS}' if n == 1 else ''})"
    return f"SELECT doc_id, pos, {n} AS n FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY doc_id, pos) AS r FROM x WHERE t{n - 1} IS NOT NULL) WHERE r > 1 AND {enough}"


LINE_DEDUP = f"""
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM a),
k AS (SELECT doc_id, pos, line, trim(line, ' ') AS t0, len(regexp_extract_all(trim(line, ' '), '[^{_BLANK}]+')) AS w0, length(trim(line, ' ')) AS c0 FROM l),
x AS (SELECT *, {", ".join(f"lead({c}0, {n}) OVER o AS {c}{n}" for n in range(1, MIN_LINES) for c in "twc")} FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS ({" UNION ALL ".join(_runs(n) for n in range(1, MIN_LINES + 1))}),
g AS (SELECT DISTINCT doc_id, pos + i AS pos FROM (SELECT doc_id, pos, unnest(range(n)) AS i FROM r)),
s AS (SELECT doc_id, count(g.pos) AS gone, string_agg(line, chr(10) ORDER BY k.pos) FILTER (g.pos IS NULL) AS kept FROM k LEFT JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(gone, 0) AS BIGINT) AS lines_removed, sha256(coalesce(CASE WHEN gone > 0 THEN kept ELSE text END, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS low FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

# Every document against the five conditions; every order and step against every document of its part.
FILTER_AUDIT = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
low AS (SELECT t, min(doc_id) AS low FROM w GROUP BY t),
f AS (SELECT part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(low < doc_id, false)] AS fails,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w JOIN low USING (t)),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(ks, lambda x: substring('ABCDE', x, 1)), '') AS filter_order, n AS step, ks[n] AS k, ks[1:n - 1] AS done FROM o, (SELECT k AS n FROM k)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT part, filter_order, step, substring('ABCDE', k, 1) AS filter, m.*, fails[k] AS hit, len(list_filter(done, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AND fails[k] AS sole FROM s, m),
r AS (SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (sole), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""

# Every prefix as a list of turns; every prefix again under each of its own prefixes. CRC-32 is a fold over the bits.
PREFIX_TRIE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substring(coalesce(text, ''), 1, 64), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM t),
b AS (SELECT c, list_transform(range(length(s)), lambda j: CAST(ascii(substring(s, CAST(j + 1 AS BIGINT), 1)) AS BIGINT)) AS codes FROM i),
h AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(codes, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 4 AS h FROM b),
p AS (SELECT c, 0 AS part, pos, role, text FROM h JOIN t ON conv_id = c - c % 20 AND pos <= h UNION ALL SELECT c, 1, pos, role, text FROM h JOIN t ON conv_id = c AND pos > h),
q AS (SELECT c, coalesce(turns, []) AS turns FROM h LEFT JOIN (SELECT c, list({'role': role, 'text': text} ORDER BY part, pos) AS turns FROM p GROUP BY c) USING (c)),
m AS (SELECT c, len(turns) AS size, unnest(range(len(turns) + 1)) AS d, turns FROM q),
n AS (SELECT turns[1:d] AS key, any_value(d) AS d, min(c) AS low, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size) AS ends FROM m GROUP BY turns[1:d]),
k AS (SELECT key, d, n, low, key[1:d - 1] AS above, CASE WHEN d > 0 THEN len(regexp_extract_all(key[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words, ends FROM n),
kids AS (SELECT above, count(*) AS kids FROM k WHERE d > 0 GROUP BY above),
w AS (SELECT k.*, coalesce(kids, 0) AS kids FROM k LEFT JOIN kids ON kids.above = k.key),
sub AS (SELECT key[1:j] AS key, sum(CAST(kids = 0 AS INTEGER)) AS leaves, sum((n - 1) * words) AS saved FROM (SELECT *, unnest(range(d + 1)) AS j FROM w) GROUP BY key[1:j])
SELECT w.low AS conv_id, CAST(w.d AS BIGINT) AS depth, u.low AS parent_conv_id, w.n AS n_convs, CAST(w.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN sub USING (key) LEFT JOIN k u ON w.d > 0 AND u.key = w.above
"""

SQL = {"op12_prefix_trie": PREFIX_TRIE, "op11_filter_audit": FILTER_AUDIT, "op1_suffix_dedup": SUFFIX_DEDUP, "op4_line_dedup": LINE_DEDUP, "op6_embedding_dedup": EMBEDDING_DEDUP}
