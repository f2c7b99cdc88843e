"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"


def _mixing() -> str:
    weights = ", ".join(f"({i}, {w}, {w * curve[0][1]}, {w * curve[1][1]})" for i, (w, curve) in enumerate(zip(mixing.WEIGHTS, mixing.CURVES, strict=True)))
    return f"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
 totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
 weighed AS (SELECT source, source_size, w.weight, w.a, w.b, source_size * {mixing.REPEATS} AS cap FROM (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS i FROM totals) t JOIN (VALUES {weights}) w(i, weight, a, b) ON t.i = w.i),
 levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE)) / CAST(sum(weight) OVER after AS DOUBLE) AS own FROM weighed
   WINDOW before AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 chosen AS (SELECT *, max(CASE WHEN own * weight <= cap THEN own END) OVER () AS level FROM levels),
 plan AS (SELECT source, source_size, CAST(weight AS DOUBLE) AS weight, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, coalesce(least(level * CAST(weight AS DOUBLE), CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM chosen),
 placed AS (SELECT s.*, p.source_size, p.target, p.a, p.b, p.weight, CAST(floor(p.target + 0.5) AS BIGINT) AS goal, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id) - size AS BIGINT) AS start
   FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
 taken AS (SELECT *, {" + ".join(f"greatest(0, least(size, goal - source_size * {i} - start))" for i in range(mixing.REPEATS))} AS taken, (CAST(start AS DOUBLE) / CAST(goal AS DOUBLE)) * weight AS more FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, source,
 CASE WHEN size > 0 AND start < goal THEN CASE WHEN more > 0 THEN 0.0 + 2 * more / (a + sqrt(greatest(a * a + 2 * (b - a) * more, 0.0))) ELSE 0.0 END END AS position FROM taken
"""


def _warc() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST((k // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM p
"""


def _quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

    def passes(r: quality_rules.Rule) -> str:
        return f"(100 * {r.count} {r.op} {r.percent} * {r.base} OR n_words < {r.least})"

    base = " AND ".join(passes(r) for r in quality_rules.RULES if r.name in quality_rules.BASE_RULES)
    n = quality_rules.WINDOW
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
 windows AS (SELECT rid, words[i : i + {n - 1}] AS five, i FROM (SELECT rid, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w)),
 twice AS (SELECT rid, five FROM windows GROUP BY rid, five HAVING count(*) > 1),
 covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (rid, five), range({n}) r(k) GROUP BY rid),
 counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^{quality_rules.SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_intersect(list_distinct(words), [{stops}])) AS BIGINT) AS n_stop_words,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts FROM w LEFT JOIN covered c USING (rid))
SELECT *, NOT ({base}) AS base_failed, {" AND ".join(map(passes, quality_rules.RULES))} AS kept FROM counts
"""


def _hard_negatives() -> str:
    return """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
 positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""


def _decontamination() -> str:
    def words(of: str) -> str:
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return rf"regexp_extract_all(translate(coalesce({of}, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
 windows AS (SELECT DISTINCT item, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i : i + 9])) AS own FROM items WHERE len(w) > 0),
 docs AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
 sizes AS (SELECT DISTINCT m FROM windows),
 places AS (SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs JOIN sizes ON len(w) >= m),
 hits AS (SELECT p.rid, p.m, p.i, x.item FROM places p JOIN docs d USING (rid) JOIN windows x ON x.m = p.m AND x.own = d.w[p.i : p.i + p.m - 1]),
 covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM hits, range(10) r(k) WHERE k < m GROUP BY rid),
 owners AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items, sha256(coalesce(o.names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (rid) LEFT JOIN owners o USING (rid)
"""


def _fill_in_middle() -> str:
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 drawn AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS g FROM d),
 formed AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
 parts AS (SELECT *, array_to_string(tokens[1 : a], '') AS prefix, array_to_string(tokens[a + 1 : b], '') AS middle, array_to_string(tokens[b + 1 : n], '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM parts
"""


SQL = {"op1_mixing": _mixing(), "op3_warc": _warc(), "op9_quality_rules": _quality_rules(), "op11_hard_negatives": _hard_negatives(), "op12_decontamination": _decontamination(), "op13_fill_in_middle": _fill_in_middle()}
