"""DuckDB SQL for the queries that SQL can express.

Operators 1, 6, 7, 9 (tokenisers, a trained model, dynamic programming) and 3
(decoding keys) have none; tests hold them against brute force.
"""

from __future__ import annotations

from .quality import EXTRA, METRICS, SIZES, SPREAD
from .url_rules import HOST_RULES, PATTERN_RULES, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

TOP_K = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

REPEATS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="text")} AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i+34], ' ') END AS k FROM i),
twice AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
f AS (SELECT r, i, word, coalesce(max(CASE WHEN twice.k IS NOT NULL THEN i END) OVER (PARTITION BY r ORDER BY i), -99) >= i - 34 AS gone FROM k LEFT JOIN twice ON k.k = twice.k),
g AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS lost, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""


def _quality() -> str:
    share = lambda m, less: f"(greatest({METRICS[m][0]} - {less}, 0) * 1000000) // greatest({METRICS[m][1]}, 1)"
    long = " UNION ALL ".join([f"SELECT lang, source, '{m}' AS metric, {share(m, 0)} AS v FROM s WHERE NOT base_failed" for m in METRICS] + [f"SELECT lang, source, '{m}', {m} FROM s WHERE NOT base_failed" for m in SIZES])
    high = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x[3]}" for m, x in METRICS.items()) + " ELSE 50 END"
    of = lambda value, m: f"max({value}) FILTER (WHERE metric = '{m}')"
    limit = lambda m: f"{of('q2', m)} + {SPREAD} * ({of('q3', m)} - {of('q2', m)}) + {EXTRA} * ({METRICS[m][2] * 1000000} // greatest({of('q2', METRICS[m][1])}, 1)) AS t_{m}"
    within = " AND ".join(f"{share(m, x[2])} <= CASE WHEN o.rows >= 50 THEN o.t_{m} WHEN l.rows >= 50 THEN l.t_{m} ELSE e.t_{m} END" for m, x in METRICS.items())
    top = lambda b: f"CASE WHEN {b} < 32 THEN {b} ELSE (({b} - 16 * (({b} - 16) // 16)) + 1) * (1 << (({b} - 16) // 16)) - 1 END"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
i AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d),
k AS (SELECT r, i, CASE WHEN i + 4 <= len(w) THEN array_to_string(w[i:i+4], ' ') END AS k FROM i),
c AS (SELECT r, i, k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1 AS twice FROM k),
f AS (SELECT r, i, coalesce(max(CASE WHEN twice THEN i END) OVER (PARTITION BY r ORDER BY i), -9) >= i - 4 AS rep FROM c),
g AS (SELECT r, count(*) FILTER (WHERE rep) AS n FROM f GROUP BY r),
m AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals FROM d LEFT JOIN g USING (r)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
long AS ({long}),
b AS (SELECT *, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> CAST(length(bin(v)) - 5 AS INT)) END AS b FROM long),
lv AS (SELECT 0 AS level, lang AS a, source AS c, metric, b FROM b UNION ALL SELECT 1, lang, NULL, metric, b FROM b UNION ALL SELECT 2, NULL, NULL, metric, b FROM b),
h AS (SELECT level, a, c, metric, b, count(*) AS n FROM lv GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY level, a, c, metric) AS rows, sum(n) OVER (PARTITION BY level, a, c, metric ORDER BY b) AS upto FROM h),
x AS (SELECT level, a, c, metric, max(rows) AS rows, min(b) FILTER (WHERE upto * 100 >= rows * 50) AS b2, min(b) FILTER (WHERE upto * 100 >= rows * {high}) AS b3 FROM q GROUP BY ALL),
y AS (SELECT *, {top("b2")} AS q2, {top("b3")} AS q3 FROM x),
t AS (SELECT level, a, c, max(rows) AS rows, {", ".join(map(limit, METRICS))} FROM y GROUP BY level, a, c),
z AS (SELECT s.*, coalesce({within}, true) AS good FROM s
LEFT JOIN t o ON o.level = 0 AND o.a IS NOT DISTINCT FROM lang AND o.c IS NOT DISTINCT FROM source LEFT JOIN t l ON l.level = 1 AND l.a IS NOT DISTINCT FROM lang LEFT JOIN t e ON e.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM z"""


def _urls() -> str:
    rule = verdict = "NULL"
    for h, p, v in sorted(HOST_RULES, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    hit = lambda v: " OR ".join(f"regexp_matches(low, '{Rule(*r).regex}')" for r in PATTERN_RULES if r[1] == v)
    return rf"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), r AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, lower(url) AS low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN ({hit("block")}) AND NOT ({hit("allow")}) THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = d.doc_id"""

SQL: dict[str, str] = {
    "op2_exact_top_k": TOP_K,
    "op4_substring_dedup": REPEATS,
    "op5_quality_rules": _quality(),
    "op8_url_filter": _urls(),
    "op10_minhash_near_dup": NEAR,
}
