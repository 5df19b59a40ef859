"""DuckDB SQL for the queries that SQL can express; the others are tested against plain models."""

from __future__ import annotations

from .importance import GAP, HOW
from .quality_rules import BITS, POLICY
from .queries import URL_RULES
from .url_filter import SUFFIXES, Reputation



def stats(source: str) -> str:
    """Common table expressions up to f: doc_id, the words and 8-word windows of every text t of a query, counted by list functions, and the operator's own conditions."""
    return rf"""d AS (SELECT row_number() OVER () AS r, doc_id, t FROM ({source})),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS solid FROM d),
g AS (SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 9)),
again AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(g.i, g.i + 8)) AS p FROM g JOIN again USING (r, g)) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(solid) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
    len(list_filter(list_zip(ws[1 : -2], ws[2 :]), lambda p: p[1] = p[2])) AS n_same_next,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim
  FROM w LEFT JOIN cover USING (r)),
f AS (SELECT *, {BITS} AS failures FROM m)"""


REJECTED = f"((failures & {POLICY.hard}) <> 0 OR bit_count(failures & {POLICY.soft}) > {POLICY.allowed})"

OP1 = rf"""
WITH {stats("SELECT doc_id, coalesce(text, '') AS t FROM documents")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT {REJECTED} AS kept, CAST(failures AS BIGINT) AS failures
FROM f
"""

#: 64-dimensional products as exact sums of whole numbers.
OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Base 32 of a digest: five hexadecimal digits at a time are four characters.
BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT) >> b) & 31 AS INTEGER) + 1, 1)), '')), '')"

OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS most FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN coalesce(page_id < most, most IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN coalesce(page_id < most, most IS NOT NULL) THEN most END AS refers_to FROM m
"""


def op10(rules: list[tuple[str, str]], how: Reputation) -> str:
    """Rules by longest fit; else the posterior's lower bound, level by level: suffix, registered domain, host."""
    shown = r"regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->', ' ', 'g'), '<[^>]*>|&[a-z]+;', ' ', 'g')"
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    listed = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for v, r in rules)
    two = ", ".join(f"'{x}'" for x in sorted(SUFFIXES))
    level = lambda name: f"(SELECT sum(n) AS m, sum(bad) AS b, count(*) AS k, sum(n * (bad / n) * (bad / n)) AS q FROM {name})"
    strength = lambda name: f"(SELECT CASE WHEN s > 0 THEN least({how.most}, greatest({how.least}, mean * (1 - mean) / s - 1)) ELSE {how.most} END FROM (SELECT (b + 0.5) / (m + 1.0) AS mean, q / m - (b / m) * (b / m) - ((b + 0.5) / (m + 1.0)) * (1 - (b + 0.5) / (m + 1.0)) * k / m AS s FROM {level(name)}))"
    label = lambda x, n: f"array_to_string(list_slice(string_split({x}, '.'), -{n}, -1), '.')"
    return rf"""
WITH {stats(f"SELECT {rest} AS doc_id, {shown} AS t FROM pages WHERE html IS NOT NULL")},
u AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce({rest}, '') AS rest FROM pages)),
b AS (SELECT lower(regexp_extract(doc_id, '^[^/?#]*')) AS host, count(*) AS n, CAST(count(*) FILTER ({REJECTED}) AS DOUBLE) AS bad FROM f GROUP BY 1),
names AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM (SELECT host FROM u UNION SELECT host FROM b)),
lv AS (SELECT host, CASE WHEN {label('name', 2)} IN ({two}) THEN {label('name', 3)} ELSE {label('name', 2)} END AS domain, CASE WHEN {label('name', 2)} IN ({two}) THEN {label('name', 2)} ELSE {label('name', 1)} END AS suffix FROM names),
hosts AS (SELECT * FROM b JOIN lv USING (host)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
k AS (SELECT {strength('suffixes')} AS ss, {strength('domains')} AS sd, {strength('hosts')} AS sh, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM suffixes) AS mean),
sr AS (SELECT suffix, (bad + mean * ss) / (n + ss) AS rate FROM suffixes, k),
dr AS (SELECT domain, (bad + rate * sd) / (n + sd) AS rate FROM domains JOIN sr USING (suffix), k),
post AS (SELECT lv.host, coalesce(b.bad, 0) + coalesce(dr.rate, sr.rate, mean) * sh AS pa, coalesce(b.n, 0) - coalesce(b.bad, 0) + (1 - coalesce(dr.rate, sr.rate, mean)) * sh AS pb FROM lv LEFT JOIN b USING (host) LEFT JOIN dr USING (domain) LEFT JOIN sr USING (suffix), k),
bound AS (SELECT host, pa / (pa + pb) - {how.z} * sqrt((pa / (pa + pb)) * (1 - pa / (pa + pb)) / (pa + pb + 1)) AS bound FROM post),
rules(rule_host, rule_path, rule, verdict) AS (VALUES {listed}),
hit AS (SELECT page_id, min_by(rule, -length(rule)) AS rule, min_by(rules.verdict, -length(rule)) AS verdict FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND bound > {how.limit} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN hit USING (page_id) LEFT JOIN bound USING (host)
"""


#: CRC-32 of distinct words byte by byte, with the table of its polynomial.
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{GAP}]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{GAP}]+')) AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) AS c FROM range(256) AS g(i))),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM b)),
crc AS (SELECT w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]))) % {HOW.buckets} AS bucket FROM hexed, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (w) GROUP BY bucket),
big AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + {HOW.buckets} AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + {HOW.buckets} AS DOUBLE)))) AS gain FROM s LEFT JOIN t USING (bucket), big),
weights AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{HOW.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {HOW.least_words} ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {HOW.least_words} AND place <= (SELECT count(*) FROM scored WHERE n_features >= {HOW.least_words}) * {HOW.percent} // 100 THEN place END AS rank FROM ranked
"""


ORACLES: dict[str, str] = {"op12_importance_resampling": OP12, "op1_quality_rules": OP1, "op6_vector_search": OP6, "op8_warc": OP8, "op10_url_filter": op10(URL_RULES, Reputation())}
