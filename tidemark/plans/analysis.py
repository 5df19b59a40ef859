"""Joins, aggregates, windows, membership (C, D, E, K) and scalar functions (H)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import codes, text, urls
from ..operators import citations, conversations, hygiene, incremental, membership, resolve, rows, status
from ..sources import views as V
from .registry import query

GATE = "(?i)^\\s*(access denied|403|404|forbidden|not found|502|just a moment|attention required|security check|captcha)"
JUNK = f"""{V.SOURCES}, f AS (SELECT *, CASE WHEN status = 3 THEN 'error_status' WHEN regexp_matches(title, '{GATE}') THEN 'gateway_title' END AS first, {V.key_sql('url', 'dedup')} AS k FROM sources),
dup AS (SELECT source_id, first_value(source_id) OVER w AS kept, row_number() OVER w AS n FROM f WHERE first IS NULL AND url <> '' WINDOW w AS (PARTITION BY nb, k ORDER BY created_at NULLS LAST, pos)),
junk AS (SELECT f.*, coalesce(first, CASE WHEN n > 1 THEN 'duplicate_of:' || substr(kept, 1, 8) END) AS reason FROM f LEFT JOIN dup USING (source_id))"""


@query(f"WITH {JUNK} SELECT nb, source_id, reason FROM junk")
def e1_junk(s, d):
    return hygiene.junk(V.sources(s, d)).select("nb", "source_id", "reason")


@query(f"WITH {JUNK} SELECT nb, split_part(reason, ':', 1) AS kind, count(*) AS n FROM junk WHERE reason IS NOT NULL GROUP BY ALL")
def clean_summary(s, d):
    return hygiene.summary(hygiene.junk(V.sources(s, d)))


@query(f"WITH {JUNK} SELECT nb, count(reason) AS n_junk, CASE WHEN count(reason) = 0 THEN 'already_clean' ELSE 'dry_run' END AS outcome FROM junk GROUP BY nb")
def d2_clean_status(s, d):
    return hygiene.status(hygiene.junk(V.sources(s, d)))


@query(f"WITH {JUNK} SELECT nb, source_id FROM junk WHERE reason IS NULL")
def k6_without_junk(s, d):
    return hygiene.cleaned(hygiene.junk(V.sources(s, d))).select("nb", "source_id")


@query(f"WITH {V.FULLTEXT}, {V.BRIDGE} SELECT label_id, pos, source_id, length(content) AS n FROM bridge JOIN fulltext USING (source_id)")
def c1_label_sources(s, d):
    return membership.members(V.label_bridge(s, d), V.fulltext(s, d)).select("label_id", "pos", "source_id", F.length("content").cast("long").alias("n"))


@query(f"WITH {V.FULLTEXT}, {V.BRIDGE} SELECT label_id, source_id FROM bridge JOIN fulltext USING (source_id) WHERE doc_id % 7 = 0")
def c2_label_and_status(s, d):
    return membership.members(V.label_bridge(s, d), V.fulltext(s, d).where("doc_id % 7 = 0")).select("label_id", "source_id")


@query(f"WITH {V.FULLTEXT}, {V.BRIDGE} SELECT label_id, count(*) AS n_stored, count(doc_id) AS n_found, count(*) - count(doc_id) AS n_missing FROM bridge LEFT JOIN fulltext USING (source_id) GROUP BY label_id")
def c3_expanded_counts(s, d):
    j = V.label_bridge(s, d).join(V.fulltext(s, d).select("source_id", "doc_id"), "source_id", "left")
    return j.groupBy("label_id").agg(F.count("*").alias("n_stored"), F.count("doc_id").alias("n_found"), (F.count("*") - F.count("doc_id")).alias("n_missing"))


@query(f"""WITH {V.SOURCES}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS nb, n_name AS name FROM nation) SELECT n.nb, name, count(source_id) AS n_sources, string_agg(source_id || '=' || title, '|' ORDER BY pos) AS summaries FROM n LEFT JOIN sources ON n.nb = sources.nb AND status = 2 GROUP BY ALL""")
def c4_metadata(s, d):
    n = V.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("nb"), F.col("n_name").alias("name"))
    src = V.sources(s, d).where("status = 2").groupBy("nb").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "source_id", "title"))).alias("m"))
    out = n.join(src, "nb", "left").select("nb", "name", F.coalesce("n", F.lit(0)).alias("n_sources"), F.array_join(F.transform("m", lambda x: F.concat(x["source_id"], F.lit("="), x["title"])), "|").alias("summaries"))
    return out


IMPORT = f"""{V.REQUESTED}, have AS (SELECT nb, k, source_id AS existing_id FROM (SELECT *, row_number() OVER (PARTITION BY nb, k ORDER BY pos) AS n FROM (SELECT *, {V.key_sql('url', 'import')} AS k FROM existing)) WHERE n = 1),
parts AS (SELECT r.*, existing_id FROM (SELECT *, CASE WHEN kind <> 'report' THEN {V.key_sql('url', 'import')} END AS k FROM requested) r LEFT JOIN have USING (nb, k))"""


@query(f"WITH {IMPORT} SELECT nb, pos, url, kind, existing_id FROM parts")
def c5_import_partition(s, d):
    return incremental.partitioned(V.requested(s, d), V.existing(s, d)).select("nb", "pos", "url", "kind", "existing_id")


@query(f"WITH {IMPORT} SELECT nb, count(*) FILTER (existing_id IS NULL) AS n_new, count(DISTINCT existing_id) AS n_present FROM parts GROUP BY nb")
def d9_import_outcome(s, d):
    return incremental.outcome(incremental.partitioned(V.requested(s, d), V.existing(s, d)))


@query(f"""WITH {V.REQUESTED}, cur AS (SELECT nb, pos, source_id, CASE WHEN pos % 5 <> 0 THEN url END AS url FROM existing), base AS (SELECT nb, source_id FROM existing WHERE pos % 3 = 0),
fresh AS (SELECT * FROM cur WHERE (nb, source_id) NOT IN (SELECT nb, source_id FROM base)),
nk AS (SELECT DISTINCT nb, {V.key_sql('url', 'import')} AS k FROM fresh WHERE url IS NOT NULL), ck AS (SELECT DISTINCT nb, {V.key_sql('url', 'import')} AS k FROM cur WHERE url IS NOT NULL),
spare AS (SELECT nb, count(*) AS spare FROM fresh WHERE url IS NULL GROUP BY nb),
r AS (SELECT *, CASE WHEN url IS NOT NULL THEN {V.key_sql('url', 'import')} END AS k, row_number() OVER (PARTITION BY nb, url IS NULL ORDER BY pos) AS nth FROM requested),
m AS (SELECT r.*, nk.k IS NOT NULL AS isnew, ck.k IS NOT NULL AS isnow, coalesce(spare, 0) AS spare FROM r LEFT JOIN nk USING (nb, k) LEFT JOIN ck ON r.nb = ck.nb AND r.k = ck.k LEFT JOIN spare ON r.nb = spare.nb),
a AS (SELECT nb, bool_or(isnew) AS anynew FROM m GROUP BY nb)
SELECT m.nb, pos, CASE WHEN isnew THEN 'committed' WHEN url IS NULL THEN CASE WHEN nth <= spare THEN 'committed' WHEN anynew THEN 'dropped' ELSE 'retry' END WHEN isnow THEN 'dropped' ELSE 'retry' END AS state FROM m JOIN a ON m.nb = a.nb""")
def c6_commit_verification(s, d):
    e = V.existing(s, d)
    return incremental.verified(V.requested(s, d), e.where("pos % 3 = 0"), e.withColumn("url", F.when(F.col("pos") % 5 != 0, F.col("url")))).select("nb", "pos", "state")


@query(f"""WITH {V.REPORTS}, c AS (SELECT DISTINCT nb, {V.key_sql('u', 'citation')} AS k FROM (SELECT nb, unnest(regexp_extract_all(report, 'https?://[^\\s<>\\]()]+')) AS u FROM reports WHERE nb <> 4)),
i AS (SELECT DISTINCT nb, {V.key_sql('u', 'citation')} AS k FROM (SELECT nb, unnest(regexp_extract_all(report, '!\\[[^\\]]*\\]\\((https?://[^\\s<>\\]()]+)', 1)) AS u FROM reports WHERE nb <> 4)),
hit AS (SELECT * FROM c EXCEPT SELECT * FROM i), src AS (SELECT page_id % 20 AS nb, page_id, CASE WHEN page_id % 15 = 0 THEN 'report' ELSE 'web' END AS kind, {V.key_sql('url', 'citation')} AS k FROM pages),
m AS (SELECT src.*, kind <> 'report' AND hit.k IS NOT NULL AS h FROM src LEFT JOIN hit USING (nb, k)), n AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY nb) AS n_matched FROM m)
SELECT nb, page_id, n_matched = 0 AS used_fallback FROM n WHERE h OR kind = 'report' OR n_matched = 0""")
def c7_cited_only(s, d):
    src = V.table(s, d, "pages").select((F.col("page_id") % 20).alias("nb"), "page_id", "url", F.when(F.col("page_id") % 15 == 0, "report").otherwise("web").alias("kind"))
    return citations.cited(src, V.reports(s, d).where("nb <> 4")).select("nb", "page_id", "used_fallback")


@query(f"WITH {V.SOURCES}, n AS (SELECT nb, source_id FROM sources WHERE status <> 1 AND source_id NOT IN (SELECT source_id FROM sources WHERE status <> 3)) SELECT nb, count(*) AS n_new, count(*) = 1 AS exactly_one FROM n GROUP BY nb")
def c8_id_diff(s, d):
    """Before, sources in error weren't listed; after, those being processed aren't."""
    src = V.sources(s, d)
    new = src.where("status <> 1").join(src.where("status <> 3").select("source_id"), "source_id", "left_anti")
    return new.groupBy("nb").agg(F.count("*").alias("n_new"), (F.count("*") == 1).alias("exactly_one"))


@query("""WITH i AS (SELECT md5(CAST(page_id AS VARCHAR)) AS id FROM pages), t AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN upper(md5(CAST(page_id AS VARCHAR))) WHEN 1 THEN ' ' || substr(md5(CAST(page_id AS VARCHAR)), 1, 5) || ' ' WHEN 2 THEN substr(md5(CAST(page_id AS VARCHAR)), 1, 1) ELSE 'zz' || page_id END AS token FROM pages),
h AS (SELECT token, min(id) FILTER (id = lower(trim(token))) AS exact, count(id) AS n, min(id) AS one FROM t LEFT JOIN i ON starts_with(id, lower(trim(token))) GROUP BY token)
SELECT token, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'prefix' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS verdict, CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN one END AS id FROM h""")
def c9_resolve_ids(s, d):
    p, k = V.table(s, d, "pages"), F.col("page_id")
    md5 = F.md5(k.cast("string"))
    token = F.when(k % 4 == 0, F.upper(md5)).when(k % 4 == 1, F.concat(F.lit(" "), F.substring(md5, 1, 5), F.lit(" "))).when(k % 4 == 2, F.substring(md5, 1, 1)).otherwise(F.concat(F.lit("zz"), k))
    return resolve.by_id(p.select(token.alias("token")), p.select(md5.alias("id")))


@query()
def c11_near_misses(s, d):
    p = V.table(s, d, "part")
    return resolve.near_misses(p.select(F.expr("substring(p_name, 1, length(p_name) - 2)").alias("token")), p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("pos")))


@query(f"""WITH {V.ANSWERS}, mk AS (SELECT conv_id, turn, m.k AS marker, m.n FROM (SELECT conv_id, turn, unnest([{{'k': 0, 'n': 1}}, {{'k': 1, 'n': 2}}, {{'k': 2, 'n': 3}}]) AS m FROM answers)),
num AS (SELECT conv_id, turn, citation_number AS n, min_by(source_id, ord) AS source_id, min_by(chunk_id, ord) AS chunk_id FROM refs WHERE chunk_id IS NOT NULL AND citation_number IS NOT NULL GROUP BY ALL),
plc AS (SELECT conv_id, turn, ord AS n, source_id, chunk_id FROM refs WHERE citation_number IS NULL AND chunk_id IS NOT NULL)
SELECT mk.conv_id, mk.turn, CAST(marker AS BIGINT) AS marker, CAST(mk.n AS BIGINT) AS n, coalesce(num.source_id, plc.source_id) AS source_id, coalesce(num.chunk_id, plc.chunk_id) AS chunk_id
FROM mk LEFT JOIN num USING (conv_id, turn, n) LEFT JOIN plc ON mk.conv_id = plc.conv_id AND mk.turn = plc.turn AND mk.n = plc.n WHERE num.source_id IS NOT NULL OR plc.source_id IS NOT NULL""")
def c13_anchored_markers(s, d):
    return citations.anchored(V.answers(s, d)).drop("at")


@query(f"""WITH {V.FULLTEXT}, r AS (SELECT source_id, CASE doc_id % 3 WHEN 0 THEN substr(content, 51, 60) WHEN 1 THEN 'qqq' || doc_id END AS cited_text FROM fulltext),
j AS (SELECT *, substr(cited_text, 1, 40) AS probe, strpos(content, substr(cited_text, 1, 40)) AS place FROM r JOIN fulltext USING (source_id))
SELECT source_id, CASE WHEN coalesce(cited_text, '') = '' THEN 'no_cited_text' WHEN place = 0 THEN 'not_found' ELSE 'found' END AS status, CASE WHEN coalesce(cited_text, '') <> '' AND place > 0 THEN place - 1 END AS start,
  CASE WHEN coalesce(cited_text, '') <> '' AND place > 0 THEN substr(content, greatest(place - 201, 0) + 1, place - 1 + length(probe) + 200 - greatest(place - 201, 0)) END AS context FROM j""")
def c14_citation_context(s, d):
    f, k = V.fulltext(s, d), F.col("doc_id")
    refs = f.select("source_id", F.when(k % 3 == 0, F.substring("content", 51, 60)).when(k % 3 == 1, F.concat(F.lit("qqq"), k)).alias("cited_text"))
    return citations.first_context(refs, f).drop("cited_text")


ENDED = f"""{V.SNAPSHOTS}, o AS (SELECT *, CASE WHEN NOT present THEN 'not_found' WHEN status = 2 THEN 'ready' WHEN status = 3 AND type_code NOT IN (0, 10) THEN 'failed' END AS outcome FROM snapshots),
ended AS (SELECT entity_id, snapshot_ts, pos, outcome FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos) AS n FROM o WHERE outcome IS NOT NULL) WHERE n = 1)"""


@query(f"WITH {ENDED} SELECT * FROM ended")
def e11_first_terminal(s, d):
    return status.terminal(V.snapshots(s, d))


WAITED = f"{ENDED}, waited AS (SELECT c_custkey AS entity_id, coalesce(outcome, 'timed_out') AS outcome FROM customer LEFT JOIN ended ON c_custkey = entity_id)"


@query(f"WITH {WAITED} SELECT * FROM waited")
def c16_requested_outcomes(s, d):
    return status.waited(V.table(s, d, "customer").select(F.col("c_custkey").alias("entity_id")), status.terminal(V.snapshots(s, d)))


@query(f"WITH {WAITED} SELECT entity_id % 25 AS nb, count(*) FILTER (outcome = 'ready') AS ready_count, count(*) FILTER (outcome = 'timed_out') AS timed_out_count, count(*) FILTER (outcome = 'failed') AS failed_count, count(*) FILTER (outcome = 'not_found') AS not_found_count, count(*) AS total_count, bool_and(outcome = 'ready') AS ok FROM waited GROUP BY 1")
def d1_wait_rollup(s, d):
    w = status.waited(V.table(s, d, "customer").select(F.col("c_custkey").alias("entity_id")), status.terminal(V.snapshots(s, d)))
    return status.rollup(w.withColumn("nb", F.col("entity_id") % 25), "nb")


@query(f"WITH {V.ARTIFACTS}, n AS (SELECT nb, title, count(*) AS c FROM artifacts WHERE id % 5 <> 0 GROUP BY ALL) SELECT t.nb, t.title, CASE WHEN c IS NULL THEN 'none' WHEN c = 1 THEN 'one' ELSE 'many' END AS verdict FROM (SELECT DISTINCT nb, title FROM artifacts WHERE id % 5 = 0) t LEFT JOIN n USING (nb, title)")
def c17_create_probe(s, d):
    a = V.artifacts(s, d)
    n = a.where("id % 5 <> 0").groupBy("nb", "title").agg(F.count("*").alias("c"))
    return a.where("id % 5 = 0").select("nb", "title").distinct().join(n, ["nb", "title"], "left").select("nb", "title", F.when(F.col("c").isNull(), "none").when(F.col("c") == 1, "one").otherwise("many").alias("verdict"))


@query(f"WITH {V.FULLTEXT}, {V.BRIDGE} SELECT source_id FROM fulltext WHERE source_id NOT IN (SELECT source_id FROM bridge)")
def c18_unlabelled(s, d):
    return membership.unlabelled(V.fulltext(s, d), V.label_bridge(s, d)).select("source_id")


@query(f"WITH {V.FULLTEXT}, {V.BRIDGE} SELECT label_id, count(*) AS n_members, string_agg(source_id, ',' ORDER BY pos) AS ids, count(content) AS n_titled FROM bridge LEFT JOIN fulltext USING (source_id) GROUP BY label_id")
def c20_label_list(s, d):
    """Of a member's title the list shows only whether there is one: a list need not hold whole texts."""
    titled = V.fulltext(s, d).select("source_id", F.when(F.col("content").isNotNull(), True).alias("titled"))
    m = membership.listed(V.label_bridge(s, d), titled, "titled")
    return m.select("label_id", "n_members", F.array_join("ids", ",").alias("ids"), F.size(F.filter("titles", lambda t: t.isNotNull())).cast("long").alias("n_titled"))


@query(f"""WITH {V.BRIDGE}, {V.SOURCES}, t AS (SELECT 'd' || page_id AS source_id, title FROM sources WHERE source_id LIKE 'p%'), b AS (SELECT label_id, pos, source_id, title, length(source_id) + coalesce(strlen(title), 0) + 16 AS size FROM bridge LEFT JOIN t USING (source_id)),
q AS (SELECT *, row_number() OVER w AS place, (sum(size) OVER w - size) // 1000 AS piece FROM b WINDOW w AS (PARTITION BY label_id ORDER BY pos, source_id ROWS UNBOUNDED PRECEDING))
SELECT label_id, CAST(piece AS BIGINT) AS piece, min(place) AS first, string_agg(source_id, ',' ORDER BY place) AS ids, string_agg(coalesce(title, '-'), ',' ORDER BY place) AS titles FROM q GROUP BY ALL""")
def c20_members_in_pieces(s, d):
    """Labels with their members and titles in rows of a thousand bytes; so much for a real listing is the caller's to say."""
    titles = V.sources(s, d).where("source_id LIKE 'p%'").select(F.concat(F.lit("d"), "page_id").alias("source_id"), "title")
    got = membership.listed_in_pieces(V.label_bridge(s, d), titles, "title", 1000)
    return got.select("label_id", "piece", "first", F.array_join("ids", ",").alias("ids"), F.array_join("titles", ",", "-").alias("titles"))


@query(f"""WITH {V.SOURCES}, q AS (SELECT nb, title, url, status, row_number() OVER w AS place, (sum(coalesce(strlen(title), 0) + coalesce(strlen(url), 0) + 16) OVER w - (coalesce(strlen(title), 0) + coalesce(strlen(url), 0) + 16)) // 500 AS piece FROM sources WINDOW w AS (PARTITION BY nb ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT nb, CAST(piece AS BIGINT) AS piece, min(place) AS first, count(*) AS n, string_agg(coalesce(url, ''), ' ' ORDER BY place) AS urls FROM q GROUP BY ALL""")
def c4_metadata_in_pieces(s, d):
    """A notebook's sources nested in rows of bounded size, in order."""
    src = V.sources(s, d).select("nb", "title", "url", "status", "pos")
    size = F.coalesce(F.octet_length("title"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + 16
    m = F.array_sort(F.collect_list(F.struct("place", "title", "url", "status")))
    got = rows.pieced(src, ["nb"], ["pos"], size, 500).groupBy("nb", "piece").agg(m.alias("sources"))
    return got.select("nb", "piece", F.col("sources")[0]["place"].alias("first"), F.size("sources").cast("long").alias("n"), F.array_join(F.transform("sources", lambda x: F.coalesce(x["url"], F.lit(""))), " ").alias("urls"))


@query("""WITH t AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS token FROM part), f AS (SELECT p_name AS token, count(*) AS c, min(p_partkey) AS id FROM part GROUP BY p_name)
SELECT token, CASE WHEN c = 1 THEN 'found' WHEN c > 1 THEN 'ambiguous' ELSE 'none' END AS verdict, CASE WHEN c = 1 THEN id END AS id FROM t LEFT JOIN f USING (token)""")
def c21_exact_title(s, d):
    p = V.table(s, d, "part")
    t = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("token"))
    return resolve.by_title(t, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


@query("""WITH t AS (SELECT user_id FROM (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY t DESC, user_id DESC LIMIT 1024)) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM t)""")
def c22_exclude_deleted(s, d):
    dead = V.table(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("t")).orderBy(F.desc("t"), F.desc("user_id")).limit(1024)
    c = V.table(s, d, "customer")
    return c.join(dead, c["c_custkey"] == dead["user_id"], "left_anti").select("c_custkey")


@query(f"WITH {V.ARTIFACTS} SELECT nb, count(*) AS total, count(*) FILTER (status = 3) AS succeeded, count(*) FILTER (status = 4) AS failed, count(*) FILTER (status = 1) AS skipped, count(*) FILTER (status = 4) > 0 AS is_failure FROM artifacts GROUP BY nb")
def d3_batch_rollup(s, d):
    n = lambda k: F.count(F.when(F.col("status") == k, 1))
    return V.artifacts(s, d).groupBy("nb").agg(F.count("*").alias("total"), n(3).alias("succeeded"), n(4).alias("failed"), n(1).alias("skipped"), (n(4) > 0).alias("is_failure"))


@query("SELECT event_type AS method, count(*) AS started, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS latency_sum, max(value) AS latency_max FROM events GROUP BY event_type")
def d4_telemetry(s, d):
    n = lambda c: F.count(F.when(c, 1))
    e = F.col("event_type") == "error"
    return V.table(s, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("started"), n(~e).alias("succeeded"), n(e).alias("failed"), F.round(F.sum("value"), 4).alias("latency_sum"), F.max("value").alias("latency_max"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS n_questions FROM conversations GROUP BY conv_id")
def d5_question_count(s, d):
    return V.table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("n_questions"))


@query(f"WITH {V.ARTIFACTS}, o AS (SELECT nb, count(*) FILTER (is_owner) AS owned FROM artifacts GROUP BY nb) SELECT nb, owned, CASE WHEN nb % 5 = 0 THEN 'unknown' WHEN owned >= greatest(nb - 1, 0) THEN 'exhausted' ELSE 'available' END AS quota FROM o")
def d6_quota(s, d):
    limit = F.when(F.col("nb") % 5 != 0, F.col("nb"))
    o = V.artifacts(s, d).groupBy("nb").agg(F.count(F.when(F.col("is_owner"), 1)).alias("owned"))
    return o.select("nb", "owned", F.when(limit.isNull(), "unknown").when(F.col("owned") >= F.greatest(limit - 1, F.lit(0)), "exhausted").otherwise("available").alias("quota"))


@query(f"WITH {V.SOURCES} SELECT nb, count(*) AS n FROM sources GROUP BY nb")
def d7_sources_per_group(s, d):
    return V.sources(s, d).groupBy("nb").agg(F.count("*").alias("n"))


@query("SELECT o_custkey % 50 AS nb, bool_and(CASE WHEN o_orderkey % 3 = 0 THEN true ELSE o_orderstatus = 'O' END) AND count(DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END) <= 1 AS ok FROM orders GROUP BY 1")
def d8_provenance(s, d):
    o = V.table(s, d, "orders").select((F.col("o_custkey") % 50).alias("nb"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("task_id"), F.lit("O").alias("target"))
    return incremental.provenance(o, "target")


@query(f"WITH {V.ARTIFACTS} SELECT nb, CASE WHEN bool_or(status = 3) THEN 'added' ELSE 'error' END AS outcome, count(*) FILTER (status = 3) AS n_added, bool_or(status = 4) AS fatal FROM artifacts GROUP BY nb")
def d10_batch_outcome(s, d):
    return V.artifacts(s, d).groupBy("nb").agg(F.when(F.bool_or(F.col("status") == 3), "added").otherwise("error").alias("outcome"), F.count(F.when(F.col("status") == 3, 1)).alias("n_added"), F.bool_or(F.col("status") == 4).alias("fatal"))


@query("SELECT l_orderkey AS id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY f, s) AS suppliers FROM (SELECT l_orderkey, l_suppkey AS s, min(l_linenumber) AS f FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def d12_distinct_first_seen(s, d):
    got = rows.distinct_in_order(V.table(s, d, "lineitem").withColumnRenamed("l_suppkey", "supplier"), ["l_orderkey"], "supplier", "l_linenumber")
    return got.select(F.col("l_orderkey").alias("id"), F.array_join("suppliers", ",").alias("suppliers"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS report FROM conversations WHERE text <> '' AND role <> 'user' GROUP BY conv_id")
def d13_joined_chunks(s, d):
    c = V.table(s, d, "conversations").where("text <> '' AND role <> 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("report"))


@query("SELECT conv_id, min_by(text, turn) AS report FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY conv_id")
def d14_first_report(s, d):
    return V.table(s, d, "conversations").where("role = 'assistant' AND text <> ''").groupBy("conv_id").agg(F.min_by("text", "turn").alias("report"))


@query(f"WITH {V.ARTIFACTS} SELECT nb, id, count(*) OVER (PARTITION BY nb) AS n_matches FROM artifacts WHERE status = 3 QUALIFY row_number() OVER (PARTITION BY nb ORDER BY created_at DESC, id) = 1")
def e2_latest(s, d):
    return rows.selected(V.artifacts(s, d).where("status = 3"), ["nb"], [F.desc("created_at"), F.col("id")]).select("nb", "id", "n_matches")


@query(f"""WITH {V.ARTIFACTS}, i AS (SELECT nb, CAST(id AS VARCHAR) AS id, title, CASE WHEN id % 5 <> 0 THEN epoch(CAST(created_at AS TIMESTAMP)) END AS created_at, id AS pos FROM artifacts),
a AS (SELECT c_custkey AS who, c_custkey % 60 AS nb, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey * 4 AS VARCHAR) END AS id, CASE c_custkey % 3 WHEN 1 THEN 'BRIEFING' WHEN 2 THEN 'no such' END AS name, c_custkey % 2 = 0 AS earliest FROM customer),
j AS (SELECT a.who, a.id AS asked_id, a.name, a.earliest, i.id, coalesce(i.created_at, 0) AS c, pos, i.nb IS NOT NULL AS there, CASE WHEN a.id IS NOT NULL THEN a.id = i.id ELSE contains(lower(i.title), lower(coalesce(a.name, ''))) END AS hit FROM a LEFT JOIN i USING (nb)),
g AS (SELECT who, asked_id, name, earliest, bool_or(there) AS there, count(*) FILTER (hit) AS n FROM j GROUP BY ALL),
k AS (SELECT who, id AS chosen FROM j WHERE hit QUALIFY row_number() OVER (PARTITION BY who ORDER BY CASE WHEN earliest THEN c ELSE -c END, pos) = 1)
SELECT who, chosen, n AS n_matches, CASE WHEN n = 0 THEN NULL WHEN asked_id IS NOT NULL THEN 'matched by id' WHEN n = 1 THEN CASE WHEN name IS NULL THEN 'only one' ELSE 'matched by name' END ELSE CASE WHEN earliest THEN 'earliest of ' ELSE 'latest of ' END || n END AS reason,
  CASE WHEN NOT there THEN 'nothing there' WHEN n = 0 AND asked_id IS NOT NULL THEN 'id not found' WHEN n = 0 THEN 'no title matches' END AS error FROM g LEFT JOIN k USING (who)""")
def e2_chosen(s, d):
    """By id, by part of the title, or the latest or earliest of all; every fifth artifact has no time."""
    i = V.artifacts(s, d).select("nb", F.col("id").cast("string").alias("id"), "title", F.when(F.col("id") % 5 != 0, F.unix_timestamp(F.col("created_at").cast("timestamp"))).alias("created_at"), F.col("id").alias("pos"))
    k = F.col("c_custkey")
    asked = V.table(s, d, "customer").select(k.alias("who"), (k % 60).alias("nb"), F.when(k % 4 == 0, (k * 4).cast("string")).alias("id"), F.when(k % 3 == 1, "BRIEFING").when(k % 3 == 2, "no such").alias("name"), (k % 2 == 0).alias("earliest"))
    return rows.chosen(i, asked, "nb").select("who", "chosen", "n_matches", "reason", "error")


@query(f"WITH {V.ARTIFACTS} SELECT nb, type_code, id FROM artifacts WHERE status = 3 QUALIFY row_number() OVER (PARTITION BY nb, type_code ORDER BY created_at DESC, id) = 1")
def e3_latest_per_type(s, d):
    return rows.newest(V.artifacts(s, d).where("status = 3"), ["nb", "type_code"], [F.desc("created_at"), F.col("id")], 1).select("nb", "type_code", "id")


PAIRS = "pairs AS (SELECT conv_id, turn, text AS question, CASE WHEN r = 'assistant' THEN t ELSE '' END AS answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def e4_pairs(s, d):
    return conversations.pairs(V.table(s, d, "conversations"))


@query(f"WITH {PAIRS} SELECT conv_id, string_agg('### Turn ' || n || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), CASE WHEN question <> '' THEN '**Q:** ' || question END, CASE WHEN answer <> '' THEN '**A:** ' || answer END), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS doc FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM pairs) GROUP BY conv_id")
def a7_history_markdown(s, d):
    p = conversations.pairs(V.table(s, d, "conversations")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.pair("question", "answer").alias("t")))).alias("p"))
    return p.select("conv_id", F.array_join(F.transform("p", lambda x, k: F.concat(F.lit("### Turn "), (k + 1).cast("string"), F.lit("\n\n"), x["t"])), "\n\n---\n\n").alias("doc"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def e5_newest_turns(s, d):
    return rows.newest(V.table(s, d, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY last DESC, conv_id DESC LIMIT 20")
def e6_recent_conversations(s, d):
    return conversations.recent(V.table(s, d, "conversations"), 20)


@query("SELECT conv_id, turn, prior + CASE WHEN text <> '' THEN 1 ELSE 0 END AS turn_number, prior > 1 AS is_follow_up FROM (SELECT *, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM conversations) WHERE role = 'assistant'")
def e7_turn_numbers(s, d):
    return conversations.numbered(V.table(s, d, "conversations"))


@query(f"WITH {V.SNAPSHOTS} SELECT entity_id, snapshot_ts, pos, status FROM (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos) AS b FROM snapshots) WHERE b IS NULL OR b <> status")
def e9_transitions(s, d):
    return status.transitions(V.snapshots(s, d)).select("entity_id", "snapshot_ts", "pos", "status")


@query(f"""WITH {V.SNAPSHOTS.replace('event_id % 6 <> 0', 'event_id % 6 = 0')}, r AS (SELECT *, sum(CASE WHEN present THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos ROWS UNBOUNDED PRECEDING) AS run FROM snapshots),
a AS (SELECT *, row_number() OVER w AS n_absent, first_value(snapshot_ts) OVER w AS since FROM r WHERE NOT present WINDOW w AS (PARTITION BY entity_id, run ORDER BY snapshot_ts, pos))
SELECT entity_id, snapshot_ts, pos, n_absent FROM a WHERE n_absent >= 5 AND snapshot_ts - since >= INTERVAL 10 SECOND OR n_absent >= 10 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos) = 1""")
def e10_removals(s, d):
    return status.removals(V.snapshots(s, d).withColumn("present", ~F.col("present")))


@query(f"WITH {V.ANSWERS} SELECT conv_id, turn, CAST(ord AS BIGINT) AS ordinal, chunk_id FROM refs WHERE chunk_id IS NOT NULL")
def e12_citation_ordinals(s, d):
    r = V.answers(s, d).select("conv_id", "turn", F.posexplode("refs").alias("k", "r"))
    return r.where("r.chunk_id IS NOT NULL").select("conv_id", "turn", (F.col("k") + 1).cast("long").alias("ordinal"), "r.chunk_id")


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || role, ',' ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def e13_oldest_first(s, d):
    c = V.table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role")), False).alias("newest"))
    return c.select("conv_id", F.array_join(F.transform(F.reverse("newest"), lambda x: F.concat(x["turn"].cast("string"), x["role"])), ",").alias("history"))


@query(f"WITH {V.SOURCES} SELECT source_id, {V.key_sql('url', 'dedup')} AS dedup_key, {V.key_sql('url', 'import')} AS import_key, {V.key_sql('url', 'citation')} AS citation_key FROM sources")
def h1_h3_url_keys(s, d):
    return V.sources(s, d).select("source_id", urls.dedup_key("url").alias("dedup_key"), urls.import_key("url").alias("import_key"), urls.citation_key("url").alias("citation_key"))


@query("SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL ELSE 'v' || page_id END AS video FROM pages")
def h7_video_id(s, d):
    k = F.col("page_id")
    v = F.concat(F.lit("v"), k)
    url = F.when(k % 5 == 0, F.concat(F.lit("https://youtu.be/"), v, F.lit("?t=3"))).when(k % 5 == 1, F.concat(F.lit("https://www.youtube.com/shorts/"), v)).when(k % 5 == 2, F.concat(F.lit("http://M.youtube.com/watch?a=b&v="), v)).when(k % 5 == 3, F.concat(F.lit("https://youtube.com/Embed/"), v, F.lit("/x"))).otherwise(F.concat(F.lit("https://evil.org/youtube.com/watch?v="), v))
    return V.table(s, d, "pages").select("page_id", urls.video_id(url).alias("video"))


@query(f"WITH r AS (SELECT 'example.com' AS rule, 'com' AS class UNION ALL SELECT 'example.net', 'net' UNION ALL SELECT 'example.org', 'org'), h AS (SELECT page_id, lower(regexp_extract(url, '{V.PARTS}', 2)) AS host FROM pages) SELECT page_id, class FROM h JOIN r ON host = rule OR ends_with(host, '.' || rule)")
def h8_host_class(s, d):
    rules = s.createDataFrame([("example.com", "com"), ("example.net", "net"), ("example.org", "org")], "rule string, class string")
    h = V.table(s, d, "pages").select("page_id", urls.host("url").alias("host"))
    labels = F.split("host", "\\.")
    h = h.withColumn("rule", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    return h.join(rules, "rule").select("page_id", "class")


@query(f"""WITH {V.ARTIFACTS} SELECT id, CASE WHEN n = '' THEN 'untitled' ELSE n END AS name FROM (SELECT id, regexp_replace(regexp_replace('. ' || title || ' ..', '[/\\\\:*?"<>|]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS n FROM artifacts)""")
def h12_safe_names(s, d):
    return V.artifacts(s, d).select("id", text.safe_name(F.concat(F.lit(". "), "title", F.lit(" .."))).alias("name"))


def scrubbed_sql(raw: str) -> str:
    """text.scrubbed() in SQL: the same patterns in the same order."""
    for pattern, to in text.SECRETS:
        raw = "regexp_replace(" + raw + ", '" + pattern.replace("'", "''") + "', '" + re.sub(r"\$(\d)", r"\\\1", to).replace("'", "''") + "', 'g')"
    return raw


@query("SELECT doc_id, " + scrubbed_sql("'SNlM0e\": \"ab' || doc_id || '\" f.sid=-' || doc_id || ' __Secure-X=a; ' || text || ' g.a000-abcdefgh' || doc_id || ' at=\"q\" Set-Cookie: ' || doc_id") + " AS clean FROM documents")
def h14_scrubbed(s, d):
    """Every document's whole text, between planted secrets of other kinds than the next query's."""
    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit('SNlM0e": "ab'), k, F.lit('" f.sid=-'), k, F.lit(" __Secure-X=a; "), "text", F.lit(" g.a000-abcdefgh"), k, F.lit(' at="q" Set-Cookie: '), k)
    return V.table(s, d, "documents").select("doc_id", text.scrubbed(raw).alias("clean"))


@query("SELECT doc_id, " + scrubbed_sql("'x access_token=' || md5(CAST(doc_id AS VARCHAR)) || '&y ' || text || ' Authorization: Bearer ' || doc_id || ' z'") + " AS clean FROM documents")
def h14_scrubbed_whole(s, d):
    """Every document's whole text, between two planted secrets."""
    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("x access_token="), F.md5(k), F.lit("&y "), F.col("text"), F.lit(" Authorization: Bearer "), k, F.lit(" z"))
    return V.table(s, d, "documents").select("doc_id", text.scrubbed(raw).alias("clean"))


def redacted_sql(raw: str) -> str:
    """text.redacted() in SQL, whose engine can't look ahead: a second group holds the separator behind a home folder of two words."""
    home = r"(?:\w+(?:[.-]+\w+)* \w+(?:[.-]+\w+)*({0})|\w+(?:[.-]+\w+)*)"
    paths = [(r"(/files/(?:dl|ul)/)[A-Za-z0-9._-]+", r"\1***"), ("(/(?:home|Users)/)" + home.format("/"), r"\1***\2"), (r"(?i)([A-Za-z]:[\\/]Users[\\/])" + home.format(r"[\\/]"), r"\1***\2")]
    out = scrubbed_sql(raw)
    for pattern, to in [*paths, (r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")]:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


@query("SELECT doc_id, CASE WHEN length(m) > 300 THEN substring(m, 1, 300) || '…' ELSE m END AS message FROM (SELECT doc_id, " + redacted_sql("'/home/jo.doe/x ' || text") + " AS m FROM documents)")
def h15_redacted(s, d):
    return V.table(s, d, "documents").select("doc_id", text.redacted(F.concat(F.lit("/home/jo.doe/x "), "text")).alias("message"))


@query(f"WITH {V.ANSWERS} SELECT a.conv_id, a.turn, regexp_replace(answer, ' ?\\[([0-9]+)\\]', '', 'g') AS clean FROM answers a")
def h18_without_markers(s, d):
    return V.answers(s, d).select("conv_id", "turn", text.without_markers("answer").alias("clean"))


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' WHEN 6 THEN 'completed' ELSE 'failed' END AS status FROM orders")
def h28_research_status(s, d):
    return V.table(s, d, "orders").select("o_orderkey", codes.research_status(F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderkey") % 8)).alias("status"))


@query("SELECT event_id, CASE WHEN value / 50 BETWEEN 0 AND 1 THEN value / 50 END AS score, CASE WHEN user_id - 50 >= 0 AND user_id - 50 <= event_id THEN user_id - 50 END AS span_start FROM events")
def h21_h22_score_and_span(s, d):
    return V.table(s, d, "events").select("event_id", codes.score(F.col("value") / 50).alias("score"), codes.span(F.col("user_id") - 50, "event_id")["start"].alias("span_start"))


@query(f"WITH {V.BRIDGE}, more AS (SELECT 'toxic' AS label_id, source_id, pos FROM bridge WHERE label_id = 'quality' AND pos % 4 = 0), u AS (SELECT *, 0 AS nw FROM bridge UNION ALL SELECT label_id, pos, source_id, 1 FROM more), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY label_id, source_id ORDER BY nw, pos) = 1) SELECT label_id, row_number() OVER (PARTITION BY label_id ORDER BY nw, pos) AS pos, source_id FROM f")
def k2_members_added(s, d):
    b = V.label_bridge(s, d)
    return membership.added(b, b.where("label_id = 'quality' AND pos % 4 = 0").select(F.lit("toxic").alias("label_id"), "pos", "source_id"))


@query(f"WITH {V.BRIDGE} SELECT label_id, pos, source_id FROM bridge WHERE NOT (label_id = 'quality' AND pos % 3 = 0)")
def k3_members_removed(s, d):
    b = V.label_bridge(s, d)
    return membership.removed(b, b.where("label_id = 'quality' AND pos % 3 = 0").select("label_id", "source_id")).select("label_id", "pos", "source_id")


@query("SELECT nb, email, permission FROM (SELECT user_id % 20 AS nb, 'u' || (user_id % 7) AS email, 2 + event_id % 3 AS permission, row_number() OVER (PARTITION BY user_id % 20, user_id % 7 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND permission <> 4")
def k4_permissions(s, d):
    u = F.col("user_id")
    return membership.permissions(V.table(s, d, "events").select((u % 20).alias("nb"), F.concat(F.lit("u"), u % 7).alias("email"), (2 + F.col("event_id") % 3).alias("permission"), F.col("event_id").alias("pos")))


@query("SELECT n_nationkey AS label_id, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey % 4 = 0 THEN '*' ELSE '-' END AS emoji FROM nation")
def k5_attribute_patch(s, d):
    n = V.table(s, d, "nation").select(F.col("n_nationkey").alias("label_id"), F.col("n_name").alias("name"), F.lit("-").alias("emoji"))
    k = F.col("label_id")
    return membership.patched(n, n.select("label_id", F.when(k % 3 == 0, F.lower("name")).alias("name"), F.when(k % 4 == 0, "*").alias("emoji")))


@query("""WITH m AS (SELECT conv_id, turn, role = 'assistant' AS marked, text FROM conversations) SELECT conv_id, text AS answer, marked FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY marked DESC, length(text) DESC, turn) = 1""")
def i5_answer_fold(s, d):
    c = V.table(s, d, "conversations").withColumn("marked", F.col("role") == "assistant")
    best = F.min_by(F.struct("text", "marked"), F.struct((~F.col("marked")).alias("u"), (-F.length("text")).alias("l"), "turn"))
    return c.groupBy("conv_id").agg(best.alias("b")).select("conv_id", F.col("b.text").alias("answer"), "b.marked")


