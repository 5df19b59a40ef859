"""Entity tables derived from the test tables; the SQL beside each makes the same rows in another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nb, source_id, url, title, status, type_code, created_at (epoch), pos: pages, and a variant of every third one."""
    pid = F.col("page_id")
    title = F.when(pid % 13 == 0, "403 Forbidden").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    status = F.when(pid % 11 == 0, 3).when(pid % 11 == 1, 1).otherwise(2)
    made = F.when(pid % 17 != 0, BASE + pid * 60)
    top = F.upper(F.regexp_extract("url", "^([a-z]+://[^/?#]*)(.*)$", 1))
    form = lambda prefix, url, at, pos: F.struct(F.concat(F.lit(prefix), pid).alias("source_id"), url.alias("url"), at.alias("created_at"), pos.alias("pos"))
    page = form("p", F.col("url"), made, pid * 2)
    variant = form("v", F.concat(top, F.regexp_extract("url", "^([a-z]+://[^/?#]*)(.*)$", 2), F.lit("#v")), made + F.when(pid % 2 == 0, -86400).otherwise(86400), pid * 2 + 1)
    p = table(spark, sf_dir, "pages").select("page_id", (pid % 20).alias("nb"), title.alias("title"), status.alias("status"), F.when(pid % 3 == 0, F.array(page, variant)).otherwise(F.array(page)).alias("forms"))
    each = p.select("page_id", "nb", "title", "status", F.explode("forms").alias("f"))  # one scan for both
    return each.select("page_id", "nb", "f.source_id", "f.url", "title", "status", F.lit(5).alias("type_code"), "f.created_at", "f.pos")


SOURCES = f"""
p AS (SELECT page_id, page_id % 20 AS nb, 'p' || page_id AS source_id, url,
  CASE WHEN page_id % 13 = 0 THEN '403 Forbidden' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  CASE page_id % 11 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS status, 5 AS type_code,
  CASE WHEN page_id % 17 <> 0 THEN {BASE} + page_id * 60 END AS created_at, page_id * 2 AS pos FROM pages),
v AS (SELECT page_id, nb, 'v' || page_id AS source_id,
  upper(regexp_extract(url, '^([a-z]+://[^/?#]*)(.*)$', 1)) || regexp_extract(url, '^([a-z]+://[^/?#]*)(.*)$', 2) || '#v' AS url, title, status, type_code,
  created_at + CASE WHEN page_id % 2 = 0 THEN -86400 ELSE 86400 END AS created_at, pos + 1 AS pos FROM p WHERE page_id % 3 = 0),
sources AS (SELECT * FROM p UNION ALL SELECT * FROM v)"""

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def key_sql(url: str, kind: str) -> str:
    """dedup_key, import_key or citation_key as SQL."""
    u = f"regexp_replace({url}, '[.,;:!?]+$', '')" if kind == "citation" else url
    g = lambda k: f"regexp_extract({u}, '{PARTS}', {k})"
    path = g(3) if kind == "dedup" else f"regexp_replace({g(3)}, '/+$', '')"
    some = lambda x, a, b: f"CASE WHEN {x} <> '' THEN '{a}' || {x} || '{b}' ELSE '' END"
    out = [some(f"lower({g(1)})", "", ":"), some(f"lower({g(2)})", "//", ""), path, some(g(4), "?", "")] + ([some(g(5), "#", "")] if kind == "citation" else [])
    return "(" + " || ".join(f"({x})" for x in out) + ")"


def fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, did = table(spark, sf_dir, "documents"), F.col("doc_id")
    """Every whole document, and of some an error page that begins with a phrase and is short enough to be taken for one."""
    text = F.when(did % 7 == 0, F.substring(F.concat(F.lit("Page Not Found "), "text"), 1, 1500)).otherwise(F.substring(F.concat(F.lit("Just a moment "), "text"), 1, 4000))
    pages = d.where((did % 7 == 0) | (did % 9 == 0)).select("doc_id", F.concat(F.lit("e"), did).alias("source_id"), text.alias("content"))
    return d.select("doc_id", F.concat(F.lit("d"), did).alias("source_id"), F.col("text").alias("content")).unionByName(pages)


FULLTEXT = """
fulltext AS (SELECT doc_id, 'd' || doc_id AS source_id, text AS content FROM documents UNION ALL
  SELECT doc_id, 'e' || doc_id, CASE WHEN doc_id % 7 = 0 THEN substr('Page Not Found ' || text, 1, 1500) ELSE substr('Just a moment ' || text, 1, 4000) END FROM documents WHERE doc_id % 7 = 0 OR doc_id % 9 = 0)"""


def label_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, pos, source_id: memberships in order, every tenth of something that is not there."""
    lab = table(spark, sf_dir, "labels")
    rows = lab.where("quality = 1").select(F.lit("quality").alias("label_id"), "doc_id").unionByName(lab.where("toxic = 1").select(F.lit("toxic").alias("label_id"), "doc_id"))
    return rows.select("label_id", F.col("doc_id").alias("pos"), F.concat(F.when(F.col("doc_id") % 10 == 0, "gone").otherwise("d"), "doc_id").alias("source_id"))


BRIDGE = """
bridge AS (SELECT label_id, doc_id AS pos, CASE WHEN doc_id % 10 = 0 THEN 'gone' ELSE 'd' END || doc_id AS source_id FROM (
  SELECT 'quality' AS label_id, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1))"""


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nb, pos, url, kind: odd pages, slash and fragment variants of even ones, reports and rows without a URL."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("nb"), "url")
    pid = F.col("page_id")
    url = F.when(pid % 10 == 9, F.lit(None)).when(pid % 4 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/#top"))).otherwise(F.col("url"))
    kind = F.when(pid % 10 == 9, F.when(pid % 20 == 9, "report").otherwise("none")).otherwise("web")
    return p.where((pid % 2 == 1) | (pid % 4 == 0)).select("nb", pid.alias("pos"), url.alias("url"), kind.alias("kind"))


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.col("page_id")
    return table(spark, sf_dir, "pages").where((pid % 4 == 0) | (pid % 6 == 1)).select((pid % 20).alias("nb"), pid.alias("pos"), F.concat(F.lit("e"), pid).alias("source_id"), F.regexp_replace("url", "[?#].*$", "").alias("url"))


REQUESTED = """
requested AS (SELECT page_id % 20 AS nb, page_id AS pos, CASE WHEN page_id % 10 = 9 THEN NULL WHEN page_id % 4 = 0 THEN regexp_replace(url, '[?#].*$', '') || '/#top' ELSE url END AS url,
  CASE WHEN page_id % 10 = 9 THEN CASE WHEN page_id % 20 = 9 THEN 'report' ELSE 'none' END ELSE 'web' END AS kind FROM pages WHERE page_id % 2 = 1 OR page_id % 4 = 0),
existing AS (SELECT page_id % 20 AS nb, page_id AS pos, 'e' || page_id AS source_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages WHERE page_id % 4 = 0 OR page_id % 6 = 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, snapshot_ts, pos, status, type_code, present."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "signup", 5).when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("pos"), status.alias("status"), F.when(F.col("user_id") % 5 == 0, 10).otherwise(5).alias("type_code"), (F.col("event_id") % 6 != 0).alias("present"))


SNAPSHOTS = """
snapshots AS (SELECT user_id AS entity_id, ts AS snapshot_ts, event_id AS pos, CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS status,
  CASE WHEN user_id % 5 = 0 THEN 10 ELSE 5 END AS type_code, event_id % 6 <> 0 AS present FROM events)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nb, id, title, status, created_at, type_code, variant, is_owner."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 1).otherwise(4)
    title = F.concat(F.when(k % 4 == 0, "Briefing Doc ").when(k % 4 == 1, "study guide ").when(k % 4 == 2, "Blog Post: ").otherwise("Notes/"), F.col("o_orderpriority"))
    return o.select((F.col("o_custkey") % 50).alias("nb"), k.alias("id"), title.alias("title"), status.alias("status"), F.col("o_orderdate").cast("date").alias("created_at"), (k % 10).cast("int").alias("type_code"), F.when(k % 3 != 0, (F.floor(k / 10) % 5).cast("int")).alias("variant"), (k % 7 == 0).alias("is_owner"))


ARTIFACTS = """
artifacts AS (SELECT o_custkey % 50 AS nb, o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Briefing Doc ' WHEN 1 THEN 'study guide ' WHEN 2 THEN 'Blog Post: ' ELSE 'Notes/' END || o_orderpriority AS title,
  CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 4 END AS status, CAST(o_orderdate AS DATE) AS created_at, CAST(o_orderkey % 10 AS INT) AS type_code,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST((o_orderkey // 10) % 5 AS INT) END AS variant, o_orderkey % 7 = 0 AS is_owner FROM orders)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nb, report: markdown links, bare URLs with punctuation after them, and images, over a group's URLs. A row is a line of the group's report."""
    pid = F.col("page_id")
    one = F.when(pid % 3 == 0, F.concat(F.lit("see [page]("), "url", F.lit(")"))).when(pid % 3 == 1, F.concat(F.lit("from "), "url", F.lit("."))).otherwise(F.concat(F.lit("![pic]("), "url", F.lit(") x")))
    return table(spark, sf_dir, "pages").where(pid % 2 == 0).select((pid % 20).alias("nb"), one.alias("report"))


REPORTS = """
reports AS (SELECT nb, string_agg(t, chr(10) ORDER BY page_id) AS report FROM (SELECT page_id % 20 AS nb, page_id,
  CASE page_id % 3 WHEN 0 THEN 'see [page](' || url || ')' WHEN 1 THEN 'from ' || url || '.' ELSE '![pic](' || url || ') x' END AS t FROM pages WHERE page_id % 2 = 0) GROUP BY nb)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, answer with markers, refs (source_id, citation_number, chunk_id); a hole in the numbers every fifth row."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    key: Column = F.col("conv_id") * 1000 + F.col("turn")
    ref = lambda k, n: F.struct(F.concat(F.lit("d"), (key + k) % 100).alias("source_id"), n.cast("long").alias("citation_number"), F.when((key + k) % 4 != 0, F.concat(F.lit("c"), key + k)).alias("chunk_id"))
    refs = F.array(ref(0, F.lit(1)), ref(1, F.when(key % 5 != 0, 2)), ref(2, F.when(key % 3 == 0, 2)))
    return c.select("conv_id", "turn", F.concat(F.substring("text", 1, 30), F.lit(" [1]"), F.expr("substring(text, 31)"), F.lit(" [2][3]")).alias("answer"), refs.alias("refs"))


ANSWERS = """
answers AS (SELECT conv_id, turn, substr(text, 1, 30) || ' [1]' || substr(text, 31) || ' [2][3]' AS answer, conv_id * 1000 + turn AS k FROM conversations WHERE role = 'assistant'),
refs AS (SELECT conv_id, turn, i + 1 AS ord, 'd' || ((k + i) % 100) AS source_id, CASE i WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN k % 5 <> 0 THEN 2 END ELSE CASE WHEN k % 3 = 0 THEN 2 END END AS citation_number,
  CASE WHEN (k + i) % 4 <> 0 THEN 'c' || (k + i) END AS chunk_id FROM answers, (SELECT unnest(range(3)) AS i))"""
