"""Resolution by title (C), unions and paging (F, G), more scalar functions (H) and tree flattening (K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, text, urls
from ..operators import resolve
from ..sources import views as V
from .registry import query

FORMATS = {"audio": "mp3", "video": "mp4", "slide_deck": "pdf", "infographic": "png", "report": "md", "data_table": "csv", "mind_map": "json"}
TITLES = "SELECT DISTINCT lower(substr(o_orderpriority, 1, 3)) AS token FROM orders UNION SELECT DISTINCT lower(n_name) FROM nation"
NAMES = "SELECT n_nationkey AS id, lower(n_name) AS title FROM nation UNION ALL SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) + 100, lower(o_orderpriority) FROM orders"


@query(f"""WITH t AS ({TITLES}), i AS ({NAMES}), e AS (SELECT title AS token, count(*) AS n, min(id) AS id FROM i GROUP BY title),
p AS (SELECT token, count(*) AS n, min(id) AS id FROM t JOIN i ON starts_with(title, token) GROUP BY token)
SELECT token, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'ambiguous' WHEN p.n = 1 THEN 'prefix' WHEN p.n > 1 THEN 'ambiguous' ELSE 'none' END AS verdict,
  CASE WHEN e.n = 1 THEN e.id WHEN e.n IS NULL AND p.n = 1 THEN p.id END AS id FROM t LEFT JOIN e USING (token) LEFT JOIN p USING (token)""")
def c10_resolve_titles(s, d):
    n, o = V.table(s, d, "nation"), V.table(s, d, "orders")
    prio = F.col("o_orderpriority")
    tokens = o.select(F.lower(F.substring(prio, 1, 3)).alias("token")).union(n.select(F.lower("n_name"))).distinct()
    items = n.select(F.col("n_nationkey").cast("int").alias("id"), F.lower("n_name").alias("title")).union(o.select(F.substring(prio, 1, 1).cast("int") + 100, F.lower(prio)).distinct())
    exact = items.groupBy(F.col("title").alias("token")).agg(F.count("*").alias("n"), F.min("id").alias("one"))
    prefix = resolve.begun(tokens, items, "token", "title").groupBy("token").agg(F.count("*").alias("m"), F.min("id").alias("first"))
    verdict = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(F.col("m") == 1, "prefix").when(F.col("m") > 1, "ambiguous").otherwise("none")
    return tokens.join(exact, "token", "left").join(prefix, "token", "left").select("token", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("one")).when(F.col("n").isNull() & (F.col("m") == 1), F.col("first")).alias("id"))


@query("""WITH f AS (SELECT c.conv_id, c.turn, c.text AS cited, d.doc_id, strpos(d.text, substr(c.text, 1, 40)) AS p FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'assistant')
SELECT conv_id, turn, CASE WHEN coalesce(trim(cited), '') = '' THEN 'no_cited_text' WHEN coalesce(p, 0) = 0 THEN 'not_found' ELSE 'found' END AS status, CASE WHEN p > 0 THEN CAST(p - 1 AS BIGINT) END AS start FROM f""")
def c15_passage_status(s, d):
    c = V.table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("cited"))
    docs = V.table(s, d, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    at = F.expr("instr(text, substring(cited, 1, 40))")
    rows = c.join(docs, "conv_id", "left").withColumn("at", at)
    status = F.when(F.trim(F.coalesce("cited", F.lit(""))) == "", "no_cited_text").when(F.coalesce("at", F.lit(0)) == 0, "not_found").otherwise("found")
    return rows.select("conv_id", "turn", status.alias("status"), F.when(F.col("at") > 0, (F.col("at") - 1).cast("long")).alias("start"))


@query(f"WITH {V.REPORTS}, u AS (SELECT nb, unnest(regexp_extract_all(report, 'https?://[^\\s<>()\\[\\]\"'']+')) AS url FROM reports) SELECT nb, count(*) AS n_found, count(DISTINCT {V.key_sql('url', 'citation')}) AS n_cited FROM u GROUP BY nb")
def d11_cited_counts(s, d):
    found = V.reports(s, d).select("nb", F.explode(F.regexp_extract_all("report", F.lit(r"https?://[^\s<>()\[\]\"']+"), 0)).alias("url"))
    return found.groupBy("nb").agg(F.count("*").alias("n_found"), F.count_distinct(urls.citation_key("url")).alias("n_cited"))


@query("""SELECT conv_id, role, text, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 4""")
def f6_history_limit(s, d):
    """Two exchanges are four rows; only a window's first rows leave each task."""
    c = V.table(s, d, "conversations").where(F.col("role").isin("user", "assistant"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return c.withColumn("n", n).where("n <= 4").select("conv_id", "role", "text", "turn")


@query(f"""WITH {V.ARTIFACTS} SELECT nb, 'artifact' AS origin, CAST(id AS BIGINT) AS id, title FROM artifacts WHERE status = 3 UNION ALL SELECT p_partkey % 50, 'mind_map', CAST(p_partkey AS BIGINT), p_name FROM part WHERE p_partkey % 5 = 0""")
def g2_artifacts_and_maps(s, d):
    a = V.artifacts(s, d).where("status = 3").select("nb", F.lit("artifact").alias("origin"), F.col("id").cast("long").alias("id"), "title")
    k = F.col("p_partkey")
    return a.unionByName(V.table(s, d, "part").where(k % 5 == 0).select((k % 50).alias("nb"), F.lit("mind_map").alias("origin"), k.cast("long").alias("id"), F.col("p_name").alias("title")))


@query("""SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)(youtube\\.com|youtu\\.be)$') THEN true ELSE false END AS is_video, h FROM (
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '') AS h FROM pages)""")
def h6_video_host(s, d):
    return V.table(s, d, "pages").select("page_id", (urls.on_host("url", "youtube.com") | urls.on_host("url", "youtu.be")).alias("is_video"), urls.host("url").alias("h"))


@query("""SELECT event_id, CASE WHEN value BETWEEN 0 AND 253402300799 THEN epoch_ms(CAST(floor(value) AS BIGINT) * 1000) END AS at FROM events""")
def h19_epochs(s, d):
    return V.table(s, d, "events").select("event_id", codes.epoch(F.floor(F.when(F.col("value") >= 0, F.col("value")))).cast("timestamp_ntz").alias("at"))


@query("""SELECT conv_id, trim(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(text) <> '')) AS cited, min(turn) FILTER (trim(text) <> '') AS first_turn, max(turn) FILTER (trim(text) <> '') AS last_turn FROM conversations GROUP BY conv_id""")
def h23_cited_text(s, d):
    parts = V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))).alias("p"))
    p = F.filter("p", lambda x: x["t"] != "")
    return parts.select("conv_id", p.alias("p")).select("conv_id", F.nullif(F.trim(F.array_join(F.transform("p", lambda x: x["t"]), " ")), F.lit("")).alias("cited"), F.try_element_at("p", F.lit(1))["turn"].alias("first_turn"), F.try_element_at("p", F.lit(-1))["turn"].alias("last_turn"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' WHEN 'error' THEN '5' ELSE event_type END AS code FROM events""")
def h30_result_types(s, d):
    named = F.when(F.col("event_type") == "view", "web").when(F.col("event_type") == "click", "drive").when(F.col("event_type") == "error", "report").otherwise(F.col("event_type"))
    known = F.create_map(*[F.lit(x) for k, v in codes.RESULT_TYPE.items() for x in (k, str(v))])
    return V.table(s, d, "events").select("event_id", F.coalesce(F.try_element_at(known, named), named).alias("code"))


@query(f"""WITH {V.ARTIFACTS} SELECT id, CASE type_code WHEN 1 THEN 'mp3' WHEN 2 THEN 'md' WHEN 3 THEN 'mp4' WHEN 4 THEN CASE WHEN variant = 4 THEN 'json' END WHEN 5 THEN 'json' WHEN 7 THEN 'png' WHEN 8 THEN 'pdf' WHEN 9 THEN 'csv' END AS extension FROM artifacts""")
def h34_extensions(s, d):
    kind = codes.artifact_kind("type_code", "variant")
    return V.artifacts(s, d).select("id", F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), kind).alias("extension"))


@query("""SELECT doc_id, list_filter(list_transform(string_split(lang || ', ,' || source, ','), lambda x: trim(x)), lambda x: x <> '') AS l, len(l) AS n, array_to_string(l, '|') AS words FROM documents""".replace("SELECT doc_id, ", "SELECT doc_id, n, words FROM (SELECT doc_id, ") + ")")
def h36_keywords(s, d):
    words = F.filter(F.transform(F.split(F.concat("lang", F.lit(", ,"), "source"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return V.table(s, d, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.array_join(words, "|").alias("words"))


@query("""SELECT u.conv_id, u.turn, CASE WHEN coalesce(u.text, '') <> '' THEN '**Q:** ' || u.text ELSE '' END || CASE WHEN coalesce(u.text, '') <> '' AND coalesce(a.text, '') <> '' THEN chr(10) || chr(10) ELSE '' END || CASE WHEN coalesce(a.text, '') <> '' THEN '**A:** ' || a.text ELSE '' END AS pair
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def h37_formatted_pairs(s, d):
    c = V.table(s, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", text.pair("text", "answer").alias("pair"))


@query("""WITH t AS (SELECT r_regionkey AS map_id, r_name AS path, 0 AS depth, NULL AS parent_path, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS child_count FROM region
UNION ALL SELECT r_regionkey, r_name || '/' || n_name, 1, r_name, n_name, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey, r_name || '/' || n_name || '/' || c_mktsegment, 2, r_name || '/' || n_name, c_mktsegment, 0 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) ON c_nationkey = n_nationkey)
SELECT map_id, path, CAST(depth AS INT) AS depth, parent_path, name, CAST(child_count AS BIGINT) AS child_count FROM t""")
def k1_flattened_maps(s, d):
    """A tree per region as JSON, then flattened level by level; a tree has so many levels as its type names."""
    leaf = V.table(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    leaf = leaf.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("name"))).alias("children"))
    mid = V.table(s, d, "nation").join(leaf, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "children")).alias("children"))
    trees = V.table(s, d, "region").join(mid, "r_regionkey", "left").select(F.col("r_regionkey").alias("map_id"), F.to_json(F.struct(F.col("r_name").alias("name"), "children")).alias("tree"))
    shape = "struct<name:string,children:array<struct<name:string,children:array<struct<name:string>>>>>"
    root = trees.select("map_id", F.from_json("tree", shape).alias("t")).select("map_id", F.col("t.name").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_path"), F.col("t.name").alias("name"), F.col("t.children").alias("kids"))
    below = lambda p, k: p.select("map_id", F.col("path").alias("parent_path"), F.explode("kids").alias("c")).select("map_id", F.concat("parent_path", F.lit("/"), "c.name").alias("path"), F.lit(k).alias("depth"), "parent_path", F.col("c.name").alias("name"), *([F.col("c.children").alias("kids")] if k == 1 else []))
    first = below(root, 1)
    n = F.coalesce(F.size("kids"), F.lit(0)).cast("long")
    count = F.when(F.col("kids").isNull(), F.lit(0)).otherwise(n).cast("long").alias("child_count")
    cols = ["map_id", "path", "depth", "parent_path", "name"]
    return root.select(*cols, count).unionByName(first.select(*cols, count)).unionByName(below(first, 2).select(*cols, F.lit(0).cast("long").alias("child_count")))
