"""Scans, views, filters, paging, set operations (A, B, F, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, text, urls
from ..operators import citations, names, rows
from ..sources import views as V
from .registry import query


def _listing(s, d):
    src = V.sources(s, d)
    return src.unionByName(src.where("page_id % 5 = 0").withColumn("title", F.lit("again")).withColumn("pos", F.col("pos") + 1_000_000))


@query(f"""WITH {V.SOURCES}, l AS (SELECT * FROM sources UNION ALL SELECT page_id, nb, source_id, url, 'again', status, type_code, created_at, pos + 1000000 FROM sources WHERE page_id % 5 = 0)
SELECT nb, source_id, title, pos FROM (SELECT *, row_number() OVER (PARTITION BY nb, source_id ORDER BY pos) AS n FROM l) WHERE n = 1""")
def a1_roster(s, d):
    return rows.keep_first(_listing(s, d), ["nb", "source_id"], ["pos"]).select("nb", "source_id", "title", "pos")


@query("""SELECT page_id % 20 AS nb, count(*) AS n, count(*) FILTER (url LIKE '%?%') AS n_bad, 10 * count(*) FILTER (url LIKE '%?%') > count(*) AS failed FROM pages GROUP BY 1""")
def a3_malformed_rate(s, d):
    bad = F.count(F.when(F.col("url").contains("?"), 1))
    return V.table(s, d, "pages").groupBy((F.col("page_id") % 20).alias("nb")).agg(F.count("*").alias("n"), bad.alias("n_bad"), (10 * bad > F.count("*")).alias("failed"))


@query("""SELECT p_partkey % 40 AS deck, '{"title":"deck ' || (p_partkey % 40) || '","cards":[' || string_agg('{"front":' || to_json(p_name) || ',"back":' || to_json(p_brand) || '}', ',' ORDER BY p_partkey) || ']}' AS doc FROM part GROUP BY p_partkey % 40""")
def a6_flashcards_json(s, d):
    cards = V.table(s, d, "part").groupBy((F.col("p_partkey") % 40).alias("deck")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("f"), F.col("p_brand").alias("b")))).alias("c"))
    return cards.select("deck", F.to_json(F.struct(F.concat(F.lit("deck "), "deck").alias("title"), F.transform("c", lambda c: F.struct(c["f"].alias("front"), c["b"].alias("back"))).alias("cards"))).alias("doc"))


@query("""SELECT p_partkey % 40 AS deck, '# deck ' || (p_partkey % 40) || chr(10) || chr(10) || string_agg('## Card ' || n || chr(10) || chr(10) || '**Q:** ' || p_name || chr(10) || chr(10) || '**A:** ' || p_brand || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY n) AS doc
FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS n FROM part) GROUP BY p_partkey % 40""")
def a7_flashcards_markdown(s, d):
    cards = V.table(s, d, "part").groupBy((F.col("p_partkey") % 40).alias("deck")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("f"), F.col("p_brand").alias("b")))).alias("c"))
    one = lambda c, i: F.concat(F.lit("## Card "), (i + 1).cast("string"), F.lit("\n\n**Q:** "), c["f"], F.lit("\n\n**A:** "), c["b"], F.lit("\n\n---\n"))
    return cards.select("deck", F.concat(F.lit("# deck "), F.col("deck").cast("string"), F.lit("\n\n"), F.array_join(F.transform("c", one), "\n")).alias("doc"))


@query("""SELECT page_id, 'track' AS name, CAST(regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS BIGINT) AS value FROM pages WHERE regexp_extract(html, 'track\\(([0-9]+)\\)', 1) <> ''""")
def a9_embedded_value(s, d):
    v = F.regexp_extract("html", r"track\(([0-9]+)\)", 1)
    return V.table(s, d, "pages").where(v != "").select("page_id", F.lit("track").alias("name"), v.cast("long").alias("value"))


PLANNED = """w AS (SELECT nb, id, title || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.md' AS file FROM (SELECT nb, id, replace(replace(title, '/', '_'), ':', '_') AS title, row_number() OVER (PARTITION BY nb, title ORDER BY id) AS n FROM artifacts WHERE status = 3)),
e AS (SELECT DISTINCT nb, replace(replace(title, '/', '_'), ':', '_') || '.md' AS file FROM artifacts WHERE status = 1)"""


def planned(s, d):
    """Files that are to be written, each title of a folder numbered already, and files that are there: of other artifacts, so many have the name of the first."""
    a = V.artifacts(s, d)
    safe = F.regexp_replace("title", "[/:]", "_")
    n = F.row_number().over(Window.partitionBy("nb", "title").orderBy("id"))
    w = a.where("status = 3").select("nb", "id", F.concat(safe, F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(""), F.lit(".md")).alias("file"))
    return w, a.where("status = 1").select("nb", F.concat(safe, F.lit(".md")).alias("file")).distinct()


@query(f"""WITH {V.ARTIFACTS}, {PLANNED} SELECT id, 'force' AS policy, CASE WHEN e.file IS NULL THEN 'write' ELSE 'overwritten' END AS action, w.file AS target FROM w LEFT JOIN e USING (nb, file)
UNION ALL SELECT id, 'skip', CASE WHEN e.file IS NULL THEN 'write' ELSE 'skipped' END, CASE WHEN e.file IS NULL THEN w.file END FROM w LEFT JOIN e USING (nb, file)""")
def a10_conflict_policy(s, d):
    w, e = planned(s, d)
    both = [names.resolved(w, "nb", "file", "id", e, p).select("id", F.lit(p).alias("policy"), "action", "target") for p in ("force", "skip")]
    return both[0].unionByName(both[1])


@query(f"""WITH {V.ARTIFACTS}, w AS (SELECT nb, id, replace(replace(title, '/', '_'), ':', '_') AS title, row_number() OVER (PARTITION BY nb, title ORDER BY id) AS n FROM artifacts WHERE status = 3),
e AS (SELECT DISTINCT nb, replace(replace(title, '/', '_'), ':', '_') AS title FROM artifacts WHERE status = 1), j AS (SELECT w.*, e.title IS NOT NULL AS there FROM w LEFT JOIN e USING (nb, title))
SELECT id, title || CASE WHEN n + there::INT > 1 THEN ' (' || (n + there::INT) || ')' ELSE '' END || '.md' AS file FROM j""")
def e8_names_beside_existing(s, d):
    """Names for titles where files of other artifacts are there already."""
    a = V.artifacts(s, d)
    _, e = planned(s, d)
    got = names.unique(a.where("status = 3").select("nb", "id", "title", F.lit(".md").alias("ext")), "nb", "title", "ext", "id", e)
    return got.select("id", "file")


KIND_SQL = "CASE type_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.SOURCE_KIND.items()) + " ELSE 'unknown' END"
STATUS_SQL = "CASE status " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.SOURCE_STATUS.items()) + " ELSE 'unknown' END"


@query(f"WITH {V.SOURCES} SELECT source_id, title, {KIND_SQL} AS kind, {STATUS_SQL} AS status_label, CAST(created_at AS BIGINT) AS created_at FROM sources")
def b2_compact_view(s, d):
    return V.sources(s, d).select("source_id", "title", codes.source_kind("type_code").alias("kind"), codes.source_status("status").alias("status_label"), "created_at")


@query(f"WITH {V.SOURCES} SELECT *, {KIND_SQL} AS kind, {STATUS_SQL} AS status_label FROM sources")
def b1_full_view(s, d):
    return V.sources(s, d).withColumns({"kind": codes.source_kind("type_code"), "status_label": codes.source_status("status")})


@query(f"WITH {V.SOURCES} SELECT nb, source_id FROM sources WHERE {STATUS_SQL} = 'ready'")
def b3_status_filter(s, d):
    return V.sources(s, d).where(codes.source_status("status") == "ready").select("nb", "source_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 14 AND o_orderpriority LIKE '1%' THEN 'pdf' ELSE " + KIND_SQL.replace("type_code", "o_orderkey % 20") + " END AS kind FROM orders")
def b4_source_kind(s, d):
    mime = F.when(F.col("o_orderpriority").startswith("1"), "application/pdf").otherwise("text/x")
    return V.table(s, d, "orders").select("o_orderkey", codes.source_kind(F.col("o_orderkey") % 20, mime).alias("kind"))


ARTIFACT_SQL = "CASE WHEN type_code = 4 THEN CASE variant WHEN 1 THEN 'flashcards' WHEN 2 THEN 'quiz' WHEN 4 THEN 'mind_map' ELSE 'unknown' END ELSE CASE type_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.ARTIFACT_KIND.items()) + " ELSE 'unknown' END END"


@query(f"WITH {V.ARTIFACTS} SELECT id, {ARTIFACT_SQL} AS kind FROM artifacts")
def b5_artifact_kind(s, d):
    return V.artifacts(s, d).select("id", codes.artifact_kind("type_code", "variant").alias("kind"))


@query(f"WITH {V.ARTIFACTS} SELECT id, type_code FROM artifacts WHERE type_code = 5 OR type_code = 4 AND variant = 4")
def b6_mind_map_filter(s, d):
    return V.artifacts(s, d).where((F.col("type_code") == 5) | (F.col("type_code") == 4) & (F.col("variant") == 4)).select("id", "type_code")


@query(f"WITH {V.ARTIFACTS} SELECT id, CASE WHEN lower(title) LIKE 'briefing doc%' THEN 'briefing_doc' WHEN lower(title) LIKE 'study guide%' THEN 'study_guide' WHEN lower(title) LIKE 'blog post%' THEN 'blog_post' ELSE 'report' END AS subtype FROM artifacts WHERE type_code = 2")
def b7_report_subtype(s, d):
    return V.artifacts(s, d).where("type_code = 2").select("id", codes.report_subtype("type_code", "title").alias("subtype"))


@query(f"WITH {V.ARTIFACTS} SELECT id, title FROM artifacts WHERE lower(title) LIKE '%urgent%'")
def b8_title_filter(s, d):
    return V.artifacts(s, d).where(F.contains(F.lower("title"), F.lit("urgent"))).select("id", "title")


NOTE = """notes AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"name":"' || p_name || '","children":[]}' ELSE p_name END AS content, CASE WHEN p_partkey % 10 = 0 THEN 2 END AS sentinel FROM part)"""
NOTE_SQL = """CASE WHEN content IS NULL AND sentinel = 2 THEN 'deleted' WHEN content IS NULL THEN 'unknown' WHEN content LIKE '{%' AND (content LIKE '%"children":%' OR content LIKE '%"nodes":%') THEN 'mind_map' ELSE 'note' END"""


def _notes(s, d):
    k = F.col("p_partkey")
    content = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit('{"name":"'), "p_name", F.lit('","children":[]}'))).otherwise(F.col("p_name"))
    return V.table(s, d, "part").select(k.alias("id"), content.alias("content"), F.when(k % 10 == 0, 2).alias("sentinel"))


def _mind_map():
    return F.col("content").startswith("{") & (F.col("content").contains('"children":') | F.col("content").contains('"nodes":'))


def _note_kind():
    return F.when(F.col("content").isNull(), F.when(F.col("sentinel") == 2, "deleted").otherwise("unknown")).when(_mind_map(), "mind_map").otherwise("note")


@query(f"WITH {NOTE} SELECT id, {NOTE_SQL} AS kind FROM notes")
def b9_note_kind(s, d):
    return _notes(s, d).select("id", _note_kind().alias("kind"))


@query(f"WITH {NOTE} SELECT id FROM notes WHERE {NOTE_SQL} = 'mind_map'")
def b10_mind_map_content(s, d):
    return _notes(s, d).where(_mind_map()).select("id")


@query(f"WITH {NOTE} SELECT id FROM notes WHERE {NOTE_SQL} IN ('note', 'unknown')")
def b20_live_notes(s, d):
    return _notes(s, d).where(~_note_kind().isin("deleted", "mind_map")).select("id")


@query(f"WITH {V.ARTIFACTS} SELECT nb, count(*) AS n FROM artifacts WHERE is_owner GROUP BY nb")
def b11_owned(s, d):
    return V.artifacts(s, d).where("is_owner").groupBy("nb").agg(F.count("*").alias("n"))


@query(f"WITH {V.ARTIFACTS} SELECT id FROM artifacts WHERE status = 3")
def b12_completed(s, d):
    return V.artifacts(s, d).where("status = 3").select("id")


@query(f"WITH {V.ANSWERS} SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS n_refs, string_agg(source_id, ',' ORDER BY ord) AS ids FROM refs GROUP BY ALL")
def b13_lite_references(s, d):
    lite = F.transform("refs", lambda r: F.struct(r["source_id"], r["citation_number"]))
    return V.answers(s, d).select("conv_id", "turn", F.size(lite).cast("long").alias("n_refs"), F.array_join(F.transform(lite, lambda r: r["source_id"]), ",").alias("ids"))


@query(f"WITH {V.SOURCES} SELECT source_id FROM sources WHERE regexp_matches(title, '(?i)^\\s*(access denied|403|404|forbidden|not found|502|just a moment|attention required|security check|captcha)')")
def b14_gateway_titles(s, d):
    return V.sources(s, d).where(text.gateway("title")).select("source_id")


_any = lambda phrases: "(" + " OR ".join(f"contains(lower(content), '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


@query(f"""WITH {V.FULLTEXT} SELECT source_id, CASE WHEN length(content) < 100 THEN 'thin' WHEN length(content) < 2000 AND {_any(text.DEAD_LINK)} THEN 'dead_link' WHEN length(content) < 5000 AND {_any(text.BOT_WALL)} THEN 'bot_wall' END AS tag FROM fulltext""")
def b15_content_sanity(s, d):
    return V.fulltext(s, d).select("source_id", text.sanity("content").alias("tag"))


_HOST = f"regexp_replace(regexp_replace(lower(regexp_extract(url, '{V.PARTS}', 2)), '^.*@', ''), ':[0-9]*$', '')"


@query(f"""WITH u AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'http://127.0.0.' || (page_id % 250) || '/x' WHEN 1 THEN 'http://192.168.1.5:80/' WHEN 2 THEN 'ftp://x.org/' WHEN 3 THEN 'http:///none' WHEN 4 THEN 'https://me@LocalHost/' WHEN 5 THEN 'http://172.' || (page_id % 40) || '.0.1' ELSE url END AS url FROM pages),
h AS (SELECT page_id, url, {_HOST} AS h, lower(regexp_extract(url, '{V.PARTS}', 1)) AS sch, TRY_CAST(regexp_extract({_HOST}, '^(\\d+)\\.(\\d+)\\.\\d+\\.\\d+$', 1) AS INT) AS a, TRY_CAST(regexp_extract({_HOST}, '^(\\d+)\\.(\\d+)\\.\\d+\\.\\d+$', 2) AS INT) AS b FROM u)
SELECT page_id, CASE WHEN sch NOT IN ('http', 'https') THEN 'scheme' WHEN h = '' THEN 'host' WHEN h = 'localhost' OR h LIKE '%.localhost' THEN 'localhost' WHEN a IN (0, 10, 127) OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 169 AND b = 254 THEN 'private' END AS reason FROM h""")
def b16_admissible_urls(s, d):
    k = F.col("page_id")
    url = F.when(k % 9 == 0, F.concat(F.lit("http://127.0.0."), k % 250, F.lit("/x"))).when(k % 9 == 1, "http://192.168.1.5:80/").when(k % 9 == 2, "ftp://x.org/").when(k % 9 == 3, "http:///none").when(k % 9 == 4, "https://me@LocalHost/").when(k % 9 == 5, F.concat(F.lit("http://172."), k % 40, F.lit(".0.1"))).otherwise(F.col("url"))
    return V.table(s, d, "pages").withColumn("url", url).select("page_id", urls.internal_reason("url").alias("reason"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'text' ELSE 'url' END AS kind FROM pages""")
def b17_input_kind(s, d):
    k = F.col("page_id")
    given = F.when(k % 4 == 0, F.concat(F.lit("https://m.YouTube.com/watch?v="), k)).when(k % 4 == 1, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    return V.table(s, d, "pages").select("page_id", urls.input_kind(given).alias("kind"))


@query(f"""WITH {V.REQUESTED} SELECT nb, count(*) FILTER (kind = 'report') AS n_report, count(*) FILTER (kind = 'web' AND url IS NOT NULL) AS n_web, count(*) FILTER (kind <> 'report' AND url IS NULL) AS n_skipped FROM requested GROUP BY nb""")
def b21_importable(s, d):
    n = lambda c: F.count(F.when(c, 1))
    web = (F.col("kind") != "report") & F.col("url").isNotNull()
    return V.requested(s, d).groupBy("nb").agg(n(F.col("kind") == "report").alias("n_report"), n(web).alias("n_web"), n((F.col("kind") != "report") & F.col("url").isNull()).alias("n_skipped"))


@query(f"WITH {V.ARTIFACTS} SELECT id, type_code NOT IN (1, 3, 7, 8) OR id % 2 = 0 AS ready FROM artifacts")
def b22_media_ready(s, d):
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://x/"), "id"))
    return V.artifacts(s, d).select("id", (~F.col("type_code").isin(1, 3, 7, 8) | F.coalesce(url.rlike("^https?://"), F.lit(False))).alias("ready"))


@query(f"WITH {V.SOURCES} SELECT source_id, pos, (SELECT count(*) FROM sources) AS total, (SELECT count(*) FROM sources) > 150 AS has_more FROM (SELECT * FROM sources ORDER BY pos LIMIT 50 OFFSET 100)")
def f1_page(s, d):
    return rows.page(V.sources(s, d).select("source_id", "pos"), ["pos"], 50, 100)


@query(f"WITH {V.FULLTEXT} SELECT source_id, substr(content, 101, 500) AS part, length(content) AS char_count, length(content) > 600 AS truncated FROM fulltext")
def f3_content_window(s, d):
    n = F.length("content")
    return V.fulltext(s, d).select("source_id", F.substring("content", 101, 500).alias("part"), n.cast("long").alias("char_count"), (n > 600).alias("truncated"))


@query(f"WITH {V.FULLTEXT} SELECT source_id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '…' ELSE content END AS preview FROM fulltext")
def f4_preview(s, d):
    return V.fulltext(s, d).select("source_id", text.preview("content").alias("preview"))


@query(f"WITH {V.SOURCES} SELECT source_id, row_number() OVER (ORDER BY created_at NULLS LAST, pos) AS place FROM sources")
def f7_oldest_first(s, d):
    return rows.placed(V.sources(s, d).select("source_id", "created_at", "pos"), [F.col("created_at").asc_nulls_last(), "pos"]).select("source_id", "place")


@query(f"WITH {V.SOURCES} SELECT nb, row_number() OVER (PARTITION BY nb ORDER BY pos) AS index, source_id FROM sources QUALIFY index <= 5")
def f8_indexed_prefix(s, d):
    from pyspark.sql import Window

    return rows.newest(V.sources(s, d), ["nb"], [F.col("pos")], 5).select("nb", F.row_number().over(Window.partitionBy("nb").orderBy("pos")).cast("long").alias("index"), "source_id")


@query(f"""WITH {V.ARTIFACTS}, {NOTE}, u AS (SELECT id, content AS title, 'note' AS type, 0 AS prio FROM notes WHERE {NOTE_SQL} IN ('note', 'unknown') UNION ALL SELECT id, title, 'artifact', 1 FROM artifacts)
SELECT id, title, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio) AS n FROM u) WHERE n = 1""")
def g1_studio_union(s, d):
    notes = _notes(s, d).where(~_note_kind().isin("deleted", "mind_map")).select("id", F.col("content").alias("title"), F.lit("note").alias("type"))
    return rows.union_first(["id"], ["type"], notes, V.artifacts(s, d).select("id", "title", F.lit("artifact").alias("type"))).select("id", "title", "type")


@query(f"""WITH {V.ARTIFACTS}, {NOTE} SELECT id, 'note' AS kind, content AS tree FROM notes WHERE {NOTE_SQL} = 'mind_map' UNION ALL SELECT id, 'interactive', NULL FROM artifacts WHERE type_code = 4 AND variant = 4""")
def g3_mind_maps(s, d):
    a = _notes(s, d).where(_mind_map()).select("id", F.lit("note").alias("kind"), F.col("content").alias("tree"))
    return a.unionByName(V.artifacts(s, d).where("type_code = 4 AND variant = 4").select("id", F.lit("interactive").alias("kind")), allowMissingColumns=True)


_URL = r"https?://(?:[^\s<>\]\(\)\"'']+|\([^\s<>\]\(\)\"'']*\))+"
G4 = f"""WITH {V.REPORTS}, every AS (SELECT DISTINCT nb, {V.key_sql('u', 'citation')} AS url FROM (SELECT nb, unnest(regexp_extract_all(report, '{_URL}')) AS u FROM reports)),
img AS (SELECT DISTINCT nb, {V.key_sql('u', 'citation')} AS url FROM (SELECT nb, unnest(regexp_extract_all(report, '!\\[[^\\]]*\\]\\(({_URL})', 1)) AS u FROM reports))
SELECT nb, url FROM every WHERE url LIKE 'http%' EXCEPT SELECT nb, url FROM img"""


@query(G4)
def g4_report_urls(s, d):
    return citations.report_keys(V.reports(s, d)).select("nb", F.col("key").alias("url"))


@query(f"""WITH {V.REQUESTED}, r AS (SELECT nb, {V.key_sql('url', 'import')} AS k FROM requested WHERE url IS NOT NULL), e AS (SELECT nb, {V.key_sql('url', 'import')} AS k FROM existing)
SELECT nb, count(DISTINCT k) FILTER (hit) AS n_both, bool_and(hit) AS is_subset FROM (SELECT r.nb, r.k, e.k IS NOT NULL AS hit FROM r LEFT JOIN (SELECT DISTINCT * FROM e) e USING (nb, k)) GROUP BY nb""")
def g5_url_sets(s, d):
    r = V.requested(s, d).where("url IS NOT NULL").select("nb", urls.import_key("url").alias("k")).distinct()
    e = V.existing(s, d).select("nb", urls.import_key("url").alias("k")).distinct().withColumn("hit", F.lit(True))
    return r.join(e, ["nb", "k"], "left").groupBy("nb").agg(F.count("hit").alias("n_both"), (F.count("hit") == F.count("*")).alias("is_subset"))


@query(f"WITH {V.SOURCES} SELECT nb, source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM sources WHERE page_id % 4 = 0)")
def g6_baseline_except(s, d):
    src = V.sources(s, d)
    return src.join(src.where("page_id % 4 = 0").select("nb", "source_id"), ["nb", "source_id"], "left_anti").select("nb", "source_id")


@query(f"""WITH {V.SOURCES}, u AS (SELECT nb, source_id, 'verified' AS origin, 0 AS prio, pos FROM sources WHERE page_id % 2 = 0 UNION ALL SELECT nb, source_id, 'returned', 1, pos FROM sources WHERE page_id % 3 = 0)
SELECT nb, source_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY nb, source_id ORDER BY prio, pos) AS n FROM u) WHERE n = 1""")
def g7_merged_results(s, d):
    src = V.sources(s, d).select("page_id", "nb", "source_id", "pos")
    return rows.union_first(["nb", "source_id"], ["pos"], src.where("page_id % 2 = 0").withColumn("origin", F.lit("verified")), src.where("page_id % 3 = 0").withColumn("origin", F.lit("returned"))).select("nb", "source_id", "origin")
