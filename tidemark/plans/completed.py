"""What listings, rollups and edits owe beside their main result: what was available, who failed, what was refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, text, urls
from ..operators import gates, hygiene, rows, status
from ..sources import views as V
from .analysis import JUNK, WAITED
from .registry import query


@query(f"WITH {V.SOURCES} SELECT nb, source_id FROM sources WHERE title <> '' AND url IS NOT NULL")
def a3_gated_ingest(s, d):
    """Rows without a title or URL are malformed; over a tenth of them would fail the ingest."""
    bad = (F.coalesce("title", F.lit("")) == "") | F.col("url").isNull()
    return gates.gated(V.sources(s, d), bad).select("nb", "source_id")


QUIZ = """SELECT p_size AS quiz, string_agg('## ' || p_partkey || '. ' || p_name || chr(10) || chr(10) || '- [' || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE ' ' END || '] ' || p_brand || chr(10) || '- [' || CASE WHEN p_partkey % 2 = 1 THEN 'x' ELSE ' ' END || '] ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) || 'Hint: ' || p_brand ELSE '' END, chr(10) || chr(10) ORDER BY p_partkey) AS doc FROM part GROUP BY p_size"""


def quizzes(s, d):
    """quiz, questions: question, options with whether each is right, hint. A quiz is one row, as it is one file."""
    k = F.col("p_partkey")
    option = lambda c, right: F.struct(F.col(c).alias("text"), right.alias("right"))
    q = F.struct(k.alias("number"), F.col("p_name").alias("question"), F.array(option("p_brand", k % 2 == 0), option("p_type", k % 2 == 1)).alias("options"), F.when(k % 3 == 0, F.col("p_brand")).alias("hint"))
    return V.table(s, d, "part").groupBy(F.col("p_size").alias("quiz")).agg(F.sort_array(F.collect_list(q)).alias("questions"))


@query(QUIZ)
def a7_quiz_markdown(s, d):
    line = lambda o: F.concat(F.lit("- ["), F.when(o["right"], "x").otherwise(" "), F.lit("] "), o["text"])
    one = lambda q: F.concat(F.lit("## "), q["number"].cast("string"), F.lit(". "), q["question"], F.lit("\n\n"), F.array_join(F.transform(q["options"], line), "\n"), F.coalesce(F.concat(F.lit("\n\nHint: "), q["hint"]), F.lit("")))
    return quizzes(s, d).select("quiz", F.array_join(F.transform("questions", one), "\n\n").alias("doc"))


@query("SELECT p_size AS quiz, CAST(count(*) AS BIGINT) AS n_questions, '{\"title\":\"quiz ' || p_size || '\",\"questions\":[' || string_agg('{\"question\":\"' || p_name || '\",\"options\":[\"' || p_brand || '\",\"' || p_type || '\"]}', ',' ORDER BY p_partkey) || ']}' AS doc FROM part GROUP BY p_size")
def a6_quiz_json(s, d):
    q = F.transform("questions", lambda x: F.struct(x["question"].alias("question"), F.transform(x["options"], lambda o: o["text"]).alias("options")))
    doc = F.to_json(F.struct(F.concat(F.lit("quiz "), F.col("quiz").cast("string")).alias("title"), q.alias("questions")))
    return quizzes(s, d).select("quiz", F.size("questions").cast("long").alias("n_questions"), doc.alias("doc"))


@query("""SELECT n_nationkey AS map_id, '{"name":"' || n_name || '","children":[' || string_agg('{"name":"' || c_mktsegment || '"}', ',' ORDER BY c_mktsegment) || ']}' AS doc FROM nation JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def a6_mind_map_json(s, d):
    kids = V.table(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct().groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list("c_mktsegment")), lambda x: F.struct(x.alias("name"))).alias("children"))
    n = V.table(s, d, "nation").join(kids, F.col("c_nationkey") == F.col("n_nationkey"))
    return n.select(F.col("n_nationkey").alias("map_id"), F.to_json(F.struct(F.col("n_name").alias("name"), "children")).alias("doc"))


@query(f"""WITH {V.ARTIFACTS}, w AS (SELECT nb, CASE nb % 3 WHEN 0 THEN 'BRIEFING' WHEN 1 THEN 'urgent' ELSE 'zzz' END AS wanted FROM artifacts GROUP BY nb), a AS (SELECT nb, string_agg(DISTINCT title, '; ' ORDER BY title) AS titles FROM artifacts GROUP BY nb)
SELECT w.nb, wanted, count(t.id) AS n_found, CASE WHEN count(t.id) = 0 THEN 'none titled ' || wanted || '; available: ' || any_value(a.titles) END AS error FROM w JOIN a USING (nb) LEFT JOIN artifacts t ON t.nb = w.nb AND contains(lower(t.title), lower(wanted)) GROUP BY w.nb, wanted""")
def b8_titled_or_available(s, d):
    """How many artifacts a title filter finds; where it finds none, what there is. Distinct titles of a group are few."""
    wanted = F.when(F.col("nb") % 3 == 0, "BRIEFING").when(F.col("nb") % 3 == 1, "urgent").otherwise("zzz")
    a = V.artifacts(s, d).withColumn("wanted", wanted)
    hit = F.contains(F.lower("title"), F.lower("wanted"))
    found = a.groupBy("nb", "wanted").agg(F.count(F.when(hit, 1)).alias("n_found"), F.array_join(F.sort_array(F.collect_set("title")), "; ").alias("titles"))
    return found.select("nb", "wanted", "n_found", F.when(F.col("n_found") == 0, F.concat(F.lit("none titled "), "wanted", F.lit("; available: "), "titles")).alias("error"))


PHRASES = lambda words: "len(list_filter([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "], lambda p: contains(lower(content), p))) > 0"


@query(f"""WITH {V.FULLTEXT}, p AS (SELECT *, doc_id % 5 <> 0 AS web, doc_id % 4 <> 0 AS ready FROM fulltext)
SELECT source_id, CASE WHEN web AND ready THEN CASE WHEN length(content) < 100 THEN 'thin' WHEN length(content) < 2000 AND {PHRASES(text.DEAD_LINK)} THEN 'dead_link' WHEN length(content) < 5000 AND {PHRASES(text.BOT_WALL)} THEN 'bot_wall' END END AS tag FROM p""")
def b15_ready_pages(s, d):
    """Only web pages that are ready are tagged."""
    on = (F.col("doc_id") % 5 != 0) & (F.col("doc_id") % 4 != 0)
    return V.fulltext(s, d).select("source_id", F.when(on, text.sanity("content")).alias("tag"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'path-shaped text' WHEN 1 THEN 'path-shaped text' END AS warning FROM pages")
def b17_path_warnings(s, d):
    k = F.col("page_id")
    given = F.when(k % 4 == 0, F.concat(F.lit("./notes/"), k, F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit("/home/x/"), k, F.lit(".pdf"))).when(k % 4 == 2, "just some text").otherwise(F.col("url"))
    return V.table(s, d, "pages").select("page_id", urls.path_warning(given).alias("warning"))


@query(f"WITH {V.SOURCES} SELECT o.nb, o.declared, coalesce(n.n, 0) AS listed, o.declared > 0 AND n.n IS NULL AS inconsistent FROM (SELECT c_custkey AS nb, c_custkey % 3 AS declared FROM customer) o LEFT JOIN (SELECT nb, count(*) AS n FROM sources GROUP BY nb) n USING (nb)")
def c4_inconsistent(s, d):
    """Notebooks that declare sources and list none."""
    n = V.sources(s, d).groupBy("nb").agg(F.count("*").alias("n"))
    o = V.table(s, d, "customer").select(F.col("c_custkey").alias("nb"), (F.col("c_custkey") % 3).alias("declared"))
    return o.join(n, "nb", "left").select("nb", "declared", F.coalesce("n", F.lit(0)).alias("listed"), ((F.col("declared") > 0) & F.col("n").isNull()).alias("inconsistent"))


@query(f"WITH {WAITED} SELECT entity_id % 25 AS nb, outcome, row_number() OVER (PARTITION BY entity_id % 25, outcome ORDER BY entity_id) AS place, entity_id FROM waited")
def d1_wait_lists(s, d):
    """Who is in each bucket, in order: a row for each rather than a list in one."""
    w = status.waited(V.table(s, d, "customer").select(F.col("c_custkey").alias("entity_id")), status.terminal(V.snapshots(s, d)))
    w = w.withColumn("nb", F.col("entity_id") % 25)
    return rows.numbered(w, ["nb", "outcome"], ["entity_id"], "n").select("nb", "outcome", F.col("n").alias("place"), "entity_id")


@query("""WITH f AS (SELECT o_orderkey % 16 AS bad, o_orderkey % 3 AS cut, o_orderkey FROM orders), c AS (SELECT o_orderkey, 20 AS n_payloads, CASE bad WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 0 END AS bad_payloads, CASE WHEN cut = 1 THEN 11 ELSE 10 END AS n_framings, CASE WHEN cut = 1 THEN 1 ELSE 0 END AS bad_framings FROM f)
SELECT o_orderkey, 20 - bad_payloads AS n_chunks, bad_payloads, bad_framings, CASE WHEN 10 * bad_payloads > n_payloads THEN 'payload' WHEN 10 * bad_framings > n_framings THEN 'framing' WHEN 10 * (bad_payloads + bad_framings) > 10 + n_framings THEN 'total' END AS refused FROM c""")
def a3_framed_payloads(s, d):
    """Answers of twenty payloads, half of them behind their length; two or three broken, the last length without a payload. A tenth is still let through."""
    k = F.col("o_orderkey")
    broken = F.when(k % 16 == 3, 2).when(k % 16 == 5, 3).otherwise(0)
    payload = lambda i: F.when(i < broken, F.lit("[1, oops")).otherwise(F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", '), i.cast("string"), F.lit("]")))
    line = lambda i: F.when(i % 2 == 0, F.concat(F.length(payload(i)).cast("string"), F.lit("\r\n"), payload(i))).otherwise(payload(i))
    text_ = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), line), "\n\n"), F.when(k % 3 == 1, "\n17\n").otherwise(""))
    read = gates.framed(V.table(s, d, "orders").select("o_orderkey", text_.alias("answer")), "answer")
    return read.select("o_orderkey", F.size("chunks").alias("n_chunks"), "bad_payloads", "bad_framings", "refused")


DELETED = f"WITH {JUNK}, t AS (SELECT nb, reason IS NOT NULL AS junk, page_id % 4 = 0 AS refused FROM junk)"


@query(f"{DELETED} SELECT nb, count(*) FILTER (junk AND NOT refused) AS deleted_count, count(*) FILTER (junk AND refused) AS failed_count, CASE WHEN count(*) FILTER (junk) = 0 THEN 'already_clean' ELSE 'completed' END AS status FROM t GROUP BY nb")
def d2_clean_outcomes(s, d):
    """After deleting: how many went and how many could not. Every fourth page is one that can't be deleted."""
    j = hygiene.junk(V.sources(s, d)).select("nb", F.col("reason").isNotNull().alias("junk"), (F.col("page_id") % 4 == 0).alias("refused"))
    n = lambda c: F.count(F.when(c, 1))
    out = j.groupBy("nb").agg(n(F.col("junk") & ~F.col("refused")).alias("deleted_count"), n(F.col("junk") & F.col("refused")).alias("failed_count"))
    return out.withColumn("status", F.when(F.col("deleted_count") + F.col("failed_count") == 0, "already_clean").otherwise("completed"))


@query(f"WITH {JUNK} SELECT count(*) FILTER (reason IS NOT NULL AND page_id % 4 <> 0) AS deleted, count(*) FILTER (reason IS NOT NULL AND page_id % 4 = 0) AS failed, count(*) FILTER (reason IS NULL OR page_id % 4 = 0) AS kept FROM junk")
def k6_delete_counts(s, d):
    n = lambda c: F.count(F.when(c, 1))
    bad, refused = F.col("reason").isNotNull(), F.col("page_id") % 4 == 0
    return hygiene.junk(V.sources(s, d)).agg(n(bad & ~refused).alias("deleted"), n(bad & refused).alias("failed"), n(~bad | refused).alias("kept"))


@query("SELECT event_type AS method, round(sum(CASE WHEN event_id % 3 = 0 THEN value / 10 ELSE 0 END), 4) AS wait_sum, max(CASE WHEN event_id % 3 = 0 THEN value / 10 END) AS wait_max FROM events GROUP BY event_type")
def d4_waits(s, d):
    """Time spent waiting before a call: every third event waited a tenth of its value."""
    wait = F.when(F.col("event_id") % 3 == 0, F.col("value") / 10)
    return V.table(s, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.round(F.sum(F.coalesce(wait, F.lit(0.0))), 4).alias("wait_sum"), F.max(wait).alias("wait_max"))


@query(f"""WITH {V.ARTIFACTS}, a AS (SELECT nb, id, status, min(id) FILTER (status = 4 AND id % 3 = 0) OVER (PARTITION BY nb) AS fatal FROM artifacts)
SELECT nb, row_number() OVER (PARTITION BY nb ORDER BY id) AS place, id, CASE WHEN id > fatal THEN 'not_tried' WHEN status = 3 THEN 'added' ELSE 'error' END AS result FROM a""")
def d10_item_results(s, d):
    """A result for each item in its place; after a fatal failure nothing more is tried."""
    a = V.artifacts(s, d)
    fatal = a.where("status = 4 AND id % 3 = 0").groupBy("nb").agg(F.min("id").alias("fatal"))
    result = F.when(F.col("id") > F.col("fatal"), "not_tried").when(F.col("status") == 3, "added").otherwise("error")
    return rows.numbered(a, ["nb"], ["id"], "n").join(fatal, "nb", "left").select("nb", F.col("n").alias("place"), "id", result.alias("result"))


@query(f"WITH {V.ARTIFACTS} SELECT nb, count(*) FILTER (type_code = 5) AS n_artifacts, CASE WHEN nb % 4 = 0 THEN NULL ELSE count(*) FILTER (type_code = 4 AND variant = 4) END AS n_notes, nb % 4 = 0 AS notes_failed FROM artifacts GROUP BY nb")
def g2_failed_branch(s, d):
    """A branch that could not be read gives null, which is not the same as none. Notes of every fourth group could not."""
    n = lambda c: F.count(F.when(c, 1))
    failed = F.col("nb") % 4 == 0
    out = V.artifacts(s, d).groupBy("nb").agg(n(F.col("type_code") == 5).alias("n_artifacts"), n((F.col("type_code") == 4) & (F.col("variant") == 4)).alias("n_notes"))
    return out.select("nb", "n_artifacts", F.when(~failed, F.col("n_notes")).alias("n_notes"), failed.alias("notes_failed"))


HOSTS = [("example.com", "exact", "app"), ("example.net", "subdomain", "login"), ("org", "subdomain", "gate")]
HOST_SQL = f"regexp_replace(regexp_replace(lower(regexp_extract(url, '{V.PARTS}', 2)), '^.*@', ''), ':[0-9]*$', '')"


@query(f"WITH h AS (SELECT page_id, {HOST_SQL} AS h FROM pages) SELECT page_id, CASE WHEN h = 'example.com' THEN 'app' WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'login' WHEN h = 'org' OR h LIKE '%.org' THEN 'gate' END AS class FROM h")
def h8_host_classes(s, d):
    """Rules say whether they hold for a host alone or for what is below it too; few enough to go to every task."""
    rules = F.broadcast(s.createDataFrame(HOSTS, "rule string, scope string, class string"))
    h = V.table(s, d, "pages").select("page_id", urls.bare_host("url").alias("h"))
    last = F.array_distinct(F.array(*[F.substring_index("h", ".", -k) for k in (1, 2, 3)], F.col("h")))
    hit = h.select("page_id", "h", F.explode(last).alias("rule")).join(rules, "rule").where("scope = 'subdomain' OR rule = h")
    best = hit.groupBy("page_id").agg(F.max_by("class", F.length("rule")).alias("class"))
    return h.select("page_id").join(best, "page_id", "left")


@query(f"WITH {V.ANSWERS} SELECT conv_id, turn, k0 AS marker, CAST(p AS BIGINT) AS \"at\" FROM (SELECT conv_id, turn, unnest([0, 1, 2]) AS k0, unnest([least(length(text), 30), length(text), length(text)]) AS p FROM conversations WHERE role = 'assistant')")
def h18_marker_positions(s, d):
    """Where each marker stood, in the text without markers."""
    m = V.answers(s, d).select("conv_id", "turn", F.posexplode(text.markers("answer")).alias("k", "m"))
    return m.select("conv_id", "turn", F.col("k").alias("marker"), F.col("m.at").alias("at"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '5' WHEN 3 THEN '1' WHEN 4 THEN 'other' ELSE '7' END AS code FROM part")
def h30_default_type(s, d):
    """Names to codes, other texts kept, nothing taken for web."""
    k = F.col("p_partkey")
    given = F.when(k % 6 == 0, "web").when(k % 6 == 1, "drive").when(k % 6 == 2, "report").when(k % 6 == 4, "other").when(k % 6 == 5, "7")
    named = F.create_map(*[F.lit(x) for p in codes.RESULT_TYPE.items() for x in p])
    return V.table(s, d, "part").select("p_partkey", F.coalesce(F.try_element_at(named, F.coalesce(given, F.lit("web"))).cast("string"), given).alias("code"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 4) THEN 'not assignable' END AS refused FROM orders")
def k4_refused_permissions(s, d):
    """Owner (1) and remove (4) can't be given to a user; 2, 3 and 5 stand for the others here."""
    given = F.when(F.col("o_orderkey") % 5 == 0, 5).otherwise(F.col("o_orderkey") % 5)
    return V.table(s, d, "orders").select("o_orderkey", F.when(given.isin(1, 4), "not assignable").alias("refused"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'nothing to change' END AS refused, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'new ' || p_name WHEN p_partkey % 4 = 3 THEN p_name END AS name, CASE WHEN p_partkey % 4 IN (2, 3) THEN '*' WHEN p_partkey % 4 = 1 THEN p_brand END AS emoji FROM part")
def k5_patched_labels(s, d):
    """A rename keeps the emoji unless one is given; a patch of nothing is refused."""
    k = F.col("p_partkey")
    name, emoji = F.when(k % 4 > 0, F.when(k % 4 < 3, F.concat(F.lit("new "), "p_name"))), F.when(k % 4 >= 2, "*")
    nothing = name.isNull() & emoji.isNull()
    return V.table(s, d, "part").select("p_partkey", F.when(nothing, "nothing to change").alias("refused"), F.when(~nothing, F.coalesce(name, "p_name")).alias("name"), F.when(~nothing, F.coalesce(emoji, "p_brand")).alias("emoji"))
