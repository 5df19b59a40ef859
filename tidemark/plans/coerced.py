"""Scalar functions over loosely shaped values: titles, hosts, identifiers, lists, codes and JSON payloads (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, text, urls, variants
from ..sources import views as V
from .registry import query

HOST = "example.com"
BASE_URL = "https://app.example.org/notebook/"


def cases(key: str, values: list[str | None], other: str) -> str:
    """SQL that both engines read: a text by the remainder of a key."""
    return f"CASE {key} % {len(values) + 1} " + " ".join(f"WHEN {k} THEN {v or 'NULL'}" for k, v in enumerate(values)) + f" ELSE {other} END"


def values(table: dict, names: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    rows = ", ".join(f"({', '.join(map(quote, (k, *(v if isinstance(v, tuple) else (v,)))))})" for k, v in table.items())
    return f"(VALUES {rows}) AS dim({names})"


PDF = cases("page_id", ["regexp_replace(url, '[?#].*$', '') || '/Some%20Paper+' || page_id || '.PDF?v=2#p3'", "regexp_replace(url, '[?#].*$', '') || '/a%2Fb.pdf'", "regexp_replace(url, '[?#].*$', '') || '/..pdf/'", "'ftp://h/x.pdf'", "regexp_replace(url, '[?#].*$', '') || '/%C3%A9' || page_id || '.pdf/'"], "url")
PDF_LEAF = "regexp_extract(regexp_replace(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1)"


@query(f"""WITH l AS (SELECT page_id, {PDF} AS link FROM pages), n AS (SELECT *, url_decode({PDF_LEAF}) AS name FROM l), t AS (SELECT *, trim(regexp_replace(name, '(?i)\\.pdf$', '')) AS stem FROM n)
SELECT page_id, CASE WHEN page_id % 2 = 0 AND starts_with(link, 'http') AND regexp_matches(name, '(?i)\\.pdf$') AND stem NOT IN ('', '.', '..') AND NOT contains(stem, '/') THEN left(stem, 200) ELSE link END AS title FROM t""")
def h5_pdf_titles(s, d):
    link = V.table(s, d, "pages").select("page_id", F.expr(PDF).alias("link"), F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("web_page").alias("kind"))
    return link.select("page_id", urls.shown_title("link", "link", "kind").alias("title"))


@query(rf"""SELECT page_id, len(list_filter(regexp_extract_all(html || ' see ' || url, 'https?://[^\s"''<>]+'), lambda u: regexp_matches(lower(u), '^https?://([^/?#]*@)?([^/?#]*\.)?{HOST.replace(".", "[.]")}(:[0-9]*)?([/?#]|$)'))) > 0 AS found FROM pages""")
def h9_login_urls(s, d):
    return V.table(s, d, "pages").select("page_id", F.coalesce(urls.names_host(F.concat("html", F.lit(" see "), "url"), HOST), F.lit(False)).alias("found"))


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://{HOST}/cookiemismatch#x' ELSE 'https://a.{HOST}/CookieMismatch/?c=' || page_id END AS hop FROM pages")
def h10_first_hop(s, d):
    middle = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit(f"https://a.{HOST}/CookieMismatch/?c="), F.col("page_id").cast("string")))
    hops = F.array("url", F.lit(f"https://not{HOST}/CookieMismatch"), middle, F.lit(f"https://{HOST}/cookiemismatch#x"))
    return V.table(s, d, "pages").select("page_id", urls.first_hop(hops, HOST, "cookiemismatch").alias("hop"))


@query("SELECT p_partkey, lower(p_name) || ' - ' || lower(p_brand) || ' -- fi' AS folded FROM part")
def h16_folded_titles(s, d):
    raw = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit(" –  "), F.col("p_brand"), F.lit("\n—− ﬁ "))
    return V.table(s, d, "part").select("p_partkey", text.folded(raw).alias("folded"))


BULLET = cases("doc_id", ["'  - '", "'* '", "'-'", "' +  '"], "''")


@query(rf"SELECT doc_id, regexp_replace(regexp_replace({BULLET} || text || '  ', '^\s*(?:[-*+]\s+)?', ''), '\s+$', '') AS clean FROM documents")
def h17_without_bullets(s, d):
    return V.table(s, d, "documents").select("doc_id", text.no_bullet(F.expr(f"{BULLET} || text || '  '")).alias("clean"))


HEX = "md5(CAST(o_orderkey AS STRING))"
UUIDS = "concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))".format(h=HEX)
TOKENS = cases("o_orderkey", [UUIDS, f"upper({UUIDS})", HEX], f"concat({UUIDS}, 'x')")


@query(f"SELECT o_orderkey, regexp_full_match({TOKENS}, '{text.UUID}') AS is_uuid, CASE WHEN o_orderkey % 4 < 2 THEN {TOKENS} END AS first_uuid FROM orders".replace("STRING", "VARCHAR"))
def h20_uuids(s, d):
    token = F.expr(TOKENS)
    nested = F.concat(F.lit('[[null, "a", [["x-'), F.expr(UUIDS), F.lit('", "'), token, F.lit('"]]], "'), token, F.lit('"]'))
    return V.table(s, d, "orders").select("o_orderkey", text.is_uuid(token).alias("is_uuid"), text.first_uuid(nested).alias("first_uuid"))


LISTS = cases("p_partkey", ["'[\"' || p_brand || '\", \"b c\", 5]'", "'[' || p_brand || ', b c]'", "p_name || ', ,b,'", "'  '", "'[a,' || p_brand", None], "'[]'")


@query(f"""WITH l AS (SELECT p_partkey, trim({LISTS}) AS t FROM part)
SELECT p_partkey, CASE WHEN t IS NULL THEN NULL WHEN starts_with(t, '[') AND json_valid(t) THEN array_to_string(from_json(t, '["VARCHAR"]'), '|') ELSE
  array_to_string(list_filter(list_transform(string_split(CASE WHEN starts_with(t, '[') THEN regexp_replace(substr(t, 2), '\\]$', '') ELSE t END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS items FROM l""")
def h24_lists(s, d):
    return V.table(s, d, "part").select("p_partkey", F.array_join(variants.as_list(F.expr(LISTS)), "|").alias("items"))


LANG = cases("doc_id", ["upper(lang)", "lang || '_CA'", "'zh_Hans'"], "lang")


@query(f"SELECT doc_id, name, name IS NOT NULL AS valid FROM (SELECT doc_id, {LANG} AS code FROM documents) LEFT JOIN {values(codes.LANGUAGE, 'code, name')} USING (code)")
def h27_languages(s, d):
    name = codes.language(F.expr(LANG))
    return V.table(s, d, "documents").select("doc_id", name.alias("name"), name.isNotNull().alias("valid"))


CODE = "CASE WHEN o_orderkey % 9 < 8 THEN o_orderkey % 9 END"


@query(f"""WITH r AS (SELECT o_orderkey, {CODE} AS code, o_custkey % 2 AS n FROM orders)
SELECT o_orderkey, CASE WHEN code IS NULL THEN NULL WHEN code = 3 AND n > 0 THEN 'unknown' ELSE coalesce(reason, 'unknown') END AS reason FROM r LEFT JOIN {values(codes.RESEARCH, 'code, reason')} USING (code)""")
def h29_terminations(s, d):
    return V.table(s, d, "orders").select("o_orderkey", codes.termination(F.expr(CODE), F.col("o_custkey") % 2).alias("reason"))


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS code, o_custkey % 3 AS kind, CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority END AS q FROM orders),
t AS (SELECT *, CASE code WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'no_results' WHEN 4 THEN 'cancelled' WHEN 0 THEN 'unknown' ELSE 'unknown' END AS reason, coalesce(' for ' || chr(39) || q || chr(39), '') AS asked FROM r)
SELECT o_orderkey, CASE reason WHEN 'no_results' THEN 'the search' || CASE kind WHEN 1 THEN ' of the web' WHEN 2 THEN ' of the drive' ELSE '' END || ' found nothing' || asked WHEN 'cancelled' THEN 'the run' || asked || ' was cancelled' WHEN 'unknown' THEN 'the run' || asked || ' ended with code ' || code END AS message,
  CASE reason WHEN 'no_results' THEN CASE kind WHEN 2 THEN 'try the exact name, the address or the id of the document' WHEN 1 THEN 'try a broader query' ELSE 'try a broader query; in a drive, try the exact name, the address or the id of the document' END WHEN 'cancelled' THEN 'start the run again if its sources are needed' WHEN 'unknown' THEN 'taken for ended: start a new run' END AS hint FROM t""")
def h29_messages(s, d):
    """What to tell of runs that ended otherwise than well, and what to do about it."""
    code, kind = F.col("o_orderkey") % 6, F.col("o_custkey") % 3
    r = V.table(s, d, "orders").select("o_orderkey", code.alias("code"), kind.alias("kind"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).alias("q"), codes.termination(code, F.lit(0)).alias("reason"))
    return r.select("o_orderkey", codes.termination_message("reason", "code", "q", "kind").alias("message"), codes.termination_hint("reason", "kind").alias("hint"))


FITS = [("rpc", 2), ("server", 6), ("timeout", 10), ("auth", 14), ("library", 3), ("source_add", 7)]


@query(f"""WITH c AS (SELECT event_id, coalesce({', '.join(f"CASE WHEN event_id % {k} = 0 THEN '{c}' END" for c, k in sorted(FITS, key=lambda x: codes.CATEGORIES.index(x[0])))}, 'unexpected') AS category FROM events)
SELECT event_id, category, category IN ({', '.join(f"'{c}'" for c in codes.RETRIABLE)}) AS retriable, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.HINTS.items())} END AS hint FROM c""")
def h31_error_categories(s, d):
    fits = F.array(*[F.when(F.col("event_id") % k == 0, c) for c, k in FITS])
    found = V.table(s, d, "events").select("event_id", codes.error_category(fits).alias("category"))
    return found.withColumn("retriable", codes.retriable("category")).withColumn("hint", codes.error_hint("category"))


FRESH = cases("page_id", ["'true'", "'false'", "'[]'", "'[[null,true,[\"p' || page_id || '\"]]]'", "'[[null,false]]'", "'[\"x\"]'", "'[[null,null]]'", "'[[null,\"true\"]]'", "'[[null]]'", "'not json'"], "'null'")


@query("SELECT page_id, CASE page_id % 11 WHEN 0 THEN 'fresh' WHEN 2 THEN 'fresh' WHEN 3 THEN 'fresh' WHEN 1 THEN 'stale' WHEN 4 THEN 'stale' ELSE 'drift' END AS freshness FROM pages")
def h32_freshness(s, d):
    return V.table(s, d, "pages").select("page_id", variants.freshness(F.expr(FRESH)).alias("freshness"))


SAID = cases("event_id", ["'Rate Limit hit'", "'over QUOTA'", "'limit exceeded'", None], "'broken'")
CODED = cases("event_id", [None, "'USER_DISPLAYABLE_ERROR'"], "'OTHER'")
STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'removed' ELSE 'completed' END"


@query(f"SELECT event_id, ({STATE}) IN ('failed', 'removed') AND (coalesce(({CODED}) = 'USER_DISPLAYABLE_ERROR', false) OR coalesce(regexp_matches(lower({SAID}), 'rate limit|quota|limit exceeded'), false)) AS limited FROM events")
def h33_rate_limited(s, d):
    return V.table(s, d, "events").select("event_id", codes.rate_limited(F.expr(STATE), F.expr(CODED), F.expr(SAID)).alias("limited"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'anyone_with_link' ELSE 'restricted' END AS access, 'full_notebook' AS view_level, CASE WHEN p_partkey % 2 = 0 THEN '{BASE_URL}' || url_encode(p_name || '/~*#' || p_brand) END AS share_url FROM part")
def h35_share_access(s, d):
    public = F.col("p_partkey") % 2 == 0
    key = F.concat("p_name", F.lit("/~*#"), "p_brand")
    return V.table(s, d, "part").select("p_partkey", F.when(public, "anyone_with_link").otherwise("restricted").alias("access"), F.lit("full_notebook").alias("view_level"), F.when(public, urls.share_url(BASE_URL, key)).alias("share_url"))


TREES = cases("p_partkey", ["'{\"name\": \"' || p_name || '\", \"children\": []}'", "'{\"name\": \"\"}'", "'{\"name\": 5}'", "'[1]'", "'{'"], "'{\"title\": \"x\"}'")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE 'Mind Map' END AS title FROM part")
def h38_tree_titles(s, d):
    return V.table(s, d, "part").select("p_partkey", variants.tree_title(F.expr(TREES)).alias("title"))


@query(f"SELECT c_custkey, plan, notebook_limit, source_limit FROM customer LEFT JOIN {values(codes.TIER, 'tier, plan, notebook_limit, source_limit')} ON c_custkey % 8 = tier")
def h39_tiers(s, d):
    dim = s.createDataFrame([(k, *v) for k, v in codes.TIER.items()], "tier long, plan string, notebook_limit int, source_limit int")
    c = V.table(s, d, "customer").withColumn("tier", F.col("c_custkey") % 8)
    return c.join(F.broadcast(dim), "tier", "left").select("c_custkey", "plan", "notebook_limit", "source_limit")


DIRECT = cases("p_partkey", ["' ' || p_name || ' '", "'  '"], "NULL")
NESTED = cases("p_partkey", ["'[3, null, \"' || p_brand || '\"]'", "'[[1, \" \"], [null, \" ' || p_type || '\"], \"late\"]'", "'\"bare\"'"], "'[[[\"too deep\"]], {\"a\": \"b\"}]'")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN p_type END AS error FROM part")
def h40_failure_texts(s, d):
    return V.table(s, d, "part").select("p_partkey", variants.failure_text(F.expr(DIRECT), F.expr(NESTED)).alias("error"))
