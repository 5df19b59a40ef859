"""Captured payloads to typed tables (A): positional arrays, nested texts, data tables, polls, artifacts, HTML."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, markdown, variants
from ..sources import files
from ..sources import views as V
from ..sources.shared import folder
from .registry import query

DEPTH = 100
PAYLOAD = """CASE WHEN pos % 10 = 7 THEN 'oops' WHEN pos % 10 = 8 THEN '[[5], "no id"]' ELSE concat('[["', source_id, '"], "', replace(title, '"', ''), '", [', CASE WHEN pos % 3 = 0 THEN concat('"', url, '"') ELSE 'null' END, ', null, [', coalesce(CAST(created_at AS STRING), 'null'), '], null, ', type_code, ', ',
  CASE WHEN pos % 4 = 0 THEN concat('["', url, '#5"]') ELSE 'null' END, ', null, ', CASE WHEN pos % 5 = 0 THEN concat('["', url, '#7"]') ELSE '[]' END, '], [null, ', status, ']]') END"""


@query(f"""WITH {V.SOURCES} SELECT pos, CASE WHEN pos % 10 < 7 OR pos % 10 = 9 THEN source_id END AS id, CASE WHEN pos % 10 = 8 THEN 'no id' WHEN pos % 10 <> 7 THEN replace(title, '"', '') END AS title,
  CASE WHEN pos % 10 NOT IN (7, 8) THEN CASE WHEN pos % 5 = 0 THEN url || '#7' WHEN pos % 4 = 0 THEN url || '#5' WHEN pos % 3 = 0 THEN url END END AS url, CASE WHEN pos % 10 NOT IN (7, 8) THEN created_at END AS created_at,
  CASE WHEN pos % 10 NOT IN (7, 8) THEN CAST(status AS INTEGER) END AS status, pos % 10 IN (7, 8) AS quarantined FROM sources""")
def a2_decoded_rows(s, d):
    """Rows of nested arrays by position; what has no usable id is quarantined, and no shape is an error."""
    v = variants.parsed("payload")
    rows = V.sources(s, d).select("pos", F.expr(PAYLOAD).alias("payload")).select("pos", v.alias("v"))
    v = F.col("v")
    url = F.coalesce(variants.string_at(v, "$[2][7][0]"), variants.string_at(v, "$[2][5][0]"), variants.string_at(v, "$[2][0]"))
    id_ = variants.string_at(v, "$[0][0]")
    return rows.select("pos", id_.alias("id"), variants.string_at(v, "$[1]").alias("title"), url.alias("url"), F.try_variant_get(v, "$[2][2][0]", "long").alias("created_at"), F.try_variant_get(v, "$[3][1]", "int").alias("status"), id_.isNull().alias("quarantined"))


def texts_in(value, depth: int = DEPTH) -> list[str]:
    """All strings that aren't empty, depth first; deeper than ``depth`` lists, nothing."""
    out, stack = [], [(value, 0)]
    while stack:
        x, k = stack.pop()
        if isinstance(x, str):
            out += [x] if x else []
        elif isinstance(x, list) and k < depth:
            stack += [(y, k + 1) for y in reversed(x)]
    return out


def nested_text(separator: str):
    @F.pandas_udf(T.StringType())
    def run(payloads: pd.Series) -> pd.Series:
        def one(p):
            try:
                return separator.join(texts_in(json.loads(p)))
            except (TypeError, ValueError, RecursionError):
                return None

        return payloads.map(one)

    return run


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 <> 4 THEN p_name || chr(10) || p_brand || chr(10) || p_type || chr(10) || 'end' END AS content FROM part")
def a4_flattened_text(s, d):
    payload = F.when(F.col("p_partkey") % 9 == 4, "[broken").otherwise(F.concat(F.lit('[[0, 9, ["'), "p_name", F.lit('", ["", null, ["'), "p_brand", F.lit('"]], {"k": "v"}]], "'), "p_type", F.lit('", [[[["end"]]], '), F.lit("[" * 120 + '"deep"' + "]" * 120), F.lit("]]")))
    return V.table(s, d, "part").select("p_partkey", nested_text("\n")(payload).alias("content"))


TABLE = """concat('[[0, 9, [["Na", "me"], [[1, ["Qty"]]]]], [1, 2], [9, 20, [["', o_orderpriority, '"], ["', o_custkey, '", ["x"]]]], [9, 20, [["', o_orderstatus, '"]]]]')"""


@query("""SELECT o_orderkey AS table_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE c WHEN 0 THEN 'Name' ELSE 'Qty' END AS header, CASE WHEN r = 1 THEN CASE c WHEN 0 THEN o_orderpriority ELSE o_custkey || 'x' END ELSE o_orderstatus END AS text
FROM orders, (VALUES (1, 0), (1, 1), (2, 0)) AS cells(r, c)""")
def a5_data_tables(s, d):
    return cells(V.table(s, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.expr(TABLE).alias("payload")))


@query("SELECT o_orderkey AS table_id, CASE o_orderkey % 4 WHEN 0 THEN 'not a table' ELSE 'no header' END AS error FROM orders WHERE o_orderkey % 4 < 3")
def a5_table_errors(s, d):
    """Payloads that are no JSON, tables that are empty, and such whose first row has no cells."""
    k = F.col("o_orderkey")
    payload = F.when(k % 4 == 0, "[oops").when(k % 4 == 1, "[]").when(k % 4 == 2, F.concat(F.lit("[[1], "), F.substring(F.expr(TABLE), 2, 10_000))).otherwise(F.expr(TABLE))
    return table_errors(V.table(s, d, "orders").select(k.alias("table_id"), payload.alias("payload")))


def _rows(tables):
    """tables with rows: each row's variant, in place."""
    return tables.select("table_id", F.try_variant_get(variants.parsed("payload"), "$", "array<variant>").alias("rows"))


def _long_enough(row):
    return F.coalesce(F.size(F.try_variant_get(row, "$", "array<variant>")) >= 3, F.lit(False))


def table_errors(tables):
    """table_id, error of the tables that cells() can make nothing of."""
    head = F.get("rows", F.lit(0))
    error = F.when(F.col("rows").isNull(), "not a table").when(head.isNull() | ~_long_enough(head), "no header")
    return _rows(tables).select("table_id", error.alias("error")).where("error IS NOT NULL")


def cells(tables, row_of=lambda row: F.try_variant_get(row, "$[2]", "array<variant>"), text_of=None):
    """table_id, payload to table_id, row, col, header, text: the first row is the header, and a table without one is an error (table_errors()); other rows of fewer than three slots go.

    ``row_of`` takes the cells from a row's variant, ``text_of`` the text from a column with a cell's JSON.
    """
    held = _rows(tables).where(_long_enough(F.get("rows", F.lit(0)))).select("table_id", F.filter("rows", _long_enough).alias("rows"))
    long = held.select("table_id", F.transform("rows", lambda r: F.transform(row_of(r), lambda c: F.to_json(c))).alias("rows"))
    text = text_of or nested_text("")
    body = long.select("table_id", F.col("rows")[0].alias("head"), F.posexplode("rows").alias("row", "cells")).where("row > 0")
    cell = body.select("table_id", "row", "head", F.posexplode("cells").alias("col", "cell"))
    return cell.select("table_id", "row", "col", text(F.try_element_at("head", F.col("col") + 1)).alias("header"), text("cell").alias("text"))


def csv_lines(cells_):
    """cells() as the lines of CSV files, one per table and row, the header being row 0; a text is quoted where it has to be."""
    bare = F.col("text").rlike('[",\r\n]')
    one = F.when(bare, F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("text"))
    head = cells_.groupBy("table_id", "col").agg(F.first("header").alias("text")).select("table_id", F.lit(0).cast("long").alias("row"), "col", "text")
    rows = cells_.select("table_id", F.col("row").cast("long").alias("row"), "col", "text").unionByName(head).select("table_id", "row", "col", F.coalesce(one, F.lit("")).alias("text"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), ",")
    return rows.groupBy("table_id", "row").agg(line.alias("line")).withColumn("line", F.when(F.col("line") == "", '""').otherwise(F.col("line")))


@query("""WITH c AS (SELECT o_custkey % 40 AS t, o_orderpriority || ',' || o_orderkey AS line FROM orders UNION ALL SELECT DISTINCT o_custkey % 40, NULL FROM orders)
SELECT 'table-' || t || '.csv' AS file, CASE WHEN line IS NULL THEN 'Name,Qty' ELSE '"' || replace(line, ',', ' ""p"", x",') END AS line FROM c""")
def a5_csv_files(s, d):
    """A CSV file for each table, written with a byte-order mark (which reading takes away) and read back line by line."""
    k = F.col("o_orderkey")
    cell = lambda col, header, text: F.struct(F.lit(col).alias("col"), F.lit(header).alias("header"), text.alias("text"))
    both = F.array(cell(0, "Name", F.concat("o_orderpriority", F.lit(' "p", x'))), cell(1, "Qty", k.cast("string")))
    long = V.table(s, d, "orders").select((F.col("o_custkey") % 40).alias("table_id"), (k + 1).alias("row"), F.explode(both).alias("c")).select("table_id", "row", "c.*")
    uri = folder(s, "csv")
    lines = csv_lines(long)
    pieces = lines.select(F.concat(F.lit("table-"), F.col("table_id"), F.lit(".csv")).alias("path"), F.col("row").alias("place"), F.concat("line", F.lit("\r\n")).alias("text"))
    files.write_files(pieces, uri, bom=True)
    return files.read_lines(s, uri)


@query("""WITH m AS (SELECT n_nationkey, n_name FROM nation), k AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM k JOIN m ON c_nationkey = n_nationkey WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment))
SELECT 'map-' || n_nationkey || '.json' AS file, unnest(['{', '  "name": "é ' || n_name || '",', '  "children": [']) AS line FROM m WHERE n_nationkey IN (SELECT c_nationkey FROM k)
UNION ALL SELECT 'map-' || c_nationkey || '.json', unnest(['    {', '      "name": "' || c_mktsegment || '"', CASE WHEN i < n THEN '    },' ELSE '    }' END]) FROM n UNION ALL SELECT 'map-' || n_nationkey || '.json', unnest(['  ]', '}']) FROM m WHERE n_nationkey IN (SELECT c_nationkey FROM k)""")
def a6_map_files(s, d):
    """Mind maps as indented JSON, a file each."""

    @F.pandas_udf(T.StringType())
    def indented(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False))

    kids = V.table(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct().groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list("c_mktsegment")), lambda x: F.struct(x.alias("name"))).alias("children"))
    n = V.table(s, d, "nation").join(kids, F.col("c_nationkey") == F.col("n_nationkey"))
    tree = F.to_json(F.struct(F.concat(F.lit("é "), "n_name").alias("name"), "children"))
    uri = folder(s, "maps")
    files.write_files(n.select(F.concat(F.lit("map-"), "n_nationkey", F.lit(".json")).alias("path"), F.lit(0).alias("place"), indented(tree).alias("text")), uri)
    return files.read_lines(s, uri)


QUESTION = "'## ' || p_partkey || '. ' || p_name || chr(10) || chr(10) || '- [' || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE ' ' END || '] ' || p_brand || chr(10) || '- [' || CASE WHEN p_partkey % 2 = 1 THEN 'x' ELSE ' ' END || '] ' || p_type"


@query(f"""WITH q AS (SELECT p_size AS quiz, string_agg({QUESTION}, chr(10) || chr(10) ORDER BY p_partkey) AS doc FROM part GROUP BY p_size) SELECT 'quiz-' || quiz || '.md' AS file, unnest(string_split('# Quiz ' || quiz || chr(10) || chr(10) || doc || chr(10) || '---', chr(10))) AS line FROM q
UNION ALL SELECT 'quiz-' || p_size || '.json', unnest(string_split(string_agg('{{"question":"' || p_name || '"}}', ',' || chr(10) ORDER BY p_partkey), chr(10))) FROM part GROUP BY p_size UNION ALL SELECT 'quiz-' || p_size || '.json', unnest(['{{"title":"quiz ' || p_size || '","questions":[', ']}}']) FROM part GROUP BY p_size""")
def a7_quiz_files(s, d):
    """Quizzes as Markdown and as JSON, from a row for each question: a quiz need not fit in one."""
    right = lambda odd: F.when(F.col("p_partkey") % 2 == odd, "x").otherwise(" ")
    text = F.concat(F.lit("## "), F.col("p_partkey").cast("string"), F.lit(". "), "p_name", F.lit("\n\n- ["), right(0), F.lit("] "), "p_brand", F.lit("\n- ["), right(1), F.lit("] "), "p_type")
    p = V.table(s, d, "part")
    quiz = F.col("p_size").cast("string")
    named = lambda kind: lambda q: F.concat(F.lit("quiz-"), q.cast("string"), F.lit(kind))
    md = files.listed(p, "p_size", "p_partkey", named(".md"), text, F.concat(F.lit("# Quiz "), quiz, F.lit("\n\n")), "\n\n", "\n---\n")
    js = files.listed(p, "p_size", "p_partkey", named(".json"), F.to_json(F.struct(F.col("p_name").alias("question"))), F.concat(F.lit('{"title":"quiz '), quiz, F.lit('","questions":[\n')), ",\n", "\n]}\n")
    uri = folder(s, "quizzes")
    files.write_files(md.unionByName(js), uri)
    return files.read_lines(s, uri)


def _replaced(sql: str, *steps: tuple[str, str]) -> str:
    """sql with regular expressions replaced one after another, everywhere."""
    for pattern, to in steps:
        quoted = to.replace("'", "''").replace("\n", "' || chr(10) || '")
        sql = f"regexp_replace({sql}, '{pattern}', '{quoted}', 'g')"
    return sql


def _by_token(sql: str, pattern: str, otherwise: str, within: str) -> str:
    """sql cut into what the pattern matches, other dollar signs and what stands between: matches through one function, the rest through another."""
    return f"array_to_string(list_transform(regexp_extract_all({sql}, '{pattern}|[^$]+|[$]'), lambda t: CASE WHEN t LIKE '$_%' THEN {within} ELSE {otherwise} END), '')"


#: The tags of the pages at hand, by patterns: heads and comments out, white space to one blank, signs escaped outside of math, then tag by tag. These entities are HTML's old ones, which stand without their semicolon too.
TEXT_SQL = _replaced("html", ("(?s)<head>.*?</head>", ""), ("(?s)<!--.*?-->|<![^>]*>", ""), (r"\s+", " "))
ESCAPED_SQL = f"CASE WHEN page_id % 8 = 0 THEN {TEXT_SQL} ELSE {_by_token(TEXT_SQL, '[$][$][^<]+?[$][$]|[$][^$<]+[$]', _replaced('t', (r'([\\*_`\[\]])', chr(92) * 2 + chr(92) + '1')), 't')} END"
TAGS_SQL = _replaced(ESCAPED_SQL, ('<a href="([^"]*)">(.*?)</a>', r"[\2](\1)"), ("<h1>", "\n\n# "), ("</?b>", "**"), ("<br>", "  \n"), ("<li>", "\n- "), ("</?(?:ul|h1|p|div|article|nav|footer)(?: [^>]*)?>", "\n\n"), ("<[^>]*>", ""), ("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&amp;?", "&"))
TAGS_SQL = _by_token(TAGS_SQL, r"[$][^$\n]*[$]", "t", _replaced("t", (r"\\([*_])", r"\1")))
LINES_SQL = f"array_to_string(list_transform(string_split({TAGS_SQL}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^ *(-|[0-9]+[.]) |  $') THEN x ELSE trim(x) END), chr(10))"


@query(f"SELECT page_id, {_replaced(LINES_SQL, (r'\n{3,}', chr(10) * 2), (r'^\s+|\s+$', ''))} AS markdown FROM pages")
def a8_markdown(s, d):
    """Every page's HTML as Markdown; every eighth is taken for a source that is Markdown already."""

    @F.pandas_udf(T.StringType())
    def convert(html: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([markdown.markdown(h, k) for h, k in zip(html, kind, strict=True)], dtype=object)

    return V.table(s, d, "pages").select("page_id", convert("html", F.when(F.col("page_id") % 8 == 0, 8).otherwise(5)).alias("markdown"))


POLL = """CASE WHEN page_id % 13 = 5 THEN '[null, "bad"]' ELSE concat('["t', page_id, '", [null, ["q', page_id, '", 1], null, [[["', url, '", "title ', page_id, '", "desc", ', CASE page_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '1' ELSE 'null' END, '], [null, "deep", null, 5, null, null, ["part one", "part two"]], [null, ["now", "# md ', page_id, '"], null, 5], [null, null, "x"]], "sum"], ', page_id % 5, ']]') END"""


def research_tasks(polls):
    """payload to (tasks, sources): tasks without an id or details are skipped, sources with neither title nor URL dropped."""
    held = polls.select("payload", variants.parsed("payload").alias("v"))
    v = F.col("v")
    tasks = held.select(variants.string_at(v, "$[0]").alias("task_id"), variants.string_at(v, "$[1][1][0]").alias("query"), F.try_variant_get(v, "$[1][1][1]", "int").alias("source_type"), F.try_variant_get(v, "$[1][4]", "int").alias("status_code"),
                        variants.string_at(v, "$[1][3][1]").alias("summary"), F.try_variant_get(v, "$[1][3][0]", "array<variant>").alias("rows")).where("task_id IS NOT NULL AND query IS NOT NULL")
    r = F.col("r")
    url, chunks = variants.string_at(r, "$[0]"), F.try_variant_get(r, "$[6]", "array<string>")
    report = F.coalesce(variants.string_at(r, "$[1][1]"), F.array_join(chunks, "\n\n"))
    title = F.coalesce(variants.string_at(r, "$[1][0]"), variants.string_at(r, "$[1]"))
    kind = F.coalesce(F.try_variant_get(r, "$[3]", "int"), F.when(url.isNull() & report.isNotNull(), 5), F.lit(1))
    sources = tasks.select("task_id", F.posexplode("rows").alias("pos", "r")).select("task_id", "pos", url.alias("url"), title.alias("title"), kind.alias("type"), report.alias("report")).where("url IS NOT NULL OR title IS NOT NULL")
    return tasks.drop("rows"), sources


@query("SELECT 't' || page_id AS task_id, 'q' || page_id AS query, 1 AS source_type, CASE page_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, 'sum' AS summary FROM pages WHERE page_id % 13 <> 5")
def a11_research_tasks(s, d):
    tasks, _ = research_tasks(V.table(s, d, "pages").select(F.expr(POLL).alias("payload")))
    return tasks.select("task_id", "query", "source_type", codes.research_status("status_code").alias("status"), "summary")


@query("""WITH t AS (SELECT * FROM pages WHERE page_id % 13 <> 5) SELECT 't' || page_id AS task_id, 0 AS pos, url, 'title ' || page_id AS title, CASE page_id % 3 WHEN 0 THEN 2 ELSE 1 END AS type, NULL AS report FROM t
UNION ALL SELECT 't' || page_id, 1, NULL, 'deep', 5, 'part one' || chr(10) || chr(10) || 'part two' FROM t UNION ALL SELECT 't' || page_id, 2, NULL, 'now', 5, '# md ' || page_id FROM t""")
def a11_research_sources(s, d):
    return research_tasks(V.table(s, d, "pages").select(F.expr(POLL).alias("payload")))[1]


ARTIFACT = """concat('["a', id, '", "', title, '", ', type_code, ', null, ', status, ', ', CASE WHEN id % 4 = 0 THEN concat('"quota ', id, '"') ELSE '[null, ["  ", "late"]]' END, ', [null, "https://x/', id, '"], null, null, [null, [', coalesce(CAST(variant AS STRING), 'null'), ', "prompt ', id, '"]], null, null, null, null, null, [', id, ', 0]]')"""


@query(f"""WITH {V.ARTIFACTS} SELECT 'a' || id AS id, title, type_code, CASE WHEN variant IS NOT NULL THEN variant END AS variant, CASE WHEN type_code IN (1, 3, 7, 8) THEN 'https://x/' || id END AS url, id AS created_at, 'prompt ' || id AS prompt,
  CASE WHEN status = 4 THEN CASE WHEN id % 4 = 0 THEN 'quota ' || id ELSE 'late' END END AS error FROM artifacts""")
def a12_decoded_artifacts(s, d):
    rows = V.artifacts(s, d).select(F.expr(ARTIFACT).alias("payload")).select(variants.parsed("payload").alias("v"))
    v = F.col("v")
    kind, status = F.try_variant_get(v, "$[2]", "int"), F.try_variant_get(v, "$[4]", "int")
    error = variants.failure_text(F.coalesce(variants.string_at(v, "$[5]"), F.lit("")), F.to_json(F.try_variant_get(v, "$[5]", "variant")))
    return rows.select(variants.string_at(v, "$[0]").alias("id"), variants.string_at(v, "$[1]").alias("title"), kind.alias("type_code"), F.try_variant_get(v, "$[9][1][0]", "int").alias("variant"), F.when(kind.isin(1, 3, 7, 8), variants.string_at(v, "$[6][1]")).alias("url"),
                       F.try_variant_get(v, "$[15][0]", "long").alias("created_at"), variants.string_at(v, "$[9][1][1]").alias("prompt"), F.when(status == 4, error).alias("error"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name END AS content FROM part")
def a12_decoded_notes(s, d):
    """A note's content from the legacy slot, a text, or the current one, a list."""
    k = F.col("p_partkey")
    payload = F.when(k % 3 == 0, F.concat(F.lit('["n", "'), "p_name", F.lit('"]'))).when(k % 3 == 1, F.concat(F.lit('["n", [null, "'), "p_name", F.lit('"]]'))).otherwise('["n"]')
    v = variants.parsed(payload)
    return V.table(s, d, "part").select("p_partkey", v.alias("v")).select("p_partkey", F.coalesce(variants.string_at(F.col("v"), "$[1][1]"), variants.string_at(F.col("v"), "$[1]")).alias("content"))
