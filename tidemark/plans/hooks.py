"""Functions that the caller puts in (J): a classifier, formatters, extractors, callbacks, accessors, a progress sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, hygiene, resolve
from ..sources import views as V
from ..sources.shared import folder
from ..streaming import sinks
from .analysis import JUNK
from .payloads import TABLE, cells
from .registry import query


@query(f"WITH {V.SOURCES} SELECT nb, source_id FROM sources WHERE NOT (length(url) > 40 OR title = '403 Forbidden')")
def j1_own_classifier(s, d):
    """A caller's own idea of junk: long addresses and one title."""

    def classify(sources):
        return sources.withColumn("reason", F.when(F.length("url") > 40, "long").when(F.col("title") == "403 Forbidden", "title"))

    return gates.cleaned(V.sources(s, d), classify).select("nb", "source_id")


@query("SELECT p_partkey, '- **' || p_name || '** (' || p_brand || ')' AS short, '### ' || p_name || chr(10) || chr(10) || p_type AS long FROM part")
def j2_own_formatters(s, d):
    """Two formatters over the same rows."""
    short = lambda c: F.concat(F.lit("- **"), c("p_name"), F.lit("** ("), c("p_brand"), F.lit(")"))
    long = lambda c: F.concat(F.lit("### "), c("p_name"), F.lit("\n\n"), c("p_type"))
    return gates.rendered(gates.rendered(V.table(s, d, "part"), short, "short"), long, "long").select("p_partkey", "short", "long")


@query("""SELECT o_orderkey AS table_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE c WHEN 0 THEN '[[1,["Qty"]]]' ELSE '["Na","me"]' END AS header,
CASE WHEN r = 2 THEN '["' || o_orderstatus || '"]' WHEN c = 0 THEN '["' || o_custkey || '",["x"]]' ELSE '["' || o_orderpriority || '"]' END AS text FROM orders, (VALUES (1, 0), (1, 1), (2, 0)) AS cells(r, c)""")
def j3_own_extractors(s, d):
    """Cells from last to first, each as the JSON it was."""
    tables = V.table(s, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.expr(TABLE).alias("payload"))
    return cells(tables, row_of=lambda r: F.reverse(F.try_variant_get(r, "$[2]", "array<variant>")), text_of=lambda c: F.col(c) if isinstance(c, str) else c)


@query("SELECT event_type AS method, count(*) AS started, max(value) AS latency_max FROM events GROUP BY event_type")
def j4_told_of_counters(s, d):
    """A callback is told of the counters that changed after every batch, and writes them under its number; the last it heard of each."""
    told = folder(s, "told")
    rows = sinks.opened(s, d, "events").select(F.col("event_type").alias("method"), "value")

    def tell(changed, number):
        changed.write.mode("overwrite").parquet(f"{told}/batch={number}")

    sinks.folded(rows, ["method"], after=tell, started=F.count("*"), latency_max=F.max("value"))
    heard = s.read.schema("method string, started long, latency_max double, batch int").parquet(told)
    return heard.groupBy("method").agg(F.max_by("started", "batch").alias("started"), F.max_by("latency_max", "batch").alias("latency_max"))


@query(f"WITH {V.SNAPSHOTS} SELECT entity_id, snapshot_ts, pos, status FROM (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos) AS b FROM snapshots) WHERE b IS NULL OR b <> status")
def j5_told_of_changes(s, d):
    """A callback is told of the changes of status in every batch; it writes them under the batch's number, so that one told twice is there once."""
    told = folder(s, "changes")
    e = sinks.opened(s, d, "events")
    status = F.when(F.col("event_type") == "signup", 5).when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    rows = e.select(F.col("user_id").alias("entity_id"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("pos"), status.alias("status"))

    def tell(changes, number):
        changes.write.mode("overwrite").parquet(f"{told}/batch={number}")

    schema = "entity_id long, at long, pos long, status int"
    sinks.kept_by(rows, ["entity_id"], sinks.Changes(), schema, after=tell)
    return s.read.schema(schema).parquet(told).select("entity_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("snapshot_ts"), "pos", "status")


@query("""WITH t AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_name END AS token FROM customer), f AS (SELECT s_name AS token, count(*) AS n, min(s_suppkey) AS id FROM supplier GROUP BY s_name)
SELECT token, CASE WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS verdict, CASE WHEN n = 1 THEN id END AS id FROM t LEFT JOIN f USING (token)""")
def j6_own_accessors(s, d):
    """Ids and titles are where the caller says."""
    c = V.table(s, d, "customer")
    tokens = c.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).otherwise(F.col("c_name")).alias("token"))
    return resolve.by_title(tokens, V.table(s, d, "supplier"), id_of="s_suppkey", title_of="s_name")


@query(f"WITH {JUNK} SELECT count(*) AS n_rows, count(url) AS n_addressed, max(pos) AS last FROM junk WHERE reason IS NULL")
def j7_progress(s, d):
    """What a progress sink was told of a table's rows while they were written."""
    kept, seen = gates.watched(hygiene.cleaned(hygiene.junk(V.sources(s, d))), "progress", n_rows=F.count("*"), n_addressed=F.count("url"), last=F.max("pos"))
    kept.write.parquet(folder(s, "kept"))
    return s.createDataFrame([seen.get], "n_rows long, n_addressed long, last long")
