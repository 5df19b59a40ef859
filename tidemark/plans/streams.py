"""Trackers and rollups as streams over the tables' files (I); the SQL is the batch form of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..sources import views as V
from ..streaming import sinks, trackers
from .registry import query


def snapshots(s, d):
    e = sinks.opened(s, d, "events")
    status = F.when(F.col("event_type") == "signup", 5).when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("pos"), status.alias("status"), F.when(F.col("user_id") % 5 == 0, 10).otherwise(5).alias("type_code"), (F.col("event_id") % 6 != 0).alias("present"))


def ended_sql(rows: str, outcome: str) -> str:
    """The first outcome up to the deadline; else given up at it, if there is a snapshot beyond it or the watermark has passed it."""
    return f"""WITH {V.SNAPSHOTS}, r AS ({rows}), m AS (SELECT max(snapshot_ts) - INTERVAL {trackers.LATE} SECOND AS mark FROM r),
f AS (SELECT *, min(snapshot_ts) OVER (PARTITION BY entity_id) + INTERVAL {trackers.DEADLINE} SECOND AS due, {outcome} AS outcome FROM r),
e AS (SELECT entity_id, snapshot_ts, pos, outcome FROM f WHERE outcome IS NOT NULL AND snapshot_ts <= due QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos) = 1),
w AS (SELECT entity_id, due, max(snapshot_ts) AS last, arg_max(status, (snapshot_ts, pos)) FILTER (present AND snapshot_ts <= due) AS status FROM f WHERE entity_id NOT IN (SELECT entity_id FROM e) GROUP BY ALL)
SELECT *, CAST(NULL AS INTEGER) AS last_status FROM e UNION ALL SELECT entity_id, due, NULL, 'timed_out', status FROM w, m WHERE last > due OR due <= mark"""


READY = "CASE WHEN NOT present THEN 'not_found' WHEN status = 2 THEN 'ready' WHEN status = 3 AND type_code NOT IN (0, 10) THEN 'failed' END"
QUIET = "SELECT entity_id, snapshot_ts, pos, type_code, CASE WHEN entity_id % 3 <> 0 THEN status WHEN status = 5 THEN 5 ELSE 1 END AS status, present OR entity_id % 3 = 0 AS present FROM snapshots"
REGISTERED = "CASE WHEN present THEN CASE WHEN status <> 3 THEN 'registered' WHEN type_code NOT IN (0, 10) THEN 'failed' END END"


@query(ended_sql(QUIET, READY))
def i1_readiness(s, d):
    """Every third entity's snapshots only say that it is on its way, so that it is given up."""
    rows = snapshots(s, d)
    third = F.col("entity_id") % 3 == 0
    quiet = rows.withColumns({"status": F.when(third, F.when(F.col("status") == 5, 5).otherwise(1)).otherwise(F.col("status")), "present": F.col("present") | third})
    return sinks.appended(trackers.outcomes(quiet, trackers.terminal_outcome), "readiness")


@query(ended_sql("SELECT * FROM snapshots", REGISTERED))
def i2_registration(s, d):
    return sinks.appended(trackers.outcomes(snapshots(s, d), trackers.registered_outcome), "registration")


@query(f"""WITH r AS (SELECT user_id AS entity_id, ts AS snapshot_ts, event_id AS pos, user_id % 4 <> 0 AND event_id % 9 <> 0 AS present,
  CASE WHEN user_id % 4 = 0 OR event_id % 9 = 0 THEN 'not_found' WHEN event_type = 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN 'completed' ELSE 'in_progress' END WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'failed' WHEN event_type = 'signup' THEN 'pending' ELSE 'in_progress' END AS now FROM events),
m AS (SELECT max(snapshot_ts) - INTERVAL {trackers.LATE} SECOND AS mark FROM r),
o AS (SELECT *, min(snapshot_ts) OVER e + INTERVAL {trackers.DEADLINE} SECOND AS due, max(snapshot_ts) OVER e AS latest, lag(now) OVER w AS before, count(*) FILTER (present) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos ROWS UNBOUNDED PRECEDING) AS island FROM r WINDOW e AS (PARTITION BY entity_id), w AS (PARTITION BY entity_id ORDER BY snapshot_ts, pos)),
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, island, present ORDER BY snapshot_ts, pos) AS run, min(snapshot_ts) OVER (PARTITION BY entity_id, island, present) AS since FROM o WHERE snapshot_ts <= due),
t AS (SELECT *, CASE WHEN now IN ('completed', 'failed') THEN now WHEN NOT present AND (run >= {trackers.ABSENT} OR run >= {trackers.ABSENT_SHORT} AND snapshot_ts >= since + INTERVAL {trackers.ABSENT_SECONDS} SECOND) THEN 'removed' END AS ended FROM n),
u AS (SELECT *, count(ended) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM t),
g AS (SELECT entity_id, due, max(latest) AS latest, count(ended) AS ended, bool_or(now = 'in_progress') AS seen, arg_max(now, (snapshot_ts, pos)) AS last FROM t GROUP BY entity_id, due)
SELECT entity_id, snapshot_ts, pos, coalesce(ended, now) AS outcome, CAST(NULL AS INTEGER) AS last_status FROM u WHERE coalesce(over, 0) = 0 AND (ended IS NOT NULL OR before IS NULL OR before <> now)
UNION ALL SELECT entity_id, due, NULL, CASE WHEN seen THEN 'timed_out_running' ELSE 'timed_out_waiting' END, CAST(list_position({list(trackers.STATUSES)}, last) - 1 AS INTEGER) FROM g, m WHERE ended = 0 AND (latest > due OR due <= mark)""")
def i3_generations(s, d):
    """Changes of status and ends; completed without media counts as in progress. A quarter of the tasks is never listed, others now and then not."""
    e = sinks.opened(s, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "failed").when(F.col("event_type") == "signup", "pending").otherwise("in_progress")
    present = (F.col("user_id") % 4 != 0) & (F.col("event_id") % 9 != 0)
    rows = e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("pos"), status.alias("status"), present.alias("present"), (F.col("event_id") % 7 == 0).alias("has_media"))
    return sinks.appended(trackers.generations(rows), "generations")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, event_type AS method, value FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT minute, method, count(*) AS started, count(*) FILTER (method = 'error') AS failed, round(sum(value), 4) AS latency_sum, max(value) AS latency_max FROM w, m WHERE minute + INTERVAL 1 MINUTE <= mark GROUP BY minute, method""")
def i4_telemetry_by_minute(s, d):
    """Windows of a minute, once the watermark of ten minutes has passed them."""
    e = sinks.opened(s, d, "events").withWatermark("ts", "10 minutes")
    n = F.count(F.when(F.col("event_type") == "error", 1))
    rows = e.groupBy(F.window("ts", "1 minute"), F.col("event_type").alias("method")).agg(F.count("*").alias("started"), n.alias("failed"), F.sum("value").alias("s"), F.max("value").alias("latency_max"))
    return sinks.appended(rows.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "method", "started", "failed", F.round("s", 4).alias("latency_sum"), "latency_max"), "telemetry")


def counters(rows):
    """Counters and the largest latency by method, of rows method and value."""
    return {"started": F.count("*"), "failed": F.count(F.when(F.col("method") == "error", 1)), "latency_max": F.max("value")}


@query("SELECT event_type AS method, count(*) AS started, count(*) FILTER (event_type = 'error') AS failed, max(value) AS latency_max FROM events GROUP BY event_type")
def i4_telemetry_in_all(s, d):
    """Counters since the beginning: a batch's counts are added to those so far."""
    rows = sinks.opened(s, d, "events").select(F.col("event_type").alias("method"), "value")
    return sinks.folded(rows, ["method"], **counters(rows))


@query("""WITH c AS (SELECT conv_id, turn, text AS answer, role = 'assistant' AS marked, CASE WHEN turn % 3 <> 1 THEN 'c' || conv_id || '-' || turn // 2 END AS conversation, [conv_id % 7, turn] AS refs, (conv_id + turn) % 4 <> 0 AND conv_id % 11 <> 0 AS parsed FROM conversations),
b AS (SELECT * FROM c WHERE parsed QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY marked DESC, length(coalesce(answer, '')) DESC, turn) = 1),
l AS (SELECT conv_id, arg_max(conversation, turn) FILTER (parsed AND conversation IS NOT NULL) AS conversation, bool_or(parsed) AS parsed FROM c GROUP BY conv_id)
SELECT conv_id, coalesce(answer, CASE WHEN b.conv_id IS NOT NULL THEN '' END) AS answer, marked, turn, refs[1] AS first_ref, refs[2] AS second_ref, l.conversation, CASE WHEN NOT l.parsed THEN 'no parseable chunk' END AS problem FROM l LEFT JOIN b USING (conv_id)""")
def i5_answers_as_they_grow(s, d):
    """Of each stream of chunks, the longest marked one up to now, else the longest, with the references that came with it; the first of equally long ones.

    The conversation is the last one named. Chunks that can't be parsed count for nothing, and a stream of them alone is a problem; an empty answer is none.
    """
    c = sinks.opened(s, d, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn").cast("long")
    parsed = ((conv + turn) % 4 != 0) & (conv % 11 != 0)
    answer, marked = F.coalesce("text", F.lit("")), F.coalesce(F.col("role") == "assistant", F.lit(False))
    named = F.when(parsed & (turn % 3 != 1), F.concat(F.lit("c"), conv, F.lit("-"), F.floor(turn / 2)))
    chunks = c.select("conv_id", turn.alias("turn"), parsed.alias("parsed"), marked.alias("marked"), answer.alias("answer"), F.array(conv % 7, turn).alias("refs"), named.alias("named"))
    best = F.when(F.col("parsed"), F.struct((~F.col("marked")).alias("u"), (-F.length("answer")).alias("l"), "turn", "marked", "answer", "refs"))
    last = F.when(F.col("named").isNotNull(), F.struct("turn", "named"))
    rows = sinks.folded(chunks, ["conv_id"], best=F.min(best), last=F.max(last), n_parsed=F.count(F.when(F.col("parsed"), 1)))
    ref = lambda k: F.get("best.refs", F.lit(k))
    return rows.select("conv_id", "best.answer", "best.marked", "best.turn", ref(0).alias("first_ref"), ref(1).alias("second_ref"), F.col("last.named").alias("conversation"), F.when(F.col("n_parsed") == 0, "no parseable chunk").alias("problem"))


#: Seconds that a notebook's research is waited for.
RESEARCH_SECONDS = 5 * 24 * 3600


@query(f"""WITH p AS (SELECT user_id AS nb, ts, event_id AS pos, event_id % 6 <> 0 AS own, event_id % 7 = 0 AS other, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status FROM events),
m AS (SELECT max(ts) - INTERVAL {trackers.LATE} SECOND AS mark FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY nb ORDER BY ts, pos) AS n, max(ts) OVER (PARTITION BY nb) AS latest FROM p),
b AS (SELECT nb, ts AS start, ts + INTERVAL {RESEARCH_SECONDS} SECOND AS due, latest, CASE WHEN own AND NOT other THEN 't' || nb WHEN other AND NOT own THEN 's' || nb END AS pin, CASE WHEN NOT own AND NOT other THEN 'no_research' WHEN own AND other THEN 'ambiguous' END AS ended FROM f WHERE n = 1),
e AS (SELECT nb, p.ts, status AS told FROM b JOIN p USING (nb) WHERE ended IS NULL AND own AND pin = 't' || b.nb AND status <> 'in_progress' AND p.ts <= due QUALIFY row_number() OVER (PARTITION BY nb ORDER BY p.ts, pos) = 1)
SELECT b.nb, b.pin, CASE WHEN ended IS NOT NULL THEN start WHEN told IS NOT NULL THEN e.ts WHEN latest > due OR due <= mark THEN due END AS ended_at,
  coalesce(ended, told, CASE WHEN latest > due OR due <= mark THEN 'timed_out' END, 'waiting') AS outcome FROM b LEFT JOIN e USING (nb), m""")
def i6_research(s, d):
    """Every event is a poll of its user's notebook: its own task, one that never ends, both or none."""
    e = sinks.opened(s, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("in_progress")
    nb, pos = F.col("user_id").cast("string"), F.col("event_id")
    own = F.when(pos % 6 != 0, F.struct(F.concat(F.lit("t"), nb).alias("task"), status.alias("status")))
    other = F.when(pos % 7 == 0, F.struct(F.concat(F.lit("s"), nb).alias("task"), F.lit("in_progress").alias("status")))
    polls = e.select(F.col("user_id").alias("nb"), F.col("ts").alias("polled_at"), pos.alias("pos"), F.array_compact(F.array(own, other)).alias("tasks"))
    rows = trackers.researched(polls, RESEARCH_SECONDS)
    return rows.select("nb", "pin", F.timestamp_micros("ended").cast("timestamp_ntz").alias("ended_at"), F.coalesce("outcome", F.lit("waiting")).alias("outcome"))


@query(f"""WITH {V.REQUESTED}, e AS (SELECT nb, {V.key_sql('url', 'import')} AS key, min(pos) AS pos FROM existing GROUP BY ALL),
r AS (SELECT nb, {V.key_sql('url', 'import')} AS key, min(pos) AS pos FROM (SELECT page_id % 20 AS nb, page_id AS pos, url FROM pages) GROUP BY ALL)
SELECT * FROM e UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.nb = r.nb AND e.key = r.key)""")
def i7_idempotent_ingest(s, d):
    """Pages into what is there: the first of each URL's normal form, and none that is there already."""
    old = V.existing(s, d).select("nb", urls.import_key("url").alias("key"), "pos").groupBy("nb", "key").agg(F.min("pos").alias("pos"))
    new = sinks.opened(s, d, "pages").select((F.col("page_id") % 20).alias("nb"), urls.import_key("url").alias("key"), F.col("page_id").alias("pos"))
    return sinks.kept_by(new, ["nb", "key"], sinks.FirstWins(), "nb long, key string, pos long", start=old)


#: Turns of a conversation, and conversations, that are remembered.
TURNS, CONVERSATIONS = 1000, 100


@query(f"""WITH c AS (SELECT conv_id, turn, role, conv_id * 1000 + turn AS used FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY used DESC) AS n FROM c),
k AS (SELECT conv_id FROM n WHERE n = 1 ORDER BY used DESC LIMIT {CONVERSATIONS})
SELECT conv_id, turn, role FROM n WHERE n <= {TURNS} AND conv_id IN (SELECT conv_id FROM k)""")
def i8_newest_turns(s, d):
    """The newest thousand turns of the hundred conversations used last, one conversation after another."""
    turns = sinks.opened(s, d, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    kept = sinks.carried(turns, s.createDataFrame([], turns.schema), sinks.most_recent(["conv_id"], [F.desc("at")], TURNS, CONVERSATIONS))
    return kept.select("conv_id", "turn", "role")


@query(f"WITH {V.SNAPSHOTS} SELECT entity_id, snapshot_ts, pos FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts, pos) AS n FROM snapshots WHERE present) WHERE n = 1")
def i9_added_ids(s, d):
    return sinks.appended(trackers.first_seen(snapshots(s, d)), "added")
