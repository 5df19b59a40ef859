"""Streams over many micro-batches, in any order within one, with silent keys, and over restarts."""

import itertools
import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.streaming import sinks, trackers

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State stores are many small files, one set a partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def split_events(spark, tmp_path):
    """The events in files that arrive one after another, so that a stream takes many micro-batches."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(4):
        events.withColumn("part", F.ntile(4).over(Window.orderBy("ts", "event_id"))).where(F.col("part") == k + 1).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["i1_readiness", "i2_registration", "i4_telemetry_in_all", "i9_added_ids", "i3_generations", "i6_research", "j4_told_of_counters", "j5_told_of_changes"])
def test_batches_of_a_stream_make_no_difference(spark, monkeypatch, split_events, name):
    whole = sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))
    plain = sinks.opened
    monkeypatch.setattr(sinks, "opened", lambda s, d, n, files=None: plain(s, d, n, 1))
    assert sorted(map(str, catalog.QUERIES[name](spark, split_events).collect())) == whole


def test_batches_of_conversations_make_no_difference(spark, monkeypatch, tmp_path):
    whole = {n: sorted(map(str, catalog.QUERIES[n](spark, SF).collect())) for n in ("i5_answers_as_they_grow", "i8_newest_turns")}
    for k in range(4):
        spark.read.parquet(f"{SF}/conversations.parquet").where(F.col("conv_id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    plain = sinks.opened
    monkeypatch.setattr(sinks, "opened", lambda s, d, n, files=None: plain(s, d, n, 1))
    for name, rows in whole.items():
        assert sorted(map(str, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == rows


def test_generations_step_by_step(spark):
    got = sorted(map(tuple, catalog.QUERIES["i3_generations"](spark, SF).select("entity_id", "pos", "outcome").collect()), key=str)
    want = []
    for user in sorted({r["user_id"] for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").collect()}):
        state = (None, None, 0, None, False, False)
        rows_ = spark.read.parquet(f"{SF}/events.parquet").where(F.col("user_id") == user).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type").orderBy("at", "event_id").collect() if user % 10 == 0 else []
        for r in rows_:
            kind = {"purchase": "completed", "signup": "pending"}.get(r["event_type"], "failed" if r["event_type"] == "error" and r["event_id"] % 5 == 0 else "in_progress")
            state, told = trackers.generation(state, r["at"], user % 4 != 0 and r["event_id"] % 9 != 0, kind, r["event_id"] % 7 == 0)
            want += [(user, None if told.startswith("timed_out") else r["event_id"], told)] if told else []
    assert [g for g in got if g[0] % 10 == 0] == sorted(want, key=str) and want


def test_generation_rules():
    second, s0 = 1_000_000, (None, None, 0, None, False, False)

    def go(*steps):
        state, out = s0, []
        for k, (at, present, status, media) in enumerate(steps):
            state, told = trackers.generation(state, at * second, present, status, media)
            out.append(told)
        return out

    assert go((0, True, "completed", False), (1, True, "completed", True), (2, True, "failed", True)) == ["in_progress", "completed", None]
    assert go(*[(k, False, None, False) for k in range(10)]) == ["not_found"] + [None] * 8 + ["removed"]
    assert go(*[(3 * k, False, None, False) for k in range(5)]) == ["not_found"] + [None] * 3 + ["removed"]
    assert go(*[(k, False, None, False) for k in range(4)], (4, True, "pending", False), *[(5 + k, False, None, False) for k in range(4)]) == ["not_found"] + [None] * 3 + ["pending", "not_found"] + [None] * 3
    late = trackers.DEADLINE + 1
    assert go((0, True, "pending", False), (late, True, "pending", False)) == ["pending", "timed_out_waiting"]
    assert go((0, True, "in_progress", False), (late, True, "pending", False)) == ["in_progress", "timed_out_running"]


def fed(spark, path, schema, *batches):
    """A stream whose files are the batches, one after another; its column ``at`` (seconds) becomes the time."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/{k}")
        part = next(f for f in os.listdir(f"{path}/{k}") if f.startswith("part"))
        os.makedirs(f"{path}/t.parquet", exist_ok=True)
        os.rename(f"{path}/{k}/{part}", f"{path}/t.parquet/{k}.parquet")
        os.utime(f"{path}/t.parquet/{k}.parquet", (k + 1, k + 1))
    return sinks.opened(spark, str(path), "t", 1)


SNAP = "entity_id long, at long, pos long, status int, type_code int, present boolean"


#: Seconds from which the tests count: a watermark starts at zero, and what is not after it is late.
ZERO = 1_000_000


def waited(spark, stream, deadline=1000, outcome=trackers.terminal_outcome):
    rows = stream.withColumn("snapshot_ts", F.timestamp_seconds(F.col("at") + ZERO))
    got = sinks.appended(trackers.outcomes(rows, outcome, deadline, late=10), "waited").collect()
    return sorted((r["entity_id"], r["snapshot_ts"].timestamp(), r["pos"], r["outcome"], r["last_status"]) for r in got)


def seconds(rows, zero):
    return [(e, round(t - zero), p, o, s) for e, t, p, o, s in rows]


def test_silent_entities_are_given_up_without_another_snapshot(spark, tmp_path):
    on = lambda e, at, status=1, present=True, kind=5: (e, at, at, status, kind, present)
    stream = fed(spark, tmp_path, SNAP, [on(1, 0), on(2, 0, 5), on(3, 0)], [on(1, 400, 5), on(3, 900), on(4, 400)], [on(5, 1005)], [on(5, 1100)], [on(3, 1200, 2)])
    got = seconds(waited(spark, stream), ZERO)
    # 1 and 2 fell silent; 3's ready snapshot is after its deadline; 4's deadline is not there yet, 5's neither.
    assert [(e, o, s) for e, _, _, o, s in got] == [(1, "timed_out", 5), (2, "timed_out", 5), (3, "timed_out", 1)]
    assert {(t, p) for _, t, p, *_ in got} == {(1000, None)}


@pytest.mark.parametrize("cut", [2, 1000])
def test_order_and_arrow_batches_make_no_difference(spark, tmp_path, cut):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", cut)
    try:
        for k, order in enumerate(itertools.permutations([(100, 1), (1060, 5), (0, 0), (1500, 2)])):
            stream = fed(spark, tmp_path / str(k), SNAP, [(1, at, n, status, 5, True) for n, (at, status) in enumerate(order)])
            if k % 4 == 0:
                assert [(o, s) for *_, o, s in waited(spark, stream)] == [("timed_out", 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_a_hot_entity_in_many_arrow_batches():
    """The fold itself, chunk by chunk, against a plain model."""
    import random

    class Value:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        def __init__(self):
            self.timers = set()

        getValueState = lambda self, name, schema: Value()

        def registerTimer(self, ms):
            self.timers.add(ms)

        def deleteTimer(self, ms):
            self.timers.remove(ms)

    rng = random.Random(8)
    for _ in range(300):
        batches = [[(rng.randrange(200) + 60 * b, rng.randrange(10**6), rng.choice([None, 1, 5]), rng.choice([None] * 9 + ["ready"])) for _ in range(rng.randrange(1, 12))] for b in range(2)]
        edge = max(x[0] for x in batches[0])  # files arrive in the order of their snapshots
        batches[1] = [(max(r[0], edge), 10**6 + r[1], *r[2:]) for r in batches[1]]
        p, handle = trackers.Waiting(100), Handle()
        p.init(handle)
        out = []
        for batch in batches:
            chunks = [batch[k : k + 3] for k in range(0, len(batch), 3)]
            frames = (pd.DataFrame(c, columns=["at", "pos", "status", "outcome"]).assign(at=lambda f: f["at"] * trackers.MICRO) for c in chunks)
            out += [tuple(r) for f in p.handleInputRows((1,), frames, None) for r in f.itertuples(index=False)]
        out += [tuple(r) for f in (p.handleExpiredTimer((1,), None, None) if handle.timers else ()) for r in f.itertuples(index=False)]
        every = sorted((r for b in batches for r in b), key=lambda r: r[:2])
        due = every[0][0] + 100
        ended = next(((at, pos, o) for at, pos, _, o in every if o and at <= due), None)
        last = [s for at, _, s, _ in every if at <= due and s is not None]
        want = (*ended, None) if ended else (due, None, "timed_out", last[-1] if last else None)
        got = [(int(at) // trackers.MICRO, None if pd.isna(pos) else int(pos), o, None if pd.isna(s) else int(s)) for _, at, pos, o, s in out]
        assert got == [want]


def test_a_key_takes_one_read_and_one_write_of_its_state():
    calls = []

    class Value:
        get = lambda self: calls.append("get")
        exists = lambda self: calls.append("exists")
        update = lambda self, value: calls.append("update")

    class Handle:
        getValueState = lambda self, name, schema: Value()

    p = trackers.Waiting(100)
    p.init(Handle())
    rows = pd.DataFrame({"at": [5, 3, 3], "pos": [0, 2, 1], "status": [1.0, None, 2.0], "outcome": ["late", "b", "a"]})
    out = pd.concat(p.handleInputRows((7,), iter([rows, rows[:0]]), None))
    assert out.astype(object).where(out.notna(), None).values.tolist() == [[7, 3, 1, "a", None]] and calls == ["get", "update"]


def test_registration_waits_out_a_passing_failure(spark, tmp_path):
    stream = fed(spark, tmp_path, SNAP, [(1, 0, 0, 3, 10, True), (2, 0, 0, 3, 5, True), (3, 0, 0, 3, None, True), (4, 0, 0, 1, 5, False)], [(1, 50, 1, 1, 10, True), (4, 60, 1, 5, 5, True)], [(9, 5000, 2, 2, 5, True)])
    got = [(e, o, s) for e, _, _, o, s in waited(spark, stream, outcome=trackers.registered_outcome)]
    assert got == [(1, "registered", None), (2, "failed", None), (3, "timed_out", 3), (4, "registered", None), (9, "registered", None)]


def test_generations_fall_silent(spark, tmp_path):
    schema = "entity_id long, at long, pos long, status string, present boolean, has_media boolean"
    stream = fed(spark, tmp_path, schema, [(1, 0, 0, "pending", True, False), (2, 0, 0, "completed", True, False), (3, 0, 0, "pending", False, False)], [(2, 5, 1, None, False, False)], [(4, 3000, 3, "failed", True, True)])
    got = sinks.appended(trackers.generations(stream.withColumn("snapshot_ts", F.timestamp_seconds(F.col("at") + ZERO)), 1000, 10), "fell").collect()
    assert sorted(((r["entity_id"], r["outcome"], r["last_status"]) for r in got), key=str) == sorted(
        [(1, "pending", None), (1, "timed_out_waiting", 0), (2, "in_progress", None), (2, "not_found", None), (2, "timed_out_running", 4), (3, "not_found", None), (3, "timed_out_waiting", 4), (4, "failed", None)], key=str
    )


def test_research_rules(spark, tmp_path):
    going, done, bad = "in_progress", "completed", "failed"
    schema = "nb long, at long, pos long, tasks array<struct<task:string,status:string>>"
    first = [
        (1, 0, 0, None), (1, 1, 1, [("a", done)]),
        (2, 0, 0, [("a", going), ("b", going)]),
        (3, 1, 1, [("b", done)]), (3, 0, 0, [("a", going)]), (3, 2, 2, []), (3, 3, 3, [("b", done), ("a", bad)]),
        (4, 0, 0, [("a", going)]), (4, 10, 1, [("a", going)]),
        (5, 0, 0, [("a", done)]),
        (6, 0, 0, [("x", done), ("y", done)]),
        (7, 0, 0, [("a", going)]),
    ]
    later = [(1, 4, 9, [("a", done)]), (4, 11, 9, [("a", done)]), (6, 5, 9, [("named", done)]), (3, 4, 9, [("a", done)]), (8, 10, 0, [("q", going)])]
    named = spark.createDataFrame([(6, "named")], "nb long, pin string")
    for k, batches in enumerate([(first, later), (first + later,), (first, later, [(8, 12, 1, None)])]):
        polls = fed(spark, tmp_path / str(k), schema, *batches).withColumn("polled_at", F.timestamp_seconds(F.col("at") + ZERO))
        got = {r["nb"]: (r["pin"], r["ended"] and r["ended"] // 1_000_000 - ZERO, r["outcome"]) for r in trackers.researched(polls, 10, 1, named).collect()}
        silent = ("a", 10, "timed_out") if k == 2 else got[7]
        assert got == {1: (None, 0, "no_research"), 2: (None, 0, "ambiguous"), 3: ("a", 3, bad), 4: ("a", 10, "timed_out"), 5: ("a", 0, done), 6: ("named", 5, done), 7: silent, 8: ("q", None, None)}
        assert got[7] in (("a", 10, "timed_out"), ("a", None, None))


def test_delivered_again_changes_nothing_and_callbacks_may_fail(spark, tmp_path):
    rows = [(1, "a", 5), (1, "a", 3), (1, "b", 9), (2, "a", 1)]
    told = []
    start = spark.createDataFrame([(2, "a", 0)], "nb int, key string, pos int")
    got = sinks.kept_by(fed(spark, tmp_path, start.schema, rows, rows, [(1, "a", 1)]), ["nb", "key"], sinks.FirstWins(), "nb int, key string, pos long", start=start, after=lambda df, n: told.append(df.count()) or 1 / 0)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 3), (1, "b", 9), (2, "a", 0)] and told == [2, 0, 0]


def test_conversations_are_forgotten(spark, tmp_path):
    schema = "conv string, at long"
    batches = [[("a", 1), ("a", 2), ("a", 3), ("b", 4)], [("c", 5), ("b", 6)], [("a", 7), ("c", 8)], [("d", 9), ("d", 9)]]
    for k, (count, groups, want) in enumerate([(2, 2, [("c", 8), ("d", 9), ("d", 9)]), (1, 3, [("a", 7), ("c", 8), ("d", 9)]), (0, 5, []), (5, 0, []), (1000, 100, sorted(r for b in batches for r in b))]):
        stream = fed(spark, tmp_path / str(k), schema, *batches)
        got = sinks.carried(stream, spark.createDataFrame([], schema), sinks.most_recent(["conv"], [F.desc("at")], count, groups))
        # c has 5 and 8; a lost 1 to 3 when it was dropped after the second batch
        assert sorted(map(tuple, got.collect())) == (sorted([("c", 5), *want]) if (count, groups) == (2, 2) else want)


KILLED = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from pyspark.sql import DataFrameWriter
from tidemark.streaming import sinks
where, kind, fall = sys.argv[1], sys.argv[2], sys.argv[3] == "fall"
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{where}/shared").getOrCreate()
stream = sinks.opened(spark, where, "t", 1)
if kind == "folded":
    def tell(batch, number):
        if fall and number == 2:
            os._exit(9)
    out = sinks.folded(stream, ["k"], f"file://{where}/at", tell, n=F.count("*"), total=F.sum("v"))
else:
    plain = DataFrameWriter.parquet
    def parquet(self, path, *args, **kwargs):
        plain(self, path, *args, **kwargs)
        if fall and os.path.exists(f"{where}/at/checkpoint/offsets/2"):
            os._exit(9)
    DataFrameWriter.parquet = parquet
    out = sinks.carried(stream, spark.createDataFrame([], "k long, v long"), lambda table, batch: table.unionByName(batch).groupBy("k").agg(F.sum("v").alias("v")), f"file://{where}/at")
if not fall:
    plain_rows = sorted(tuple(r) for r in out.collect())
    print("ROWS", plain_rows)
"""


@pytest.mark.parametrize("kind", ["folded", "carried"])
def test_killed_before_the_commit_and_started_anew(spark, tmp_path, kind):
    batches = [[(k, 10 * b + k) for k in range(3)] + [(b, 1)] for b in range(4)]
    fed(spark, tmp_path, "k long, v long", *batches)
    env = os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")}
    run = lambda how: subprocess.run([sys.executable, "-c", KILLED, str(tmp_path), kind, how], env=env, capture_output=True, text=True, timeout=300)
    assert run("fall").returncode == 9
    assert os.path.exists(f"{tmp_path}/at/" + ("" if kind == "folded" else "checkpoint/") + "offsets/2")
    again = run("go on")
    sums = {}
    for k, v in (r for b in batches for r in b):
        n, total = sums.get(k, (0, 0))
        sums[k] = n + 1, total + v
    want = sorted((k, n, t) if kind == "folded" else (k, t) for k, (n, t) in sums.items())
    assert f"ROWS {want}" in again.stdout, again.stderr[-2000:]
