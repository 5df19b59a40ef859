"""Operators 4, 6, 8 and 10 and the pipeline against plain models."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import chat_format, queries, simhash, url_filter, vector_search, warc
from tidemark.llm.common import shared_path

SF = "/root/testdata/sf0.001"


def run(spark, monkeypatch, name, df, query, sf=SF):
    monkeypatch.setattr(queries, "table", lambda s, d, n: df if n == name else s.read.parquet(f"{d}/{n}.parquet"))
    return query(spark, sf)


TURNS = "conv_id long, turn long, role string, text string, node string, leaf string"


def turns(spark, which):
    if which == "sf":
        return spark.read.parquet(f"{SF}/conversations.parquet")
    shared = [(0, "system", "Be <|turn|> kind \\ <|"), (1, "user", "hi"), (2, "assistant", "hello <|end|>\n")]
    rows = [(c, *t) for c in range(40) for t in shared]
    rows += [(c, 3, "user", f"more {c % 7}") for c in range(20)] + [(c, 4, "assistant", "\\" * (c % 3) + "<") for c in range(20)]
    rows += [(50, 0, None, None), (50, 0, None, None), (51, 0, "assistant", ""), (None, 1, "user", "x"), (None, 0, "assistant", "é\U0001f600")]
    rows += [(60, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(150)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op4(spark, monkeypatch, which):
    df = turns(spark, which)
    own = {}
    for r in df.collect() + [type(df.first())(conv_id=-7, turn=k, role=x, text=queries.HOSTILE[1]) for k, x in enumerate(("user", "assistant"))]:
        own.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    want = {}
    for conv, t in own.items():
        t.sort()
        learnt = "".join(x for _, role, x in t if role == "assistant")
        want[conv] = (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), sum(len(chat_format.format_turn(r, x)) for _, r, x in t))
    got = {r["conv_id"]: tuple(r)[1:] for r in run(spark, monkeypatch, "conversations", df, queries.op4_chat_formatting).collect()}
    assert got == want


def test_forest_is_depth_first(spark):
    df = turns(spark, "edge")
    nodes, members = chat_format.formatted(df)
    rows = sorted(nodes.collect(), key=lambda r: r["start"])
    named = {bytes(r["node"]): r for r in rows}
    at, path = 0, []
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["text"])
        at += r["n_tokens"]
        path = path[: r["depth"]]
        assert len(path) == r["depth"] and (not path or path[-1] == bytes(r["parent"]))  # a child follows within its parent's subtree
        above = {t for p in path for t in range(named[p]["start"], named[p]["start"] + named[p]["n_tokens"])}
        attended = [t for x in r["ancestors"] for t in range(x["start"], x["end"])]
        assert len(attended) == len(set(attended)) and set(attended) == above
        assert r["depth_start"] == len(above)
        assert r["tree"] == (named[path[0]]["start"] if path else r["start"])
        path.append(bytes(r["node"]))
    shared = [r for r in rows if "Be <" in r["text"]]
    assert len(shared) == 1 and members.count() == df.select("conv_id").distinct().count()


def test_a_long_conversation_with_branches_takes_linear_space(spark):
    n = 3000
    rows = [(0, k, "user", f"t{k}") for k in range(n)]
    rows += [(c, k, "user", f"t{k}") for c in range(1, 40) for k in range(c)] + [(c, c, "assistant", f"end {c}") for c in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, members = chat_format.formatted(df)
    r = nodes.agg(F.count("*").alias("n"), F.sum(F.size("ancestors")).alias("held"), F.max(F.size("ancestors")).alias("most")).first()
    assert r["n"] == n + 39 and r["held"] <= 6 * n and r["most"] <= 20
    got = {r["conv_id"]: (r["n_turns"], r["formatted_chars"]) for r in chat_format.read_back(nodes, members).collect()}
    size = lambda c, k: len(chat_format.format_turn("user", f"t{k}"))
    assert got[0] == (n, sum(size(0, k) for k in range(n))) and got[7][0] == 8 and len(got) == 40


def brute_top(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, v in ok:
        if q % 20 == 0:
            got = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op6(spark, monkeypatch, which):
    if which == "sf":
        df = spark.read.parquet(f"{SF}/embeddings.parquet")
    else:
        rng = random.Random(2)
        rows = [(i, [rng.choice([0.5, -0.25, 0.1, rng.random()]) for _ in range(6)]) for i in range(150)]
        rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (220, [math.inf] * 6), (240, [1.0, 2.0]), (241, [0.5, 0.5]), (None, [0.1] * 6), (242, [1e17] * 2), (243, []), (260, []), (7, [0.5] * 6)]
        df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, row string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, run(spark, monkeypatch, "embeddings", df, queries.op6_vector_search).collect()))
    if which == "edge":
        clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
        assert got == [(q, r, i, clip(s)) for q, r, i, s in brute_top(rows)]
    else:
        assert got == brute_top(rows)


def test_small_blocks_and_coarse_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (300, 8)))]
    df = vector_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=4, vector_block=37, cells=4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_cells_spare_reads():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 64, (4000, 16)))
    low, width, cells = vector_search.approximation(x)
    assert cells.nbytes * 8 == x.nbytes
    lower, upper = vector_search.bounds(x[:50], low, width, cells)
    full = x[:50] @ x.T
    assert (lower <= full).all() and (full <= upper).all()
    kept = sum(len(i) for i, *_ in vector_search.candidates(x[:50], np.arange(50), low, width, cells, np.arange(4000), 10))
    assert 500 <= kept < 1500


def test_a_vector_that_is_most_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(400 + i, [0.5 + i / 64, 1.0]) for i in range(100)]
    df = vector_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=7, vector_block=50)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_ids_and_vectors_that_repeat(spark):
    rows = [(0, [64.0, 0.0])] * 25 + [(i, [64.0, 0.0]) for i in range(1, 21)] + [(20 + i, [6.0, i / 64]) for i in range(30)]
    rows += [(40, [64.0, 0.0])] * 70 + [(i, [64.0, 0.0]) for i in (60, 80, 80, 90)]
    df = vector_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    for k in (1, 3, 20):
        got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, k, query_block=30, vector_block=40)
        assert sorted(map(tuple, got.collect())) == [r for r in brute_top(rows) if r[1] <= k]


def pages(spark, which):
    if which == "sf":
        return spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(1, "http://a.com/x", "<p>one</p>"), (2, "http://b.com", "<p>one</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "u", "é" * 3000), (6, "HTTP://User@Ex.NET:80/En", "x"), (None, "n", "x"), (9, "z", "last"), (9, "z", "last"), (8, "z", "last")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, shard string, size int")


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op8(spark, monkeypatch, which):
    df = pages(spark, which)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    most = {}
    for i, b in rows:
        if i is not None:
            most[b] = max(most.get(b, i), i)
    want = []
    for i, b in rows:
        again = b in most and most[b] != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", most[b] if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, run(spark, monkeypatch, "pages", df, queries.op8_warc).collect()), key=key) == sorted(want, key=key)


def test_archives_are_deterministic(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    seen = []
    for n in (3, 7):
        uri = shared_path(spark, "warc")
        rows = warc.write(df.repartition(n), uri, shard_bytes=60_000, file_bytes=6_000).collect()
        seen.append(sorted((r["path"], r["sha256"], r["n_records"]) for r in rows))
    assert seen[0] == seen[1] and len(seen[0]) > 5 and max(p for p, *_ in seen[0]) > "part-000001-00001"


def test_hot_records_make_the_same_files(spark):
    rows = [(7, f"u{k % 3}", "same" * 100) for k in range(3000)] + [(7, f"v{k}", "other" * 90) for k in range(2000)] + [(k, "w", f"{k % 9}" * 300) for k in range(200)]
    seen = []
    for n in (2, 5):
        uri = shared_path(spark, "warc")
        files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n), uri, shard_bytes=100_000, file_bytes=4_000).collect()
        seen.append(sorted((r["path"], r["sha256"], r["n_records"]) for r in files))
        assert sum(r["n_records"] for r in files) == len(rows) and len({r["shard"] for r in files if r["n_records"] > 5}) > 10
        assert sorted((r["page_id"], r["url"]) for r in warc.read(spark, uri).collect()) == sorted((i, u) for i, u, _ in rows)
    assert seen[0] == seen[1]


def test_archives_with_extreme_and_hot_ids(spark):
    rows = [(-(1 << 63), "a", "x" * 400), ((1 << 63) - 1, "b", "y"), (0, "c", "x" * 400)] + [(None, f"n{k % 3}", "z" * 700) for k in range(3000)] + [(7, f"h{k}", f"{k % 50}" * 300) for k in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    uri = shared_path(spark, "warc")
    shards = {r["shard"] for r in warc.write(df, uri, shard_bytes=100_000, file_bytes=4_000).collect()}
    assert len(shards) > 20
    got = warc.read(spark, uri).collect()
    most = {}
    for i, _, b in rows:
        if i is not None:
            most[b] = max(most.get(b, i), i)
    want = [(i, len(b), "revisit" if b in most and most[b] != i else "response", most[b] if b in most and most[b] != i else None) for i, _, b in rows]
    assert sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)


def test_reader_rejects_damage(spark, tmp_path):
    uri = f"file://{tmp_path}/w"
    warc.write(pages(spark, "edge"), uri)
    path = next((tmp_path / "w").glob("*.gz"))
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends early|records"):
        warc.read(spark, uri).collect()


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stop: s[: min([k for k, c in enumerate(s) if c in stop], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op10(spark, monkeypatch, which):
    df = pages(spark, which)
    if which == "edge":
        more = ["http://example.net/en/x", "http://a.example.net/en/", "http://Example.NET/enx", "https://notexample.net", "http://x.net/a?b://c", "http://example.com/de/#x", "http://b.example.com/dex", "http://o.org/fr/", "org/fr/", "http://org/fr/", "://net/", "http://net", "http://a..net/x", "É://ÉA.com/é"]
        df = df.select("page_id", "url", "html").union(spark.createDataFrame([(100 + k, u, "t") for k, u in enumerate(more)] * 2, "page_id long, url string, html string"))
    got = sorted(((r["page_id"] is None, r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"] if r["rule"] else "") for r in run(spark, monkeypatch, "pages", df, queries.op10_url_filter).collect()), key=str)
    want = []
    for r in df.collect():
        host, path = brute_parts(r["url"])
        fits = [(len(x), x, v) for v, x in queries.URL_RULES if (host == (h := x.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + x.split("/", 1)[1])]
        _, rule, verdict = max(fits, default=(0, "", ""))
        want.append((r["page_id"] is None, r["page_id"], host, path, rule, verdict))
    assert got == sorted(want, key=str)


def brute_verdicts(hosts, labelled, how):
    """Of each host, whether its posterior's lower bound is over the limit: beta-binomial priors from suffix to domain to host."""

    def names(host):
        host = host.rsplit(":", 1)[0] if ":" in host else host
        labels = host.split(".")
        n = 2 if ".".join(labels[-2:]) in url_filter.SUFFIXES else 1
        return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])

    count = [{}, {}, {}]
    for host, bad in labelled:
        for level, name in enumerate((host, *names(host))):
            n, b = count[level].get(name, (0, 0))
            count[level][name] = n + 1, b + bad
    total, bad = len(labelled), sum(b for _, b in labelled)
    mean = (bad + 0.5) / (total + 1)
    strength = []
    for level in count:
        spread = sum(n * (b / n) ** 2 for n, b in level.values()) / total - (bad / total) ** 2 - mean * (1 - mean) * len(level) / total
        strength.append(min(how.most, max(how.least, mean * (1 - mean) / spread - 1)) if spread > 0 else how.most)
    suffix = {name: (b + mean * strength[2]) / (n + strength[2]) for name, (n, b) in count[2].items()}
    domain = {name: (b + suffix[name if name in suffix else names(name)[1]] * strength[1]) / (n + strength[1]) for name, (n, b) in count[1].items()}
    out = {}
    for host in hosts:
        d, s = names(host)
        prior, (n, b) = domain.get(d, suffix.get(s, mean)), count[0].get(host, (0, 0))
        p, q = b + prior * strength[0], n - b + (1 - prior) * strength[0]
        out[host] = p / (p + q) - how.z * math.sqrt(p * q / (p + q) ** 2 / (p + q + 1)) > how.limit
    return out


def test_verdicts_against_a_plain_model(spark):
    rng = random.Random(9)
    names = [f"{a}.{b}.{c}" for a in "wxyz" for b in ("one", "two", "bad", "worse") for c in ("com", "org", "co.uk", "net:80")] + ["solo", "a.b"]
    rows = [(h, int(rng.random() < (0.95 if "bad" in h else 0.8 if "worse" in h else 0.1))) for h in names for _ in range(rng.choice([0, 1, 3, 40]))]
    hosts = sorted({*names, "new.bad.com", "q.worse.org", "fresh.com", "x.unknown"})
    want = brute_verdicts(hosts, rows, url_filter.Reputation())
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(hosts)], "page_id long, url string")
    got = url_filter.judged(pages, url_filter.rule_table(spark, [("allow", "rule.invalid/")]), spark.createDataFrame(rows, "host string, bad int")).collect()
    assert {r["host"]: r["verdict"] == "block" for r in got} == want and 3 < sum(want.values()) < len(want) - 3


def test_reputation_blocks_bad_hosts_and_shrinks(spark):
    rows = [("bad.spam.com", 1)] * 40 + [("new.spam.com", 1)] + [("ok.fine.com", 0)] * 60 + [("one.fine.com", 1)] + [("x.other.org", 0)] * 30
    got = {r["host"]: r for r in url_filter.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.spam.com"]["bound"] > 0.5 > got["one.fine.com"]["bound"]
    assert got["new.spam.com"]["rate"] > got["one.fine.com"]["rate"]  # the domain speaks for a host with one page
    assert got["ok.fine.com"]["bound"] < 0.1


def test_hosts_without_outcomes_are_judged_like_their_siblings(spark):
    rows = [(f"h{k}.spam.com", 1) for k in range(30) for _ in range(20)] + [(f"h{k}.fine.com", 0) for k in range(30) for _ in range(20)]
    rows += [(f"h{k}.bad.co.uk:8080", 1) for k in range(30) for _ in range(20)] + [(f"h{k}.good.co.uk", 0) for k in range(30) for _ in range(20)]
    labelled = spark.createDataFrame(rows, "host string, bad int")
    hosts = ["new.spam.com", "new.spam.com:81", "new.fine.com", "new.bad.co.uk", "new.good.co.uk", "new.other.com", "x.unseen", "h1.spam.com"]
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)] * 2, "page_id long, url string")
    got = url_filter.judged(pages, url_filter.rule_table(spark, [("allow", "rule.net/")]), labelled).collect()
    assert len(got) == 2 * len(hosts) and all(r["bound"] is not None for r in got)
    assert {r["host"] for r in got if r["verdict"] == "block"} == {"new.spam.com", "new.spam.com:81", "new.bad.co.uk", "h1.spam.com"}


def test_hosts_of_very_many_labels(spark):
    host = "a." * 200_000 + "example.net"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, f"http://{host}/de"), (3, "http://" + "b" * 500_000)], "page_id long, url string")
    labelled = spark.createDataFrame([("x.com", 0)], "host string, bad int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(pages, url_filter.rule_table(spark, queries.URL_RULES), labelled).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow")}


def test_empty_tables(spark, monkeypatch):
    for name, df, q in (("conversations", turns(spark, "edge"), queries.op4_chat_formatting), ("embeddings", spark.read.parquet(f"{SF}/embeddings.parquet"), queries.op6_vector_search), ("pages", pages(spark, "edge"), queries.op8_warc), ("pages", pages(spark, "edge"), queries.op10_url_filter)):
        got = run(spark, monkeypatch, name, df.limit(0), q).collect()
        assert [r["conv_id"] for r in got] == [-7] if name == "conversations" else not got


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name == "simhash_near_dedup":
            comp = brute.op9([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in docs.collect()} == {d for d, _, c in comp if d == c}
        if name == "suffix_array_dedup":
            given = before.collect()
            want = brute.whole_characters([r["text"] for r in given])
            assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == sorted((r["doc_id"], t, len(t)) for r, t in zip(given, want, strict=True))
            assert any(t != r["text"] for r, t in zip(given, want, strict=True))
        if name != "best_fit_packing":
            assert docs.columns == names
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] <= sizes[4]


def test_stages_take_nulls_and_repeats(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 800")
    for _, stage in corpus_pipeline.STAGES[:3]:
        given = stage(spark, given, SF)
    good = [r["text"] for r in given.orderBy("doc_id").limit(6).collect()]
    rows = [(None, t, None, None, None) for t in good[:3]] + [(5, good[3], "en", "web", 9), (5, good[4], "en", "web", 9), (5, good[4], "en", "web", 9), (None, None, None, None, None), (7, "", "en", "x", 0), (8, good[5] + " é" * 100_000, "en", "x", 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, SF)
            assert name == "best_fit_packing" or kept.columns == docs.columns
            docs = spark.createDataFrame(kept.collect(), kept.schema)
        assert (docs.count() > 0) == bool(some)


@pytest.mark.parametrize("name", ["op8_warc", "op10_url_filter", "op1_quality_rules"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    from tidemark.llm import oracles

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, sf).select(*columns).collect())


def test_near_dedup_keeps_one_row_of_every_component(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(60)) for _ in range(12)] + [None]
    ids = [None] * 5 + [7] * 4 + [8, 9, 10, None]
    rows = [(i, t, "en", "x", 1) for i, t in zip(ids, texts, strict=True)]
    rows += [(None, texts[9], "en", "x", 1), (3, texts[10], "de", "x", 1), (None, texts[0], "en", "x", 1), (7, texts[5], "fr", "x", None)] + [rows[5]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    want = [(i, t) for i, t in zip([*ids[:10], 3, *ids[11:]], texts, strict=True)]  # of equal texts: the smallest id, a null one only where there is no other
    found = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(want, key=str)
    assert {tuple(r) for r in found} <= set(rows)
    assert sorted(simhash.representatives(docs.repartition(5)).collect(), key=str) == sorted(found, key=str)
