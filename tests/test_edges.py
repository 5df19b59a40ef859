"""Edges of operators, each against a plain model or by hand."""

import difflib
import random
import re
import time
import unicodedata

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import codes, markdown, text, urls, variants
from tidemark.operators import citations, gates, membership, names, resolve, rows
from tidemark.plans import payloads
from tidemark.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


def taken_one_by_one(titles):
    taken = set()
    for base, extension in titles:
        name, n = base + extension, 2
        while name in taken:
            name, n = f"{base} ({n}){extension}", n + 1
        taken.add(name)
        yield name


def safe(title):
    return re.sub(r'[/\\:*?"<>|]', "_", title or "").strip(". ") or "untitled"


def test_names_are_those_of_one_by_one(spark):
    rng = random.Random(1)
    titles = [rng.choice(["x", "y/", " .z. ", "", "x (2)", "x (3)", "x (2) (2)", "x (02)", "x (1)", None]) for _ in range(400)]
    data = [(k % 3, k, t, rng.choice([".md", ".pdf"])) for k, t in enumerate(titles)]
    df = spark.createDataFrame(data, "folder int, id int, title string, ext string")
    got = {r["id"]: r["file"] for r in names.unique(df.repartition(5), "folder", "title", "ext", "id").collect()}
    for folder in range(3):
        own = [d for d in data if d[0] == folder]
        assert [got[d[1]] for d in own] == list(taken_one_by_one((safe(d[2]), d[3]) for d in own))


def test_names_beside_existing_files(spark):
    rng = random.Random(2)
    pool = ["x", "x (2)", "x (3)", "x (2) (2)", "y", "y (02)", "z.v", "w"]
    data = [(k % 3, k, rng.choice(pool), rng.choice([".md", ".pdf"])) for k in range(240)] + [(9, 1000 + k, "hot", ".md") for k in range(50)]
    there = [(f, rng.choice(pool[:-1]) + rng.choice([".md", ".pdf", ".txt"])) for f in range(4) for _ in range(9)] + [(0, "x (5).md"), (1, "x.md")]
    df = spark.createDataFrame(data, "folder int, id int, title string, ext string").repartition(4)
    existing = spark.createDataFrame(there, "folder int, file string")
    got = {r["id"]: r["file"] for r in names.unique(df, "folder", "title", "ext", "id", existing).collect()}
    assert len(got) == len(data)
    for folder in (0, 1, 2, 9):
        taken = {name for f, name in there if f == folder}
        for f, i, title, ext in data:
            if f == folder:
                name, n = title + ext, 2
                while name in taken:
                    name, n = f"{title} ({n}){ext}", n + 1
                taken.add(name)
                assert got[i] == name
    files = spark.createDataFrame([(0, 1, "x.md"), (0, 2, "x (2).md"), (0, 3, "x (2) (2).md"), (0, 4, "x (3).md"), (0, 5, ".rc"), (0, 6, "plain"), (1, 7, "x.md"), (2, 8, "n.md")], "folder int, id int, name string")
    existing = spark.createDataFrame([(0, "x.md"), (0, ".rc"), (0, "plain"), (0, "x (4).md"), (1, "x.md")], "folder int, file string")
    out = {p: {r["id"]: (r["action"], r["target"]) for r in names.resolved(files, "folder", "name", "id", existing, p).collect()} for p in ("rename", "skip", "force")}
    # 1 becomes x (2), so 2 finds that taken, and 3 what 2 became.
    assert out["rename"] == {1: ("renamed", "x (2).md"), 2: ("renamed", "x (2) (2).md"), 3: ("renamed", "x (2) (2) (2).md"), 4: ("write", "x (3).md"), 5: ("renamed", ".rc (2)"), 6: ("renamed", "plain (2)"), 7: ("renamed", "x (2).md"), 8: ("write", "n.md")}
    assert out["skip"][1] == ("skipped", None) and out["force"][1] == ("overwritten", "x.md") and out["skip"][2] == out["force"][2] == ("write", "x (2).md")
    with pytest.raises(ValueError):
        names.resolved(files, "folder", "name", "id", existing, "ask")


def test_equal_titles_are_counted_in_many_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).alias("folder"), "id", F.when(F.col("id") % 1000 == 0, "  ").otherwise("same").alias("title"), F.lit(".md").alias("ext"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be put together again
    try:
        got = names.unique(df, "folder", "title", "ext", "id")
        tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 20_000
    last = got.where("id in (0, 1, 1000, 39999)").select("id", "file").collect()
    assert dict(map(tuple, last)) == {0: "untitled.md", 1: "same.md", 1000: "untitled (2).md", 39999: "same (39960).md"}


def test_uuids_in_nested_lists(spark):
    u, v = "0a1b2c3d-0000-4000-8000-00000000000" + "1", "0A1B2C3D-0000-4000-8000-00000000000F"
    given = [f'["x{u}", [["{v}"]], "{u}"]', f'{{"k": "{u}"}}', f'[{{"k": "{u}"}}, "{v}"]', "[" * 9 + f'"{u}"' + "]" * 9, "[" * 10 + f'"{u}"' + "]" * 10, f'"{u}"', "[", None, "[1, null]"]
    assert one(spark, text.first_uuid, *given) == [v, None, v, u, None, u, None, None, None]


def test_pieces_of_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2]), k, rng.randrange(1, 60)) for k in range(3000)]
    got = sorted(map(tuple, rows.pieced(spark.createDataFrame(data, "k int, v int, s int").repartition(5), ["k"], ["v"], F.col("s"), 500).collect()), key=str)
    want = []
    for key in (None, 1, 2):
        before = 0
        for n, (k, v, s) in enumerate((d for d in data if d[0] == key), 1):
            want.append((k, v, s, n, before // 500))
            before += s
    assert got == sorted(want, key=str)


def test_who_is_chosen(spark):
    items = spark.createDataFrame([(1, "a", "Alpha", None, 0), (1, "b", "alphabet", 5, 1), (1, "c", "Beta", 5, 2), (2, "d", None, 7, 0)], "nb int, id string, title string, created_at long, pos int")
    asked = [(0, 1, None, None, None), (1, 1, "", "", True), (2, 1, "c", "alpha", None), (3, 1, "zz", None, None), (4, 1, None, "ALPHA", False), (5, 1, None, "bet", True), (6, 1, None, "BETA", None), (7, 2, None, None, None), (8, 3, None, None, None), (9, 1, None, "nope", None), (9, 1, None, "nope", None)]
    got = rows.chosen(items, spark.createDataFrame(asked, "who int, nb int, id string, name string, earliest boolean"), "nb").select("who", "chosen", "n_matches", "reason", "error")
    assert sorted(map(tuple, got.collect())) == [
        (0, "b", 3, "latest of 3", None), (1, "a", 3, "earliest of 3", None), (2, "c", 1, "matched by id", None), (3, None, 0, None, "id not found"), (4, "b", 2, "latest of 2", None), (5, "b", 2, "earliest of 2", None),
        (6, "c", 1, "matched by name", None), (7, "d", 1, "only one", None), (8, None, 0, None, "nothing there"), (9, None, 0, None, "no title matches"), (9, None, 0, None, "no title matches"),
    ]


def test_many_ids_chosen_in_one_group(spark):
    n = 30_000  # as pairs of an id and an item: 900 million
    items = spark.range(n).selectExpr("1 AS nb", "CAST(id AS STRING) AS id", "concat('Title ', id % 7) AS title", "id % 5 AS created_at", "id AS pos")
    asked = spark.range(n).selectExpr("id AS who", "1 AS nb", "IF(id % 10 = 0, NULL, CAST(id * 2 AS STRING)) AS id", "concat('title ', id % 3) AS name", "id % 2 = 0 AS earliest")
    began = time.time()
    got = {r["who"]: (r["chosen"], r["n_matches"]) for r in rows.chosen(items, asked, "nb").collect()}
    assert time.time() - began < 60
    for k in range(n):
        if k % 10:
            assert got[k] == ((str(2 * k), 1) if 2 * k < n else (None, 0))
        else:
            own = range(k % 3, n, 7)
            assert got[k] == (str(min(own, key=lambda x: (x % 5, x))), len(own))


def test_gates_of_framed_answers(spark):
    good, bad = '["x"]', "[oops"
    answers = ["", None, " \n ", good, f"5\n{good}", f"999\r\n{good}\r\n\r\n4\n{bad}", "\n".join([good] * 9 + [bad]), "\n".join([good] * 18 + [bad] * 2), "\n".join([good] * 17 + [bad] * 2), "\n".join([f"5\n{good}"] * 9 + ["5"]), "\n".join([f"5\n{good}"] * 8 + ["5"]), f"5\n\n{good}", "7\n8\n" + good, "\n".join([f"5\n{good}"] * 10 + [bad] + ["5"])]
    got = gates.framed(spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").coalesce(1), "a").orderBy("k").collect()
    counts = [(len(r["chunks"]), r["n_payloads"], r["bad_payloads"], r["n_framings"], r["bad_framings"], r["refused"]) for r in got]
    assert counts == [
        (0, 0, 0, 0, 0, None), (0, 0, 0, 0, 0, None), (0, 0, 0, 0, 0, None), (1, 1, 0, 0, 0, None), (1, 1, 0, 1, 0, None), (1, 2, 1, 2, 0, "payload"),
        (9, 10, 1, 0, 0, None), (18, 20, 2, 0, 0, None), (17, 19, 2, 0, 0, "payload"), (9, 9, 0, 10, 1, None), (8, 8, 0, 9, 1, "framing"), (1, 2, 1, 1, 0, "payload"), (2, 2, 0, 1, 0, None), (10, 11, 1, 11, 1, "total"),
    ]


def test_every_place_of_a_cited_text(spark):
    probe = "ab" * 20
    content = (probe + "ab") * 3 + "." + probe[:-1] + "x"
    hits = [m.start() for m in re.finditer(probe, content)]
    many = "needle-in-a-haystack" * 100_000
    full = spark.createDataFrame([("s", content), ("m", many), ("n", None), ("e", "")], "source_id string, content string")
    refs = spark.createDataFrame([("s", probe + "beyond forty"), ("m", "needle-in-a-haystack"), ("n", "x"), ("e", "x"), ("s", ""), ("s", None), ("gone", "x")], "source_id string, cited_text string")
    got = citations.all_contexts(refs, full)
    assert sorted((r["start"], r["context"]) for r in got.where("source_id = 's'").collect()) == [(h, content[max(0, h - 200) : h + 240]) for h in hits]
    assert got.where("source_id = 'm'").agg(F.count("*"), F.sum("start"), F.max(F.length("context"))).first()[:] == (100_000, 20 * 100_000 * 99_999 // 2, 420)
    assert got.where("source_id NOT IN ('s', 'm')").count() == 0


def test_secrets_by_name(spark):
    raw = ["SID=abc; HSID=d; SSID=e; APISID=f/g; SAPISID=h; LSID=s.x:1; OSID=o", 'NID=511=ab; SIDCC="q q"; LSOLH=_SNID; BSID=left', "sid=lower is no cookie", "__Secure-3PSIDTS=sidts-abcdefghij x", "the word SID alone"]
    assert one(spark, text.scrubbed, *raw) == ["SID=***; HSID=***; SSID=***; APISID=***; SAPISID=***; LSID=***; OSID=***", 'NID=***; SIDCC="*** q"; LSOLH=***; BSID=***', "sid=lower is no cookie", "__Secure-3PSIDTS=*** x", "the word SID alone"]


def test_adding_no_members_is_refused(spark):
    bridge = spark.createDataFrame([(1, "a", 0)], "label_id int, source_id string, pos int")
    with pytest.raises(ValueError):
        membership.added(bridge, bridge.limit(0))


def test_a_label_list_holds_no_texts(spark, tmp_path, monkeypatch):
    docs = [(k, "x" * 5000 if k % 4 else None) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    longest, plain = [], membership.listed

    def listed(bridge, items, title):
        longest.append(items.agg(F.max(F.octet_length(F.col(title).cast("string")))).first()[0])
        return plain(bridge, items, title)

    monkeypatch.setattr(membership, "listed", listed)
    got = catalog.QUERIES["c20_label_list"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("quality", 20, ",".join(f"d{k}" for k in range(1, 40, 2)), 20)]
    assert longest[0] < 10


def test_tables_without_a_header(spark):
    rows_ = [(1, '[[0, 9, [["h"]]], [9, 20, [["x"]]]]'), (2, "[[0, 9]]"), (3, "[]"), (4, "oops"), (5, '[[1], [0, 9, [["late"]]]]'), (6, None), (7, '[[0, 9, [["h"]]]]')]
    df = spark.createDataFrame(rows_, "table_id int, payload string")
    assert sorted(map(tuple, payloads.table_errors(df).collect())) == [(2, "no header"), (3, "no header"), (4, "not a table"), (5, "no header"), (6, "not a table")]
    assert [tuple(r) for r in payloads.cells(df).collect()] == [(1, 1, 0, "h", "x")]


def test_chained_names_of_the_query(spark):
    got = sorted(map(tuple, catalog.QUERIES["e8_chained_names"](spark, SF).select("folder", "id", "title", "ext", "file").collect()))
    for folder in {g[0] for g in got}:
        own = sorted((g for g in got if g[0] == folder), key=lambda g: g[1])
        assert [g[4] for g in own] == list(taken_one_by_one((safe(g[2]), g[3]) for g in own))


def test_redaction_against_plain_patterns(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["message"] for r in catalog.QUERIES["h15_redacted"](spark, SF).collect()}
    for k, t in docs.items():
        t = f"/home/jo.doe/x {t}"
        for pattern, to in (*text.SECRETS, *text.PATHS):
            t = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), t, flags=re.ASCII)
        t = " ".join(t.split())
        assert got[k] == (t if len(t) <= 300 else t[:300] + "…")


def test_secrets_of_every_kind(spark):
    raw = ['SNlM0e":"abc" FdrFJe: \'x\'', "SNlM0e&quot;:&quot;abc&quot; f.sid=-12&b", "AF1_QpN-abc_d at=x", '__Host-GAPS="1:a"; __Secure-1PSID=z', "tok ya29.abcdefghij and AIzaSyA12345678", "Set-Cookie: a=b\nno", "nothing here"]
    assert one(spark, text.scrubbed, *raw) == ['SNlM0e":"***" FdrFJe: \'***\'', "SNlM0e&quot;:&quot;***&quot; f.sid=***&b", "AF1_QpN-*** at=***", '__Host-GAPS="***"; __Secure-1PSID=***', "tok ya29.*** and AIza***", "Set-Cookie: ***\nno", "nothing here"]


def test_near_misses_against_all_pairs(spark):
    titles = ["Alpha Report", "alpha  report — two", "Beta", "beta-max", "", None, "Gamma Ray", "gamma rays", "Delta", "ALPHA"]
    items = [(f"i{k}", t, k) for k, t in enumerate(titles)]
    tokens = ["alpha", "Beta max", "gama ray", "zzz", "  "]
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t).translate(str.maketrans(dict.fromkeys(text.DASHES, "-"))).split()).casefold()
    want = set()
    for token in tokens:
        q = fold(token)
        if not q:
            continue
        named = [(i, t, pos, fold(t)) for i, t, pos in items if t]
        begun = [x for x in named if x[3].startswith(q)]
        scored = sorted(((difflib.SequenceMatcher(None, x[3], q).ratio(), x[3], -x[2], x) for x in named if x not in begun), reverse=True)
        best = [x for s, *_, x in scored if s >= 0.6]
        want |= {(token, k, x[0]) for k, x in enumerate((begun + best)[:3], 1)}
    got = resolve.near_misses(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(items, "id string, title string, pos int"))
    assert {(r["token"], r["rank"], r["id"]) for r in got.collect()} == want


def folded(t):
    return " ".join(unicodedata.normalize("NFKC", t).translate(str.maketrans(dict.fromkeys(text.DASHES, "-"))).split()).casefold()


def test_similar_titles_of_ten_thousand(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    titles = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(10_000)})
    tokens = [t[:-1] + "x" for t in titles[:15]] + [titles[20][::-1], "zq", "e", titles[30] + titles[31]]
    got = {(r["_t"], r["_f"], round(r["_s"], 9)) for r in resolve.similar(spark.createDataFrame([(t,) for t in tokens], "_t string"), spark.createDataFrame([(t,) for t in titles], "_f string").repartition(4)).collect()}
    want = set()
    for t in tokens:
        s = difflib.SequenceMatcher()
        s.set_seq2(t)
        for f in titles:
            s.set_seq1(f)
            if s.real_quick_ratio() >= 0.6 and s.quick_ratio() >= 0.6 and s.ratio() >= 0.6:
                want.add((t, f, round(s.ratio(), 9)))
    assert got == want and len(want) > 15


def test_nearest_are_the_best_of_all_pairs(spark):
    rng = random.Random(5)
    names_ = sorted({"".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    tokens = sorted({"".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 9))) + rng.choice(["", "!"]) for _ in range(60)})
    t, n = spark.createDataFrame([(x,) for x in tokens], "_t string"), spark.createDataFrame([(x,) for x in names_], "_f string")
    every = {(x, y): r for x in tokens for y in names_ if (r := difflib.SequenceMatcher(None, y, x).ratio()) >= 0.6}
    for limit in (1, 3):
        got = {(r["_t"], r["_f"]): r["_s"] for r in resolve.nearest(t, n, limit).collect()}
        assert got.items() <= every.items()
        for x in tokens:
            best = lambda of: sorted(((s, f) for (y, f), s in of.items() if y == x), reverse=True)[:limit]  # noqa: B023, E731
            assert best(got) == best(every)


def test_close_names_are_not_held_against_all(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(resolve, "similar", fail)
    items = spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "concat('large ring ', id) AS title", "id AS pos")
    tokens = spark.range(3000).selectExpr("IF(id % 2 = 0, upper(concat('large ring ', id)), concat('large ring ', id, '!')) AS token")
    got = {r["token"]: r["id"] for r in resolve.near_misses(tokens, items, 1).collect()}
    assert got == {f"LARGE RING {k}" if k % 2 == 0 else f"large ring {k}!": str(k) for k in range(3000)}


def test_labels_nothing_fits_get_near_names(spark):
    labels = spark.createDataFrame([("1a", "Project Alpha"), ("2b", "project beta"), ("3c", "Other"), ("4d", "Project Alpha")], "id string, name string")
    got = {r["token"]: (r["verdict"], r["near_ids"]) for r in resolve.labelled_or_near(spark.createDataFrame([("projct alpha",), ("1A",), ("OTHER",), ("qqqq",), ("project",)], "token string"), labels).collect()}
    assert got == {"projct alpha": ("none", ["1a", "4d", "2b"]), "1A": ("id", None), "OTHER": ("none", ["3c"]), "qqqq": ("none", None), "project": ("none", ["1a", "2b", "4d"])}


def test_beginnings_against_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("abé😀") for _ in range(rng.randint(0, most)))
    tokens, items = sorted({word(8) for _ in range(150)}), [(k, word(10)) for k in range(300)] + [(300, None)]
    spark.createDataFrame([(t,) for t in [*tokens, None]], "token string").write.parquet(f"{tmp_path}/tokens")
    spark.createDataFrame(items, "id int, name string").write.parquet(f"{tmp_path}/items")
    got = resolve.begun(spark.read.parquet(f"{tmp_path}/tokens"), spark.read.parquet(f"{tmp_path}/items"), "token", "name")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # rows made of names are many more than names
    pairs = [(r["token"], r["id"]) for r in got.collect()]
    assert sorted(pairs) == sorted((t, i) for t in tokens for i, n in items if t and n and n.startswith(t)) and len(pairs) > 500


def test_labels_ids_before_names(spark):
    items = spark.createDataFrame([("abc1", "x"), ("abc2", "abc1"), ("ff", "abc"), ("ffe", "Name"), ("q", "Name"), ("r", "one")], "id string, name string")
    tokens = ["ABC1", "abc", "ff", "Name", "name", "one", "r", "zz", ""]
    got = {r["token"]: (r["verdict"], r["id"]) for r in resolve.by_label(spark.createDataFrame([(t,) for t in tokens], "token string"), items).collect()}
    assert got == {"ABC1": ("id", "abc1"), "abc": ("ambiguous_id", None), "ff": ("id", "ff"), "Name": ("ambiguous_name", None), "name": ("none", None), "one": ("name", "r"), "r": ("id", "r"), "zz": ("none", None), "": ("none", None)}


def test_a_gate_fails_over_a_tenth(spark):
    df = spark.range(100).withColumn("bad", F.col("id") < 10)
    assert gates.gated(df, F.col("bad")).count() == 90
    with pytest.raises(Exception, match="malformed rows"):
        gates.gated(spark.range(100), F.col("id") < 11).count()
    assert gates.gated(df.limit(0), F.col("bad")).count() == 0


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, title string")
    kept = gates.cleaned(df, lambda t: t.withColumn("reason", F.when(F.col("title") == "b", "mine")))
    seen, watch = gates.watched(kept, "progress", n=F.count("*"))
    assert [r["id"] for r in seen.collect()] == [1] and watch.get["n"] == 1


def test_envelope_problems(spark):
    df = spark.createDataFrame([(g, k) for g in range(6) for k in range(5)], "g int, k int")
    limit = F.expr("CASE g WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0 WHEN 3 THEN 1001 WHEN 4 THEN 2 ELSE 1000 END")
    got = {r["g"]: tuple(r)[1:] for r in rows.envelope(df, limit, F.expr("CASE g WHEN 1 THEN 2 WHEN 4 THEN 4 ELSE 0 END"), ["g"], ["k"]).collect()}
    assert got == {0: (5, 5, None, None), 1: (5, 0, None, "offset requires limit"), 2: (5, 0, None, "limit out of range"), 3: (5, 0, None, "limit out of range"), 4: (5, 1, False, None), 5: (5, 5, False, None)}


def test_places_are_whole_and_ordered(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 7 != 0, F.pmod(F.hash("id"), F.lit(50))).alias("t"), "id").repartition(9)
    got = sorted(rows.placed(df, [F.col("t").asc_nulls_last(), "id"]).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 1001))
    assert [(r["t"], r["id"]) for r in got] == sorted(((r["t"], r["id"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_pdf_titles(spark):
    given = ["https://h/papers/Some%20Paper.pdf?v=2#p3", "HTTPS://h/a.PDF/", "https://h/download?file=x.pdf", "https://h/", "https://h/..pdf", "https://h/%2Fa%2F.pdf", "ftp://h/a.pdf", "https://h/a%00b.pdf", "https://h/1%2B1+2.pdf", "https://h/" + "x" * 300 + ".pdf", None, "https://h/%zz.pdf"]
    assert one(spark, urls.pdf_title, *given) == ["Some Paper", "a", None, None, ".", None, None, "ab", "1+1+2", "x" * 200, None, "%zz"][:4] + [None] + [None, None, "ab", "1+1+2", "x" * 200, None, "%zz"]


def test_lists_and_payload_shapes(spark):
    assert one(spark, lambda c: F.to_json(F.array(F.array_join(variants.as_list(c), "|"))), '["a", "b c", 5]', "[a, b]", "[a,b", "a, ,b,", "  ", None, "[]") == ['["a|b c|5"]', '["a|b"]', '["a|b"]', '["a|b"]', '[""]', "[null]", '[""]']
    assert one(spark, variants.freshness, "true", "false", "[]", "[[null,true]]", '[[null,"true"]]', "[[1]]", "5", "null", None, "{") == ["fresh", "stale", "fresh", "fresh", *["drift"] * 6]
    assert one(spark, variants.tree_title, '{"name":"a"}', '{"name":""}', '{"name":1}', "[]", None) == ["a", *["Mind Map"] * 4]
    assert one(spark, lambda c: variants.failure_text(F.lit(" "), c), '[null, " x "]', '[[1, "y"], "z"]', '[[["deep"]]]', '"s"', None) == ["x", "y", None, None, None]
    assert payloads.texts_in(["a", "", ["b", {"k": "v"}, ["c"]], 5, None]) == ["a", "b", "c"]
    deep = "x"
    for _ in range(101):
        deep = [deep]
    assert payloads.texts_in(deep) == [] and payloads.texts_in(deep[0]) == ["x"]


def test_scalars_at_their_edges(spark):
    assert one(spark, codes.language, "fr", "FR", "fr_CA", None) == ["Français", None, "Français (Canada)", None]
    assert one(spark, lambda c: codes.rate_limited(F.lit("removed"), F.lit(None).cast("string"), c), "Quota!", "x", None) == [True, False, False]
    hosts = ["::1", "127.1", "0x7f000001", "8.8.8.8", "example.org", "::ffff:192.168.0.1", "", None, "fe80::1", "1.2.3.4.5"]
    assert one(spark, urls.host_class, *hosts) == ["internal", "internal", "internal", "public", None, "internal", None, None, "internal", None]


def test_addresses_against_the_standard_library(spark):
    import ipaddress
    import socket

    rng = random.Random(6)
    quads = [str(ipaddress.ip_address(rng.choice([rng.getrandbits(32), 0x0A000000 | rng.getrandbits(20), 0xC0000000 | rng.getrandbits(10), 0xAC100000 | rng.getrandbits(21), 0xC6120000 | rng.getrandbits(18)]))) for _ in range(300)]
    sixes = [rng.choice([0x2001 << 112, 0xFC << 120, 0xFE80 << 112, 0, 0xFFFF << 32, 0x2606 << 112, 0x20010DB8 << 96, 0x20010003 << 96, 0x64FF9B0001 << 88]) | rng.getrandbits(rng.choice([1, 16, 80])) for _ in range(300)]
    odd = ["0x7f.1", "0177.0.0.1", "256.1.1.1", "1.256", "0", "00", "09", "0x", "4294967295", "4294967296", "1.2.3.4.5", "1..2", ".1", "a.b", "1.16777216", "1.2.65536", "0x100000000", "99999999999999999999999", "0000000000000000000000000012", "::", ":::", "1::2::3", "::1.2.3.4", "::ffff:01.2.3.4", "::ffff:1.2.3", "12345::", "g::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", ":1", "fe80", "2001:1::1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "100.64.0.1"]
    hosts = quads + [str(ipaddress.IPv6Address(x)) for x in sixes] + [ipaddress.IPv6Address(x).exploded for x in sixes[:50]] + odd

    def one(h):
        try:
            ip = ipaddress.ip_address(h)
        except ValueError:
            try:
                ip = ipaddress.ip_address(socket.inet_aton(h)) if h != "0x" else None
            except OSError:
                ip = None
        if ip is None:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return "internal" if ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_unspecified else "public"

    assert list(zip(hosts, one_by_one(spark, urls.host_class, hosts), strict=True)) == [(h, one(h)) for h in hosts]


def one_by_one(spark, column, values):
    return one(spark, column, *values)


def test_urls_that_lead_inside(spark):
    given = ["http://127.1/", "http://2130706433/", "http://[::1]:80/x", "http://[::ffff:10.1.2.3]", "https://a.LocalHost.", "http://localhost.localdomain:1/", "http://me:pw@[fe80::1%25eth0]/", "HTTP://8.8.8.8", "file:///etc/passwd", "http:///x", "http://[2606:4700::1]/", "http://xlocalhost/", "http://./", None]
    want = ["private", "private", "private", "private", "localhost", "localhost", "private", None, "scheme", "host", None, None, "host", None]
    assert one(spark, urls.internal_reason, *given) == want
    assert one(spark, lambda u: urls.internal_reason(u, allow_internal=True), *given) == [w if w in ("scheme", "host") else None for w in want]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h2>Hi <b>you</b></h2><p>a_b</p>", "## Hi **you**\n\na\\_b"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>x<br>y</td><td>p|q</td></tr></table>", "| A | B |\n| --- | --- |\n| x<br>y | p\\|q |"),
        ("<p>so $a_1 * b_2$ and c_d</p>", "so $a_1 * b_2$ and c\\_d"),
        ("<ul><li>one</li><li>two</li></ul><ol><li>x</li></ol>", "- one\n- two\n\n1. x"),
        ('<p><a href="http://x/">go</a> &amp; <img src="i.png" alt="pic"></p><script>no()</script>', "[go](http://x/) & ![pic](i.png)"),
        ("<p>unclosed <b>bold<p>next", "unclosed **bold\n\nnext"),
        ("", ""),
    ],
)
def test_markdown(html, want):
    assert markdown.markdown(html) == want


def test_markdown_sources_are_not_escaped():
    assert markdown.markdown("<p># a_b *c*</p>", 8) == "# a_b *c*" and markdown.markdown("<p>a_b</p>", 5) == "a\\_b" and markdown.markdown(None) is None


def test_markdown_of_cut_entities_against_its_sql(spark, tmp_path):
    pages = [(k, "u", h) for k, h in enumerate(["<h1>a &amp;&amp</h1><p>b</p>", "<p>x &lt y &gt; &quot z &copy 1 &middot</p>", "<p>&am &l &ampx &amplt; &amp;lt &amp;lt;</p>", '<a href="/b">R&amp</a>'])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["markdown"] for r in catalog.QUERIES["a8_markdown"](spark, str(tmp_path)).collect()}
    want = dict(duckdb.connect().execute(f"WITH pages AS (SELECT * FROM '{tmp_path}/pages.parquet/*.parquet') {catalog.ORACLES['a8_markdown']}").fetchall())
    assert got == want and got[0] == "# a &&\n\nb"


def test_csv_lines(spark):
    df = spark.createDataFrame([(1, '[[0, 9, [["a\\"b"], ["c"]]], [9, 20, [["x"], ["y,z"]]]]'), (2, "[[0]]"), (3, "oops")], "table_id int, payload string")
    got = sorted(map(tuple, payloads.csv_lines(payloads.cells(df)).collect()))
    assert got == [(1, 0, '"a""b",c'), (1, 1, 'x,"y,z"')]


def test_files_of_pieces(spark, tmp_path):
    uri = f"file://{tmp_path}/out"
    pieces = [("a/b.txt", k, f"{k}é\n") for k in range(2000)] + [("c.csv", 2, None), ("c.csv", 1, "x\r\n"), (None, 0, "lost"), ("empty", 0, "")]
    files.write_files(spark.createDataFrame(pieces, "path string, place int, text string").repartition(7), uri, bom=True)
    read = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}
    bom = b"\xef\xbb\xbf"
    assert read == {"a/b.txt": bom + "".join(f"{k}é\n" for k in range(2000)).encode(), "c.csv": bom + b"x\r\n", "empty": bom}
    fails = spark.range(4).select(F.lit("bad").alias("path"), "id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("x").alias("text")).withColumnRenamed("id", "place")
    with pytest.raises(Exception, match="no"):
        files.write_files(fails, uri)
    assert not (tmp_path / "out" / "bad").exists()
    again = spark.createDataFrame([("c.csv", 0, "new")], "path string, place int, text string")
    files.write_files(again, uri)
    assert (tmp_path / "out" / "c.csv").read_bytes() == b"new"


def test_numbers_within_few_keys(spark):
    pairs = [(k % 3 or None, (k * 7919) % 1000) for k in range(1000)]
    got = rows.numbered(spark.createDataFrame(pairs, "k long, v long"), ["k"], ["v"], "n").collect()
    want = {(k, v): n for key in {k for k, _ in pairs} for n, (k, v) in enumerate(sorted(p for p in pairs if p[0] == key), 1)}
    assert {(r["k"], r["v"]): r["n"] for r in got} == want and len(got) == len(pairs)
    none = rows.numbered(spark.createDataFrame([], "k long, v long"), ["k"], ["v"], "n")
    assert none.count() == 0
    first = rows.selected(spark.createDataFrame([(None, 2), (None, 1), (1, 5)], "k long, v long"), ["k"], [F.col("v")])
    assert sorted(map(tuple, first.select(F.coalesce("k", F.lit(0)), "v", "n_matches", "reason").collect())) == [(0, 1, 2, "first of 2"), (1, 5, 1, "only one")]


def test_report_keys_leave_out_what_is_an_image_anywhere(spark):
    rows = [(1, "see http://a.org/x and ![p](http://b.org/y)"), (1, "from http://b.org/y."), (1, None), (1, ""), (2, "http://b.org/y http://b.org/y"), (None, "http://c.org/z"), (3, "![p](http://a.org/x)")]
    got = {tuple(r) for r in citations.report_keys(spark.createDataFrame(rows, "nb int, report string")).collect()}
    assert got == {(1, "http://a.org/x"), (2, "http://b.org/y"), (None, "http://c.org/z")}
    assert citations.report_keys(spark.createDataFrame([], "nb int, report string")).count() == 0
