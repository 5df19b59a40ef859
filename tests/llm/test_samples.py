"""Operators 11, 12 and 13 against plain models, on the smallest tables and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest


from tests.llm.test_texts import KEY, docs_and_rows
from tidemark.llm import fingerprints, importance, queries, whitening

SF = "/root/testdata/sf0.001"


def run(spark, monkeypatch, tables, query):
    monkeypatch.setattr(queries, "table", lambda s, d, name: tables.get(name) or s.read.parquet(f"{d}/{name}.parquet"))
    return query(spark, SF)


def vectors(spark, which):
    if which == "sf":
        return spark.read.parquet(f"{SF}/embeddings.parquet")
    rng = np.random.default_rng(3)
    rows = [(k, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0]).tolist()) for k in range(300)]  # the last dimension never varies
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [float("nan")] * 6), (2003, [float("inf"), 0, 0, 0, 0, 0]), (2004, [])]
    rows += [(3000 + k, [float(k), 2.0 * k * k, -1e15 * k]) for k in range(5)]  # of another length, and large
    rows += [(4000, [1.0])]  # alone: without variance
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v], 1, "clash") for k, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, deviation string").repartition(5)


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op11(spark, monkeypatch, which):
    df = vectors(spark, which)
    got = {}
    for r in run(spark, monkeypatch, {"embeddings": df}, queries.op11_embedding_whitening).collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    by_length = {}
    for r in df.collect():
        v = r["embedding"]
        if v and all(c is not None and math.isfinite(c) for c in v):
            by_length.setdefault(len(v), []).append((r["vec_id"], tuple(math.floor(64 * c) + 1_000_000 for c in v)))
    seen = 0
    for dim, rows in by_length.items():
        distinct = sorted({x for _, x in rows})
        n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
        z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in distinct])
        values, axes = np.linalg.eigh(z.T @ z / n)
        values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
        some = values > 1e-12 * values[0]
        values, axes = values[some], axes[:, some]
        signs = [None] * len(values)
        for (vec_id, x), count in Counter(rows).items():
            centred = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
            want = centred @ axes / np.sqrt(values)
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            own = got.get((vec_id, deviation if deviation < 1 << 63 else None), {})
            for j, w in enumerate(want):
                same = [r for r in own[j + 1] if r["n"] == n and abs(abs(r["whitened"]) - abs(w)) < 1e-7]
                assert len(same) == count
                seen += count
                for r in same:
                    assert r["explained"] == pytest.approx(values[j] / (z**2).sum() * n, rel=1e-9) and 0 <= r["identity_error"] < 1e-9
                    if abs(w) > 1e-3:
                        signs[j] = signs[j] or math.copysign(1, r["whitened"] * w)
                        assert signs[j] == math.copysign(1, r["whitened"] * w)
    assert seen == sum(len(x) for own in got.values() for x in own.values())


def test_op11_empty(spark):
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_subspace_on_flat_and_steep_spectra():
    rng = np.random.default_rng(5)
    for spectrum in (60 + np.arange(90) / 50, 2.0 ** -np.arange(90), np.r_[np.ones(3), np.zeros(87)], np.ones(90)):
        basis = np.linalg.qr(rng.standard_normal((90, 90)))[0]
        v = basis * spectrum @ basis.T
        axes, values, residual = whitening.subspace(lambda q: v @ q, 90, 8)
        assert values == pytest.approx(np.sort(spectrum)[::-1][:8], abs=1e-12) and residual < 1e-10
        assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12


def test_deviations_that_need_more_than_64_bits():
    model = whitening.Model(3, (0, 3), np.array([0, 1]), np.zeros(2), np.zeros((2, 0)), np.zeros(0), 0.0, 0.0, 0)
    y = np.array([[1 << 61, 1], [5, 0], [1 << 29, 1]])
    assert model.deviations(y) == [None, 15**2 + 9, (3 << 29) ** 2]


WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bucket_counts(text, longest, buckets):
    words = WORDS.findall(lowered(text))
    grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), len(grams), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def model_of_op12(rows, target, how):
    counts = [(d, *bucket_counts(t, how.longest, how.buckets)) for d, t in rows]
    s, t = Counter(), Counter()
    for *_, c in counts:
        s.update(c)
    for text in target:
        t.update(bucket_counts(text, how.longest, how.buckets)[2])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + how.buckets) / ((s[b] + 1) * (t.total() + how.buckets)))) for b in s}
    out = []
    for d, n_words, n, c in counts:
        h = int(hashlib.sha256(f"{how.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in c.items())
        out.append((d, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    drawn = sorted((r for r in out if r[4] >= how.least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    quota = len(drawn) * how.percent // 100
    rank = {}
    for k, r in enumerate(drawn[:quota]):
        rank.setdefault(r, []).append(k + 1)
    return [(*r[:4], rank[r].pop() if rank.get(r) else None) for r in out]


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op12(spark, monkeypatch, which):
    df, rows = docs_and_rows(spark, which)
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = run(spark, monkeypatch, {"documents": df}, queries.op12_importance_resampling)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(model_of_op12(rows, target, importance.HOW), key=KEY)


def test_op12_runs_of_words_and_ties(spark):
    how = importance.Resampling(longest=3, buckets=64, least_words=2, percent=40)
    rows = [(k % 7 if k % 5 else None, t) for k, t in enumerate(["B a-b c", "a b\x1cc\xa0d", "x", None, "a a a a", "Größe STRASSE ß 1a\x7fb"] * 9)]
    rows += [(1, "b a"), (2, "b a")] + [(77, "same words here")] * 40
    target = ["a b c", None, "B A", "größe"]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int").repartition(6)
    got = importance.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), how)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(model_of_op12(rows, target, how), key=KEY)
    assert importance.resampled(docs.limit(0), docs, how).collect() == []
    assert {r["rank"] for r in importance.resampled(docs, docs.limit(0), importance.HOW).collect()} == {None}  # nothing has 20 words
    kept = importance.sample(docs.where("doc_id = 77").limit(1), docs, importance.Resampling(least_words=1, percent=100))
    assert [tuple(r) for r in kept.collect()] == [(77, "same words here", 0)]


def test_split_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 7)
    text = "ab " * 9 + "longestwordofall, é" + "x" * 30 + "\U0001f600 z"
    assert [(w, text[a:b]) for w, a, b in importance.words_with_offsets(text)] == [(w, w) for w in WORDS.findall(text)]


def plain_vector(paragraph):
    """Seals and counts by lane of one paragraph."""
    data = paragraph.encode()
    seals = [int.from_bytes(hashlib.shake_128(data).digest(8 * fingerprints.SEALS)[8 * k : 8 * k + 8], "little") for k in range(fingerprints.SEALS)]
    data = data.ljust(8, b"\0") if data else data
    lanes = Counter()
    for i in range(len(data) - 7):
        h = int.from_bytes(data[i : i + 8], "little") * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 32
        at = h * 0xD6E8FEB86659FD93 % 2**64 >> 56
        lanes[at % 128] += 1 if at < 128 else -1
    return seals, lanes


def plain_print(text):
    seals, lanes = [0] * fingerprints.SEALS, Counter()
    for p in (text or "").split("\n"):
        s, c = plain_vector(p)
        seals = [(a + b) % 2**64 for a, b in zip(seals, s, strict=True)]
        for k, v in c.items():
            lanes[k] += v
    return b"".join(s.to_bytes(8, "little") for s in seals) + b"".join((lanes[k] % 2**32).to_bytes(4, "little") for k in range(128))


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op13(spark, monkeypatch, which):
    df, rows = docs_and_rows(spark, which)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = run(spark, monkeypatch, {"documents": df}, queries.op13_fingerprints).collect()
    want = []
    for k, (d, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + following[:quarter]
        own, after, near = plain_print(t), plain_print(edited), plain_print(following)
        likes = [fingerprints.likeness(own, after), fingerprints.likeness(own, near)]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.shown(own), fingerprints.shown(after), *likes))
    assert sorted(map(tuple, got), key=KEY) == sorted(want, key=KEY)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    if which == "sf":
        assert np.mean([r["near_edited"] for r in got]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in got])


def test_op13_single_empty_and_hot(spark, monkeypatch):
    schema = "doc_id long, text string, part int"
    assert fingerprints.edited(spark.createDataFrame([], schema)).collect() == []
    one = fingerprints.edited(spark.createDataFrame([(4, "abcdefgh", 1)], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    rows = [(5, "hot row\nagain")] * 300 + [(5, f"text {k}") for k in range(40)] + [(None, "n")] * 30 + [(9, None)]
    got = fingerprints.edited(spark.createDataFrame([(*r, 0) for r in rows], schema).repartition(7)).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, fingerprints.shown(plain_print(t))) for d, t in rows)
    assert sum(r["near_next"] == 1.0 for r in got) == 299 + 29  # copies follow each other, but for each group's last


def test_fingerprints_add_up(spark):
    text = "one paragraph\nanother, longer paragraph\n\nshort\nshort\nx"
    mixed = "\n".join(reversed(text.split("\n")))
    fp = fingerprints.fingerprint(text)
    assert fp == fingerprints.fingerprint(mixed) != fingerprints.fingerprint(text + "\n") and fingerprints.fingerprint(None) == fingerprints.fingerprint("")
    assert fingerprints.with_paragraphs(fp, inserted="new\none", deleted="short\nx") == fingerprints.fingerprint("one paragraph\nanother, longer paragraph\n\nshort\nnew\none")
    rows = [(k % 3 if k % 4 else None, p) for k, p in enumerate(text.split("\n") * 20)]
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc long, text string").repartition(6), keep=("doc",))
    got = {r["doc"]: bytes(r["fingerprint"]) for r in fingerprints.total(prints, ("doc",)).collect()}
    assert got == {d: fingerprints.fingerprint("\n".join(p for k, p in rows if k == d)) for d in (None, 0, 1, 2)}
    assert bytes(fingerprints.total(prints).first()["fingerprint"]) == fingerprints.fingerprint("\n".join(p for _, p in rows))


def test_long_texts_are_counted_in_steps(monkeypatch):
    text = "\n".join(f"line {k} of a long text" for k in range(50)) + "é" * 9
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "STEP", 11)
    assert fingerprints.fingerprint(text) == whole == plain_print(text)
