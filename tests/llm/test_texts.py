"""Operators 1, 2, 3, 5, 7 and 9 against plain models, on the smallest tables and on edge cases."""

import functools
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import bpe, packing, quality_classifier, quality_rules, queries, simhash, suffix_dedup, token_cache

SF = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, lang string, failures string, h string"


def edge_docs(spark):
    long = " ".join(f"w{k * 7919 % 1000}" for k in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "same words " * 30), (5, "same words " * 30), (5, "same words " * 30), (None, "null id here"),
        (6, "é" * 150 + "x"), (7, "ü" * 149 + "é" * 150 + "y"), (8, long), (9, long[5:]), (10, "A\nB\nA\nB\n \n \nÄ"), (11, "\x1c\xa0 odd \x85 space "),
        (12, "a" * 50_000), (13, "<|endoftext|> x <|startoftext|>" * 3), (14, "aaaa " * 200),
    ]
    return spark.createDataFrame([(a, b, "en", "clash", "clash") for a, b in rows], EDGE)


def docs_and_rows(spark, which):
    df = edge_docs(spark) if which == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def run(spark, monkeypatch, df, query):
    monkeypatch.setattr(queries, "table", lambda s, d, name: df if name == "documents" else s.read.parquet(f"{d}/{name}.parquet"))
    return query(spark, SF)


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op1(spark, monkeypatch, which):
    df, rows = docs_and_rows(spark, which)
    got = run(spark, monkeypatch, df, queries.op1_quality_rules)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=KEY)
    assert got == sorted(((d, *brute.op1(t)) for d, t in rows), key=KEY)


def test_ledger_policies_and_ablations(spark):
    rows = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    found = {(r["policy"], r["rule"]): r for r in quality_rules.ablations(rows).collect()}
    masks = [r["failures"] for r in rows.collect()]
    for policy, (name, bit) in itertools.product((quality_rules.POLICY, quality_rules.STRICT, quality_rules.LENIENT), quality_rules.BIT.items()):
        r = found[policy.version, name]
        rejects = lambda m: bool(m & policy.hard) or (m & policy.soft).bit_count() > policy.allowed
        assert r["n_failed"] == sum(bool(m & bit) for m in masks)
        assert r["n_rejected"] == sum(map(rejects, masks))
        assert r["n_only_this"] == sum(rejects(m) and not rejects(m & ~bit) for m in masks)
    kept = quality_rules.judged(rows).where("kept").count()
    assert quality_rules.kept_documents(spark.read.parquet(f"{SF}/documents.parquet")).count() == kept


def test_op1_on_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.judged(quality_rules.ledger(docs)).join(labels, "doc_id")
    good = got.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = got.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.95 and bad < 0.1, (good, bad)


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op2(spark, monkeypatch, which):
    lib = token_cache.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    df, rows = docs_and_rows(spark, which)
    got = sorted(map(tuple, run(spark, monkeypatch, df, queries.op2_bpe).collect()), key=KEY)
    assert got == sorted(((d, *brute.op2(lib, t)) for d, t in rows), key=KEY)


def test_tree_concatenation_is_exact(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(7)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200, 3000))) for alphabet in ("ab", "aab", "the", "étà", "日本語中", "!?.-", "01239", " ", "abcdefghijklmnopqrstuvwxyz") for _ in range(12)]
    texts += ["x" * 999 + " " + "y'll" * 400 + "<|endoftext|>" * 3 + "z" * 700 + "  \n " * 300, " " * 900 + "q" * 900, "ab1!" * 800]
    lib = token_cache.tokenizer(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, path, piece=37), path).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded"] == texts[r["doc_id"]]
    both = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in bpe.encode(df, path, piece=37, decoded=True).collect()}
    assert both == {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(df, path), path).collect()}


def test_joins_at_any_cut_are_exact():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib, rng = token_cache.tokenizer(path), random.Random(11)
    for alphabet in ("'sltdrem v", " \n\t  a", "日本é a", "<|endoftext|>", "0123 9a", "!?.-' s", "\x85\xa0 a b", "ab"):
        for _ in range(60):
            text = "".join(rng.choice([rng.choice(alphabet), "<|endoftext|>" if rng.random() < 0.05 else "x", " the"]) for _ in range(rng.randrange(0, 250)))
            for piece in (9, 50):
                leaves = token_cache.cache(path).encode(bpe.halves(text, piece))
                assert bpe.tree(path, leaves).tolist() == lib.encode(text, add_special_tokens=False).ids, (piece, text)


def test_every_text_longer_than_a_piece_is_joined(spark, monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    long = max(texts, key=lambda t: len(t or ""))
    assert len(long) > bpe.PIECE_CHARS and len(bpe.halves(long)) > 1 and "".join(bpe.halves(long)) == long


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name, monkeypatch):
    path = queries.tokenizer_path(name)
    lib, rng, held = token_cache.tokenizer(path), random.Random(3), token_cache.ChunkCache(path, most=300)
    pieces = ["aé", ",.", "-", "É", "ß", "À×÷", "=\u0338", "<a(", "e\u0301", "A.B,c!d", "'s", "'Ll", " ", "  \n", "\x85", "\xa0", "日本", "9", "<|endoftext|>", "<|startoftext|>", "<|START", "X" * 200, "_a|b", "\u3000", "ǅ", "İ"]
    for _ in range(12):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, ""]
        for t, ids in zip(texts, held.encode(texts), strict=True):
            assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t
        assert len(held.index) <= 300


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op3(spark, monkeypatch, which):
    lib = token_cache.tokenizer(queries.tokenizer_path("word_bpe_49k.json"))
    df, rows = docs_and_rows(spark, which)
    got = run(spark, monkeypatch, df, queries.op3_best_fit_packing).collect()
    flat = [tuple(r)[:5] for r in got]
    assert sorted(flat, key=KEY) == sorted(((d, *p) for d, t in rows for p in brute.op3(lib, t)), key=KEY)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 4096) * 1.02 + 1


def test_packing_keeps_every_capacity():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 400, 900)
    for rule in ("norm", "dot"):
        cap = packing.Capacity(1000, 5, 200_000, (1.0, 1.0, 1.0), rule)
        b, at = packing.best_fit(lengths, cap)
        assert np.bincount(b, lengths).max() <= 1000 and np.bincount(b).max() <= 5 and np.bincount(b, lengths.astype(float) ** 2).max() <= 200_000


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pieces(docs, queries.tokenizer_path("word_bpe_49k.json"), with_ids=True)
    got = packing.sequences(packing.packed(rows), rows).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op5(spark, monkeypatch, which):
    df, rows = docs_and_rows(spark, which)
    got = sorted(map(tuple, run(spark, monkeypatch, df, queries.op5_suffix_dedup).collect()), key=KEY)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute.op5([t for _, t in rows]), strict=True)), key=KEY)


@pytest.mark.parametrize("spread", [suffix_dedup.SPREAD, 3])
def test_op5_on_edited_copies(spark, monkeypatch, spread):
    """Also with all but the rarest anchors and cores dealt over several tasks."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd \n") for _ in range(1200)) for _ in range(4)]
    rows = []
    for k in range(60):
        t = list(rng.choice(base)[rng.randrange(300) :])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("XYZé")
        rows.append((k, "".join(t) + rng.choice(["", "ab" * 150, "x" * 400])))
    monkeypatch.setattr(suffix_dedup, "BUFFER_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "removed", functools.partial(suffix_dedup.removed, spread=spread))
    got = sorted(map(tuple, run(spark, monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"), queries.op5_suffix_dedup).collect()))
    assert got == sorted((d, *x) for (d, _), x in zip(rows, brute.op5([t for _, t in rows]), strict=True))


def test_without_repeats_keeps_characters(spark):
    rows = [(1, "é" * 150 + "x"), (2, "ü" * 20 + "é" * 150 + "y"), (3, None)]
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")).collect()}
    assert got[1]["text"] == "x" and got[2]["text"] == "ü" * 20 + "y" and got[2]["n_chars"] == 21 and got[3]["text"] is None


def test_op7_holds_out_and_separates(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    pos, neg = got.loc[got["quality"] == 1, "score"].to_numpy(), got.loc[got["quality"] == 0, "score"].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.97


def test_op7_edges(spark):
    df = edge_docs(spark)
    labels = spark.createDataFrame([(1, 0, 0), (4, 0, 0), (8, 1, 0), (9, 1, 0), (99, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.scored(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality_classifier.scored(df, labels.limit(0)).collect()} == {0.5}


def test_score_is_the_difference_of_log_densities(spark):
    sf = "/root/testdata/sf0.001"
    feats = quality_classifier.features(spark.read.parquet(f"{sf}/documents.parquet"))
    model = quality_classifier.fit(quality_classifier.labelled(feats, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = feats.select("x", quality_classifier.score_column(model).alias("score")).toPandas()
    x, log = np.stack(rows["x"].to_numpy()), []
    for k in range(2):
        low = np.linalg.inv(model.factor[k])
        d = x - model.mean[k]
        log.append(model.prior[k] - 0.5 * np.linalg.slogdet(low @ low.T)[1] - 0.5 * (d * np.linalg.solve(low @ low.T, d.T).T).sum(1))
    assert np.allclose(rows["score"], 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), atol=1e-6)


def test_fit_against_a_plain_model(spark):
    """Means, shrunk covariances and scores, by numpy's own covariance, solver and determinant."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    feats = quality_classifier.features(docs).collect()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [(r["x"], quality[r["doc_id"]]) for r in feats if r["doc_id"] in quality and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * own[k] for k in (0, 1)) / len(y)
    density = []
    for k in (0, 1):
        cov = 0.9 * own[k] + 0.1 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(cov))
        d = np.array([r["x"] for r in feats]) - x[y == k].mean(0)
        density.append(np.log((y == k).mean()) - np.linalg.slogdet(cov)[1] / 2 - (d * np.linalg.solve(cov, d.T).T).sum(1) / 2)
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, labels).collect()}
    assert np.allclose([got[r["doc_id"]] for r in feats], want, atol=1e-6)


def test_a_worker_keeps_only_the_caches_at_work():
    import public_tokenizers

    from tidemark.llm import common

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    held = token_cache.cache(path)
    common.working("tokens")
    assert token_cache.cache(path) is held
    common.working("textstats")
    assert token_cache.cache(path) is not held


def test_classifier_is_fitted_before_the_rules_filter(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    bad = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    assert quality_classifier.kept_documents(bad, labels).count() == bad.count()  # one class alone can't be fitted on
    assert quality_classifier.kept_documents(bad, labels, docs).count() < 0.1 * bad.count()
    kept = quality_classifier.kept_documents(good, labels, docs)
    assert kept.columns == docs.columns and kept.count() > 0.95 * good.count()


@pytest.mark.parametrize("which", ["edge", "sf"])
def test_op9(spark, monkeypatch, which):
    df, rows = docs_and_rows(spark, which)
    df, rows = df.where("doc_id is not null"), [r for r in rows if r[0] is not None]
    got = sorted(map(tuple, run(spark, monkeypatch, df, queries.op9_simhash).collect()))
    assert got == sorted(brute.op9(rows))


def test_links_keep_components_in_blocks(spark):
    rng = random.Random(11)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    prints = {s for s in seeds}
    for _ in range(700):
        x = rng.choice(seeds)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")

    def groups(pairs):
        parent = {p: p for p in signed}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[root(a)] = root(b)
        return {frozenset(p for p in signed if root(p) == r) for r in {root(p) for p in signed}}

    want = groups((a, b) for i, a in enumerate(signed) for b in signed[:i] if (prints[i] ^ prints[signed.index(b)]).bit_count() <= 4)
    assert groups((r["a"], r["b"]) for r in simhash.links(df, block=40).collect()) == want
    assert groups((r["a"], r["b"]) for r in simhash.links(df).collect()) == want


def test_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([], EDGE)
    for q in queries.QUERIES.values():
        if q.__name__ in ("op1_quality_rules", "op2_bpe", "op3_best_fit_packing", "op5_suffix_dedup", "op7_quality_classifier", "op9_simhash"):
            assert run(spark, monkeypatch, df, q).count() == 0
