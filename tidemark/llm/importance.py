"""Target-distribution importance resampling over hashed word runs.

Texts are lower-cased in A-Z and split by an untrained ``Split`` pre-tokeniser of the tokenizers library, which gives
words with their offsets; what lies between white space is split once a worker and remembered, as words don't cross it. Runs of
words are windows over pairs of offsets in the line of words; a run's CRC-32 gives its bucket. Each document's histogram of buckets is stored once; its sum over all documents and that over the
target's texts give each bucket's gain, the gains add up to a document's weight, and Gumbel noise from a hash of its id
turns drawing in proportion to exp(weight / 1000) into taking the highest scores.

Edge cases: a null or empty text has no features and weight 0; a null id is hashed as the empty string and comes
before other ids on ties; rows that agree in id and score follow by weight, features and their place in the table;
repeated rows are drawn one by one; an empty target or table of documents gives finite gains; a table without
eligible documents draws none; extra columns are ignored. Invalid UTF-8 counts as replacement characters.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, bounded_batches, running, stored, working

#: Characters that are in no word: ASCII but digits and lower-case letters.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Characters that the library splits at once. Of chunks between white space a worker remembers so many distinct ones with their words.
PIECE, REMEMBERED, REMEMBERED_BYTES = 1 << 16, 200_000, 64

_splitter: list = []
_words: dict[bytes, tuple[bytes, ...]] = {}
CACHES["importance"] = lambda: (_splitter.clear(), _words.clear())


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to ``longest`` words in so many buckets; of documents with ``least_words`` or more, ``percent`` % are drawn."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


HOW = Resampling()


def pieces(text: str):
    """(start, piece) of about PIECE characters each that end at a gap between words; a longer word stays whole."""
    at, gap = 0, re.compile(f"[{GAP}]")
    while at < len(text):
        end = gap.search(text, at + PIECE)
        end = end.start() if end else len(text)
        yield at, text[at:end]
        at = end


def words_with_offsets(text: str):
    """(word, start, end) of every word of a lower-cased text."""
    if not _splitter:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        _splitter.append(Split(Regex(f"[{GAP}]+"), "removed"))
    for at, piece in pieces(text):
        for word, (start, end) in _splitter[0].pre_tokenize_str(piece):
            yield word, at + start, at + end


def words_of(chunks: Iterable[bytes]) -> dict[bytes, tuple[bytes, ...]]:
    """The words of each of these chunks of what lies between white space, lower-cased; those not known yet are split in one call, and offsets tell whose words they are."""
    if len(_words) > REMEMBERED:
        _words.clear()
    known = {c: _words.get(c) for c in chunks}
    new = [c for c, words in known.items() if words is None]
    if new:
        texts = [c.decode(errors="replace") for c in new]
        found: list[list[bytes]] = [[] for _ in new]
        ends = list(itertools.accumulate(len(t) + 1 for t in texts))
        at = 0
        for word, start, _ in words_with_offsets(" ".join(texts)):
            while start >= ends[at]:
                at += 1
            found[at].append(word.encode())
        for c, words in zip(new, found, strict=True):
            known[c] = (c,) if words == [c] else tuple(words)
            if len(c) <= REMEMBERED_BYTES:
                _words[c] = known[c]
    return known


def runs(text: bytes | None, longest: int = 1) -> tuple[int, Counter[bytes]]:
    """The number of words of a text, and how often each run of 1 to ``longest`` of them, joined by one space, occurs in it."""
    chunks = (text or b"").lower().split()  # of bytes: nothing but ASCII letters and white space
    often = Counter(chunks)
    words = words_of(often)
    count: Counter[bytes] = Counter()
    for chunk, n in often.items():
        for word in words[chunk]:
            count[word] = count.get(word, 0) + n
    n_words = count.total()
    if longest > 1:
        line = [word for chunk in chunks for word in words[chunk]]
        edge = np.cumsum([0, *(len(w) + 1 for w in line)])  # word i is at [edge[i], edge[i + 1] - 1) of the words' line
        joined = b" ".join(line)
        for more in range(1, min(longest, len(line))):
            count.update(joined[a:b] for a, b in zip(edge[: len(line) - more].tolist(), (edge[more + 1 :] - 1).tolist(), strict=True))
    return n_words, count


def histogram(text: bytes | None, how: Resampling) -> tuple[int, int, bytes]:
    """Words, features, and (bucket, count) of the buckets that occur, as pairs of unsigned 32-bit integers."""
    n_words, count = runs(text, how.longest)
    crcs = np.fromiter(map(zlib.crc32, count.keys()), np.uint32, len(count))
    n = np.fromiter(count.values(), np.int64, len(count))
    at, back = np.unique(crcs % np.uint32(how.buckets), return_inverse=True)
    total = np.bincount(back, n, len(at)).astype(np.int64)
    n_features = int(n.sum())
    return n_words, n_features, np.stack([at, total], 1).astype("<u4").tobytes()


def histograms(df: DataFrame, how: Resampling = HOW, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of keep, n_words, n_features and hist of every row."""

    @F.pandas_udf("n_words long, n_features long, hist binary")
    def hist(texts: pd.Series) -> pd.DataFrame:
        working("importance")
        return pd.DataFrame([histogram(t, how) for t in texts], columns=["n_words", "n_features", "hist"])

    return bounded_batches(df).select(*keep, hist(F.col(text_col).cast("binary")).alias("h")).select(*keep, "h.*")


def totals(hists: DataFrame, how: Resampling = HOW) -> np.ndarray:
    """How often each bucket occurs over all rows: so many numbers, whatever the table's size."""

    def run(pdfs):
        total = np.zeros(how.buckets, np.int64)
        for pdf in pdfs:
            pairs = np.frombuffer(b"".join(pdf["hist"]), "<u4").reshape(-1, 2)
            np.add.at(total, pairs[:, 0], pairs[:, 1])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    out = np.zeros(how.buckets, np.int64)
    for k, n in hists.select("hist").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed frequency in the target over that in the source."""
    n_s, n_t, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(n_s + b)) / (float(s + 1) * float(n_t + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: str, seed: str):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = HOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, and rank (null for those that weren't drawn) of every row of docs."""
    hists = stored(histograms(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), how, keep=("doc_id",)), "histograms")
    gain = gains(totals(hists, how), totals(histograms(target, how, text_col), how))

    @F.pandas_udf("long")
    def weight(hist: pd.Series) -> pd.Series:
        pairs = [np.frombuffer(h, "<u4").reshape(-1, 2) for h in hist]
        return pd.Series([int(gain[p[:, 0]] @ p[:, 1].astype(np.int64)) for p in pairs], dtype="int64")

    scored = hists.select("doc_id", "n_words", "n_features", weight("hist").alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise("doc_id", how.seed))
    outside = (F.col("n_words") < how.least_words).cast("int")
    # A number by place of a stored table, the same on a retry, so that no group of ties is all in one range.
    ranked = scored.select(outside.alias("outside"), (-F.col("score")).alias("lower"), "doc_id", "weight", "n_features", "score", F.monotonically_increasing_id().alias("place"), F.lit(1).cast("long").alias("one"))
    placed = running(ranked, ["outside", "lower", "doc_id", "weight", "n_features", "place"], "one", "resampling")
    quota = placed.where("outside = 0").count() * how.percent // 100
    rank = F.when((F.col("outside") == 0) & (F.col("before") < quota), F.col("before") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def sample(docs: DataFrame, target: DataFrame, how: Resampling = HOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn, all columns unchanged; their ids must be distinct."""
    drawn = resampled(docs, target, how, id_col, text_col).where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col))
    return docs.join(drawn, id_col, "left_semi").select(*docs.columns)
