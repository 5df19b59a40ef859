"""Repeated passages, exactly: a depth-limited most-significant-digit radix sort of all suffixes.

Suffixes are told apart only through ``threshold`` bytes, digit by digit, and a group that shrinks to one member is
done; what is still together at full depth are the strings that occur again. Sorting every suffix of a corpus would move
many times its bytes, so suffixes that share their first digit are handled as one: of the strings of ``threshold``
bytes around a place, all those whose least-hashed ``digit`` bytes (their *anchor*) are the same form a run, and the
anchor is the digit by which the whole run is sorted first. Equal strings have equal anchors, so nothing is lost.

Pass 1 sorts runs by anchor and drops anchors that occur once. Pass 2 sorts the rest by their whole run: equal runs are
repeated throughout. Pass 3 takes the anchors whose runs differ (where copies begin, end or were edited), cuts each
distinct run into blocks of ``step`` strings and sorts these by their *core*, the bytes all of a block's strings share; a core
that occurs once ends its block. Pass 4 sorts the rest by the bytes around the core, first whole blocks, then, where blocks
differ, string by string at full depth. A string is counted wherever it starts, in any document; matches never
cross documents. Anchors, runs and cores travel as 64-bit hashes: 64 bits tell anchors apart, and 64 more the runs and cores
under one anchor, so what shares an anchor rests on 64 bits; the bytes around a core travel as they are.

An anchor or core may hold a third of all rows (a line that a text repeats, a group of copies). Its rows are dealt over
several tasks by a random share; each tallies its own, and tallies, at most one a share, are added up before rows are told whether they recur.

Edge cases: a null or empty text, or one shorter than the threshold, has no repeats; repeated rows repeat each other;
ids play no part, so repeated or null ones are fine: equal texts lose the same bytes, so what is found is kept once per
text, named by 96 bits of two hash functions; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, bounded_batches, groups_of, stored, working

THRESHOLD = 200
DIGIT = 40
BASE = 0x9E3779B97F4A7C15
STEP = 16
#: An anchor or core of more rows is dealt over several tasks, one for so many; what they tally is then put together.
SPREAD = 4096
#: Texts are scanned through buffers of so many bytes; some ten arrays of 8 bytes a place are held for one.
BUFFER_BYTES = 1 << 18
RUN = "k long, h int, start int, n int, lead int, anchor long, run long"


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(n, np.uint64(base))
            x[0] = 1
            both.append(np.cumprod(x))
    return both[0], both[1]


CACHES["suffix_dedup"] = _powers.cache_clear


def runs(data: np.ndarray, bounds: np.ndarray, threshold: int = THRESHOLD, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """Of texts side by side in data: place, number of strings, anchor's distance and anchor of each run. bounds: text k is [bounds[k], bounds[k + 1])."""
    n, w = len(data), threshold - digit + 1
    if n < threshold:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    up, down = _powers(max(BUFFER_BYTES * 2, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[digit:] - sums[:-digit]) * down[: n - digit + 1]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    m = len(h)
    value = np.full(-(-m // w) * w, np.iinfo(np.uint64).max)
    value[:m] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    rows = value.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - threshold + 1], ahead[w - 1 : w - 1 + n - threshold + 1])
    none = np.iinfo(np.uint64).max
    for e in bounds[1:-1]:  # strings that would cross into the next text
        least[max(0, e - threshold + 1) : e] = none
    edge = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    at, length = edge[:-1], np.diff(edge)
    held = least[at] != none
    at, length = at[held], length[held]
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, length, place - at, h[place]


def _runs_of(threshold: int, digit: int):
    def run(batches):
        import xxhash

        working("suffix_dedup")
        h3 = xxhash.xxh3_64_intdigest
        for batch in batches:
            for a, b in groups_of(batch.column(2), BUFFER_BYTES):
                texts = [t or b"" for t in batch.column(2).slice(a, b - a).to_pylist()]
                joined = b"".join(texts)
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                for lo in range(0, max(1, len(joined) - threshold + 1), BUFFER_BYTES * 2):  # a very long text: by parts whose strings don't overlap
                    hi = min(len(joined), lo + BUFFER_BYTES * 2 + threshold - 1)
                    part = np.frombuffer(joined, np.uint8)[lo:hi]
                    inner = bounds[(bounds > lo) & (bounds < hi)]
                    at, n, lead, anchor = runs(part, np.concatenate([[lo], inner, [hi]]) - lo, threshold, digit)
                    at = at + lo
                    of = np.searchsorted(bounds, at, "right") - 1
                    view = memoryview(joined)
                    own = np.fromiter((h3(view[x:y]) for x, y in zip(at.tolist(), (at + n + threshold - 1).tolist(), strict=True)), np.uint64, len(at))
                    who = pa.array(of + a)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(who), batch.column(1).take(who), pa.array((at - bounds[of]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64))],
                        ["k", "h", "start", "n", "lead", "anchor", "run"],
                    )

    return run


BLOCK = "k long, h int, start int, n int, anchor long, place int, core long, left binary, right binary, weight int"


def _blocks_of(threshold: int, step: int):
    """Pass 3: the blocks of the listed runs, on a grid from the anchor. weight: 2 where the run itself occurs again."""

    def run(batches):
        import xxhash
        import zstandard

        working("suffix_dedup")
        h3, unpack = xxhash.xxh3_64_intdigest, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            who, starts, counts, anchors, places, cores, lefts, rights, weights = ([] for _ in range(9))
            for k in range(batch.num_rows):  # a document's runs at a time: a batch's are a million objects
                text = unpack(batch.column(2)[k].as_py())
                for start, n, lead, anchor, weight in zip(*(x.to_pylist() for x in batch.column(3)[k].values.flatten()), strict=True):
                    first = -lead
                    last = first + n - 1
                    for place in range(first // step, last // step + 1):
                        a, b = max(first, place * step), min(last, place * step + step - 1)
                        base, at = start + place * step - first, start + a - first
                        who.append(k)
                        starts.append(at)
                        counts.append(b - a + 1)
                        anchors.append(anchor)
                        places.append(place)
                        cores.append(h3(text[base + step - 1 : base + threshold]))
                        lefts.append(text[at : base + step - 1])
                        rights.append(text[base + threshold : start + b - first + threshold])
                        weights.append(weight)
                if len(who) > 20_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(who, pa.int64())), batch.column(1).take(pa.array(who, pa.int64())), pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array(anchors, pa.int64()),
                            pa.array(places, pa.int32()), pa.array(np.array(cores, np.uint64).view(np.int64)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(weights, pa.int32()),
                        ],
                        ["k", "h", "start", "n", "anchor", "place", "core", "left", "right", "weight"],
                    )
                    who, starts, counts, anchors, places, cores, lefts, rights, weights = ([] for _ in range(9))

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are dealt out again. docs as from keyed()."""

    @F.pandas_udf("binary")
    def pack(texts):
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        return texts.map(lambda t: c.compress(t or b""))

    return docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("packed", pack("text")).drop("text")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k and h (96 bits that name the text), text (binary) and doc_id."""
    text = F.col(text_col).cast("binary")
    return bounded_batches(docs).select(F.xxhash64(text).alias("k"), F.hash(text).alias("h"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def _salt(parts: str) -> Column:
    """A random one of ``parts`` shares for a row of a key that is dealt over several tasks, -1 for one of a key that one task can hold; null parts stay null.

    Only drawn in a stage that writes its table, so that all who read the table see one draw.
    """
    return F.when(F.col(parts) > 1, F.floor(F.rand() * F.col(parts)).cast("int")).when(F.col(parts) == 1, -1).alias("salt")


def _recurring(tallies: DataFrame, key: list[str]) -> DataFrame:
    """tallies: key, salt, total. The key and salts of all keys whose totals sum to more than one."""
    hot = tallies.where("salt >= 0").select(*key, "salt", "total")
    several = hot.groupBy(*key).agg(F.sum("total").alias("all")).where("all > 1").select(*key)
    return tallies.where("salt < 0 AND total > 1").select(*key, "salt").unionByName(hot.drop("total").join(several, key))


def _once(tallies: DataFrame, key: list[str]) -> DataFrame:
    """tallies: key, salt, total, r. One row of each key: its whole total, its first r, and that one's salt."""
    hot = tallies.where("salt >= 0").groupBy(*key).agg(F.sum("total").alias("total"), F.min(F.struct("r", "salt")).alias("f"))
    return tallies.where("salt < 0").select(*key, "salt", "total", "r").unionByName(hot.select(*key, "f.salt", "total", "f.r"))


def repeats(rows: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, step: int = STEP, spread: int = SPREAD) -> DataFrame:
    """rows as from keyed(). k, h, spans (array<long>, start << 32 | end): what to remove from each text, not yet merged."""
    rows = rows.select("k", "h", "text")
    span = lambda start, n: F.shiftleft(start.cast("long"), 32).bitwiseOR((start + n + (threshold - 1)).cast("long")).alias("span")
    parts = F.ceil(F.col("total") / spread).cast("int")
    all_runs = rows.mapInArrow(_runs_of(threshold, digit), RUN)
    # Pass 1. The runs are made twice, which costs less than keeping those that turn out to be alone. parts: of anchors whose runs differ.
    anchors = all_runs.groupBy("anchor").agg(F.count("*").alias("total"), (F.min("run") != F.max("run")).alias("mixed")).where("total > 1").select("anchor", F.when(F.col("mixed"), parts).alias("parts"))
    anchors = stored(anchors, "anchors")  # else the join keeps the aggregate's partitions, and a hot anchor's can't be split
    tied = stored(all_runs.join(anchors, "anchor").select(*all_runs.columns, _salt("parts")), "tied")
    whole = tied.where("salt IS NULL").select("k", "h", span(F.col("start"), F.col("n")))
    # Pass 2: runs under an anchor whose runs differ, once each.
    run = ["anchor", "run"]
    differ = stored(tied.where("salt IS NOT NULL").groupBy(*run, "salt").agg(F.count("*").alias("total"), F.min(F.struct("k", "h", "start", "n", "lead")).alias("r")), "differ")
    same = tied.where("salt IS NOT NULL").join(_recurring(differ, run), [*run, "salt"]).select("k", "h", span(F.col("start"), F.col("n")))
    # Pass 3.
    wanted = _once(differ, run).select("r.*", "anchor", F.when(F.col("total") > 1, 2).otherwise(1).alias("weight"))
    per_doc = wanted.groupBy("k", "h").agg(F.collect_list(F.struct("start", "n", "lead", "anchor", "weight")).alias("runs"))
    held = _packed(rows).dropDuplicates(["k", "h"]).join(per_doc, ["k", "h"]).select("k", "h", "packed", "runs")
    blocks = held.mapInArrow(_blocks_of(threshold, step), BLOCK)
    core, around = ["anchor", "place", "core"], ["left", "right"]
    blocks = stored(blocks, "blocks")
    cores = blocks.groupBy(*core).agg(F.sum("weight").alias("total")).where("total > 1").select(*core, parts.alias("parts"))
    cores = stored(cores, "shared-cores")
    shared = stored(blocks.join(cores, core).select(*blocks.columns, _salt("parts")), "cores")
    # Pass 4.
    distinct = stored(shared.groupBy(*core, *around, "salt").agg(F.sum("weight").alias("total"), F.min(F.struct("k", "h", "start", "n")).alias("r")), "distinct")
    equal = shared.where("weight = 1").join(_recurring(distinct, core + around), [*core, *around, "salt"]).select("k", "h", span(F.col("start"), F.col("n")))
    lead = F.lit(step - 1) - F.octet_length("left")  # of the block's first string
    strings = _once(distinct, core + around).withColumn("lead", lead).select(*core, "salt", "total", "r", "lead", "left", "right", F.explode(F.sequence(F.col("lead"), F.col("lead") + F.col("r.n") - 1)).alias("j"))
    strings = strings.select(*core, "salt", "j", F.expr("concat(substring(left, j - lead + 1, octet_length(left)), substring(right, 1, j))").alias("rest"), "total", "r", (F.col("r.start") + F.col("j") - F.col("lead")).alias("start"))
    key = [*core, "j", "rest"]
    twice = _recurring(strings.groupBy(*key, "salt").agg(F.sum("total").alias("total")), key)
    edges = strings.where("total = 1").join(twice, [*key, "salt"]).select("r.k", "r.h", span(F.col("start"), F.lit(1)))
    return whole.unionByName(same).unionByName(equal).unionByName(edges).groupBy("k", "h").agg(F.collect_set("span").alias("spans"))


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of what packed spans cover; touching ones are one run."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.concatenate([new[1:] - 1, [len(spans) - 1]])]


def widened(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs that cut no UTF-8 character."""
    a, b = start.tolist(), end.tolist()
    for k in range(len(a)):
        while a[k] and 128 <= text[a[k]] < 192:
            a[k] -= 1
        while b[k] < len(text) and 128 <= text[b[k]] < 192:
            b[k] += 1
    return a, b


def _cut(whole_chars: bool):
    def run(batches):
        import zstandard

        working("suffix_dedup")
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept, starts, ends = [], [], []
            for packed, spans in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = unpack(packed)
                a, b = [], []
                if spans.is_valid and len(spans.values):
                    a, b = merged(spans.values.to_numpy())
                    a, b = widened(text, a, b) if whole_chars else (a.tolist(), b.tolist())
                kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)))
                starts.append(a)
                ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "kept", "starts", "ends"])

    return run


def removed(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, whole_chars: bool = False, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, kept (binary), starts and ends of the maximal removed runs, in bytes of the input."""
    rows = keyed(docs, id_col, text_col)
    spans, texts = repeats(rows, threshold, digit, spread=spread), _packed(rows)
    held = texts.join(spans, ["k", "h"], "left").select("doc_id", "n_bytes", "packed", "spans")
    return held.mapInArrow(_cut(whole_chars), "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """docs with the repeated passages gone from ``text`` (whole characters), n_chars brought up to date, other columns unchanged."""
    rows = keyed(docs)
    spans = repeats(rows, threshold, digit)

    @F.pandas_udf("string")
    def cut(texts, lists):
        out = []
        for text, own in zip(texts, lists, strict=True):
            if own is not None and len(own) and text is not None:
                b = text.encode()
                x, y = widened(b, *merged(np.asarray(own, np.int64)))
                text = b"".join(b[p:q] for p, q in zip([0, *y], [*x, len(b)], strict=True)).decode()
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    held = docs.withColumns({"__k": F.xxhash64(F.col("text").cast("binary")), "__h": F.hash(F.col("text").cast("binary"))})
    own = spans.select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    got = held.join(own, ["__k", "__h"], "left")
    got = got.withColumn("text", cut("text", "__spans"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)
