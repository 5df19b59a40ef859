"""Document fingerprints by a homomorphic multiset hash.

A paragraph (what lies between newlines) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo powers of two. So the order of paragraphs doesn't matter, paragraphs can be
added or taken out without the rest, and fingerprints of parts add up to that of the whole.

A vector has two kinds of lanes. SEALS lanes modulo 2**64 come from an extendable-output hash of the whole paragraph:
they decide equality. LANES lanes modulo 2**32 count the paragraph's 8-byte strings, each with a sign and at a lane that
its hash selects: their inner products estimate those of the counts themselves, so the likeness of two fingerprints is that of the
texts' multisets of strings (2ab / (aa + bb)), with an error of about 1 / sqrt(LANES).

An edited text's fingerprint is its own one's without the paragraphs that the edit touches, plus those that it brings.

Edge cases: a null or empty text is one empty paragraph; equal texts have equal fingerprints, as have texts whose
paragraphs are in another order; a null id comes before other ids; rows of one id are in the order of a hash of their texts;
rows that agree in both are told apart by their place in the scan, so the table should be one that is stored; the last
document's next is the first, and a single row's next is itself; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, groups_of, working

SEALS, LANES, STRING = 16, 128, 8
#: Bytes of a long text whose strings are counted at once.
STEP = 1 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32))


def counted(data: bytes) -> np.ndarray:
    """Lanes of the strings of STRING bytes without a newline among them."""
    lanes = np.zeros(2 * LANES, np.int64)
    for a in range(0, max(0, len(data) - STRING + 1), STEP):
        part = data[a : a + STEP + STRING - 1]
        n = len(part) - STRING + 1
        strings = np.empty(n, np.uint64)
        for k in range(min(STRING, n)):
            strings[k::STRING] = np.frombuffer(part, "<u8", len(range(k, n, STRING)), k)
        breaks = np.cumsum(np.frombuffer(part, np.uint8) == 10)
        whole = breaks[STRING - 1 :] == np.concatenate([[0], breaks[: n - 1]])
        h = strings[whole] * MIX[0]
        h ^= h >> MIX[2]
        h *= MIX[1]
        lanes += np.bincount((h >> np.uint64(56)).astype(np.intp), minlength=2 * LANES)
    return lanes[:LANES] - lanes[LANES:]


def summed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the vectors of a text's paragraphs: seals and lanes."""
    data = text.encode(errors="replace")
    paragraphs = data.split(b"\n")
    seals = np.frombuffer(b"".join([hashlib.shake_128(p).digest(8 * SEALS) for p in paragraphs]), "<u8").reshape(-1, SEALS).sum(0, dtype=np.uint64)
    short = [p for p in paragraphs if 0 < len(p) < STRING]  # such a paragraph is one string, filled up with zeros
    lanes = counted(data) + counted(b"\n".join(p.ljust(STRING, b"\0") for p in short))
    return seals, lanes.astype(np.uint32)


def packed(seals: np.ndarray, lanes: np.ndarray) -> bytes:
    return seals.astype("<u8").tobytes() + lanes.astype("<u4").tobytes()


def unpacked(fp: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fp, "<u8", SEALS), np.frombuffer(fp, "<u4", LANES, 8 * SEALS)


def fingerprint(text: str | None) -> bytes:
    return packed(*summed(text or ""))


def with_paragraphs(fp: bytes, inserted: str | None = None, deleted: str | None = None) -> bytes:
    """The fingerprint after inserting and deleting these paragraphs (texts of one or more; None: none)."""
    seals, lanes = unpacked(fp)
    if inserted is not None:
        s, c = summed(inserted)
        seals, lanes = seals + s, lanes + c
    if deleted is not None:
        s, c = summed(deleted)
        seals, lanes = seals - s, lanes - c
    return packed(seals, lanes)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints, about 0 for texts without common strings."""
    if a == b:
        return 1.0
    x, y = (unpacked(fp)[1].astype(np.int32).astype(np.float64) for fp in (a, b))  # lanes count up and down from zero
    size = float(x @ x + y @ y)
    return min(1.0, max(0.0, 2 * float(x @ y) / size)) if size else 0.0


def shown(fp: bytes) -> str:
    return base64.b64encode(fp).decode()


def edit(text: str, following: str) -> tuple[str, int]:
    """The text whose last quarter (rounded down) of code points is replaced by as many first ones of the other, or all; and where the first touched paragraph starts."""
    quarter = len(text) // 4
    kept = text[: len(text) - quarter]
    return kept + following[:quarter], kept.rfind("\n") + 1


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of keep and fingerprint (binary) of every row."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        working("fingerprints")
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    return bounded_batches(df).select(*keep, of(F.col(text_col)).alias("fingerprint"))


def total(prints: DataFrame, keys: tuple[str, ...] = (), fingerprint_col: str = "fingerprint") -> DataFrame:
    """The fingerprint of all rows of a group together: of a corpus, whatever its order and partitioning, or of documents whose paragraphs are rows.

    Words of 32 bits are added up by place before anything is sent around, so a hot group is no burden; carries come last.
    """

    @F.pandas_udf("array<long>")
    def words(fps: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(fp, "<u4").astype(np.int64) for fp in fps], dtype=object)

    @F.pandas_udf("binary")
    def carried(sums: pd.Series) -> pd.Series:
        out = []
        for own in sums:
            v = [int(x) for x in own]
            seals = [(v[2 * k] + (v[2 * k + 1] << 32)) % (1 << 64) for k in range(SEALS)]
            out.append(packed(np.array(seals, np.uint64), np.array([x % (1 << 32) for x in v[2 * SEALS :]], np.uint64).astype(np.uint32)))
        return pd.Series(out, dtype=object)

    each = prints.select(*keys, F.posexplode(words(fingerprint_col)).alias("__at", "__v"))
    sums = each.groupBy(*keys, "__at").agg(F.sum(F.col("__v").cast("decimal(28,0)")).cast("string").alias("__v"))
    places = F.transform(F.sort_array(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"])  # 160 numbers a group
    return sums.groupBy(*keys).agg(places.alias("__sums")).select(*keys, carried("__sums").alias("fingerprint"))


Key = tuple[bool, int, int, int]


def heads(keys: DataFrame, parts: int) -> list[Key]:
    """The least key of each of about so many ranges of all keys (doc_id, hash, place), sorted: a row a range reaches the driver."""
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "hash", "place")]
    least = keys.repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash", "place")).alias("k"))
    return sorted(tuple(r) for r in least.select("k.*").collect())


def with_next(docs: DataFrame, f, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """f(doc_id, text, next_text) for every row, the next one by ascending id; f gives a tuple of schema's columns but doc_id.

    Keys alone are dealt into ranges first. Then every text goes to its range once, and a range's first one to the range before as
    well, so that each range is a stream that knows what follows its last row: texts are moved once and held two at a time.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"), "text")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * keyed.rdd.getNumPartitions())
    first = heads(keyed.select("doc_id", "hash", "place"), parts)
    n = len(first)
    ends = set(first)

    @F.pandas_udf("array<struct<part:int,beyond:boolean>>")
    def ranges(doc_id: pd.Series, known: pd.Series, hashes: pd.Series, place: pd.Series) -> pd.Series:
        out = []
        for key in zip(known.tolist(), doc_id.tolist(), hashes.tolist(), place.tolist(), strict=True):
            at = bisect_right(first, key) - 1
            out.append([(at, False), ((at - 1) % n, True)] if key in ends else [(max(at, 0), False)])
        return pd.Series(out, dtype=object)

    where = ranges(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), "hash", "place")
    dealt = keyed.select("*", F.explode(where).alias("r")).select("doc_id", "hash", "place", "text", "r.part", "r.beyond")
    order = ["part", "beyond", F.col("doc_id").asc_nulls_first(), "hash", "place"]
    streams = dealt.repartition(max(n, 1), "part").sortWithinPartitions(*order).select("doc_id", "text", "part", "beyond")

    def run(pdfs):
        working("fingerprints")
        held = None
        for pdf in pdfs:
            out = []
            for doc_id, text, part, beyond in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["part"], pdf["beyond"], strict=True):
                text = text or ""
                if held is not None and held[2] == part:
                    out.append((held[0], *f(held[1], text)))
                held = None if beyond else (doc_id, text, part)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = f"doc_id long, {schema}"
    names = [c.split()[0] for c in schema.split(", ")]
    return streams.mapInPandas(run, schema)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    last: list = [None, None]  # the text that came as next is the next call's own

    def of(text: str) -> bytes:
        if last[0] != text:
            last[:] = text, fingerprint(text)
        return last[1]

    def compared(text: str, following: str):
        own, (changed, start) = of(text), edit(text, following)
        after = with_paragraphs(own, inserted=changed[start:], deleted=text[start:])
        near = of(following)
        digest = hashlib.sha256(changed.encode(errors="replace")).hexdigest()
        return len(text), digest, shown(own), shown(after), likeness(own, after), likeness(own, near)

    return with_next(docs, compared, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col, text_col)
