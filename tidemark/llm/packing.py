"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths, what attention
within documents costs). Pieces are placed longest first; among the open sequences in which a piece fits under *every*
capacity, the one with the least weighted residual norm after placing it is chosen ("norm"), or the one whose residual
has the largest weighted dot product with the piece's demand ("dot"). Stored pieces are dealt by row number over buckets
of ``bucket_rows``, which are packed independently; a second pass packs what the buckets' poorly filled sequences hold.

Edge cases: a null text is an empty one, whose one piece is the end id alone; only documents longer than a sequence
are cut; repeated rows are packed as rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, groups_of, stored, working
from .token_cache import cache

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = SCHEMA + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """Per sequence. The default capacities of documents and attention can't bind before that of tokens; all three residuals select the bin."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"


def pieces(docs: DataFrame, path: str, capacity: Capacity = Capacity(), end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of each document's ids followed by ``end_id``; ``ids`` (binary, little-endian 32-bit) on demand."""
    size = capacity.tokens

    def run(batches):
        working("tokens")
        for batch in batches:
            ids = batch.column(0)
            for a, b in groups_of(batch.column(1)):
                got: list[tuple] = []
                who: list[int] = []
                for k, x in enumerate(cache(path).encode(batch.column(1).slice(a, b - a)), a):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(x), size)):
                        own = x[at : at + size].tobytes()
                        who.append(k)
                        got.append((p, at, len(own) // 4, zlib.crc32(own), own))
                p, at, n, crc, own = zip(*got, strict=True)
                cols = [ids.take(pa.array(who)), pa.array(p, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights)
    rest = np.empty((1024, 3))
    n, bins, offsets = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[k], 1, float(lengths[k]) ** 2])
        open_ = rest[:n]
        fits = np.flatnonzero((open_[:, 0] >= need[0]) & (open_[:, 1] >= 1) & (open_[:, 2] >= need[2]))
        if len(fits):
            if capacity.rule == "dot":
                best = np.argmax(((open_[fits] / full) * (need / full)) @ weight)
            else:
                best = np.argmin((((open_[fits] - need) / full) ** 2) @ weight)
            b = int(fits[best])
        else:
            if n == len(rest):
                rest = np.concatenate([rest, np.empty_like(rest)])
            b, n = n, n + 1
            rest[b] = full
        bins[k], offsets[k] = b, capacity.tokens - rest[b, 0]
        rest[b] -= need
    return bins, offsets


def packed(rows: DataFrame, capacity: Capacity = Capacity(), bucket_rows: int = 8192, poor: float = 0.9) -> DataFrame:
    """SCHEMA rows to PACKED rows; other columns of ``rows`` are dropped."""

    def fit(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            b, at = best_fit(pdf["length"].to_numpy(), capacity)
            filled = np.bincount(b, pdf["length"])
            out = pdf.assign(sequence_id=(np.int64(pdf["bucket"].iloc[0]) << 32) + (np.int64(level) << 31) + b, offset=at)
            return out.assign(poor=(filled < poor * capacity.tokens)[b])

        return run

    def level(df: DataFrame, count: int, k: int) -> DataFrame:
        n = max(1, -(-count // bucket_rows))
        dealt = df.withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("long"))  # read from stored rows: the same on a retry
        return dealt.groupBy("bucket").applyInPandas(fit(k), f"{PACKED}, bucket long, poor boolean")

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = stored(rows.select(*names), "pieces")
    first = stored(level(rows, rows.count(), 0).drop("bucket"), "packed")
    again = first.where("poor").select(*names)
    count = again.count()
    return first.where("NOT poor").drop("poor").unionByName(level(again, count, 1).drop("bucket", "poor"))


def sequences(packed_rows: DataFrame, rows_with_ids: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (binary). One group holds one sequence, so it is bounded."""
    held = packed_rows.join(rows_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = held.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "n_tokens", F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
