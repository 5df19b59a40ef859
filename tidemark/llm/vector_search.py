"""Exact top-k by inner product with vector-approximation files.

Of each block of vectors there is an approximation file: per dimension a grid of 256 cells, one byte a component, an eighth
of the exact vectors' size. It is the only thing that queries are held against at first: a block of queries meets a block
of cells in a task of its own, where the cells bound every score from both sides, and only vectors whose upper bound
reaches the k-th best lower bound remain. Then exact vectors, which lie in a table of their own, are read in order
of upper bounds: the first k of each query, and after them only those whose bound still reaches the k-th exact score.

Of equal vectors, k rows of each id, and of those the 2k with the smallest ids, hold the k best for any query, whose own
id takes up k of them at most; so a vector that makes up a large part of all rows is cut down before it is dealt out. Every
other vector meets every query once, as cells, block by block; queries travel to them in as few bytes a component as hold
their whole numbers.

Edge cases: vectors that are null or hold a null or a value that isn't finite take no part, nor do rows without an id; scores are
between vectors of one length; rows with the query's id are its own row; repeated query rows are answered one by one;
where scores could pass 2 ** 53, they are added up in whole numbers and clipped to 64 bits; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CELLS = 256
QUERY_BLOCK = 16_384
VECTOR_BLOCK = 16_384
#: Queries whose bounds are in memory at once.
STEP = 64
LIMITS = (-(1 << 63), (1 << 63) - 1)


def scaled(df: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and x (binary: doubles) of the vectors that take part, components floored to whole numbers."""

    @F.pandas_udf("binary")
    def floored(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = None if v is None else np.array([np.nan if c is None else c for c in v] if v.dtype == object else v, np.float64)
            out.append((np.floor(scale * x) + 0.0).tobytes() if x is not None and np.isfinite(scale * x).all() else None)  # no -0.0
        return pd.Series(out, dtype=object)

    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), floored(vector_col).alias("x"))
    return rows.where("x IS NOT NULL").withColumn("dim", (F.octet_length("x") / 8).cast("int"))


def approximation(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per dimension the grid's low edge and its cells' width, and the cell of each component (a byte)."""
    with np.errstate(over="ignore", invalid="ignore"):
        low = x.min(0)
        width = np.maximum(1, np.ceil((x.max(0) - low + 1) / cells))
        at = np.clip(np.nan_to_num((x - low) // width), 0, cells - 1).astype(np.uint8)
    return low, width, at


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the clipped scores of each query with each vector, from the vectors' cells alone (bytes, or the same as doubles)."""
    with np.errstate(over="ignore", invalid="ignore"):
        base = (q * width) @ cells.T.astype(np.float64, copy=False) + (q @ low)[:, None]
        size = (np.abs(q) @ (np.abs(low) + CELLS * width))[:, None]
        slack = np.where(size < 2.0**52, 0.0, size * 2.0**-40)  # sums of whole numbers are exact below
        lower = base + (np.minimum(q, 0) @ (width - 1))[:, None] - slack
        upper = base + (np.maximum(q, 0) @ (width - 1))[:, None] + slack
    lower[np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf
    return np.clip(lower, *map(float, LIMITS)), np.clip(upper, *map(float, LIMITS))


def candidates(q: np.ndarray, q_ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int):
    """(query's place, vector's place, lower, upper) of the pairs whose upper bound reaches the query's k-th lower bound."""
    wide = cells.astype(np.float64)
    for a in range(0, len(q), STEP):
        lower, upper = bounds(q[a : a + STEP], low, width, wide)
        other = ids[None, :] != q_ids[a : a + STEP, None]
        if lower.shape[1] > k:
            lower[~other] = -np.inf
            sure = np.partition(lower, -k, axis=1)[:, -k]
            other &= upper >= sure[:, None]
        i, j = np.nonzero(other)
        yield i + a, j, lower[i, j], upper[i, j]


def exact_scores(q: pd.Series, x: pd.Series) -> np.ndarray:
    """Inner products of vectors given as bytes of doubles, row by row."""
    out = np.zeros(len(q), np.int64)
    size = q.map(len).to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        a, b = (np.frombuffer(b"".join(v.iloc[at])).reshape(len(at), -1) for v in (q, x))
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * (n // 8) < 2.0**52:
            out[at] = np.einsum("ij,ij->i", a, b)
        else:
            out[at] = [min(max(sum(int(c) * int(d) for c, d in zip(v, w, strict=True)), LIMITS[0]), LIMITS[1]) for v, w in zip(a, b, strict=True)]
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, cells: int = CELLS) -> DataFrame:
    """vectors as from scaled(). query_id, rank, vec_id, score: the k best of each row for which the column is_query holds."""
    rows = stored(vectors, "vectors").withColumn("row", F.monotonically_increasing_id())  # of stored rows: the same on a retry
    of_id = F.row_number().over(Window.partitionBy("dim", "x", "vec_id").orderBy("row"))
    of_all = F.row_number().over(Window.partitionBy("dim", "x").orderBy("vec_id", "row"))
    few = rows.withColumn("nth", of_id).where(F.col("nth") <= k)  # each limit is applied before rows are shuffled as well
    exact = stored(few.withColumn("nth", of_all).where(F.col("nth") <= 2 * k).drop("nth"), "exact")
    queries = rows.where(is_query)
    n_v, n_q = max(1, -(-exact.count() // vector_block)), max(1, -(-queries.count() // query_block))
    ids = lambda pdf: {"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "rows": [pdf["row"].to_numpy(np.int64).tobytes()]}
    matrix = lambda pdf: np.frombuffer(b"".join(pdf["x"])).reshape(len(pdf), -1)
    kind = "dim int, block int, ids binary, rows binary, low binary, width binary, data binary"

    def approximated(pdf: pd.DataFrame) -> pd.DataFrame:
        low, width, at = approximation(matrix(pdf), cells)
        return pd.DataFrame(ids(pdf) | {"low": [low.tobytes()], "width": [width.tobytes()], "data": [at.tobytes()]})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf)
        size = np.abs(x).max(initial=0)
        kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<f8"
        return pd.DataFrame(ids(pdf) | {"low": [b""], "width": [kind.encode()], "data": [x.astype(kind).tobytes()]})

    # Blocks are numbered over all lengths, so a length with few rows has small blocks.
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block")
    files = stored(exact.select("*", block(n_v)).groupBy("dim", "block").applyInPandas(approximated, kind), "approximation")
    asked = queries.select("*", block(n_q)).groupBy("dim", "block").applyInPandas(packed, kind)
    cell = lambda own, n_other, mine, other: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_other - 1)), lambda o: F.struct(own.alias(mine), o.alias(other)))).alias("c")
    held = ("dim", "ids", "rows", "low", "width", "data")
    sent = files.select(*held, F.lit(1).alias("kind"), cell(F.col("block"), n_q, "v", "q")).unionByName(asked.select(*held, F.lit(0).alias("kind"), cell(F.col("block"), n_v, "q", "v")))
    meet = sent.select("dim", "c.q", "c.v", "kind", *held[1:]).repartition("dim", "q", "v").sortWithinPartitions("dim", "q", "v", "kind")

    def scan(pdfs):
        at, q, q_ids, q_rows = None, None, None, None
        for pdf in pdfs:
            for dim, qb, vb, side, own, row, low, width, data in pdf.itertuples(index=False):
                own, row = np.frombuffer(own, np.int64), np.frombuffer(row, np.int64)
                if side == 0:
                    at, q, q_ids, q_rows = (dim, qb, vb), np.frombuffer(data, width.decode()).reshape(len(own), dim).astype(np.float64), own, row
                elif at == (dim, qb, vb):
                    for i, j, lower, upper in candidates(q, q_ids, np.frombuffer(low), np.frombuffer(width), np.frombuffer(data, np.uint8).reshape(len(own), dim), own, k):
                        yield pd.DataFrame({"query_id": q_ids[i], "asked": q_rows[i], "row": row[j], "lower": lower, "upper": upper})

    found = meet.mapInPandas(scan, "query_id long, asked long, row long, lower double, upper double")
    whole = Window.partitionBy("asked").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = found.withColumn("sure", F.nth_value("lower", k).over(whole)).where("sure IS NULL OR upper >= sure")
    near = stored(near.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("upper"), "row"))).drop("sure", "lower"), "candidates")

    @F.pandas_udf("long")
    def dot(q: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(exact_scores(q, x))

    def read(pairs: DataFrame) -> DataFrame:
        asked = queries.select(F.col("row").alias("asked"), F.col("x").alias("q"))
        return pairs.join(exact.select("row", "vec_id", "x"), "row").join(asked, "asked").select("query_id", "asked", "vec_id", dot("q", "x").alias("score"))

    first = stored(read(near.where(F.col("place") <= k)), "first-read")
    kth = first.groupBy("asked").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    more = read(near.where(F.col("place") > k).join(kth, "asked").where(F.col("upper") >= F.col("kth").cast("double")))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
