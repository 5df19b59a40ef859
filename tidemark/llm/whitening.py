"""Embedding whitening by Chebyshev-filtered subspace iteration.

The fit list holds each distinct integer vector once, in blocks of rows. A subspace of three times the wanted size is
multiplied by the covariance V: a pass sends its basis Q to every block of centred vectors X, and sums X'(XQ) come
back, so a pass costs one scan and moves d times the subspace's size. A polynomial recurrence over such passes damps
eigenvalues between the spectrum's lower end (from a Lanczos column carried along with the first passes) and the
subspace's smallest Ritz value; then QR and Rayleigh-Ritz. It ends when the residuals |Vu - eu| of all wanted
components are at rounding, or raises.

Edge cases: rows whose vector is null or holds a null or a value that isn't finite are dropped, rows with a null id
are not; repeated rows are all returned, but count once in the fit; vectors of each length are fitted by themselves,
one length after the other; entries whose scaled floor passes 2**62 in size are clipped to it; components without variance (rank
deficiency, a single vector) have no direction and are left out, so an empty table or a list of one vector gives no
rows; a deviation that doesn't fit into 64 bits is null; among equal eigenvalues any basis is right; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, working

COMPONENTS = 16
OFFSET = 1_000_000
#: Rows of a block of the fit list, and bytes after which the blocks at hand are written.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
LANCZOS_STEPS = 12
MOST_DEGREE, MOST_CYCLES = 16, 200
#: Residuals count as rounding at so many times the largest eigenvalue; where they stop falling, at the second figure.
TOLERANCE, STALLED = 2e-15, 1e-11
CLIP = 2.0**62


@dataclass(frozen=True)
class Model:
    """n vectors with exact sums (without OFFSET); the mean as whole and fractional part; unit axes in columns, falling eigenvalues."""

    n: int
    sums: tuple[int, ...]
    whole: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float = 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole).astype(np.float64) - self.rest

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.axes / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        most = max((abs(int(a) * self.n - s) for edge in (y.min(0), y.max(0)) for a, s in zip(edge, self.sums, strict=True)), default=0)
        if most * most * y.shape[1] < 1 << 62 and self.n * max(abs(int(y.min())), abs(int(y.max()))) < 1 << 62:
            z = self.n * y - np.array(self.sums, np.int64)
            return (z * z).sum(1).tolist()
        exact = (sum((self.n * int(a) - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in y)
        return [v if v < 1 << 63 else None for v in exact]


def integers(df: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and y of the vectors that take part: floor(scale * entry) in 2, 4 or 8 bytes each, the least that hold the vector."""

    @F.pandas_udf("binary")
    def floored(vectors: pd.Series) -> pd.Series:
        working("whitening")
        out = []
        for v in vectors:
            x = np.array([np.nan if c is None else c for c in v] if v.dtype == object else v, np.float64)
            if not np.isfinite(x).all():
                out.append(None)
                continue
            with np.errstate(over="ignore"):
                y = np.clip(np.floor(scale * x), -CLIP, CLIP).astype(np.int64)
            size = max(int(y.max(initial=0)), -int(y.min(initial=0)))
            out.append(y.astype("<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<i8").tobytes())
        return pd.Series(out, dtype=object)

    rows = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), floored(vector_col).alias("y")).where("y IS NOT NULL")


def matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    """The n vectors of a block, as 64-bit integers."""
    return np.frombuffer(data, f"<i{len(data) // n // dim}").reshape(n, dim).astype(np.int64)


def blocked(rows: DataFrame) -> DataFrame:
    """Rows (dim, y) as blocks: dim, size and the bytes of so many vectors of one width."""

    def run(pdfs):
        held: dict[tuple[int, int], list[bytes]] = {}
        size = 0
        for pdf in pdfs:
            for dim, y in zip(pdf["dim"], pdf["y"], strict=True):
                own = held.setdefault((dim, len(y)), [])
                own.append(y)
                size += len(y)
                if len(own) == BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield flushed(held)
                    held, size = {}, 0
        if held:
            yield flushed(held)

    def flushed(held) -> pd.DataFrame:
        return pd.DataFrame([(dim, len(own), b"".join(own)) for (dim, _), own in held.items()], columns=["dim", "size", "data"])

    return rows.select("dim", "y").mapInPandas(run, "dim int, size int, data binary")


def summed(blocks: DataFrame, dim: int, size: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of f(block), an array of so many numbers: the only thing that reaches the driver."""

    def run(pdfs):
        working("whitening")
        total = np.zeros(size)
        for pdf in pdfs:
            for n, data in zip(pdf["size"], pdf["data"], strict=True):
                total += f(matrix(data, n, dim)).ravel()
        yield pd.DataFrame({"k": np.arange(size), "v": total})

    out = np.zeros(size)
    for k, v in blocks.where(F.col("dim") == dim).mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[k] = v
    return out


def exact_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their sums, exact however large: 32 bits at a time."""

    def run(pdfs):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for pdf in pdfs:
            for size, data in zip(pdf["size"], pdf["data"], strict=True):
                y = matrix(data, size, dim)
                n, high, low = n + size, high + (y >> 32).sum(0), low + (y & 0xFFFFFFFF).sum(0)
        yield pd.DataFrame({"k": np.arange(dim), "n": n, "high": high, "low": low})

    parts = blocks.where(F.col("dim") == dim).mapInPandas(run, "k int, n long, high long, low long").groupBy("k")
    found = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    sums = {r["k"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return found[0]["n"], [sums[k] for k in range(dim)]


def growth(x: float) -> float:
    """By how much a Chebyshev polynomial's value at x > 1 grows with each degree."""
    return x + np.sqrt(max(0.0, x * x - 1))


def subspace(times: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns), eigenvalues and largest residual of the k largest eigenvalues of a symmetric, positive matrix given by its products."""
    size = min(dim, 3 * k)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dim, size)))[0]
    chain = [rng.standard_normal(dim)]
    chain[0] /= np.linalg.norm(chain[0])
    alpha: list[float] = []
    beta: list[float] = []

    def product(x: np.ndarray) -> np.ndarray:
        """V x; while the Lanczos chain is short, its next vector is carried along."""
        if size == dim or len(alpha) >= min(LANCZOS_STEPS, dim) or (beta and beta[-1] == 0.0):
            return times(x)
        out = times(np.column_stack([x, chain[-1]]))
        f = out[:, -1]
        alpha.append(float(f @ chain[-1]))
        basis = np.column_stack(chain)
        f = f - basis @ (basis.T @ f)
        f = f - basis @ (basis.T @ f)
        beta.append(float(np.linalg.norm(f)))
        if beta[-1] > 1e-12 * abs(alpha[0]):
            chain.append(f / beta[-1])
        else:
            beta[-1] = 0.0
        return out[:, :-1]

    vq, before, trusted, slow = product(q), np.inf, True, 0
    for _ in range(MOST_CYCLES):
        h = q.T @ vq
        values, w = np.linalg.eigh((h + h.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        q, vq = q @ w, vq @ w
        worst = float(np.linalg.norm(vq - q * values, axis=0)[:k].max())
        top = float(values[0])
        slow = slow + 1 if worst > before / 2 else 0
        if size == dim or top <= 0 or worst <= TOLERANCE * top or (slow >= 2 and worst <= STALLED * top):
            return q[:, :k], values[:k], worst
        if slow >= 2:
            trusted, slow = False, 0  # the lower end was taken too high: go on with zero, which is sure
        before = min(before, worst)
        low = 0.0
        if trusted and len(alpha) > 3:
            ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
            low = max(0.0, float(ritz[0]) - beta[len(alpha) - 1])
        high = max(float(values[-1]), low + 1e-6 * top)
        half, mid = (high - low) / 2, (high + low) / 2
        most, least = growth(max(1.0, (top - mid) / half)), growth(max(1.0, (values[k - 1] - mid) / half))
        degree = int(np.clip(np.log(1e10) / max(1e-3, np.log(most / least)), 2, MOST_DEGREE))
        older, newer = q, (vq - mid * q) / half
        for _ in range(degree - 1):
            older, newer = newer, (2 / half) * (product(newer) - mid * newer) - older
        q = np.linalg.qr(newer)[0]
        vq = product(q)
    raise ArithmeticError(f"components of {dim} dimensions did not converge: residual {worst}, largest eigenvalue {top}")


def fit(blocks: DataFrame, dim: int, k: int = COMPONENTS) -> Model:
    """The first k components of the vectors of one length, given as blocks; fewer if variance ends before."""
    n, sums = exact_sums(blocks, dim)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    blank = Model(n, tuple(sums), whole, rest, np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0)
    trace = float(summed(blocks, dim, 1, lambda y: np.array([(blank.centred(y) ** 2).sum()]))[0]) / n
    if trace <= 0:
        return blank
    passes = [0]

    def times(q: np.ndarray) -> np.ndarray:
        passes[0] += 1

        def own(y: np.ndarray) -> np.ndarray:
            x = blank.centred(y)
            return x.T @ (x @ q)

        return summed(blocks, dim, dim * q.shape[1], own).reshape(dim, -1) / n

    axes, values, residual = subspace(times, dim, min(k, dim))
    some = values > 1e-12 * values[0]
    model = Model(n, tuple(sums), whole, rest, axes[:, some], values[some], trace, residual, passes[0])
    wide = int(some.sum())

    def moments(y: np.ndarray) -> np.ndarray:
        w = model.whitened(y)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = summed(blocks, dim, wide + wide * wide, moments) / n
    mean, second = found[:wide], found[wide:].reshape(wide, wide)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(wide)).max())
    return Model(n, tuple(sums), whole, rest, model.axes, model.values, trace, residual, passes[0], error)


def applied(rows: DataFrame, dim: int, model: Model) -> DataFrame:
    """rows as from integers(). A row per vector of this length and component."""

    def run(pdfs):
        working("whitening")
        for pdf in pdfs:
            width = pdf["y"].map(len)
            for _, own in pdf.groupby(width):
                y = matrix(b"".join(own["y"]), len(own), dim)
                yield pd.DataFrame({"vec_id": own["vec_id"].astype("Int64"), "deviation": pd.array(model.deviations(y), "Int64"), "w": list(model.whitened(y))})

    wide = rows.where(F.col("dim") == dim).select("vec_id", "y").mapInPandas(run, "vec_id long, deviation long, w array<double>")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    per = wide.select("vec_id", "deviation", explained.alias("explained"), F.posexplode("w").alias("at", "whitened"))
    return per.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at("explained", F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


EMPTY = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, k: int = COMPONENTS, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row that takes part and each of its components."""
    rows = stored(integers(df, scale, id_col, vector_col), "whitening-rows")
    blocks = stored(blocked(rows.select("dim", "y").dropDuplicates()), "whitening-fit")
    out = df.sparkSession.createDataFrame([], EMPTY)
    for (dim,) in sorted(blocks.select("dim").distinct().collect()):
        model = fit(blocks, dim, k)
        if len(model.values):
            out = out.unionByName(applied(rows, dim, model))
    return out
