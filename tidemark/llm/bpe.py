"""BPE encoding and decoding of whole texts, byte-level vocabulary, exact to the tokenizers library.

A text of more than ``piece`` characters is halved until its parts are short enough; these leaves are encoded in
parallel, wherever they are cut, and their encodings are concatenated pairwise up the tree of halves. Around each join a
window of tokens is encoded again, twice as wide each time, until its first tokens are those that the left side has
at that place and its last ones those that the right side has: what lies outside is then untouched by the cut. Should
they never agree, the window ends up as both sides. Shorter texts are a leaf by themselves.

Edge cases: a null text is an empty one and has no ids; repeated rows and repeated ids give one row each; an empty
table gives an empty result; extra columns are ignored; the special token's string in a text becomes its id, as the
library does by default, also where a cut runs through it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, working
from .token_cache import byte_table, cache, decode_bytes, tokenizer

PIECE_CHARS = 32_768
#: Tokens on each side of a join that are encoded again at first: more bytes than the special token has.
FIRST_WINDOW = 24
#: Tokens at each end of a window on which the sides must agree.
AGREED = 4


def encode_one(path: str, text: str) -> np.ndarray:
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def join(path: str, left: np.ndarray, right: np.ndarray, window: int = FIRST_WINDOW) -> np.ndarray:
    """The encoding of two neighbouring stretches of a text from the encodings of each."""
    data, start, size = byte_table(path)
    inside = lambda i: size[i] and 128 <= data[start[i]] < 192  # noqa: E731  the token begins within a character
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        while a and inside(left[a]):
            a -= 1
        while b < len(right) and inside(right[b]):
            b += 1
        seam = np.concatenate([left[a:], right[:b]])
        again = encode_one(path, decode_bytes(path, seam).decode())
        starts = a == 0 or (again[:AGREED] == left[a : a + AGREED]).all()
        ends = b == len(right) or (again[-AGREED:] == right[b - AGREED : b]).all()
        if starts and ends:
            return np.concatenate([left[:a], again, right[b:]])
        window *= 2


def tree(path: str, leaves: list[np.ndarray]) -> np.ndarray:
    """The leaves' encodings joined pairwise, level by level, as the text was halved."""
    while len(leaves) > 1:
        leaves = [join(path, *leaves[k : k + 2]) for k in range(0, len(leaves), 2)]
    return leaves[0] if leaves else np.zeros(0, np.uint32)


def halves(text: str, piece: int = PIECE_CHARS) -> list[str]:
    """The text in 2 ** n parts of at most ``piece`` characters, each level's halves equal but for one character."""
    parts = [text]
    while len(parts[0]) > piece or len(parts[-1]) > piece:
        parts = [p for t in parts for p in (t[: len(t) // 2], t[len(t) // 2 :])]
    return parts


def _encoded(path: str, keep: int, decoded: bool):
    """An Arrow function: the first ``keep`` columns, then ids, on demand decoded, of the texts in the column after them."""

    def run(batches):
        working("tokens")
        for batch in batches:
            ids = cache(path).encode(batch.column(keep))
            cols = [*batch.columns[:keep], pa.array([x.tobytes() for x in ids], pa.binary())]
            names = [*batch.schema.names[:keep], "ids"]
            if decoded:
                cols, names = [*cols, pa.array([decode_bytes(path, x).decode() for x in ids], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def decode_udf(path: str):
    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        working("tokens")
        return pd.Series([decode_bytes(path, np.frombuffer(x, np.uint32)).decode() for x in ids], dtype=object)

    return run


def encode(docs: DataFrame, path: str, piece: int = PIECE_CHARS, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers, so that no array is copied value by value), on demand decoded."""
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    extra = ", decoded string" * decoded
    short = rows.where(F.length("text") <= piece).mapInArrow(_encoded(path, 1, decoded), "doc_id long, ids binary" + extra)

    def split(pdfs):
        for pdf in pdfs:
            for key, doc_id, text in pdf[["key", "doc_id", "text"]].itertuples(index=False):
                got = halves(text, piece)
                yield pd.DataFrame({"key": key, "doc_id": doc_id, "seq": range(len(got)), "text": got}).astype({"doc_id": "Int64"})

    def gather(pdfs):
        working("tokens")
        key, doc_id, leaves = None, None, []

        def row():
            whole = tree(path, leaves)
            return pd.DataFrame({"doc_id": pd.array([doc_id], "Int64"), "ids": [whole.tobytes()]} | ({"decoded": [decode_bytes(path, whole).decode()]} if decoded else {}))

        for pdf in pdfs:
            for k, d, ids in pdf[["key", "doc_id", "ids"]].itertuples(index=False):
                if key is not None and k != key:
                    yield row()
                    leaves = []
                key, doc_id = k, None if pd.isna(d) else int(d)
                leaves.append(np.frombuffer(ids, np.uint32))
        if key is not None:
            yield row()

    long = rows.where(F.length("text") > piece).withColumn("key", F.monotonically_increasing_id())  # the scan is the same on a retry
    leaves = long.mapInPandas(split, "key long, doc_id long, seq int, text string").repartition("key", "seq")
    spread = leaves.mapInArrow(_encoded(path, 3, False), "key long, doc_id long, seq int, ids binary")
    whole = spread.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(gather, "doc_id long, ids binary" + extra)
    return short.unionByName(whole)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the text, special tokens as their strings."""
    return encoded.withColumn("decoded", decode_udf(path)("ids"))
