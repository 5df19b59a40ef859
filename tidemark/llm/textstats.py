"""Counts over whole texts that quality rules and the quality classifier share.

A word is a run of bytes other than ASCII space, tab, newline, vertical tab, form feed and carriage return, which is
what ``bytes.split()`` yields. A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import working

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
CONTINUATION = bytes(range(128, 192))
STOPS = b".,;:?"
WINDOW = 8

#: In this order; all of them are whole numbers.
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_next", "n_distinct",
    "n_upper", "n_letters", "n_exclaim", "n_digits", "n_stops", "n_high",
)


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def repeated_positions(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions covered by windows of so many ids that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hits = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[hits]  # the key only proposes; whole windows decide
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hits = hits[count[back.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    solid = text.translate(None, SPACE)
    n_bytes = len(solid)
    high = _count(solid, CONTINUATION)
    return (
        len(words), n_bytes - high, _count(solid, SYMBOLS), len(lines), len(lines) - len(set(lines)),
        repeated_positions(ids), int((ids[1:] == ids[:-1]).sum()), len(first), _count(solid, UPPER), _count(solid, LETTERS),
        solid.count(b"!"), _count(solid, DIGITS), _count(solid, STOPS), high,
    )


SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


@F.pandas_udf(SCHEMA)
def stats(texts: pd.Series) -> pd.DataFrame:
    """A struct of FIELDS for each text, given as binary."""
    working("textstats")
    return pd.DataFrame(np.array([measure(t) for t in texts], np.int64).reshape(-1, len(FIELDS)), columns=list(FIELDS))
