"""SimHash near-duplicate detection by a byte-position inverted index with count filtering.

Fingerprints within ``max_bits`` = 4 differ in at most 4 of their 8 bytes, so they share at least 4 positional bytes.
Any 4 of 8 positions hold one of the 20 position triples below (a Turan system), so an index over those triples meets
every such pair. Within a posting list the shared positional bytes of each pair are tallied and pairs under 4 are dropped before their
bits are compared. Equal fingerprints are merged first. Long lists are cut into blocks and compared block by block in
many tasks; a task passes on a spanning forest of the links it found, never all pairs, which leaves the components as they are.

Edge cases: a null or empty text has fingerprint zero, linked like any other; texts of fewer words than a shingle are
one shingle; repeated rows and ids are linked through their equal fingerprints; a null id takes part but can't be the
smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .common import bounded_batches, stored, working

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
#: Every choice of 4 of the 8 positions holds at least one of these triples: the ring's three arcs, split 3, 3, 2.
ARCS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = tuple(t for t in itertools.combinations(range(BYTES), 3) if any((c := [sum(p in arc for p in t) for arc in ARCS])[k] == 3 or c[k] == 2 and c[(k + 1) % 3] == 1 for k in range(3)))
BLOCK = 2048


def fingerprint(text: bytes | None, words_per: int = SHINGLE) -> int:
    import xxhash

    words = (text or b"").lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= words_per:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        starts = np.concatenate([[0], ends[:-words_per] + 1]).tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(flat[a:b], SEED) for a, b in zip(starts, ends[words_per - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    """Of texts given as binary; the 64 bits as a signed long."""
    working("simhash")
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))


def forest(a: np.ndarray, b: np.ndarray | None, max_bits: int = MAX_BITS, rows: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or between a and b: tally equal positional bytes, then count bits."""
    both = a if b is None else np.concatenate([a, b])
    parent = np.arange(len(both))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    other, shift = (a, 0) if b is None else (b, len(a))
    least, out = BYTES - max_bits, []
    low = np.uint64(0x0101010101010101)
    for at in range(0, len(a), rows):
        x = a[at : at + rows, None] ^ other[None, :]
        y = x | x >> np.uint64(4)
        y |= y >> np.uint64(2)
        y |= y >> np.uint64(1)
        shared = BYTES - np.bitwise_count(y & low)  # positional bytes in common
        near = (shared >= least) & (np.bitwise_count(x) <= max_bits)
        for i, j in np.argwhere(near):
            i, j = int(i) + at, int(j) + shift
            if i != j and (p := root(i)) != (q := root(j)):
                parent[max(p, q)] = min(p, q)
                out.append((int(both[i]), int(both[j])))
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """prints: distinct ``fp`` (long). Pairs (a, b) that join the same components as all pairs within max_bits would."""
    byte = lambda p: F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
    key = lambda k, t: F.lit(k).cast("long") * (1 << 24) + byte(t[0]) * (1 << 16) + byte(t[1]) * (1 << 8) + byte(t[2])
    posted = prints.select("fp", F.explode(F.array(*[key(k, t) for k, t in enumerate(TRIPLES)])).alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = posted.join(sizes, "key")
    whole = F.col("n") <= block
    # A list of more than a block's rows: n_blocks blocks, every pair of them a group of its own.
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), n_blocks).cast("int")
    pairs = F.when(whole, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    )
    cells = lists.select("key", "fp", F.when(whole, 0).otherwise(own).alias("own"), F.explode(pairs).alias("c")).select("key", "fp", "own", "c.i", "c.j")

    def run(pdfs):
        held: tuple | None = None
        rows: list = []

        def close():
            if held is None:
                return None
            own, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            fp = fp.astype(np.int64).view(np.uint64)
            got = forest(fp, None, max_bits) if held[1] == held[2] else forest(fp[own == held[1]], fp[own == held[2]], max_bits)
            return np.array(got, np.uint64).reshape(-1, 2).view(np.int64) if got else None

        for pdf in pdfs:
            if not len(pdf):
                continue
            k, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
            own, fp = pdf["own"].to_numpy(), pdf["fp"].to_numpy()
            edge = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            found = []
            for a, b in itertools.pairwise([0, *edge.tolist(), len(k)]):
                cell = (k[a], i[a], j[a])
                if cell != held:
                    if (got := close()) is not None:
                        found.append(got)
                    held, rows = cell, []
                rows.append((own[a:b], fp[a:b]))
            if found:
                f = np.concatenate(found)
                yield pd.DataFrame({"a": f[:, 0], "b": f[:, 1]})
        if (got := close()) is not None:
            yield pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    sorted_ = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInPandas(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """nodes (one row of each ``fp``) with label: their component's smallest linked fingerprint."""
    found = stored(links(nodes.select("fp"), max_bits), "links")
    labels = components(found)  # node, label: for fingerprints with links
    return nodes.join(labels, nodes["fp"] == labels["node"], "left").select(*nodes.columns, F.coalesce("label", "fp").alias("label"))


def classes(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most ``max_bits`` differing bits."""
    prints = stored(bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_udf(F.col(text_col).cast("binary")).alias("fp")), "fingerprints")
    named = labelled(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), max_bits)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_print = stored(named.join(least, "label").select("fp", "component_id"), "by_print")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, max_bits: int = MAX_BITS, text_col: str = "text") -> DataFrame:
    """One row of each component, all columns unchanged: that with the smallest doc_id, null ids last, then the smallest row key.

    The key is a hash of the whole row, as an id may be null or stand at several texts; rows of one key are copies of each other.
    """
    others = F.to_json(F.struct(*[c for c in docs.columns if c != text_col]))
    keyed = docs.withColumn("__key", F.unhex(F.sha2(F.concat_ws("\n", others, F.col(text_col).cast("string")), 256)))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("key")).alias("row")
    prints = stored(bounded_batches(keyed).select(row, fingerprint_udf(F.col(text_col).cast("binary")).alias("fp")), "fingerprints")
    named = labelled(prints.groupBy("fp").agg(F.min("row").alias("row")), max_bits)
    keep = named.groupBy("label").agg(F.min("row").alias("row")).select(F.col("row.key").alias("__key"))
    return keyed.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
