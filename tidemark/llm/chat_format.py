"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Control strings inside roles and texts are escaped
reversibly: a backslash is doubled, and ``<|`` becomes ``<\\|``; so a mark only ever is a mark. The loss mask covers
assistants' texts, in escaped characters.

A conversation is the chain of its prefixes; a prefix is named by a running SHA-256 over the turns so far, so equal
prefixes of any conversations are one *node*. Of the conversations that share a node, the one whose hashed id is least owns
it. A conversation owns all that follows a node it owns, so its own nodes are one *path* down the tree. The forest is in
depth-first order: a path is emitted in one run, then what branches off it, from its deepest node upwards. ``start`` is a node's
place in the sequence of all emitted tokens. A token's position id is ``depth_start`` plus its place in the node, and it
attends to its own node's earlier tokens and to the ``ancestors`` intervals: one for each path on the way from the root,
of which a random order of owners makes some ln(conversations) at most, however long a conversation is.

Turns stream through sorted partitions, so neither a tree nor the texts of a conversation are ever one group in memory; a
first turn that very many conversations share is one node, found by partial aggregates. Running sums over ranges place
nodes along paths and paths beside each other, so neither a long path nor one with very many branches is one task. As a
SHA-256 over a conversation is asked for, the turns of one conversation pass through one task, in order.

Edge cases: a null text or role is an empty one; turns sort by turn, then role, then text, nulls first, and repeated rows are
turns of their own; a null conv_id is a conversation like any other; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, running, stored, working
from .token_cache import cache

#: The template's marks.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNT = "assistant"
INTERVAL = "struct<start: bigint, end: bigint, first_depth: int, last_depth: int>"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


def parse_turns(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """role, text and the span of the escaped text, of each turn in a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError("not a formatted conversation")
        a = formatted.index(TEXT, at)
        b = formatted.index(END, a + len(TEXT))
        out.append((unescape(formatted[at + len(TURN) : a]), unescape(formatted[a + len(TEXT) : b]), (a + len(TEXT), b)))
        at = b + len(END)
    return out


def ids_of(path: str | None, texts: list[str]) -> list[np.ndarray]:
    """Token ids of formatted turns: a byte-level vocabulary's, or code points where path is None."""
    if path:
        return cache(path).encode(texts)
    return [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]


def chained(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Each turn with its depth, its prefix's name and its parent's: a running hash in one pass over sorted rows."""
    rows = bounded_batches(turns).select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(pdfs):
        key, depth, digest = object(), 0, b""
        for pdf in pdfs:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                conv = None if pd.isna(conv) else conv
                if conv != key:
                    key, depth, digest = conv, 0, b""
                r, t = role.encode(), text.encode()
                parent, digest, depth = digest, hashlib.sha256(digest + len(r).to_bytes(8, "big") + r + t).digest()[:16], depth + 1
                out.append((depth - 1, digest, parent))
            yield pdf.assign(depth=[o[0] for o in out], node=[o[1] for o in out], parent=[o[2] for o in out])[["conv_id", "depth", "node", "parent", "role", "text"]].astype({"conv_id": "Int64"})

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(run, "conv_id long, depth int, node binary, parent binary, role string, text string")


def tree(chain: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """chain as from chained(), stored. (nodes, members).

    nodes: node, parent, depth, path (its path's start), tree (the root's start), start, n_tokens, depth_start, ancestors (array of
    start, end, first_depth, last_depth), text (formatted), ids (binary), loss_start, loss_end (characters of text under the loss
    mask). members: conv_id and its last node.
    """
    members = stored(chain.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("m")).select("conv_id", F.col("m.node").alias("leaf")), "leaves")
    owner = F.concat_ws(":", F.lpad(F.hex(F.xxhash64("conv_id")), 16, "0"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    found = chain.select("node", "parent", "depth", "role", "text", owner.alias("owner")).groupBy("node").agg(
        F.min("owner").alias("owner"), *[F.first(c).alias(c) for c in ("parent", "depth", "role", "text")]
    )

    def emit(pdfs):
        working("tokens")
        for pdf in pdfs:
            formatted = [format_turn(r, t) for r, t in zip(pdf["role"], pdf["text"], strict=True)]
            ids = ids_of(path, formatted)
            a = [len(TURN) + len(escape(r)) + len(TEXT) if r == LEARNT else 0 for r in pdf["role"]]
            b = [len(f) - len(END) if r == LEARNT else 0 for r, f in zip(pdf["role"], formatted, strict=True)]
            yield pdf[["node", "parent", "owner", "depth"]].assign(text=formatted, ids=[x.astype("<u4").tobytes() for x in ids], n_tokens=[len(x) for x in ids], loss_start=a, loss_end=b)

    emitted = found.mapInPandas(emit, "node binary, parent binary, owner string, depth int, text string, ids binary, n_tokens long, loss_start int, loss_end int")
    emitted = running(emitted, ["owner", "depth"], "n_tokens", "nodes")  # before: along the path, but for the path's own base
    # Paths, each with the one it branches off and where.
    above = F.min_by("parent", "depth")
    paths = emitted.groupBy("owner").agg(F.min("before").alias("base"), F.sum("n_tokens").alias("length"), F.min("depth").alias("top"), above.alias("node"))
    joints = emitted.select("node", F.col("owner").alias("parent"), (F.col("before") + F.col("n_tokens")).alias("cut"))
    paths = stored(paths.join(joints, "node", "left").drop("node").withColumn("parent", F.coalesce("parent", F.lit(""))), "paths")
    levels = [paths.where("parent = ''")]
    while not (below := stored(paths.join(levels[-1].select(F.col("owner").alias("parent")), "parent"), "level")).isEmpty():
        levels.append(below)
    # Tokens of whole subtrees, from the lowest level up; then each path's place among those beside it.
    sized = [levels[-1].select("owner", "parent", "top", F.col("length").alias("total"))]
    for level in reversed(levels[:-1]):
        sums = sized[0].groupBy(F.col("parent").alias("owner")).agg(F.sum("total").alias("s"))
        total = (F.col("length") + F.coalesce("s", F.lit(0))).alias("total")
        sized.insert(0, stored(level.join(sums, "owner", "left").select("owner", "parent", "top", total), "sized"))
    every = sized[0]
    for more in sized[1:]:
        every = every.unionByName(more)
    beside = running(every.select("owner", "parent", (-F.col("top")).alias("rise"), "total"), ["parent", "rise", "owner"], "total", "beside")
    first = beside.groupBy("parent").agg(F.min("before").alias("first"))
    beside = stored(beside.join(first, "parent").select("owner", (F.col("before") - F.col("first")).alias("aside")), "aside")
    zero = F.lit(0).cast("long")
    placed = [levels[0].join(beside, "owner").select("owner", "base", "length", "top", F.col("aside").alias("start"), zero.alias("depth_start"), F.col("aside").alias("tree"), F.array().cast(f"array<{INTERVAL}>").alias("ancestors"))]
    for level in levels[1:]:
        up = placed[-1].select(F.col("owner").alias("parent"), *[F.col(c).alias(f"u_{c}") for c in ("base", "length", "top", "start", "depth_start", "tree", "ancestors")])
        cut = F.col("cut") - F.col("u_base")
        own = F.struct(F.col("u_start").alias("start"), (F.col("u_start") + cut).alias("end"), F.col("u_top").alias("first_depth"), (F.col("top") - 1).alias("last_depth")).cast(INTERVAL)
        start = F.col("u_start") + F.col("u_length") + F.col("aside")
        at = level.join(beside, "owner").join(up, "parent").select("owner", "base", "length", "top", start.alias("start"), (F.col("u_depth_start") + cut).alias("depth_start"), F.col("u_tree").alias("tree"), F.concat("u_ancestors", F.array(own)).alias("ancestors"))
        placed.append(stored(at, "placed"))
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    where = where.select("owner", "base", "top", F.col("start").alias("path"), "depth_start", "tree", "ancestors")
    along = F.col("before") - F.col("base")
    own = F.struct(F.col("path").alias("start"), (F.col("path") + along).alias("end"), F.col("top").alias("first_depth"), (F.col("depth") - 1).alias("last_depth")).cast(INTERVAL)
    nodes = emitted.join(where, "owner").select(
        "node", "parent", "depth", "path", "tree", (F.col("path") + along).alias("start"), "n_tokens", (F.col("depth_start") + along).alias("depth_start"),
        F.when(along > 0, F.concat("ancestors", F.array(own))).otherwise(F.col("ancestors")).alias("ancestors"), "text", "ids", "loss_start", "loss_end",
    )
    return nodes, members


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation, from the emitted forest alone: its turns, by following ``ancestors`` from its last node.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    wanted = members.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf")
    ends = wanted.join(nodes.select(F.col("node").alias("leaf"), "path", "depth", "ancestors"), "leaf")
    none = F.lit(None).cast("long")
    last = F.struct(F.col("path").alias("start"), none.alias("end"), F.col("depth").alias("first_depth"), F.col("depth").alias("last_depth")).cast(INTERVAL)
    spans = ends.select("leaf", F.explode(F.concat("ancestors", F.array(last))).alias("a"))
    steps = spans.select("leaf", F.col("a.start").alias("path"), F.explode(F.sequence("a.first_depth", "a.last_depth")).alias("depth"))
    parts = steps.join(nodes.select("path", "depth", "text", "loss_start", "loss_end"), ["path", "depth"]).select("leaf", "depth", "text", "loss_start", "loss_end")

    def run(pdfs):
        key, state = None, None

        def row():
            turns, loss, n, learnt, size = state
            return {"leaf": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": learnt, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for pdf in pdfs:
            out = []
            for leaf, text, a, b in zip(pdf["leaf"], pdf["text"], pdf["loss_start"], pdf["loss_end"], strict=True):
                if leaf != key:
                    if key is not None:
                        out.append(row())
                    key, state = leaf, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, own, _ in parse_turns(text):
                    state[0].update(f"{role}\n{own}\n".encode())
                    state[2] += 1
                learnt = unescape(text[a:b])
                state[1].update(learnt.encode())
                state[3] += len(learnt)
                state[4] += len(text)
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([row()])

    read = parts.repartition("leaf").sortWithinPartitions("leaf", "depth").mapInPandas(run, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(read, "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def formatted(turns: DataFrame, path: str | None = None, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of a table of turns, both written to the shared folder."""
    nodes, members = tree(stored(chained(turns, id_col), "turns"), path)
    return stored(nodes, "forest"), members
