"""Bridge tables: members in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import numbered, pieced


def members(bridge: DataFrame, items: DataFrame) -> DataFrame:
    """Memberships of items that are there; the others are dropped silently."""
    return bridge.join(items, "source_id")


def listed(bridge: DataFrame, items: DataFrame, title: str) -> DataFrame:
    """Per label, all member ids and their titles one to one, null where the item is gone; and how many."""
    rows = bridge.join(items.select("source_id", F.col(title).alias("title")), "source_id", "left")
    out = rows.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source_id", "title"))).alias("m"))
    return out.select("label_id", F.transform("m", lambda x: x["source_id"]).alias("ids"), F.transform("m", lambda x: x["title"]).alias("titles"), F.size("m").cast("long").alias("n_members"))


#: Bytes of ids and titles that a row of a listing holds, about.
PIECE_BYTES = 1 << 20


def listed_in_pieces(bridge: DataFrame, items: DataFrame, title: str, most: int = PIECE_BYTES) -> DataFrame:
    """listed() for labels of any size: label_id, piece, first (the place of its first member), ids, titles; the pieces of a label follow one another."""
    rows = bridge.join(items.select("source_id", F.col(title).alias("title")), "source_id", "left")
    size = F.octet_length("source_id") + F.coalesce(F.octet_length("title"), F.lit(0)) + 16
    own = F.array_sort(F.collect_list(F.struct("place", "source_id", "title")))
    out = pieced(rows.select("label_id", "pos", "source_id", "title"), ["label_id"], ["pos", "source_id"], size, most).groupBy("label_id", "piece").agg(own.alias("m"))
    return out.select("label_id", "piece", F.col("m")[0]["place"].alias("first"), F.transform("m", lambda x: x["source_id"]).alias("ids"), F.transform("m", lambda x: x["title"]).alias("titles"))


def unlabelled(items: DataFrame, bridge: DataFrame) -> DataFrame:
    return items.join(bridge, "source_id", "left_anti")


def added(bridge: DataFrame, more: DataFrame) -> DataFrame:
    """more: label_id, source_id, pos. Members there already keep their places; new ones follow in order. Adding nothing is refused."""
    if more.isEmpty():
        raise ValueError("no members to add")
    rows = bridge.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)))
    first = rows.groupBy("label_id", "source_id").agg(F.min(F.struct("_new", "pos")).alias("at")).select("label_id", "source_id", F.col("at._new").alias("_new"), F.col("at.pos").alias("_at"))
    return numbered(first, ["label_id"], ["_new", "_at", "source_id"], "pos").select("label_id", "pos", "source_id")


def removed(bridge: DataFrame, less: DataFrame) -> DataFrame:
    return bridge.join(less, ["label_id", "source_id"], "left_anti")


def permissions(changes: DataFrame) -> DataFrame:
    """nb, email, permission after all changes in order; permission 4 removes."""
    last = changes.groupBy("nb", "email").agg(F.max_by("permission", "pos").alias("permission"))
    return last.where("permission <> 4")


def patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """New name and emoji where given, else the old ones."""
    p = patches.where("name IS NOT NULL OR emoji IS NOT NULL").select("label_id", F.col("name").alias("_name"), F.col("emoji").alias("_emoji"))
    return rows.join(p, "label_id", "left").select("label_id", F.coalesce("_name", "name").alias("name"), F.coalesce("_emoji", "emoji").alias("emoji"))
