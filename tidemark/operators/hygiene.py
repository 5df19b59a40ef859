"""Junk among collected sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls


def junk(sources: DataFrame) -> DataFrame:
    """Adds ``reason``: error_status, gateway_title, duplicate_of:<kept id>, or null.

    Oldest first, undated last. Only rows with neither of the first two reasons can be what others duplicate, and rows
    without a URL never do. One window over survivors; each is compared with the first of its URL only.
    """
    first = F.when(F.col("status") == 3, "error_status").when(text.gateway("title"), "gateway_title")
    marked = sources.withColumn("_first", first).withColumn("_key", F.when(F.col("_first").isNull() & (F.coalesce("url", F.lit("")) != ""), urls.dedup_key("url")))
    # Rows that can't be duplicates get a key of their own, so that they don't meet in one partition.
    w = Window.partitionBy("nb", F.coalesce("_key", F.concat(F.lit("\0"), "source_id"))).orderBy(F.col("created_at").asc_nulls_last(), "pos")
    kept = F.when(F.col("_key").isNotNull() & (F.row_number().over(w) > 1), F.concat(F.lit("duplicate_of:"), F.substring(F.first("source_id").over(w), 1, 8)))
    return marked.withColumn("reason", F.coalesce("_first", kept)).drop("_first", "_key")


def summary(judged: DataFrame) -> DataFrame:
    """Per group and kind of reason: how many, and whether there was nothing to do."""
    kind = F.split_part(F.col("reason"), F.lit(":"), F.lit(1))
    return judged.where("reason IS NOT NULL").groupBy("nb", kind.alias("kind")).agg(F.count("*").alias("n"))


def status(judged: DataFrame, dry_run: bool = True) -> DataFrame:
    n = F.count("reason")
    return judged.groupBy("nb").agg(n.alias("n_junk"), F.when(n == 0, "already_clean").otherwise("dry_run" if dry_run else "completed").alias("outcome"))


def cleaned(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NULL").drop("reason")
