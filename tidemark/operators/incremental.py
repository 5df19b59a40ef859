"""Incremental import against what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .rows import keep_first, numbered


def partitioned(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``existing_id``: the first existing source with the row's import key. Reports and rows without a URL have none."""
    have = keep_first(existing.withColumn("_key", urls.import_key("url")), ["nb", "_key"], ["pos"]).select("nb", "_key", F.col("source_id").alias("existing_id"))
    key = F.when((F.col("kind") != "report") & F.col("url").isNotNull(), urls.import_key("url"))
    return requested.withColumn("_key", key).join(have, ["nb", "_key"], "left").drop("_key")


def outcome(parts: DataFrame) -> DataFrame:
    """Per group: how many are new, and how many distinct sources were there already."""
    return parts.groupBy("nb").agg(F.count(F.when(F.col("existing_id").isNull(), 1)).alias("n_new"), F.count_distinct("existing_id").alias("n_present"))


def verified(requested: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """After a lost answer: of each requested row whether it was ``committed``, is to ``retry``, or is ``dropped``.

    A source is new when its id is in current and not in baseline. Rows without a URL are credited to new sources
    without a URL up to their number; the rest are dropped if anything was committed, else retried.
    """
    new = current.join(baseline.select("nb", "source_id"), ["nb", "source_id"], "left_anti")
    key = urls.import_key("url")
    new_keys = new.where("url IS NOT NULL").select("nb", key.alias("_key")).distinct().withColumn("_new", F.lit(True))
    now_keys = current.where("url IS NOT NULL").select("nb", key.alias("_key")).distinct().withColumn("_now", F.lit(True))
    spare = new.where("url IS NULL").groupBy("nb").agg(F.count("*").alias("_spare"))
    addressed = requested.where("url IS NOT NULL").withColumn("_key", key)
    any_new = addressed.select("nb", "_key").join(new_keys, ["nb", "_key"], "left_semi").select("nb").distinct().withColumn("_any", F.lit(True))
    rows = addressed.join(new_keys, ["nb", "_key"], "left").join(now_keys, ["nb", "_key"], "left")
    rows = rows.unionByName(numbered(requested.where("url IS NULL"), ["nb"], ["pos"], "_nth"), allowMissingColumns=True)
    rows = rows.join(spare, "nb", "left").join(any_new, "nb", "left")
    state = F.when(F.col("_new"), "committed").when(F.col("url").isNull(), F.when(F.col("_nth") <= F.coalesce("_spare", F.lit(0)), "committed").when(F.col("_any"), "dropped").otherwise("retry")).when(F.col("_now"), "dropped").otherwise("retry")
    return rows.withColumn("state", state).drop("_key", "_new", "_now", "_nth", "_spare", "_any")


def provenance(batch: DataFrame, target: str) -> DataFrame:
    """Per group: whether its task ids that are not null are one value, the target's."""
    return batch.groupBy("nb").agg((F.coalesce(F.bool_and(F.col("task_id") == F.col(target)), F.lit(True)) & (F.count_distinct("task_id") <= 1)).alias("ok"))
