"""Status over repeated snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRANSIENT = (0, 10)


def in_order():
    return Window.partitionBy("entity_id").orderBy("snapshot_ts", "pos")


def transitions(snapshots: DataFrame) -> DataFrame:
    """Rows whose status differs from the row's before."""
    before = F.lag("status").over(in_order())
    return snapshots.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col("status"))).drop("_b")


def removals(snapshots: DataFrame, few: int = 5, seconds: int = 10, many: int = 10) -> DataFrame:
    """Of each entity, the first absent row that ends a run of ``few`` over ``seconds`` or more, or of ``many``; a present row ends a run."""
    run = F.sum(F.col("present").cast("int")).over(in_order())
    rows = snapshots.withColumn("_run", run).where("NOT present")
    w = Window.partitionBy("entity_id", "_run").orderBy("snapshot_ts", "pos")
    rows = rows.withColumn("n_absent", F.row_number().over(w).cast("long")).withColumn("_since", F.unix_micros(F.col("snapshot_ts").cast("timestamp")) - F.unix_micros(F.first("snapshot_ts").over(w).cast("timestamp")))
    gone = rows.where(((F.col("n_absent") >= few) & (F.col("_since") >= seconds * 1_000_000)) | (F.col("n_absent") >= many))
    return gone.groupBy("entity_id").agg(F.min_by(F.struct("snapshot_ts", "pos", "n_absent"), F.struct("snapshot_ts", "pos")).alias("r")).select("entity_id", "r.*")


def terminal(snapshots: DataFrame) -> DataFrame:
    """The first row of each entity that ends waiting: ready, absent, or an error of a kind that doesn't pass."""
    state = F.when(~F.col("present"), "not_found").when(F.col("status") == 2, "ready").when((F.col("status") == 3) & ~F.coalesce(F.col("type_code").isin(*TRANSIENT), F.lit(True)), "failed")
    rows = snapshots.withColumn("outcome", state).where("outcome IS NOT NULL")
    return rows.groupBy("entity_id").agg(F.min_by(F.struct("snapshot_ts", "pos", "outcome"), F.struct("snapshot_ts", "pos")).alias("r")).select("entity_id", "r.*")


def waited(requested: DataFrame, ended: DataFrame) -> DataFrame:
    """Requested ids with their outcome; those that never ended timed out."""
    return requested.select("entity_id").distinct().join(ended.select("entity_id", "outcome"), "entity_id", "left").select("entity_id", F.coalesce("outcome", F.lit("timed_out")).alias("outcome"))


def rollup(outcomes: DataFrame, by: str) -> DataFrame:
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(f"{o}_count")
    return outcomes.groupBy(by).agg(n("ready"), n("timed_out"), n("failed"), n("not_found"), F.count("*").alias("total_count"), F.bool_and(F.col("outcome") == "ready").alias("ok"))
