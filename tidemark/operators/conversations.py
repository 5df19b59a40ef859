"""Turns: pairing, numbering, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def pairs(turns: DataFrame) -> DataFrame:
    """Each question with the very next turn if that is an answer, else with an empty one."""
    next_role, next_text = F.lead("role").over(by_turn()), F.lead("text").over(by_turn())
    rows = turns.withColumn("_r", next_role).withColumn("_t", next_text)  # over all turns: any other role breaks the pair
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("_r") == "assistant", F.col("_t")).otherwise("").alias("answer"))


def numbered(turns: DataFrame) -> DataFrame:
    """Answers with their number: questions before, and one more where the answer isn't empty."""
    before = F.coalesce(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(by_turn().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.withColumn("prior", before.cast("long"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", (F.col("prior") + F.when(F.coalesce("text", F.lit("")) != "", 1).otherwise(0)).alias("turn_number"), (F.col("prior") > 1).alias("is_follow_up"))


def recent(turns: DataFrame, k: int, at: str = "turn") -> DataFrame:
    """The k conversations used last (ties to the larger id): a top-k report, so its ranking ends in one small task."""
    return turns.groupBy("conv_id").agg(F.max(at).alias("last")).orderBy(F.desc("last"), F.desc("conv_id")).limit(k)
