"""Gates and hooks around a table: fail on too many bad rows, let the caller classify, watch, or be told."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: More than this share of malformed rows fails an ingest.
MALFORMED = 0.1


def gated(df: DataFrame, bad: Column, limit: float = MALFORMED) -> DataFrame:
    """The good rows; where the share of bad ones is over the limit, running it fails instead."""
    share = df.agg(F.coalesce(F.avg(bad.cast("int")), F.lit(0.0)).alias("_share"))
    checked = share.select(F.when(F.col("_share") > limit, F.raise_error(F.concat(F.lit("malformed rows: "), F.col("_share").cast("string")))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return df.where(~bad).crossJoin(F.broadcast(checked)).where(F.coalesce("_ok", F.lit(True))).drop("_ok")  # one row


def lines_read(answer: str | None) -> tuple:
    """Of a framed answer its whole JSON chunks, then how many payloads and framings there are and how many of each are bad, and of records in all.

    A line that is a number announces the next one as its payload, whatever its length; any other line is a payload itself.
    """
    lines = [x.removesuffix("\r") for x in (answer or "").strip().split("\n")]
    chunks, n_payloads, bad_payloads, n_framings, bad_framings, records = [], 0, 0, 0, 0, 0
    announced = False
    for line in lines:
        if not announced:
            line = line.strip()
            if not line:
                continue
            records += 1
            try:
                int(line)
            except ValueError:
                pass
            else:
                n_framings, announced = n_framings + 1, True
                continue
        announced = False
        n_payloads += 1
        try:
            json.loads(line)
            chunks.append(line)
        except (ValueError, RecursionError):
            bad_payloads += 1
    return chunks, n_payloads, bad_payloads, n_framings, bad_framings + announced, records


def framed(answers: DataFrame, answer: str, limit: float = MALFORMED) -> DataFrame:
    """answers with chunks (JSON texts), n_payloads, bad_payloads, n_framings, bad_framings, and which gate refuses it: ``payload``, ``framing`` or ``total``, in this order, where more than the limit is malformed; else null."""

    @F.pandas_udf("chunks array<string>, n_payloads int, bad_payloads int, n_framings int, bad_framings int, records int")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lines_read(t) for t in texts], columns=["chunks", "n_payloads", "bad_payloads", "n_framings", "bad_framings", "records"])

    rows = answers.withColumn("_r", read(answer)).select("*", "_r.*").drop("_r")
    over = lambda bad, n: F.coalesce(bad / F.nullif(n, F.lit(0)) > limit, F.lit(False))
    bad = F.col("bad_payloads") + F.col("bad_framings")
    refused = F.when(over(F.col("bad_payloads"), F.col("n_payloads")), "payload").when(over(F.col("bad_framings"), F.col("n_framings")), "framing").when(over(bad, F.col("records")), "total")
    return rows.withColumn("refused", refused).drop("records")


def cleaned(sources: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that a classifier gives no reason against; classify adds ``reason`` and may be any function of the table."""
    return sources.transform(classify).where("reason IS NULL").select(*sources.columns)


def rendered(rows: DataFrame, line: Callable[[Callable[[str], Column]], Column], name: str = "doc") -> DataFrame:
    """rows with a text of each, made by the caller's formatter: a function from a getter of columns to a column."""
    return rows.withColumn(name, line(F.col))


def watched(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """df with measures taken while it runs; the observation holds them once it has."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in measures.items()]), seen
