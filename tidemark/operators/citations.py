"""Citations: which sources a report cites, which passage an answer's marker means."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

PROBE, AROUND = 40, 200


def report_keys(reports: DataFrame) -> DataFrame:
    """nb, key: distinct citation keys of all URLs in a group's reports except those of images; a report may be one row, or a row for each line."""
    tagged = lambda found, image: F.transform(found, lambda u: F.struct(u.alias("url"), F.lit(image).alias("image")))
    found = reports.select("nb", F.explode(F.concat(tagged(urls.bare_urls("report"), False), tagged(urls.image_urls("report"), True))).alias("u"))
    keys = found.select("nb", urls.citation_key("u.url").alias("key"), "u.image").where("key LIKE 'http://%' OR key LIKE 'https://%'")
    return keys.groupBy("nb", "key").agg(F.bool_or("image").alias("image")).where("NOT image").select("nb", "key")


def cited(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Sources a group's report cites, reports first; all of them (used_fallback) where none is cited."""
    keys = report_keys(reports).withColumnRenamed("key", "_key")
    rows = sources.withColumn("_key", F.when(F.col("kind") != "report", urls.citation_key("url"))).join(keys.withColumn("_hit", F.lit(True)), ["nb", "_key"], "left")
    hits = rows.groupBy("nb").agg(F.count("_hit").alias("n_matched"))
    rows = rows.join(hits, "nb")
    keep = F.col("_hit") | (F.col("kind") == "report") | (F.col("n_matched") == 0)
    return rows.where(keep).withColumn("used_fallback", F.col("n_matched") == 0).drop("_key", "_hit")


def anchored(answers: DataFrame) -> DataFrame:
    """Markers with their reference: the first of that number that has a chunk, else the one in that place if it has no number; else the marker goes."""
    m = answers.select("conv_id", "turn", "refs", F.posexplode(text.markers("answer")).alias("k", "m")).select("conv_id", "turn", "refs", "k", "m.n", "m.at")
    numbered = F.try_element_at(F.filter("refs", lambda r: (r["citation_number"] == F.col("n")) & r["chunk_id"].isNotNull()), F.lit(1))
    placed = F.try_element_at(F.col("refs"), F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(2147483647)).cast("int"))
    ref = F.coalesce(numbered, F.when(placed["citation_number"].isNull() & placed["chunk_id"].isNotNull(), placed))
    return m.withColumn("ref", ref).where("ref IS NOT NULL").select("conv_id", "turn", F.col("k").cast("long").alias("marker"), "n", "at", "ref.source_id", "ref.chunk_id")


def first_context(refs: DataFrame, fulltext: DataFrame) -> DataFrame:
    """Where a cited text's first characters stand in its source, and what is around; why not, where they don't."""
    rows = refs.join(fulltext.select("source_id", "content"), "source_id", "left")
    probe = F.substring(F.col("cited_text"), 1, PROBE)
    at = F.instr(F.col("content"), probe)
    status = F.when(F.coalesce("cited_text", F.lit("")) == "", "no_cited_text").when(F.coalesce(at, F.lit(0)) == 0, "not_found").otherwise("found")
    start = F.greatest(at - 1 - AROUND, F.lit(0))
    rows = rows.withColumn("status", status).withColumn("start", F.when(status == "found", (at - 1).cast("long")))
    window = F.substring(F.col("content"), start + 1, at - 1 + F.length(probe) + AROUND - start)
    return rows.withColumn("context", F.when(F.col("status") == "found", window)).drop("content")


#: Hits that are given out at once.
HITS = 10_000


def all_contexts(refs: DataFrame, fulltext: DataFrame) -> DataFrame:
    """source_id, start, context of every place, none overlapping another, where a cited text's first characters stand in its source.

    Each text is gone through once from its start, and its hits are given out by the ten thousand, so a text with very many
    of them is neither searched again nor copied with each.
    """
    rows = refs.where(F.coalesce("cited_text", F.lit("")) != "").select("source_id", F.substring("cited_text", 1, PROBE).alias("probe"))
    rows = rows.join(fulltext.select("source_id", "content").where("content IS NOT NULL"), "source_id")

    def places(text_: str, probe: str):
        at = text_.find(probe)
        while at >= 0:
            yield at, text_[max(0, at - AROUND) : at + len(probe) + AROUND]
            at = text_.find(probe, at + len(probe))

    def run(pdfs):
        for pdf in pdfs:
            for source_id, probe, content in zip(pdf["source_id"], pdf["probe"], pdf["content"], strict=True):
                hits = places(content, probe)
                while own := list(itertools.islice(hits, HITS)):
                    yield pd.DataFrame({"source_id": source_id, "start": [h[0] for h in own], "context": [h[1] for h in own]})

    kind = dict(fulltext.dtypes)["source_id"]
    return rows.mapInPandas(run, f"source_id {kind}, start long, context string")
