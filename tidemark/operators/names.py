"""Unique file names for a batch, as if titles were taken one after another, and what to do where a file is there already."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .rows import numbered

NUMBERED = re.compile(r"^(.*) \((\d+)\)$", re.S)
#: What is left of a name without all its trailing numbers: names that can collide share it.
ROOT = r"( \(\d+\))+$"
#: The last dot that isn't a name's first character parts the stem from the extension.
STEM = r"^(.+?)(\.[^.]*)?$"


def unique(rows: DataFrame, folder: str, title: str, extension: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """rows with ``file``: the safe name of a title; where it is taken, the first free of ``name (2)``, ``name (3)``, and so on.

    A name is taken by an earlier row in the same folder, be it by its own title or by a number it was given, or because it is
    among ``existing`` (folder, file). The order must be total within a folder.
    """
    base = F.regexp_replace(text.safe_name(title), r"[. ]+$", "")
    return distinct(rows.withColumn("_base", base), folder, extension, order, existing)


def distinct(rows: DataFrame, folder: str, extension: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """unique() of names that are safe already: the column _base, which goes.

    Only names of one root can collide. A root of which all titles are the same and nothing is there yet has its rows simply
    counted, in as many tasks as they need. Any other root (one with titles that end in a number, or with existing
    files) is gone through row by row in a sorted partition; of it, the last number given to each name is kept, and those names
    that stand for a number not reached yet.
    """
    held = rows.withColumn("_root", F.regexp_replace("_base", ROOT, ""))
    keys = [folder, "_root", extension]
    columns = [*rows.drop("_base").columns, "file"]
    tricky = held.where(F.col("_base") != F.col("_root")).select(*keys).distinct()
    there = None
    if existing is not None:
        exts = held.select(folder, F.col(extension).alias("_x")).distinct()  # a file is held against each extension of its folder's rows
        there = existing.select(folder, "file").distinct().join(exts, folder).where(F.col("file").endswith(F.col("_x")) & (F.length("file") > F.length("_x")))
        there = there.select(folder, F.expr("left(file, length(file) - length(_x))").alias("_base"), F.col("_x").alias(extension)).withColumn("_root", F.regexp_replace("_base", ROOT, ""))
        there = there.join(held.select(*keys).distinct(), keys, "left_semi")
        tricky = tricky.unionByName(there.select(*keys)).distinct()

    def counted(own: DataFrame) -> DataFrame:
        number = F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise("")
        return numbered(own.drop("_root"), [folder, "_base", extension], [order], "_n").withColumn("file", F.concat("_base", number, extension)).select(*columns)

    if tricky.isEmpty():
        return counted(held)
    marked = held.join(tricky.withColumn("_tricky", F.lit(True)), keys, "left")
    plain = counted(marked.where("_tricky IS NULL").drop("_tricky"))
    chained = marked.where("_tricky").drop("_tricky").withColumn("_there", F.lit(False))
    if there is not None:
        chained = chained.unionByName(there.withColumn("_there", F.lit(True)), allowMissingColumns=True)

    def run(pdfs):
        key, last, taken = None, {}, set()

        def free(name: str) -> bool:
            m = NUMBERED.match(name)
            return name not in taken and not (m and 2 <= int(m[2]) <= last.get(m[1], 0) and str(int(m[2])) == m[2])

        for pdf in pdfs:
            out = []
            for *k, name, is_there in pdf[[*keys, "_base", "_there"]].itertuples(index=False):
                if k != key:
                    key, last, taken = k, {}, set()
                if is_there:
                    taken.add(name)
                    out.append(None)
                    continue
                base = name
                if free(name):
                    taken.add(name)
                else:
                    n = max(2, last.get(base, 0) + 1)
                    while f"{base} ({n})" in taken:
                        taken.discard(f"{base} ({n})")
                        n += 1
                    last[base], name = n, f"{base} ({n})"
                out.append(name + k[2])
            own = pdf.assign(file=out)
            yield own[~own["_there"].astype(bool)][columns]

    schema = rows.drop("_base").select("*", F.lit("").alias("file")).schema
    rest = chained.repartition(*keys).sortWithinPartitions(*keys, F.desc("_there"), order).mapInPandas(run, schema)
    return plain.unionByName(rest)


def resolved(rows: DataFrame, folder: str, file: str, order: str, existing: DataFrame, policy: str = "rename") -> DataFrame:
    """rows with ``action`` and ``target``: what becomes of each file (names are distinct in a folder) where some are among existing (folder, file).

    ``force`` writes over what is there, ``skip`` leaves out (no target), ``rename`` takes the first number that is free of existing
    files and of what was written before in this batch.
    """
    if policy not in ("force", "skip", "rename"):
        raise ValueError(f"no policy: {policy}")
    if policy == "rename":
        parted = rows.withColumns({"_base": F.regexp_extract(file, STEM, 1), "_ext": F.regexp_extract(file, STEM, 2), "_file": F.col(file)}).drop(file)
        out = distinct(parted, folder, "_ext", order, existing.select(F.col(folder), F.col("file")))
        out = out.withColumn("action", F.when(F.col("file") == F.col("_file"), "write").otherwise("renamed")).withColumnRenamed("file", "target").withColumnRenamed("_file", file)
        return out.select(*rows.columns, "action", "target")
    there = existing.select(F.col(folder), F.col("file").alias(file)).distinct().withColumn("_there", F.lit(True))
    met = rows.join(there, [folder, file], "left")
    other = "overwritten" if policy == "force" else "skipped"
    action = F.when(F.col("_there").isNull(), "write").otherwise(other)
    return met.withColumn("action", action).withColumn("target", F.when(F.col("action") != "skipped", F.col(file))).select(*rows.columns, "action", "target")
