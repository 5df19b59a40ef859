"""Rows to whole files, and back: a data source that writes a file of each path, its pieces in order, and shows none before all are there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "tidemark_files"
BOM = b"\xef\xbb\xbf"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: under a name of its own, and what it is to be called."""

    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """path, place, text: a task writes the files whose rows it has, one after another; they get their names when all tasks are done."""

    def __init__(self, options: dict):
        self.uri, self.bom = options["path"].rstrip("/"), options.get("bom", "false") == "true"
        self.job = f"_tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(self.uri)
        task = TaskContext.get().taskAttemptId()
        files: list[tuple[str, str]] = []
        path = out = None
        for batch in iterator:
            for name, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if name != path:
                    if out:
                        out.close()
                    path, temp = name, f"{root}/{self.job}/{task}/{name}"
                    fs.create_dir(temp.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(temp)
                    files.append((temp, f"{root}/{name}"))
                    if self.bom:
                        out.write(BOM)
                out.write((text or "").encode())
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.uri)
        for temp, final in (f for m in messages if m for f in m.files):
            fs.create_dir(final.rsplit("/", 1)[0], recursive=True)
            fs.move(temp, final)
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as pafs

        self._clear(*pafs.FileSystem.from_uri(self.uri))

    def _clear(self, fs, root: str) -> None:
        from pyarrow import fs as pafs

        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class Files(DataSource):
    """Write only; what is written are plain text files."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, place long, text string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def write_files(pieces: DataFrame, uri: str, bom: bool = False) -> None:
    """pieces: path (below uri), place, text. Of each path a file of its texts in the order of places, with no more than a piece of it in memory.

    A file that is there already is written over. Pieces hold their own separators. Rows without a path go; a null text is an empty one.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(Files)
    rows = pieces.where("path IS NOT NULL").select("path", F.col("place").cast("long").alias("place"), "text")
    rows.repartition("path").sortWithinPartitions("path", "place").write.format(NAME).mode("append").option("bom", str(bom).lower()).save(uri)


def read_lines(spark: SparkSession, uri: str) -> DataFrame:
    """file, line of all files under uri."""
    return spark.read.text(uri).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("line"))


def listed(rows: DataFrame, group: str, order: str, name, text, before="", between="", after="") -> DataFrame:
    """rows as the pieces of a file for each group: name(group) is its path, text a column; before, between and after are put around the texts.

    A group's rows may be any number: only its first one is told apart, by a partial minimum.
    """
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    ends = rows.groupBy(group).agg(F.min(order).alias("_first"))
    body = rows.join(ends, group).select(name(F.col(group)).alias("path"), F.col(order).cast("long").alias("place"), F.concat(F.when(F.col(order) == F.col("_first"), "").otherwise(lit(between)), text).alias("text"))
    edge = lambda place, c: ends.select(name(F.col(group)).alias("path"), F.lit(place).cast("long").alias("place"), lit(c).alias("text"))
    return body.unionByName(edge(-(1 << 63), before)).unionByName(edge((1 << 63) - 1, after))
