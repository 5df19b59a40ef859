"""Streams to tables: run to the end of what there is, append what is new, keep running aggregates and values by key.

A table that grows is Spark's own state: a batch reads and writes the keys that it brings, versions and their cleaning are the
state store's, and a stream that fell goes on from its checkpoint, which the caller may name. Tables of bounded size are written whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import folder

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def opened(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream; ``files`` of them a micro-batch. The path is a pattern, so that it may be a folder or a single file."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path[:-1] + "[t]")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})  # watermarks need instants


def appended(stream: DataFrame, name: str) -> DataFrame:
    """The stream's rows up to now, written in append mode to the shared folder with a checkpoint beside them."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ran(stream: DataFrame, at: str, mode: str, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """The stream up to now, with its checkpoint at a place; a query that starts there again, in whatever process, goes on where it ended or fell.

    ``after`` is called with what each batch gave out and the batch's number, once more if the batch is repeated; its failures don't stop the stream.
    """

    def tell(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # the batch's work is done once, whatever becomes of the callback
        try:
            kept.count()
            after(kept, number)
        except Exception as e:  # noqa: BLE001  a callback is not the stream's business
            print(f"callback of batch {number}: {e}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True)
    (writer.foreachBatch(tell) if after else writer.format("noop")).start().awaitTermination()


def folded(stream: DataFrame, keys: list[str], at: str | None = None, after: Callable[[DataFrame, int], None] | None = None, **values: Column) -> DataFrame:
    """A table of running aggregates by key that is Spark's own state of them: a batch touches the keys that it brings.

    values: count, sum, min or max each, as those alone keep just what they give out. ``after`` is told of the changed rows. The state
    store keeps as many versions as its settings say, and the checkpoint at ``at`` is all there is to a restart.
    """
    spark = stream.sparkSession
    at = at or folder(spark, "folded")
    out = stream.groupBy(*keys).agg(*[c.alias(k) for k, c in values.items()])
    ran(out, at, "update", after)
    value = T.StructType([f for f in out.schema.fields if f.name not in keys])
    return spark.read.format("statestore").load(at).select("key.*", F.col("value").cast(value).alias("value")).select(*keys, "value.*")


def kept_by(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, at: str | None = None, start: DataFrame | None = None, timed: bool = False, after: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """A table of one value a key (the processor's state called ``state``), which is Spark's own state of it.

    The stream's rows go to the processor by key; rows of ``start`` are its state before the first batch. schema is of what it gives out.
    """
    spark = stream.sparkSession
    spark.conf.set(STORE, ROCKS)
    at = at or folder(spark, "kept")
    initial = start.groupBy(*keys) if start is not None else None
    ran(stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append" if timed else "Update", "EventTime" if timed else "None", initial), at, "append" if timed else "update", after)
    return spark.read.format("statestore").option("stateVarName", "state").load(at).select("key.*", "value.*")


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The number of the last batch that a checkpoint says is done; -1: none."""
    done = spark.read.format("binaryFile").load(checkpoint + "/commits").select(F.element_at(F.split("path", "/"), -1).try_cast("int").alias("n"))
    return done.agg(F.coalesce(F.max("n"), F.lit(-1))).first()[0]


def carried(stream: DataFrame, start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], at: str | None = None) -> DataFrame:
    """A small table that every batch makes anew from what it was: step(table, batch). For tables whose size is bounded, as a batch writes them whole.

    Two places take turns, so what a batch starts from stands until the next one is done, and a batch that fell half way is made
    again from it, in whatever process. Which one is right is in the checkpoint.
    """
    spark = stream.sparkSession
    at = at or folder(spark, "carried")

    def version(number: int) -> DataFrame:
        return start if number < 0 else spark.read.schema(start.schema).parquet(f"{at}/{number % 2}")

    def run(batch: DataFrame, number: int) -> None:
        step(version(number - 1), batch).select(*start.columns).write.mode("overwrite").parquet(f"{at}/{number % 2}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return version(last_batch(spark, f"{at}/checkpoint"))


class FirstWins(StatefulProcessor):
    """Of each key the first row by pos of the first batch that has any; whatever comes later, or was there before, changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = min((int(pdf["pos"].min()) for pdf in rows if len(pdf)), default=None)
        if least is not None and not self.state.exists():
            self.state.update((least,))
            yield pd.DataFrame([(*key, least)])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((int(initialState["pos"].min()),))

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Rows whose status differs from the key's one before, in order of time and place. Holds a key's rows of one batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "pos"])
        before = own["status"].shift(fill_value=self.state.get()[0] if self.state.exists() else -1)
        self.state.update((int(own["status"].iloc[-1]),))
        told = own[own["status"] != before]
        if len(told):
            yield pd.DataFrame({"entity_id": key[0], "at": told["at"], "pos": told["pos"], "status": told["status"]})

    def close(self) -> None:
        pass


def most_recent(keys: list[str], order: list[Column], count: int, groups: int):
    """A step for carried(): of each key the first rows by order, and of the keys those whose first row comes first. No more than count * groups rows are kept.

    Who has to go is told when a batch ends: a key that comes again in a later one starts anew.
    """

    def step(table: DataFrame, batch: DataFrame) -> DataFrame:
        rows = table.unionByName(batch.select(*table.columns))
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= count)
        used = rows.where("_n = 1").orderBy(*order).limit(max(0, groups)).select(*keys)  # as many rows as there may be keys
        return rows.join(F.broadcast(used), keys, "left_semi").drop("_n")

    return step
