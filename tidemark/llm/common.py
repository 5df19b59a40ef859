"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numpy work on whole texts goes through buffers of about so many bytes, so that memory doesn't follow a batch's size.
BUFFER_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a fresh local one only where that is unset and executors are in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that frees a query's shuffle files when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so a lost executor costs no earlier stage.

    Nothing reads the write's shuffles again, so their files go as soon as it is done.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once. Texts are long, and a batch is held several times: in the JVM, in Arrow, as objects, as results.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after bounding its session's Arrow batches by bytes; a smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)([kmg]?)b?", df.sparkSession.conf.get(key).lower())
    size = int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] if now else 0
    if size <= 0 or size > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df in range partitions, stored, with ``before``: the sum of a long column over all rows earlier in the order of unique keys.

    Sums run within the partitions; only a row per partition is sent around.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(value))
            sums = pc.add(pc.cumulative_sum(own), total)
            cols = [*batch.columns, pa.array([part] * len(own), pa.int32()), pc.subtract(sums, own), sums]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "__part", "__local", "__upto"])
            total = sums[-1].as_py() if len(own) else total

    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType()), T.StructField("__upto", T.LongType())])
    local = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), name)
    sums = local.groupBy("__part").agg(F.max("__upto").alias("__s"))
    base = sums.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__base"))  # a row per partition
    return local.join(F.broadcast(base), "__part").select(*df.columns, (F.col("__base") + F.col("__local")).alias("before"))


def groups_of(column, limit: int = BUFFER_BYTES):
    """Slices [a, b) over an Arrow column of texts that hold about limit bytes each; a single larger text stands alone."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if k > start and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(column):
        yield start, len(column)


#: Functions that empty caches of a Python worker, by the operator whose caches they are.
CACHES: dict[str, Callable[[], None]] = {}


def working(owner: str) -> None:
    """Called by an operator's code in a Python worker, which serves many operators in turn: what others have cached there goes, and free Arrow memory with it."""
    import pyarrow as pa

    for name, clear in CACHES.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
