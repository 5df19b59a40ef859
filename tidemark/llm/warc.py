"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Records are range-sorted by page id: running sums of payload bytes in the order of ids put a shard's first id at every
``shard_bytes``, so the same table gives the same files byte for byte, however it is partitioned. A shard is one task, which
writes a run of ``.warc.gz`` files, each record a gzip member of its own, rolled once a file's compressed size passes
``file_bytes``. Files are written under temporary names with the task attempt in them and renamed when complete; the
manifest names the files that count, and only those are read.

An id with more bytes than a shard has several shards; its records are dealt over them by digest. Those of a single
(id, digest) with over a thousandth of all rows are counted by url first, as such records are equal: a row with their
number, not the rows themselves, goes to each of the shards that share them, beginning at a hash of the url.

Headers and digests are made anew. Of records with equal payloads (of at least ``least_bytes``) the one with the
largest page id is a response, and the others are revisits of it.

Edge cases: a null html is an empty payload; a null url an empty target; rows with a null id sort first and can't be
what others revisit; repeated rows with the largest id are all responses; control characters in a url are percent-encoded;
an empty table gives an empty manifest and no files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, running, stored

SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
#: Shards at most; beyond, they hold more bytes. Their first ids are what reaches the driver: 8 bytes each.
MOST_SHARDS = 100_000
#: What a record adds to its payload, about.
OVERHEAD = 600
LEAST_ID = -(1 << 63)
MANIFEST = "path string, shard int, part int, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    safe = lambda v: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in v)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {safe(v)}\r\n" for k, v in fields) + "\r\n").encode()


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # this header has no time in it
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str, digest: str, size: int, payload: bytes | None, refers_to: int | None, refers_url: str, date: str) -> bytes:
    """payload None: a revisit of page refers_to, with the HTTP header of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", record_id(page_id, digest) if payload is not None else record_id(page_id, digest + "/revisit"))]
    if payload is None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", refers_url), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("X-Page-Id", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def shard_bounds(sizes: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """sizes: id and size of every record. Of each shard, the id in which its first byte lies, in the order of ids."""
    per_id = sizes.groupBy("id").agg(F.sum(F.col("size") + OVERHEAD).alias("bytes"))
    ends = running(per_id, ["id"], "bytes", "ids")
    total = ends.agg(F.sum("bytes")).first()[0] or 0
    each = max(shard_bytes, -(-total // MOST_SHARDS))
    first, last = F.ceil(F.col("before") / each), F.ceil((F.col("before") + F.col("bytes")) / each) - 1
    found = ends.where(first <= last).select(F.explode(F.sequence(first, last)).alias("shard"), "id").collect()
    return [r["id"] for r in sorted(found, key=lambda r: r["shard"])]


def span_of(bounds: list[int]):
    """A column function: the first shard and the number of shards of an id."""
    edges = np.array(bounds or [LEAST_ID], np.int64)

    @F.pandas_udf("lo int, n int")
    def run(ids: pd.Series) -> pd.DataFrame:
        x = ids.to_numpy(np.int64)
        hi = np.maximum(np.searchsorted(edges, x, "right"), 1)
        lo = np.minimum(np.searchsorted(edges, x, "left"), hi - 1)
        return pd.DataFrame({"lo": lo.astype(np.int32), "n": (hi - lo).astype(np.int32)})

    return run


def write(pages: DataFrame, uri: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least_bytes: int = 0, level: int = LEVEL, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives under uri and the manifest to uri/manifest; returns the manifest as read back."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = bounded_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"id": F.coalesce("page_id", F.lit(LEAST_ID)), "sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    narrow = stored(rows.select("id", "page_id", "url", "sha1", "size"), "records")
    bounds = shard_bounds(narrow, shard_bytes)
    span = span_of(bounds)
    # Equal records of an id with over a thousandth of all rows: a thousand such at most.
    least = max(1000, narrow.count() // 1000)
    found = stored(narrow.groupBy("id", "sha1").agg(F.count("*").alias("n")).where(F.col("n") > least).select("id", "sha1", F.lit(True).alias("hot")), "hot-records")
    hot = F.broadcast(found)
    # Of equal payloads, the page with the largest id; then a row for each page that revisits it.
    most = narrow.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("m")).where("n > 1 AND m IS NOT NULL")
    pages_of = narrow.where(F.col("size") >= least_bytes).groupBy("sha1", "page_id", "id").agg(F.count("*").alias("rows"))
    told = pages_of.join(most.select("sha1", "m"), "sha1").where(F.coalesce(F.col("page_id") < F.col("m.page_id"), F.lit(True)))
    told = told.select("id", "page_id", "sha1", F.lit(0).alias("kind"), F.col("m.page_id").alias("refers_to"), F.col("m.url").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("long").alias("size"))
    told = told.join(hot, ["id", "sha1"], "left").withColumn("s", span("id"))
    own = F.pmod(F.xxhash64("sha1"), F.col("s.n")).cast("int")
    told = told.withColumn("i", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.col("s.n") - 1)).otherwise(F.array(own))))
    held = rows.select("id", "page_id", "sha1", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "payload", "size")
    held = held.join(hot, ["id", "sha1"], "left")
    cold = held.where("hot IS NULL").withColumn("s", span("id")).withColumn("i", own).withColumn("copies", F.lit(1).cast("long"))
    if not found.isEmpty():
        equal = held.where("hot").groupBy("id", "page_id", "sha1", "kind", "refers_to", "url", "size").agg(F.count("*").alias("m"), F.any_value("payload").alias("payload")).withColumn("s", span("id"))
        n, j = F.col("s.n"), F.col("j")
        equal = equal.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m"), n.cast("long")) - 1)))
        equal = equal.withColumn("i", F.pmod(F.xxhash64("url") + j, n).cast("int")).withColumn("copies", F.floor(F.col("m") / n) + (j < F.col("m") % n).cast("long"))
        cold = cold.drop("hot").unionByName(equal.select(*[c for c in cold.columns if c != "hot"]))
    both = told.withColumn("copies", F.lit(1).cast("long")).unionByName(cold, allowMissingColumns=True)
    both = both.select((F.col("s.lo") + F.col("i")).alias("shard"), "page_id", "sha1", "kind", "refers_to", "url", "payload", "size", "copies")
    ordered = both.repartitionById(max(1, len(bounds)), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha1", "kind", "url")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(uri)
        task = TaskContext.get().taskAttemptId()
        state: dict = {}
        done: list[tuple] = []

        def begin(shard: int, part: int) -> None:
            name = f"part-{shard:06d}-{part:05d}.warc.gz"
            fs.create_dir(f"{root}/_tmp", recursive=True)
            temp = f"{root}/_tmp/{name}.{task}"
            state.update(shard=shard, part=part, name=name, temp=temp, out=fs.open_output_stream(temp), n=0, size=0, sha=hashlib.sha256())
            info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
            put(_header([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", record_id(None, name)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")

        def put(data: bytes) -> None:
            z = member(data, level)
            state["out"].write(z)
            state["sha"].update(z)
            state["size"] += len(z)

        def end() -> None:
            if state:
                state["out"].close()
                fs.move(state["temp"], f"{root}/{state['name']}")
                done.append((state["name"], state["shard"], state["part"], state["n"], state["size"], state["sha"].hexdigest()))
                state.clear()

        told = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "page_id", "sha1", "kind", "refers_to", "url", "payload", "size", "copies")]
            for shard, page_id, sha1, kind, refers_to, url, payload, size, copies in zip(*cols, strict=True):
                if kind == 0:
                    told = (page_id, sha1, refers_to, url)
                    continue
                again = told is not None and told[:2] == (page_id, sha1)
                for _ in range(copies):
                    if not state or state["shard"] != shard:
                        end()
                        begin(shard, 0)
                    elif state["size"] >= file_bytes:
                        part = state["part"] + 1
                        end()
                        begin(shard, part)
                    put(record(page_id, url, base32(sha1), size, None if again else payload, told[2] if again else None, told[3] if again else "", date))
                    state["n"] += 1
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "shard", "part", "n_records", "n_bytes", "sha256"]).cast(pa.schema([("path", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def records(stream, chunk: int = 1 << 20):
    """(header fields, block) of each record of a .warc.gz stream, one gzip member after another."""
    data = b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            out.append(z.decompress(data))
            data = z.unused_data if z.eof else stream.read(chunk)
            if not data and not z.eof:
                raise ValueError("a gzip member ends early")
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        if not lines[0].startswith("WARC/") or rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
            raise ValueError(f"not a whole record: {lines[:1]}")
        yield fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, uri: str) -> DataFrame:
    """RECORD rows of the files that the manifest under uri names; a wrong digest or count is an error."""

    def run(pdfs):
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        for pdf in pdfs:
            for path, n_records in pdf[["path", "n_records"]].itertuples(index=False):
                rows = []
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for f, block in records(stream):
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        revisit = f["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{path}: payload and digest differ")
                        rows.append((int(f["X-Page-Id"]) if f["X-Page-Id"] else None, size, digest, f["WARC-Type"], int(f["X-Refers-To-Page-Id"]) if revisit else None, f["WARC-Target-URI"], path))
                if len(rows) != n_records:
                    raise ValueError(f"{path}: {len(rows)} records, the manifest has {n_records}")
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest").select("path", "n_records")
    return files.repartition(max(1, min(files.count(), MOST_SHARDS)), "path").mapInPandas(run, RECORD)
