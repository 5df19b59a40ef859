"""Queries over whole tables and texts that have no SQL, against plain models."""

import hashlib
import re

from tidemark import catalog
from tidemark.functions import text

SF = "/root/testdata/sf0.001"


def test_whole_texts_are_scrubbed(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = ["long " * 20 + "see code=s3cr3t&x, at=\"q\"", "a\nSet-Cookie: sid=1; b=2\nnext", "no secret = here", "Bearer id_token=t1"]
    docs.unionByName(spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(more)], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        t = f"x access_token={hashlib.md5(str(r['doc_id']).encode()).hexdigest()}&y {r['text']} Authorization: Bearer {r['doc_id']} z"
        for pattern, to in text.SECRETS:
            t = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), t, flags=re.ASCII)
        want[r["doc_id"]] = t
    got = {r["doc_id"]: r["clean"] for r in catalog.QUERIES["h14_scrubbed_whole"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == docs.count() + len(more)
    assert "s3cr3t" not in got[10**9] and "sid=1" not in got[10**9 + 1] and got[10**9 + 1].count("\n") == 2
