"""What __spark_entry__ registers of this subpackage, the corpus pipeline included."""

from __future__ import annotations

from . import oracles as sql
from .queries import QUERIES


def queries():
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles():
    return dict(sql.ORACLES)
