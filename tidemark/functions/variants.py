"""Columns of JSON text whose shape isn't known: read as VARIANT, so that another shape gives null, never a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How deep failure texts may lie.
BLANK = r"^\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(c: Column | str) -> Column:
    return F.try_parse_json(_col(c))


def string_at(v: Column, path: str) -> Column:
    """The string at a path; null for a value of any other type, which a plain cast would turn into text."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def boolean_at(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def freshness(payload: Column | str) -> Column:
    """fresh, stale, or drift for a shape that is neither."""
    v = parsed(payload)
    bare, flag = boolean_at(v, "$"), boolean_at(v, "$[0][1]")
    empty = F.size(F.try_variant_get(v, "$", "array<variant>")) == 0
    return F.when(bare | F.coalesce(empty, F.lit(False)) | flag, "fresh").when(~bare | ~flag, "stale").otherwise("drift")


def tree_title(tree: Column | str, default: str = "Mind Map") -> Column:
    """``name`` of a JSON object where it is a string with something in it."""
    return F.coalesce(F.nullif(string_at(parsed(tree), "$.name"), F.lit("")), F.lit(default))


def failure_text(direct: Column | str, payload: Column | str) -> Column:
    """The direct text where it isn't blank, else the first text in the payload that isn't, one list down at most."""
    v = parsed(payload)
    items = F.try_variant_get(v, "$", "array<variant>")
    one = lambda x: F.array(string_at(x, "$"))
    own = lambda x: F.coalesce(F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y: string_at(y, "$")), one(x))
    texts = F.filter(F.flatten(F.transform(items, own)), lambda t: t.isNotNull() & ~t.rlike(BLANK))
    some = F.when(~_col(direct).rlike(BLANK), F.btrim(_col(direct)))
    return F.coalesce(some, F.btrim(F.try_element_at(texts, F.lit(1))))


def as_list(c: Column | str) -> Column:
    """A list from a JSON array's text, ``[a, b]``, or a comma list; null stays null, and a blank text is an empty list."""
    t = F.btrim(_col(c))
    listed = F.when(t.startswith("["), F.transform(F.try_variant_get(F.try_parse_json(t), "$", "array<string>"), lambda x: F.coalesce(x, F.lit("None"))))
    bare = F.when(t.startswith("["), F.regexp_replace(F.substring(t, 2, 1 << 30), r"\]$", "")).otherwise(t)
    parts = F.filter(F.transform(F.split(bare, ","), lambda x: F.btrim(x)), lambda x: x != "")
    return F.coalesce(listed, parts)
