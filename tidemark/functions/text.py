"""Text columns: trimming, file names, citation markers, redaction, markdown."""

from __future__ import annotations

import functools
import json
import operator
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import let

# Fixed values.
DASHES = "‐‑‒–—―−"
DEAD_LINK = ("broken link", "page not found", "page isn't available", "page does not exist", "page no longer available", "no longer available", "error 404", "404 not found", "whoops!")
BOT_WALL = ("just a moment", "enable javascript and cookies", "checking your browser", "attention required", "access denied", "security verification", "captcha", "cloudflare ray id")
GATEWAY = r"(?i)^\s*(access denied|403|404|forbidden|not found|502|just a moment|attention required|security check|captcha)"
#: A lower-case text without which a pattern has nothing to find (several: any of them), the pattern, what becomes of it. The
#: engine of the SQL beside has no back-references, so single and double quotes are two patterns.
GATED_SECRETS = (
    ("at=", r"(\bat=)(\"?)[^&\s\"'<>]+(\"?)", "$1$2***$3"),
    ("snlm0e|fdrfje", r"(\b(?:SNlM0e|FdrFJe))([\"']?\s*:\s*)\"(?:[^\"'\\]|\\.)*\"", "$1$2\"***\""),
    ("snlm0e|fdrfje", r"(\b(?:SNlM0e|FdrFJe))([\"']?\s*:\s*)'(?:[^\"'\\]|\\.)*'", "$1$2'***'"),
    ("snlm0e|fdrfje", r"(\b(?:SNlM0e|FdrFJe))((?:&quot;)?\s*:\s*)&quot;.*?&quot;", "$1$2&quot;***&quot;"),
    ("snlm0e|fdrfje", r"(\b(?:SNlM0e|FdrFJe))(\s*(?:value\s+is|[:=])\s*)[^\s\"'<>&;,.?!)\]}]+", "$1$2***"),
    ("csrf=", r"(?i)(\bcsrf=)(\"?)[^&\s\"'<>]+(\"?)", "$1$2***$3"),
    ("af1_qpn-", r"(AF1_QpN-)[A-Za-z0-9_-]+", "$1***"),
    ("f.sid=", r"(\bf\.sid=)(\"?)[^&\s\"'<>]+(\"?)", "$1$2***$3"),
    ("upload_id=", r"(?i)(\bupload_id=)(\"?)[^&\s\"'<>]+(\"?)", "$1$2***$3"),
    ("token=|code=", r"(?i)(\b(?:refresh_token|access_token|id_token|code)=)(\"?)[^&\s\"'<>]+(\"?)", "$1$2***$3"),
    ("sid=|sidcc=|nid=|lsolh=", r"((?:SAPISID|APISID|SIDCC|LSOLH|HSID|SSID|LSID|OSID|SID|NID)=)(\"?)[^;\s\"'<>]+(\"?)", "$1$2***$3"),
    ("__secure-|__host-", r"(__(?:Secure|Host)-[A-Za-z0-9_]+=)(\"?)[^;\s\"'<>]+(\"?)", "$1$2***$3"),
    ("g.a000-|sidts-|ya29.|aiza", r"(g\.a000-|sidts-|ya29\.|AIza)[A-Za-z0-9_.-]{8,}", "$1***"),
    ("bearer", r"(?i)(Authorization:\s*Bearer\s+)(\"?)[^&\s\"'<>]+(\"?)", "$1$2***$3"),
    ("cookie:", r"(?i)(Cookie:\s*)[^\r\n]+", "$1***"),
)
SECRETS = tuple((pattern, to) for _, pattern, to in GATED_SECRETS)
PATHS = (
    (r"(/files/(?:dl|ul)/)[A-Za-z0-9._-]+", "$1***"),
    (r"(/(?:home|Users)/)(?:\w+(?:[.-]+\w+)* \w+(?:[.-]+\w+)*(?=/)|\w+(?:[.-]+\w+)*)", "$1***"),
    (r"(?i)([A-Za-z]:[\\/]Users[\\/])(?:\w+(?:[.-]+\w+)* \w+(?:[.-]+\w+)*(?=[\\/])|\w+(?:[.-]+\w+)*)", "$1***"),
)
MESSAGE_CHARS = 300
PREVIEW_CHARS = 200
NAME_CHARS = 240 - 7


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of any kind off both ends (trim() takes spaces alone)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def safe_name(title: Column | str) -> Column:
    """A title as a file name: reserved characters to ``_``, dots and spaces off the ends, ``untitled`` where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(_col(title), r'[/\\:*?"<>|]', "_"), r"^[. ]+|[. ]+$", "")
    return F.substring(F.when(F.coalesce(t, F.lit("")) == "", "untitled").otherwise(t), 1, NAME_CHARS)


def scrubbed(c: Column | str) -> Column:
    """Secrets to ``***``; a pattern runs only over texts that hold what it begins with. Cookie names are told apart by case, as their users write them."""

    def one(text: Column, low: Column, gate: str, pattern: str, to: str) -> Column:
        hinted = functools.reduce(operator.or_, (low.contains(word) for word in gate.split("|")))
        return let(text, lambda t: F.when(hinted, F.regexp_replace(t, pattern, to)).otherwise(t))

    def every(t: Column) -> Column:
        return let(F.lower(t), lambda low: functools.reduce(lambda out, rule: one(out, low, *rule), GATED_SECRETS, t))

    return let(_col(c), every)


def redacted(c: Column | str, most: int = MESSAGE_CHARS) -> Column:
    """Secrets, file tokens and home folders out, white space collapsed, then cut; so that no cut shows part of a secret."""
    out = scrubbed(c)
    for pattern, to in PATHS:
        out = F.regexp_replace(out, pattern, to)
    out = strip(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("…"))).otherwise(out)


def preview(c: Column | str, most: int = PREVIEW_CHARS) -> Column:
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def sanity(body: Column | str) -> Column:
    """First that fits of a page's body: ``thin``, ``dead_link``, ``bot_wall``; else null. Length is tested before any phrase."""
    b = _col(body)
    low = F.lower(b)
    has = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    return F.when(F.length(b) < 100, "thin").when(F.length(b) < 2000, F.when(has(DEAD_LINK), "dead_link").when(has(BOT_WALL), "bot_wall")).when(F.length(b) < 5000, F.when(has(BOT_WALL), "bot_wall"))


def gateway(title: Column | str) -> Column:
    return F.coalesce(_col(title).rlike(GATEWAY), F.lit(False))


def without_markers(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r" ?\[(\d+)\]", "")


def markers(c: Column | str) -> Column:
    """Citation numbers in a text, with their places in without_markers() of it: array of n, at."""
    t = _col(c)
    found, parts = F.regexp_extract_all(t, F.lit(r" ?\[(\d+)\]"), 1), F.split(t, r" ?\[\d+\]")
    at = lambda k: F.aggregate(F.slice(parts, 1, k + 1), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(found, lambda n, k: F.struct(n.cast("long").alias("n"), at(k).cast("long").alias("at")))


def no_bullet(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"^\s*(?:[-*+]\s+)?", ""), r"\s+$", "")


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """For comparing titles: compatibility forms, dashes, white space and case folded. No built-in has these."""
    table = str.maketrans(dict.fromkeys(DASHES, "-"))
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(table).split()).casefold())


def pair(question: Column | str, answer: Column | str) -> Column:
    """One exchange as markdown; an empty half is left out."""
    half = lambda c, name: F.when(F.coalesce(_col(c), F.lit("")) != "", F.concat(F.lit(f"**{name}:** "), _col(c)))
    return F.concat_ws("\n\n", half(question, "Q"), half(answer, "A"))


# Fixed values.
UUID_DEPTH = 9
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def is_uuid(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(f"^{UUID}$"), F.lit(False))


@F.pandas_udf(T.StringType())
def first_uuid(payloads: pd.Series) -> pd.Series:
    """The first whole string of JSON text that is a UUID, in lists nested up to UUID_DEPTH times, depth first; objects aren't looked into. No built-in goes by depth."""
    shape = re.compile(UUID)

    def one(payload: str | None) -> str | None:
        try:
            stack = [(json.loads(payload), 0)] if payload and shape.search(payload) else []
        except (ValueError, RecursionError):
            return None
        while stack:
            value, depth = stack.pop()
            if isinstance(value, str) and shape.fullmatch(value):
                return value
            if isinstance(value, list) and depth < UUID_DEPTH:
                stack += [(x, depth + 1) for x in reversed(value)]
        return None

    return payloads.map(one)
