"""References to rows: by id, prefix, title, similarity."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import stored

UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SHOWN = 5


#: Names and tokens meet by so many first characters before they meet by the whole token.
HEAD = 4


def begun(tokens: DataFrame, items: DataFrame, token: str, name: str) -> DataFrame:
    """Pairs of a token and an item whose name it begins: an equality join on the name's beginning of the token's length.

    Of each name only the lengths are made that tokens of the same first characters have. How many rows that gives can't be told
    beforehand, so no side is sent whole to the tasks.
    """
    lengths = tokens.select(F.substring(token, 1, HEAD).alias("_h"), F.length(token).alias("_l")).where("_l > 0").groupBy("_h").agg(F.collect_set("_l").alias("_ls"))
    col = F.col(name)
    heads = F.transform(F.filter(F.array(*map(F.lit, range(1, HEAD + 1))), lambda n: n <= F.length(col)), lambda n: F.substring(col, F.lit(1), n))
    near = items.withColumn("_h", F.explode(heads)).join(lengths.hint("merge"), "_h")
    # Of a head that is shorter than others the only length is its own; tokens of others begin with a whole head.
    parts = F.transform(F.filter("_ls", lambda n: n <= F.length(col)), lambda n: F.substring(col, F.lit(1), n))
    return tokens.join(near.withColumn("_k", F.explode(parts)).drop("_h", "_ls").hint("merge"), F.col(token) == F.col("_k")).drop("_k")


def by_id(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """token, verdict, id: a UUID passes as it is; else an equal id, else the only one the token begins; case doesn't matter."""
    t = tokens.select("token", F.lower(text.strip("token")).alias("_t")).distinct()
    hits = begun(t.where("_t <> ''"), items.select("id", F.lower("id").alias("_i")), "_t", "_i")
    found = hits.groupBy("token").agg(F.min(F.when(F.col("_t") == F.col("_i"), F.col("id"))).alias("_exact"), F.count("*").alias("_n"), F.min("id").alias("_one"))
    out = t.join(found.hint("merge"), "token", "left")
    uuid = F.col("_t").rlike(UUID)
    verdict = F.when(uuid, "passthrough").when(F.col("_exact").isNotNull(), "exact").when(F.col("_n") == 1, "prefix").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return out.select("token", verdict.alias("verdict"), F.when(uuid, F.col("_t")).when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.col("_n") == 1, F.col("_one")).alias("id"))


def by_title(tokens: DataFrame, items: DataFrame, id_of: Column | str = "id", title_of: Column | str = "title") -> DataFrame:
    """token, verdict, id by exact, case-sensitive title. Columns or names of columns say what an item's id and title are."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    found = items.select(col(id_of).alias("id"), col(title_of).alias("token")).groupBy("token").agg(F.count("*").alias("_n"), F.min("id").alias("id"))
    return tokens.select("token").distinct().join(found, "token", "left").select("token", F.when(F.col("_n") == 1, "found").when(F.col("_n") > 1, "ambiguous").otherwise("none").alias("verdict"), F.when(F.col("_n") == 1, F.col("id")).alias("id"))


def by_label(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """token, verdict, id of labels or collections: an equal id, else the only id the token begins, else the only item of exactly that name.

    Ids don't mind case, names do; several ids that a token begins are ambiguous before names are looked at.
    """
    t = tokens.select("token", F.lower(text.strip("token")).alias("_t")).distinct()
    hits = begun(t.where("_t <> ''"), items.select("id", F.lower("id").alias("_i")), "_t", "_i")
    ids = hits.groupBy("token").agg(F.min(F.when(F.col("_t") == F.col("_i"), F.col("id"))).alias("_exact"), F.count("*").alias("_n"), F.min("id").alias("_one"))
    names = items.groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("_m"), F.min("id").alias("_named"))
    out = t.join(ids.hint("merge"), "token", "left").join(names.hint("merge"), text.strip("token") == F.col("_name"), "left")
    cases = [(F.col("_exact").isNotNull(), "id", "_exact"), (F.col("_n") == 1, "prefix", "_one"), (F.col("_n") > 1, "ambiguous_id", None), (F.col("_m") == 1, "name", "_named"), (F.col("_m") > 1, "ambiguous_name", None)]
    verdict, found = F.lit("none"), F.lit(None).cast("string")
    for when, name, col in reversed(cases):
        verdict, found = F.when(when, name).otherwise(verdict), F.when(when, F.col(col) if col else F.lit(None)).otherwise(found)
    return out.select("token", verdict.alias("verdict"), found.alias("id"))


def candidates(tokens: DataFrame, items: DataFrame, limit: int = SHOWN) -> DataFrame:
    """token, rank, id: of an ambiguous token, the first ids that it begins."""
    t = tokens.select("token", F.lower(text.strip("token")).alias("_t")).where("_t <> ''").distinct()
    hits = begun(t, items.select("id", F.lower("id").alias("_i")), "_t", "_i")
    w = Window.partitionBy("token")
    return hits.withColumn("_n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("id"))).where((F.col("_n") > 1) & (F.col("rank") <= limit)).select("token", "rank", "id")


#: Of the characters (numbered within a title) that are in most titles, so many are ranked by how many titles have them; the others count as rarer.
RANKED = 1000
#: Characters' counts are compared in so many classes of code points first.
CLASSES = 64


def numbered_characters(title: str) -> list[str]:
    """A title's multiset of characters as a set: the second e is another element than the first."""
    seen: dict[str, int] = {}
    out = []
    for c in title:
        seen[c] = seen.get(c, 0) + 1
        out.append(f"{c}{seen[c]}")
    return out


def scored(pairs: DataFrame, cutoff: float) -> DataFrame:
    """_t, _f, _s: the pairs of texts whose ratio is at least cutoff; the matcher sees those that the counts of characters still admit."""

    def counts(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct text how often each class of characters occurs, and which of them each row is."""
        at, distinct = pd.factorize(texts)
        table = np.zeros((len(distinct), CLASSES), np.int32)
        for k, text_ in enumerate(distinct):
            np.add.at(table[k], [ord(c) % CLASSES for c in text_], 1)
        return table, at

    @F.pandas_udf("double")
    def ratio(tokens: pd.Series, titles: pd.Series) -> pd.Series:
        (a, i), (b, j) = counts(tokens), counts(titles)
        both = np.minimum(a[i], b[j]).sum(1)
        size = a.sum(1)[i] + b.sum(1)[j]
        out = np.zeros(len(tokens))
        s, last = difflib.SequenceMatcher(), None
        for k in np.flatnonzero(2.0 * both >= cutoff * size):
            if tokens.iloc[k] != last:
                last = tokens.iloc[k]
                s.set_seq2(last)
            s.set_seq1(titles.iloc[k])
            out[k] = s.ratio() if s.quick_ratio() >= cutoff else 0.0
        return pd.Series(out)

    return pairs.withColumn("_s", ratio("_t", "_f")).where(F.col("_s") >= cutoff)


def similar(tokens: DataFrame, names: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """_t, _f, _s: the pairs of a text of tokens and one of names whose ratio (twice the matching characters by both lengths) is at least cutoff; both distinct.

    Matching characters are common ones, so a pair shares at least cutoff / (2 - cutoff) of the characters of either text. Then the
    two have one in common among those that are left when so many, the most frequent, are taken from each: an equality join over
    a text's rarer characters. A pair met at several is kept at the first. Only what the counts of characters still admit is scored.
    """
    share = cutoff / (2 - cutoff)

    @F.pandas_udf("array<string>")
    def elements(texts: pd.Series) -> pd.Series:
        return texts.map(numbered_characters)

    common = names.select(F.explode(elements("_f")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(RANKED)
    rank = {r["c"]: k for k, r in enumerate(reversed(common.collect()), 1)}

    @F.pandas_udf("array<string>")
    def rare(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[str]:
            most = sorted(numbered_characters(t), key=lambda c: (rank.get(c, 0), c))
            return most[: len(t) - math.ceil(len(t) * share - 1e-9) + 1]

        return texts.map(one)

    t = tokens.select("_t", rare("_t").alias("_p"))
    n = names.select("_f", rare("_f").alias("_q"))
    fits = F.length("_f").between(F.ceil(F.length("_t") * share - 1e-9), F.floor(F.length("_t") / share + 1e-9))
    met = t.withColumn("_c", F.explode("_p")).join(n.withColumn("_c", F.explode("_q")), "_c").where(fits)
    met = met.where(F.array_intersect("_p", "_q")[0] == F.col("_c")).select("_t", "_f")

    return scored(met, cutoff)


def closest(tokens: DataFrame, names: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """similar(), but of pairs only whose multisets of characters are equal or differ by one character that one of them has more.

    All other pairs have a ratio of at most n / (n + 1), n being the token's characters. Texts meet by equal sums of hashes of their
    characters, with all or with all but one of them, so the work grows with the texts, not with the pairs of them.
    """

    def hashes(text_: str) -> np.ndarray:
        x = np.frombuffer(text_.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))

    @F.pandas_udf("long")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([hashes(t).sum().view(np.int64) for t in texts], dtype="int64")

    @F.pandas_udf("array<long>")
    def lessened(texts: pd.Series) -> pd.Series:
        own = map(hashes, texts)
        return pd.Series([np.unique(h.sum() - h).view(np.int64) for h in own], dtype=object)

    t, n = tokens.select("_t", whole("_t").alias("_k")), names.select("_f", whole("_f").alias("_k"))
    fewer = lambda df, c: df.select(c, F.explode(lessened(c)).alias("_k"))
    met = [a.join(b.hint("merge"), "_k").select("_t", "_f") for a, b in ((t, n), (fewer(tokens, "_t"), n), (t, fewer(names, "_f")))]
    return scored(met[0].unionByName(met[1]).unionByName(met[2]).distinct(), cutoff)


def nearest(tokens: DataFrame, names: DataFrame, limit: int, cutoff: float = 0.6) -> DataFrame:
    """Pairs of similar(), of each token the ``limit`` best at least; only tokens that have fewer among the closest are held against all names."""
    first = stored(closest(tokens, names, cutoff), "closest")
    n = F.length("_t")
    settled = first.where(F.col("_s") > n / (n + 1) + 1e-9).groupBy("_t").agg(F.count("*").alias("_n")).where(F.col("_n") >= limit).select("_t")
    rest = stored(tokens.join(settled.hint("merge"), "_t", "left_anti"), "rest")
    return first if rest.isEmpty() else first.join(rest.hint("merge"), "_t", "left_anti").unionByName(similar(rest, names, cutoff))


def near_misses(tokens: DataFrame, items: DataFrame, limit: int = 3, cutoff: float = 0.6) -> DataFrame:
    """token, rank, id, title of up to ``limit`` items: titles the token begins in input order, then similar ones, best first.

    Titles are compared folded; distinct ones are scored once, and the prefix pass is a join on equal beginnings. What it fills isn't scored.
    """
    t = tokens.select("token").distinct().withColumn("_t", text.folded("token")).where("_t <> ''")
    i = items.where(F.coalesce("title", F.lit("")) != "").select("id", "title", "pos", text.folded("title").alias("_f"))
    prefix = begun(t, i, "_t", "_f").select("token", "id", "title", F.lit(0).alias("_pass"), F.lit(0.0).alias("_s"), F.lit("").alias("_f"), "pos")
    full = prefix.select("token", "id").distinct().groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") >= limit)
    open_ = stored(t.join(full.hint("merge"), "token", "left_anti"), "open")
    best = nearest(open_.select("_t").distinct(), i.select("_f").distinct(), limit, cutoff)
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("_s"), F.desc("_f")))).where(F.col("_n") <= limit)
    # Of each title no more than the first ids can be shown, once those of the prefix pass are put aside.
    first = i.groupBy("_f", "id").agg(F.min_by(F.struct("title", "pos"), "pos").alias("_i")).select("_f", "id", "_i.*")
    few = first.withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy("pos"))).where(F.col("_n") <= 2 * limit).drop("_n")
    fuzzy = open_.join(best, "_t").drop("_n").join(few, "_f").select("token", "id", "title", F.lit(1).alias("_pass"), "_s", "_f", "pos")
    order = ["_pass", F.desc("_s"), F.desc("_f"), "pos"]
    once = prefix.unionByName(fuzzy).withColumn("_d", F.row_number().over(Window.partitionBy("token", "id").orderBy(*order))).where("_d = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(*order))).where(F.col("rank") <= limit).select("token", "rank", "id", "title")


def labelled_or_near(tokens: DataFrame, labels: DataFrame, limit: int = 3) -> DataFrame:
    """by_label(), and for tokens that nothing fits the near misses by name: near_ids, best first (at most ``limit``; else null)."""
    found = stored(by_label(tokens, labels), "found")
    order = labels.select("id", F.col("name").alias("title"), F.col("id").alias("pos"))
    near = near_misses(found.where("verdict = 'none'").select("token"), order, limit)
    listed = near.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("near_ids"))
    return found.join(listed, "token", "left")
