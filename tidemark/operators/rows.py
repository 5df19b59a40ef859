"""Keep-first, latest, paging and set operations with an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order. Rows without a key go: a null one, or an empty text."""
    usable = df
    for k in keys:
        usable = usable.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return usable.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def newest(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; none where n is not positive."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def selected(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, with how many there were and why it was taken."""
    counts = df.groupBy(*[F.col(k).alias("_" + k) for k in key]).agg(F.count("*").alias("n_matches"))
    first = newest(df, key, order, 1)  # of a key, each task passes on one row only
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in key]
    out = first.join(counts, same).drop(*["_" + k for k in key])
    return out.withColumn("reason", F.when(F.col("n_matches") == 1, "only one").otherwise(F.concat(F.lit("first of "), F.col("n_matches"))))


def chosen(items: DataFrame, asked: DataFrame, group: str) -> DataFrame:
    """asked: a group, id, name, earliest. Of items (group, id, title, created_at in seconds, pos) the one that each row asks for: asked's columns, chosen, n_matches, reason, error.

    An id decides alone; else items whose title holds the name (case doesn't matter; none: all), and of several the latest or the earliest:
    what has no time is before all others, and of equal times the first counts.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    first = F.coalesce(F.col("earliest"), F.lit(False))
    named = asked.withColumns({"_a": F.nullif(F.col("id"), F.lit("")), "_b": low(F.col("name"))})
    i = items.select(F.col(group).alias("_g"), F.col("id").alias("_id"), low(F.col("title")).alias("_t"), F.coalesce("created_at", F.lit(0)).alias("_c"), "pos")
    ends = [F.min(F.struct("_c", "pos", "_id")).alias("_first"), F.min(F.struct(-F.col("_c"), "pos", "_id")).alias("_last")]
    # An id is met by equality; a name is looked for in a group's distinct titles, not in every item.
    ids = named.select(F.col(group).alias("_g"), F.col("_a").alias("_id")).distinct().join(i, ["_g", "_id"]).groupBy("_g", F.col("_id").alias("_i")).agg(F.count("*").alias("_n"), *ends)
    titles = i.groupBy("_g", "_t").agg(F.count("*").alias("_n"), *ends)
    words = named.where("_a IS NULL").select(F.col(group).alias("_g"), F.col("_b").alias("_w")).distinct()
    hits = words.join(titles, "_g").where(F.contains("_t", "_w")).groupBy("_g", "_w").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.min("_last").alias("_last"))
    there = titles.select("_g").distinct().withColumn("_all", F.lit(True))
    out = named.join(there, F.col(group) == F.col("_g"), "left").drop("_g")
    out = out.join(ids, (F.col(group) == F.col("_g")) & (F.col("_a") == F.col("_i")), "left").withColumnsRenamed({"_n": "_n_id", "_first": "_first_id", "_last": "_last_id"}).drop("_g")
    out = out.join(hits, (F.col(group) == F.col("_g")) & F.col("_a").isNull() & (F.col("_b") == F.col("_w")), "left").drop("_g")
    chosen_id = F.when(first, F.coalesce("_first_id", "_first")["_id"]).otherwise(F.coalesce("_last_id", "_last")["_id"])
    out = out.withColumns({"chosen": chosen_id, "n_matches": F.coalesce("_n_id", "_n", F.lit(0))})
    n = F.col("n_matches")
    many = F.concat(F.when(first, "earliest of ").otherwise("latest of "), n.cast("string"))
    reason = F.when(n == 0, None).when(F.col("_i").isNotNull(), "matched by id").when(n > 1, many).otherwise(F.when(F.col("_w") != "", "matched by name").otherwise("only one"))
    error = F.when(F.col("_all").isNull(), "nothing there").when((n == 0) & F.col("_a").isNotNull(), "id not found").when(n == 0, "no title matches")
    return out.select(*asked.columns, "chosen", "n_matches", reason.alias("reason"), error.alias("error"))


def page(df: DataFrame, order: Sequence[Column | str], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows offset..offset+limit with total and has_more. Without a limit, all rows; an offset needs a limit."""
    if limit is None:
        if offset:
            raise ValueError("an offset needs a limit")
        return df.orderBy(*order)
    if limit < 1 or offset < 0:
        raise ValueError("limit is at least 1 and offset at least 0")
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df with ``place``, from 1, in a total order: counted within stored range partitions, after the rows of all earlier ones."""
    parts = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))  # a row per partition
    return parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, **sums: Column) -> DataFrame:
    """df with the running total of each of sums within each key, its own row included, in an order that is total within it.

    Sums run within stored range partitions. What a key has in earlier partitions is added where it goes over from one to the next: that
    are no more rows than partitions, so they go to every task; no key meets in one task, however few keys there are.
    """
    held = df
    for k, c in sums.items():
        held = held.withColumn(k, c.cast("long"))
    parts = stored(held.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), name)
    so_far = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = parts.groupBy(*[F.col(k).alias("_" + k) for k in keys], F.col("_p").alias("_q")).agg(F.count("*").alias("_rows"), *[F.sum(k).alias("_of_" + k) for k in sums])
    earlier = Window.partitionBy(*["_" + k for k in keys]).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*["_" + k for k in keys], "_q", F.sum("_rows").over(earlier).alias("_rows"), *[F.sum("_of_" + k).over(earlier).alias("_of_" + k) for k in sums]).where("_rows > 0").drop("_rows")
    same = [F.col("_p") == F.col("_q"), *[F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]]
    out = parts.select(*df.columns, "_p", *[F.sum(k).over(so_far).alias(k) for k in sums]).join(F.broadcast(each), same, "left")
    return out.select(*df.columns, *[(F.col(k) + F.coalesce("_of_" + k, F.lit(0))).alias(k) for k in sums])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """df with ``name``: 1, 2, 3 within each key, in an order that is total within it."""
    return ranged(df, keys, order, "numbered", **{name: F.lit(1)})


def pieced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: Column, most: int) -> DataFrame:
    """df with ``place`` (from 1) and ``piece`` (from 0) within each key: in a total order, so many rows a piece that their sizes before each add up to less than most."""
    sums = ranged(df.withColumn("_s", size.cast("long")), keys, order, "pieces", place=F.lit(1), _sum=F.col("_s"))
    return sums.select(*df.columns, "place", F.floor((F.col("_sum") - F.col("_s")) / most).alias("piece"))


def envelope(df: DataFrame, limit: Column, offset: Column, keys: Sequence[str], order: Sequence[Column | str], most: int = 1000) -> DataFrame:
    """Pages of groups, each with a limit and an offset of its own: keys, total, returned, has_more, problem.

    No limit gives everything and no has_more; an offset without a limit, or a limit out of range, is a problem and gives nothing.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    told = df.withColumn("_n", n).withColumn("_l", limit).withColumn("_o", F.coalesce(offset, F.lit(0)))
    on = F.col("_l").isNull() | ((F.col("_n") > F.col("_o")) & (F.col("_n") <= F.col("_o") + F.col("_l")))
    rows = told.groupBy(*keys).agg(F.count("*").alias("total"), F.count(F.when(on, 1)).alias("returned"), F.first("_l").alias("_l"), F.first("_o").alias("_o"))
    problem = F.when(F.col("_l").isNull() & (F.col("_o") != 0), "offset requires limit").when(~F.col("_l").between(1, most), "limit out of range").when(F.col("_o") < 0, "negative offset")
    bad = problem.isNotNull()
    return rows.select(*keys, "total", F.when(bad, 0).otherwise(F.col("returned")).cast("long").alias("returned"), F.when(~bad & F.col("_l").isNotNull(), F.col("total") > F.col("_o") + F.col("_l")).alias("has_more"), problem.alias("problem"))


def union_first(key: Sequence[str], order: Sequence[Column | str], *dfs: DataFrame) -> DataFrame:
    """Rows of all tables, the earlier table's first on equal keys."""
    out = dfs[0].withColumn("_prio", F.lit(0))
    for k, df in enumerate(dfs[1:], 1):
        out = out.unionByName(df.withColumn("_prio", F.lit(k)), allowMissingColumns=True)
    return keep_first(out, key, ["_prio", *order]).drop("_prio")


def distinct_in_order(df: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """Of each group, the distinct values in order of first appearance, as an array."""
    firsts = df.groupBy(*group, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias(value + "s"))
