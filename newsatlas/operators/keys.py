"""One row per key, top-k per key, and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsatlas.session import cut, pin

BROADCAST_KEYS = 200_000  # keys that a broadcast may hold
HOT_SHARE = 0.001  # a key is hot above this share of the rows, so at most 1/share keys are hot


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each key.

    The rank filter lets Spark apply the limit before the shuffle (partial group limit), so a hot key
    sends at most k rows per input partition to its task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= k)


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "__rank").drop("__rank")


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: at most 1/share rows by construction."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)))
    return counts.where(F.col("__n") > total.scalar() * F.lit(share)).select(key)


def lookup(df: DataFrame, table: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Left join with a table that is unique on ``key``, whatever the skew of ``df``.

    Rows of hot keys meet a broadcast of the matching table rows (at most 1/share of them); all other
    rows take the shuffled join. Both inputs should be materialised, since each is read more than once.
    """
    hot = hot_keys(df, key, share)
    marked = df.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    heavy = marked.where("__hot").drop("__hot")
    light = marked.where("__hot IS NULL").drop("__hot")
    few = table.join(F.broadcast(hot), key, "left_semi")
    return heavy.join(F.broadcast(few), key, "left").unionByName(light.join(table, key, "left"))


def keep_keys(df: DataFrame, keys: DataFrame, key: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of a wide table whose key is wanted.

    The keys are written out and counted: up to ``most`` of them travel to the rows, which then need not move; more
    take the shuffled semi join.
    """
    wanted = cut(keys.select(key).distinct())
    return df.join(F.broadcast(wanted) if wanted.count() <= most else wanted, key, "left_semi")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """One row per key; a second row for a key fails the job.

    Meant for narrow tables. The grouping leaves the rows partitioned by the key, so a join on it
    that follows needs no further shuffle.
    """
    rest = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest)).alias("__row"))
    message = F.concat(F.lit("duplicate key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    sound = F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return packed.where(sound).select(key, *[F.col("__row")[c].alias(c) for c in rest])


def ranked_list(value: str | Column, rank: str = "rank", when: Column | None = None) -> Column:
    """Aggregate: values of a bounded top-k, in rank order."""
    item = F.struct(F.col(rank).alias("r"), (F.col(value) if isinstance(value, str) else value).alias("v"))
    kept = F.collect_list(item if when is None else F.when(when, item))
    return F.transform(F.array_sort(kept), lambda x: x["v"])


def bucketed_lag(df: DataFrame, group: str, order: str, value: str, width: int, out: str) -> DataFrame:
    """Previous value inside each group, without one task per group.

    ``order`` is a whole number, unique in its group. Rows are cut into ranges of ``width`` numbers;
    the lag runs inside a range, and the first row of a range takes the last value of the range before.
    """
    cut = df.withColumn("__b", F.floor(F.col(order) / F.lit(width)))
    inside = Window.partitionBy(group, "__b").orderBy(order)
    edges = cut.groupBy(group, "__b").agg(F.max_by(value, order).alias("__last"))
    carried = edges.select(
        group, "__b", F.lag("__last").over(Window.partitionBy(group).orderBy("__b")).alias("__carry")
    )
    local = cut.withColumn("__prev", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    joined = local.join(carried, [group, "__b"], "left")
    return joined.withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))).drop(
        "__b", "__prev", "__first", "__carry"
    )


def consecutive_ids(df: DataFrame, key: str, *order: Column, out: str = "semantic_series_id") -> DataFrame:
    """(key, out): positions 1..n in a global order, from range-sorted partitions and their row counts.

    The running count covers one row per partition, so no task sees all rows.
    """
    marks = [o.alias(f"o{i}") for i, o in enumerate(order)]
    ranged = pin(df.select(key, *marks).orderBy(*[f"o{i}" for i in range(len(order))]))
    spot = ranged.select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    heads = spot.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m0"))
    before = F.sum("n").over(Window.orderBy("p")) - F.col("n")
    heads = heads.select("p", "m0", before.alias("before"))
    return spot.join(F.broadcast(heads), "p").select(key, (F.col("before") + F.col("m") - F.col("m0") + 1).alias(out))
