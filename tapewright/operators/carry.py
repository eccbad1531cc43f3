"""Running values of a long ordered history, without putting a whole key into one task.

The history of a key is cut into buckets of its order. Each bucket's value comes from a small table with a row per
bucket; within a bucket it is an ordinary window. Keys may be null, as any other value; rows without an order come before
all others, in a bucket of their own. order is a long column, or one and then others that settle its ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 100_000


def names(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def bucketed(rows: DataFrame, keys: list[str], order: str | list[str], bucket: int = BUCKET) -> DataFrame:
    """Adds _key, the keys and the bucket in one struct: structs with nulls in the same places are equal, in joins too."""
    return rows.withColumn("_key", F.struct(*keys, F.floor(F.col(names(order)[0]) / bucket).alias("_bucket")))


def with_carried(cut: DataFrame, keys: list[str], values: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Joins to each row of bucketed() what other buckets of its key say: values are sums of a bucket, carried are made of them over the row of a key's buckets (the window `W`)."""
    per = cut.groupBy("_key").agg(*[v.alias(name) for name, v in values.items()])
    return cut.join(per.select("_key", *[c.alias(name) for name, c in carried.items()]), "_key")


def buckets_of(keys: list[str]) -> Window:
    """A key's buckets in order."""
    return Window.partitionBy(*[F.col("_key")[k] for k in keys]).orderBy(F.col("_key")["_bucket"])


def before(keys: list[str]) -> Window:
    return buckets_of(keys).rowsBetween(Window.unboundedPreceding, -1)


def within(order: str | list[str]) -> Window:
    return Window.partitionBy("_key").orderBy(*names(order))


def upto(order: str | list[str]) -> Window:
    """To this place in the order: with one column, rows of the same place count together."""
    own = within(order)
    return own.rangeBetween(Window.unboundedPreceding, 0) if len(names(order)) == 1 else own.rowsBetween(Window.unboundedPreceding, 0)


def running_last(rows: DataFrame, keys: list[str], order, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds name: the largest value so far; null values are skipped."""
    cut = bucketed(rows.withColumn("_value", value), keys, order, bucket)
    both = with_carried(cut, keys, {"_most": F.max("_value")}, {"_carried": F.max("_most").over(before(keys))})
    return both.withColumn(name, F.coalesce(F.max("_value").over(upto(order)), "_carried")).drop("_value", "_key", "_carried")


def running_sum(rows: DataFrame, keys: list[str], order, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds name: the sum of value up to and with this place in the order."""
    cut = bucketed(rows.withColumn("_value", value), keys, order, bucket)
    both = with_carried(cut, keys, {"_all": F.sum("_value")}, {"_carried": F.coalesce(F.sum("_all").over(before(keys)), F.lit(0))})
    return both.withColumn(name, F.coalesce(F.sum("_value").over(upto(order)), F.lit(0)) + F.col("_carried")).drop("_value", "_key", "_carried")


def running_lag(rows: DataFrame, keys: list[str], order, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds name: the value of the row before this one in the order; null for the first."""
    cut = bucketed(rows.withColumn("_value", value), keys, order, bucket)
    last = F.max(F.struct(*names(order), "_value"))
    both = with_carried(cut, keys, {"_last": last}, {"_carried": F.lag("_last").over(buckets_of(keys))})
    both = both.withColumns({"_nth": F.row_number().over(within(order)), "_own": F.lag("_value").over(within(order))})
    return both.withColumn(name, F.when(F.col("_nth") == 1, F.col("_carried")["_value"]).otherwise(F.col("_own"))).drop("_value", "_key", "_carried", "_nth", "_own")
