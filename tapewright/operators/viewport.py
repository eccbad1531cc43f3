"""Queries for a visible range of time and price over liquidity slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.slices import display_value

FINEST_MS = 100


def slice_at(slices: DataFrame, timeframe_ms: int, ts_ms: int) -> DataFrame:
    """The slice with start <= ts < end."""
    return slices.filter((F.col("timeframe_ms") == timeframe_ms) & (F.col("slice_start") <= ts_ms) & (F.col("slice_start") > ts_ms - timeframe_ms))


def visible_slices(slices: DataFrame, timeframe_ms: int, t0: int, t1: int) -> DataFrame:
    """Slices that touch [t0, t1], both ends included, the open one too."""
    return slices.filter((F.col("timeframe_ms") == timeframe_ms) & (F.col("slice_start") >= t0 - timeframe_ms) & (F.col("slice_start") <= t1))


def suggest_timeframe(slices: DataFrame, t0: int, t1: int, max_slices: int = 4000) -> DataFrame:
    """One row: the finest length with data that needs at most max_slices for the range, else the finest with data, else FINEST_MS."""
    span = t1 - t0
    there = slices.select("timeframe_ms").distinct()
    fits = F.min(F.when(F.expr(f"{span}L div timeframe_ms") <= max_slices, F.col("timeframe_ms")))
    found = there.agg(F.coalesce(fits, F.min("timeframe_ms"), F.lit(FINEST_MS).cast("long")).alias("timeframe_ms"))
    return found if span > 0 else found.select(F.lit(FINEST_MS).cast("long").alias("timeframe_ms"))


def in_view(grid: DataFrame, timeframe_ms: int, t0: int, t1: int, step_ms: int) -> DataFrame:
    """The stretches of a grid that slices of [t0, t1] can see, cut to these slices: what lies outside isn't summed up."""
    first = (t0 - timeframe_ms + timeframe_ms - 1) // timeframe_ms * timeframe_ms  # start of the first slice that ends at t0 or later
    last = t1 // timeframe_ms * timeframe_ms + timeframe_ms
    low, high = -(-first // step_ms), -(-last // step_ms)
    rows = grid.filter((F.col("to_g") > low) & (F.col("from_g") < high))
    return rows.withColumns({"from_g": F.greatest("from_g", F.lit(low)), "to_g": F.least("to_g", F.lit(high))})


def heatmap_cells(scored: DataFrame, timeframe_ms: int, t0: int, t1: int, price_min: float, price_max: float, resolution: float, mode: str = "average") -> DataFrame:
    """Visible cells: their time and price edges, liquidity and intensity. Slices do for scored unless the mode is resting."""
    price = F.col("tick") * resolution
    rows = visible_slices(scored, timeframe_ms, t0, t1).withColumn("liquidity", display_value(mode)).filter((price >= price_min) & (price <= price_max) & (F.col("liquidity") > 0))
    return rows.select(
        "product_id",
        "side",
        "slice_start",
        (F.col("slice_start") + F.col("timeframe_ms")).alias("slice_end"),
        (price - resolution / 2).alias("price_low"),
        (price + resolution / 2).alias("price_high"),
        "liquidity",
        F.least(F.lit(1.0), F.col("liquidity") / 1000).alias("intensity"),
        "snapshot_count",
    )


def data_extent(slices: DataFrame) -> DataFrame:
    return slices.groupBy("timeframe_ms").agg(F.min("slice_start").alias("oldest"), F.max(F.col("slice_start") + F.col("timeframe_ms")).alias("newest"))


def available_timeframes(slices: DataFrame) -> DataFrame:
    return slices.select("timeframe_ms").distinct()


def newest_cells(cells: DataFrame, max_cells: int = 100_000, min_volume: float = 0.0) -> DataFrame:
    """The newest cells first, and only then those with the volume."""
    order = [F.col("slice_end").desc(), F.col("slice_start").desc(), "product_id", "side", "price_low"]
    return cells.orderBy(*order).limit(max_cells).filter(F.col("liquidity") >= min_volume)


def retain(slices: DataFrame, max_slices: int = 5000) -> DataFrame:
    """The newest slices of each product and length. Their starts are ranked as a small table of their own."""
    from pyspark.sql import Window

    starts = slices.select("product_id", "timeframe_ms", "slice_start").distinct()
    rank = F.row_number().over(Window.partitionBy("product_id", "timeframe_ms").orderBy(F.col("slice_start").desc()))
    kept = starts.withColumn("rank", rank).filter(F.col("rank") <= max_slices).drop("rank")
    return slices.join(kept, ["product_id", "timeframe_ms", "slice_start"], "left_semi")


def unprocessed(slices: DataFrame, done: DataFrame) -> DataFrame:
    """Slices whose (product, length, start) isn't among the done ones."""
    return slices.join(done, ["product_id", "timeframe_ms", "slice_start"], "left_anti")
