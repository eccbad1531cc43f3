"""Liquidity of price levels over time slices of many lengths, with a score of how lasting it is.

Samples of the book lie on a grid. A level's quantity is constant between changes, so the samples in a slice are counted
from the interval's ends and never written out; sampled_levels() writes them out and must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.book import band_filter, carry_forward, depth_limit
from tapewright.operators.carry import before, bucketed, buckets_of, running_sum, with_carried, within

#: Places of a grid within which a price bucket's changes are ordered in one task.
GRID_BUCKET = 100_000
#: Slices of a length that one task numbers.
SLICE_BUCKET = 10_000

KEY = ["product_id", "timeframe_ms", "slice_start", "side", "tick"]


def piecewise(grid: DataFrame, resolution: float, tick_size: float = 1.0) -> DataFrame:
    """Quantities by price bucket: constant stretches (product_id, side, tick, qty, from_g, to_g) where any level is present.

    Sums run in decimals and presence is an integer count, so nothing is left over where all levels are gone."""
    bucket = F.round(F.col("tick") * tick_size / resolution).cast("long").alias("tick")
    amount = F.col("qty").cast("decimal(30,8)")
    edge = lambda g, sign: F.struct(F.col(g).alias("g"), (amount * sign).alias("d"), F.lit(sign).alias("k"))
    both = grid.select("product_id", "side", bucket, F.explode(F.array(edge("from_g", 1), edge("to_g", -1))).alias("e"))
    edges = both.groupBy("product_id", "side", "tick", F.col("e.g").alias("g")).agg(F.sum("e.d").alias("d"), F.sum("e.k").alias("k"))
    keys = ["product_id", "side", "tick"]
    totals = {"_d": F.sum("d"), "_k": F.sum("k"), "_g": F.min("g")}
    carried = {"_sum": F.sum("_d").over(before(keys)), "_present": F.sum("_k").over(before(keys)), "_next": F.lead("_g").over(buckets_of(keys))}
    cut = with_carried(bucketed(edges, keys, "g", GRID_BUCKET), keys, totals, carried)
    so_far = lambda c, known: F.sum(c).over(within("g")) + F.coalesce(known, F.lit(0))
    nxt = F.coalesce(F.lead("g").over(within("g")), "_next")
    runs = cut.select(*keys, F.col("g").alias("from_g"), nxt.alias("to_g"), so_far("d", "_sum").alias("sum"), so_far("k", "_present").alias("present"))
    return runs.filter("present > 0").select("product_id", "side", "tick", F.col("sum").cast("double").alias("qty"), "from_g", "to_g")


def slice_liquidity(grid: DataFrame, timeframes: list[int], step_ms: int, resolution: float, tick_size: float = 1.0) -> DataFrame:
    """total, snapshot_count, avg, max, min, first_seen, own_last and slice_last of every level in every slice."""
    runs = piecewise(grid, resolution, tick_size)
    rows = runs.withColumn("timeframe_ms", F.explode(F.array(*[F.lit(t).cast("long") for t in timeframes])))
    # first grid point at or after a time t is ceil(t / step)
    at = lambda c: F.expr(f"({c} + {step_ms - 1}) div {step_ms}")
    first, last = F.expr(f"from_g * {step_ms} div timeframe_ms"), F.expr(f"(to_g - 1) * {step_ms} div timeframe_ms")
    rows = rows.withColumn("slice", F.explode(F.sequence(first, last))).withColumn("slice_start", F.col("slice") * F.col("timeframe_ms"))
    rows = rows.withColumn("a", F.greatest("from_g", at("slice_start"))).withColumn("b", F.least("to_g", at("(slice_start + timeframe_ms)"))).withColumn("n", F.col("b") - F.col("a")).filter("n > 0")
    metrics = rows.groupBy(*KEY).agg(
        F.sum(F.col("qty") * F.col("n")).alias("total"),
        F.sum("n").alias("snapshot_count"),
        F.max("qty").alias("max"),
        F.min("qty").alias("min"),
        (F.min("a") * step_ms).alias("first_seen"),
        ((F.max("b") - 1) * step_ms).alias("own_last"),
    )
    return with_slice_last(metrics.withColumn("avg", F.col("total") / F.col("snapshot_count")))


def lengths_with_data(grid: DataFrame, timeframes: list[int]) -> DataFrame:
    """(timeframe_ms) for which there are slices: any stretch of the grid lies in one of each length, so none has to be built."""
    return grid.filter("from_g < to_g").limit(1).select(F.explode(F.array(*[F.lit(t).cast("long") for t in timeframes])).alias("timeframe_ms"))


def slice_messages(intervals: DataFrame, samples: DataFrame, timeframes: list[int], resolution: float, tick_size: float = 1.0) -> DataFrame:
    """slice_liquidity() where every update message is a sample: intervals and samples of book.message_intervals() and message_samples().

    The non-empty slices of a product are numbered; a stretch finds the slices of its first and last sample by equality, takes those between, and is clipped to the
    samples of each."""
    every = samples.filter("is_update = 1").select("product_id", "g", "ts_ms").withColumn("timeframe_ms", F.explode(F.array(*[F.lit(t).cast("long") for t in timeframes])))
    every = every.withColumn("slice_start", slice_start(F.col("ts_ms"), F.col("timeframe_ms")))
    bounds = every.groupBy("product_id", "timeframe_ms", "slice_start").agg(F.min("g").alias("lo"), (F.max("g") + 1).alias("hi"))
    bounds = running_sum(bounds.withColumn("_slice", F.expr("slice_start div timeframe_ms")), ["product_id", "timeframe_ms"], "_slice", F.lit(1), "d", SLICE_BUCKET).drop("_slice")
    numbered = every.join(bounds.select("product_id", "timeframe_ms", "slice_start", "d"), ["product_id", "timeframe_ms", "slice_start"]).select("product_id", "timeframe_ms", "g", "d")
    runs = piecewise(intervals, resolution, tick_size).withColumn("last_g", F.col("to_g") - 1)
    at = lambda g, d: numbered.select("product_id", "timeframe_ms", F.col("g").alias(g), F.col("d").alias(d))
    rows = runs.join(at("from_g", "d0"), ["product_id", "from_g"]).join(at("last_g", "d1"), ["product_id", "timeframe_ms", "last_g"])
    rows = rows.withColumn("d", F.explode(F.sequence("d0", "d1"))).join(bounds, ["product_id", "timeframe_ms", "d"])
    rows = rows.withColumn("a", F.greatest("from_g", "lo")).withColumn("b", F.least("to_g", "hi")).withColumn("n", F.col("b") - F.col("a")).filter("n > 0")
    metrics = rows.groupBy(*KEY).agg(F.sum(F.col("qty") * F.col("n")).alias("total"), F.sum("n").alias("snapshot_count"), F.max("qty").alias("max"), F.min("qty").alias("min"), F.min("a").alias("a"), (F.max("b") - 1).alias("b"))
    when = lambda g, ts: samples.filter("is_update = 1").select("product_id", F.col("g").alias(g), F.col("ts_ms").alias(ts))
    metrics = metrics.join(when("a", "first_seen"), ["product_id", "a"]).join(when("b", "own_last"), ["product_id", "b"]).drop("a", "b")
    return with_slice_last(metrics.withColumn("avg", F.col("total") / F.col("snapshot_count")))


def with_slice_last(metrics: DataFrame) -> DataFrame:
    """Adds slice_last: the last sample of the slice that has any level. A slice has a row for each level, few; who doesn't read the column doesn't pay for it."""
    return metrics.withColumn("slice_last", F.max("own_last").over(Window.partitionBy("product_id", "timeframe_ms", "slice_start")))


def sampled_levels(grid: DataFrame, resolution: float, tick_size: float = 1.0, depth: int | None = None, band: dict | None = None) -> DataFrame:
    """Each sample's levels by price bucket, cut to a depth or a band around the mid: (product_id, g, side, tick, qty)."""
    levels = carry_forward(grid)
    if depth is not None:
        levels = depth_limit(levels, depth, "g")
    if band is not None:
        levels = band_filter(levels, at="g", tick_size=tick_size, **band)
    bucket = F.round(F.col("tick") * tick_size / resolution).cast("long").alias("tick")
    return levels.groupBy("product_id", "g", "side", bucket).agg(F.sum("qty").alias("qty"))


def slice_samples(samples: DataFrame, timeframes: list[int], step_ms: int) -> DataFrame:
    """slice_liquidity() from written-out samples."""
    rows = samples.withColumn("timeframe_ms", F.explode(F.array(*[F.lit(t).cast("long") for t in timeframes])))
    rows = rows.withColumn("ts_ms", F.col("g") * step_ms).withColumn("slice_start", slice_start(F.col("ts_ms"), F.col("timeframe_ms")))
    metrics = rows.groupBy(*KEY).agg(
        F.sum("qty").alias("total"), F.count(F.lit(1)).alias("snapshot_count"), F.max("qty").alias("max"), F.min("qty").alias("min"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("own_last")
    )
    return with_slice_last(metrics.withColumn("avg", F.col("total") / F.col("snapshot_count")))


def slice_start(ts_ms: Column, timeframe_ms: Column) -> Column:
    return (F.floor(ts_ms / timeframe_ms) * timeframe_ms).cast("long")


def with_persistence(slices: DataFrame, mode: str = "reference", threshold: float = 0.8) -> DataFrame:
    """Adds persistence and resting. mode reference measures up to the slice's last sample, strict up to the level's own.

    A closed slice rests at avg if persistence is over the threshold; the latest slice of a product and length, still open, if it has more than 2 samples."""
    last = F.col({"reference": "slice_last", "strict": "own_last"}[mode])
    held = last - F.col("first_seen")
    ratio = F.when((F.col("timeframe_ms") > 0) & (held > 0), held / F.col("timeframe_ms")).otherwise(0.0)
    newest = slices.groupBy("product_id", "timeframe_ms").agg(F.max("slice_start").alias("newest"))
    rows = slices.withColumn("persistence", ratio).join(newest, ["product_id", "timeframe_ms"]).withColumn("is_open", F.col("slice_start") == F.col("newest")).drop("newest")
    rests = F.when(F.col("is_open"), F.col("snapshot_count") > 2).otherwise(F.col("persistence") > threshold)
    return rows.withColumn("resting", F.when(rests, F.col("avg")).otherwise(0.0))


def spoof_candidates(scored: DataFrame) -> DataFrame:
    """Levels that don't rest; consistent says whether they were seen more than twice."""
    return scored.filter("resting = 0").withColumn("consistent", F.col("snapshot_count") > 2)


def display_value(mode: str) -> Column:
    return F.col({"average": "avg", "maximum": "max", "resting": "resting", "total": "total"}.get(mode, "avg"))


def tick_range(slices: DataFrame) -> DataFrame:
    return slices.groupBy("product_id", "timeframe_ms", "slice_start").agg(F.min("tick").alias("min_tick"), F.max("tick").alias("max_tick"))


def level_metrics(slices: DataFrame, price: float, side: str, resolution: float) -> DataFrame:
    return slices.filter((F.col("tick") == round(price / resolution)) & (F.col("side") == side))


def rollup_pyramid(slices: DataFrame, fine_ms: int, coarse_ms: int) -> DataFrame:
    """A coarser length from finer slices; it must be a multiple."""
    if coarse_ms % fine_ms:
        raise ValueError(f"{coarse_ms} isn't a multiple of {fine_ms}")
    rows = slices.filter(F.col("timeframe_ms") == fine_ms).withColumn("slice_start", slice_start(F.col("slice_start"), F.lit(coarse_ms))).withColumn("timeframe_ms", F.lit(coarse_ms).cast("long"))
    metrics = rows.groupBy(*KEY).agg(
        F.sum("total").alias("total"), F.sum("snapshot_count").alias("snapshot_count"), F.max("max").alias("max"), F.min("min").alias("min"), F.min("first_seen").alias("first_seen"), F.max("own_last").alias("own_last")
    )
    return with_slice_last(metrics.withColumn("avg", F.col("total") / F.col("snapshot_count")))


def cells_per_slice(cells: DataFrame) -> DataFrame:
    return cells.groupBy("product_id", "slice_start").agg(F.count(F.lit(1)).alias("cells"))


def timeframe_coverage(slices: DataFrame) -> DataFrame:
    return slices.groupBy("product_id", "timeframe_ms").agg(F.countDistinct("slice_start").alias("points"))
