"""Trades: the latest, the largest, price changes, bars, and their relation to the book."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tapewright.operators.carry import before, bucketed, running_lag, running_sum, with_carried


def recent_trades(trades: DataFrame, n: int = 1000) -> DataFrame:
    """The last n of each product as they came in; the window keeps n rows of a partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("ingest_seq").desc()))
    return trades.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def recent_trades_overall(trades: DataFrame, n: int = 1000) -> DataFrame:
    return trades.orderBy(F.col("ingest_seq").desc()).limit(n)


def largest_trades(trades: DataFrame, min_size: float, n: int) -> DataFrame:
    return trades.filter(F.col("size") >= min_size).orderBy(F.col("size").desc(), "trade_id").limit(n)


def trades_since(trades: DataFrame, product: str, last_id: str = "") -> DataFrame:
    """Trades of a product after the one with last_id; all if the id is empty or unknown."""
    own = trades.filter(F.col("product_id") == product)
    if not last_id:
        return own
    mark = own.filter(F.col("trade_id") == last_id).agg(F.coalesce(F.max("ingest_seq"), F.lit(-1)).alias("mark"))
    return own.join(F.broadcast(mark), F.col("ingest_seq") > F.col("mark")).drop("mark")  # one row


def trade_flow(trades: DataFrame, min_size: float, n: int) -> DataFrame:
    return trades.filter((F.col("size") > 0) & (F.col("size") >= min_size)).orderBy("ingest_seq").limit(n)


def last_price_change(trades: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Each trade with the change from the product's previous one, in price and per cent; 0 for the first. Trades without an ingest_seq come first."""
    rows = running_lag(trades, ["product_id"], "ingest_seq", F.col("price"), "previous", bucket)
    change = F.coalesce(F.col("price") - F.col("previous"), F.lit(0.0))
    rows = rows.withColumn("change", change).withColumn("change_pct", F.when(F.col("previous") > 0, F.col("change") / F.col("previous") * 100).otherwise(0.0))
    return rows.select(*trades.columns, "change", "change_pct")


def quotes(trades: DataFrame) -> DataFrame:
    """The latest price and change of each product."""
    rows = last_price_change(trades)
    return rows.groupBy("product_id").agg(F.max_by(F.struct("price", "change", "change_pct"), "ingest_seq").alias("q")).select("product_id", "q.*")


def relative_size(trades: DataFrame, lo: float = 4.0, hi: float = 20.0, scope: tuple = ("product_id",)) -> DataFrame:
    """Sizes on a square root and logarithmic scale from lo to hi against the scope's largest; lo if that is not positive.

    The largest is a small aggregate joined back, so a large scope isn't one task. Rows without a value of the scope are a scope of their own."""
    of = F.struct(*scope).alias("of") if scope else F.lit(0).alias("of")  # equal with nulls in the same places
    most = trades.groupBy(of).agg(F.max("size").alias("most"))
    share = F.sqrt(F.log1p(F.greatest("size", F.lit(0.0))) / F.log1p("most"))
    rows = trades.withColumn("of", of).join(most if scope else F.broadcast(most), "of")
    return rows.withColumn("radius", F.when(F.col("most") > 0, lo + share * (hi - lo)).otherwise(lo)).drop("most", "of")


def volume_profile(trades: DataFrame, resolution: float) -> DataFrame:
    tick = F.round(F.col("price") / resolution).cast("long").alias("price_tick")
    return trades.groupBy("product_id", tick).agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_trades"))


def ohlc(trades: DataFrame, timeframe_ms: int) -> DataFrame:
    """Bars of each product, with whether they rose and whether they are well formed."""
    start = (F.floor(F.col("ts_ms") / timeframe_ms) * timeframe_ms).cast("long").alias("bar_start")
    order = F.struct("ts_ms", "ingest_seq")
    bars = trades.groupBy("product_id", start).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_trades")
    )
    valid = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    return bars.withColumn("bullish", F.col("close") >= F.col("open")).withColumn("valid", valid)


def trade_batches(trades: DataFrame, ms: int = 75, n: int = 50) -> DataFrame:
    """Trades in batches that end after so many ms or trades. Windows of time are fixed: a batch that was full ends early, and the window goes on with
    the next one, where a live buffer would restart its clock (live_batches); so a batch depends on its own window alone."""
    rows = trades.withColumn("window", F.floor(F.col("ts_ms") / ms))
    nth = F.row_number().over(Window.partitionBy("product_id", "window").orderBy("ingest_seq"))
    return rows.withColumn("batch", F.ceil(nth / n).cast("int"))


def _next_flush(ts: np.ndarray, ms: int, n: int) -> np.ndarray:
    """Of each trade, as a flush: the place of the next one, which comes ms later or n trades on; -1 if the trades end before."""
    out, places = np.full(len(ts), -1), np.arange(len(ts))
    for d in range(n, 0, -1):
        if d < len(ts):
            hit = (ts[d:] - ts[:-d] >= ms) if d < n else np.ones(len(ts) - d, bool)
            out[:-d] = np.where(hit, places[d:], out[:-d])
    return out


def _block(rows: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
    """A block's trades in order, those of the next block that it looks ahead to at the end; their times, and how many are its own."""
    rows = rows.sort_by("_pos")
    own = rows["_ahead"].to_numpy(zero_copy_only=False)
    return rows, rows["ts_ms"].to_numpy(), int((~own).sum())


def live_batches(trades: DataFrame, ms: int = 75, n: int = 50, block: int = 100_000) -> DataFrame:
    """Trades with batch (from 1, per product) as a live buffer flushes them: with the trade that comes ms or more after the last flush, or is the n-th since; then its clock restarts.

    What a flush leads to depends on it alone. So a block of trades is a map from its first flush, one of its first n trades, to the first flush of the next
    block; maps are composed over twice as many blocks each time until all blocks know their first flush, and go through it. No task sees more than a block."""
    if n > block:
        raise ValueError("a block must hold a batch")
    spread = running_sum(trades, ["product_id"], ["ingest_seq", "trade_id"], F.lit(1), "_pos", block).withColumn("_block", F.expr(f"(_pos - 1) div {block}"))
    near = (F.col("_block") > 0) & ((F.col("_pos") - 1) % block < n)
    ways = F.when(near, F.array(F.struct(F.col("_block").alias("_block"), F.lit(False).alias("_ahead")), F.struct((F.col("_block") - 1).alias("_block"), F.lit(True).alias("_ahead"))))
    rows = spread.withColumn("_way", F.explode(F.coalesce(ways, F.array(F.struct("_block", F.lit(False).alias("_ahead")))))).drop("_block").select("*", "_way.*").drop("_way")

    def maps(key: tuple, rows: pa.Table) -> pa.Table:
        """(first, next_first): places among the first n of this block and the next; first 0 is the beginning of the product's trades."""
        _, ts, own = _block(rows)
        to = _next_flush(ts, ms, n)
        while ((inside := to[:own]) >= 0).any() and (inside[inside >= 0] < own).any():
            go = (inside >= 0) & (inside < own)
            to[:own] = np.where(go, to[np.where(go, inside, 0)], inside)  # twice as far each time
        first = np.arange(min(n, own))
        last = to[: len(first)]
        pairs = [(f + 1, x - own + 1) for f, x in zip(first.tolist(), last.tolist()) if x >= own]
        if key[1].as_py() == 0:
            begin = np.flatnonzero(ts[:n] - ts[0] >= ms)
            begin = int(begin[0]) if len(begin) else n - 1
            pairs += [(0, begin + 1)] if begin < len(ts) else []
        return pa.table({"product": pa.array([key[0].as_py()] * len(pairs), pa.string()), "block": pa.array([key[1].as_py()] * len(pairs), pa.int64()), "first": pa.array([p[0] for p in pairs], pa.int64()), "to": pa.array([p[1] for p in pairs], pa.int64())})

    slim = rows.select("product_id", "_block", "_pos", "ts_ms", "_ahead")
    found = slim.groupBy("product_id", "_block").applyInArrow(maps, "product string, block long, first long, to long").checkpoint()
    known = found.filter("first = 0").select("product", "block", F.col("to").alias("first"))
    steps, reach = found.filter("first > 0"), 1
    blocks = (found.agg(F.max("block")).first()[0] or 0) + 1
    while reach < blocks + 1:
        key = (F.col("k.product").eqNullSafe(F.col("s.product"))) & (F.col("k.block") == F.col("s.block")) & (F.col("k.first") == F.col("s.first"))
        more = known.alias("k").join(steps.alias("s"), key).select("k.product", (F.col("k.block") + reach).alias("block"), F.col("s.to").alias("first"))
        known = known.unionByName(more).checkpoint()
        on = (F.col("a.product").eqNullSafe(F.col("b.product"))) & (F.col("a.block") + reach == F.col("b.block")) & (F.col("a.to") == F.col("b.first"))
        steps = steps.alias("a").join(steps.alias("b"), on).select("a.product", "a.block", "a.first", "b.to").checkpoint()
        reach *= 2

    names = trades.columns

    def through(key: tuple, rows: pa.Table, first: pa.Table) -> pa.Table:
        rows, ts, own = _block(rows)
        flush = np.zeros(len(ts), np.int64)
        if first.num_rows:
            to, at = _next_flush(ts, ms, n), first["first"][0].as_py() - 1
            while 0 <= at < own:
                flush[at] = 1
                at = to[at]
        return rows.append_column("_flush", pa.array(flush)).select([*names, "_pos", "_flush"]).slice(0, own)

    schema = StructType([*trades.schema.fields, StructField("_pos", LongType()), StructField("_flush", LongType())])
    marked = rows.groupBy("product_id", "_block").cogroup(known.select(F.col("product").alias("p"), F.col("block").alias("b"), "first").groupBy("p", "b")).applyInArrow(through, schema)
    return running_sum(marked, ["product_id"], "_pos", F.col("_flush"), "batch", block).withColumn("batch", (F.col("batch") - F.col("_flush") + 1).cast("long")).drop("_pos", "_flush")


def mid_at_trade(trades: DataFrame, mids: DataFrame, bucket_ms: int = 86_400_000) -> DataFrame:
    """Trades with the latest mid (product_id, at_ms, mid) at or before them, null if there is none; a book change at the same time comes first.

    Both are laid in one order per bucket of time; the last mid before a bucket is carried in from a table of a row per bucket.
    A null mid says that from there on there is none."""
    both = mids.select("product_id", F.col("at_ms").alias("t"), F.lit(0).alias("is_trade"), F.struct("mid").alias("m"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in trades.schema if f.name != "product_id"])
    rows = both.unionByName(trades.withColumns({"t": F.col("ts_ms"), "is_trade": F.lit(1), "m": F.lit(None).cast("struct<mid:double>")}).select(*both.columns))
    last = F.max(F.when(F.col("m").isNotNull(), F.struct("t", "m")))
    keys = ["product_id"]
    found = with_carried(bucketed(rows, keys, "t", bucket_ms), keys, {"_last": last}, {"_carried": F.last("_last", ignorenulls=True).over(before(keys))})
    order = Window.partitionBy("_key").orderBy("t", "is_trade", "ingest_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("mid", F.coalesce(F.last("m", ignorenulls=True).over(order), F.col("_carried")["m"])["mid"])
    return found.filter("is_trade = 1").select(*trades.columns, "mid")


def significant_trades(trades: DataFrame, mids: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Trades further than the threshold, as a share, from the mid they met."""
    impact = F.abs(F.col("price") - F.col("mid")) / F.col("mid")
    return mid_at_trade(trades, mids).filter(F.col("mid") > 0).withColumn("impact", impact).filter(F.col("impact") > threshold)
