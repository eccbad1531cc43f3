"""Order books from level updates: changes, validity intervals, books at any time and what is read off them.

A snapshot replaces the book: updates belong to the generation of the last snapshot before them, those before any
snapshot are dropped. Quantities are absolute; 0 or less deletes. Levels are keyed by round(price / tick_size)."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.carry import before, bucketed, running_lag, running_last, running_sum, with_carried, within
from tapewright.operators.dyadic import blocks_around, blocks_of

#: Blocks of up to 2^SIZES buckets, and a time after all others.
SIZES, FAR_MS = 20, 1 << 42
LEVEL = ["product_id", "generation", "side", "tick"]


def level_order() -> Window:
    """A level's changes between two snapshots."""
    return Window.partitionBy(*LEVEL).orderBy("seq")


def with_generation(l2: DataFrame) -> DataFrame:
    """Adds generation: the seq of the product's latest snapshot."""
    snapshot = F.when(F.col("kind") == "snapshot", F.col("seq"))
    return running_last(l2, ["product_id"], "seq", snapshot, "generation").filter("generation is not null")


def apply_book_updates(l2: DataFrame, tick_size: float = 1.0, bounds: DataFrame | None = None) -> DataFrame:
    """The changes of levels, in (product_id, ts_ms, seq, generation, side, tick, qty, prev_qty); the last of several in a message counts.

    bounds: (product_id, min_price, max_price), outside of which levels are ignored."""
    rows = with_generation(l2).withColumn("tick", F.round(F.col("price") / tick_size).cast("long")).withColumn("qty", F.greatest("quantity", F.lit(0.0)))
    if bounds is not None:
        rows = rows.join(bounds, "product_id", "left").filter("min_price is null or price between min_price and max_price")
    last = rows.groupBy(*LEVEL, "seq").agg(F.max(F.struct("ord", "qty", "ts_ms")).alias("l")).select(*LEVEL, "seq", "l.qty", "l.ts_ms")
    previous = F.coalesce(F.lag("qty").over(level_order()), F.lit(0.0))
    changed = last.withColumn("prev_qty", previous).filter("qty <> prev_qty")
    return changed.select("product_id", "ts_ms", "seq", "generation", "side", "tick", "qty", "prev_qty")


def book_deltas(changes: DataFrame) -> DataFrame:
    return changes.select("product_id", "seq", "tick", "qty", "side")


def generation_ends(l2: DataFrame) -> DataFrame:
    """(product_id, generation, end_ms, end_seq): when the next snapshot replaces the book; null for the last."""
    snapshots = l2.filter("kind = 'snapshot'").groupBy("product_id", F.col("seq").alias("generation")).agg(F.min("ts_ms").alias("ts_ms"))
    order = Window.partitionBy("product_id").orderBy("generation")
    return snapshots.select("product_id", "generation", F.lead("ts_ms").over(order).alias("end_ms"), F.lead("generation").over(order).alias("end_seq"))


def level_intervals(changes: DataFrame, ends: DataFrame) -> DataFrame:
    """(product_id, side, tick, qty, from_ms, to_ms): when each quantity held; to_ms is null while it still does."""
    held = changes.withColumn("next_ms", F.lead("ts_ms").over(level_order())).join(ends, ["product_id", "generation"], "left")
    rows = held.withColumn("to_ms", F.coalesce("next_ms", "end_ms")).filter("qty > 0 and (to_ms is null or to_ms > ts_ms)")
    return rows.select("product_id", "side", "tick", "qty", F.col("ts_ms").alias("from_ms"), "to_ms")


def grid_intervals(changes: DataFrame, ends: DataFrame, step_ms: int) -> DataFrame:
    """The same on grid points k * step_ms: the half-open range of k at which each quantity is seen."""
    place = lambda c: F.ceil(F.col(c) / step_ms).cast("long")
    last = changes.groupBy("product_id").agg((F.ceil(F.max("ts_ms") / step_ms) + 1).cast("long").alias("last_to"))
    rows = changes.withColumn("from_g", place("ts_ms")).withColumn("next_g", F.lead(place("ts_ms")).over(level_order()))
    rows = rows.join(ends.withColumn("end_g", place("end_ms")), ["product_id", "generation"], "left").join(last, "product_id")
    rows = rows.withColumn("to_g", F.coalesce("next_g", "end_g", "last_to")).filter("qty > 0 and from_g < to_g")
    return rows.select("product_id", "side", "tick", "qty", "from_g", "to_g")


def message_samples(l2: DataFrame) -> DataFrame:
    """(product_id, seq, ts_ms, g): each update message is a sample of the book, numbered from 0; snapshots change it silently and show at the next update.

    Snapshot messages have the number of the next sample."""
    per = l2.groupBy("product_id", "seq").agg(F.min("ts_ms").alias("ts_ms"), F.max((F.col("kind") == "update").cast("int")).alias("is_update"))
    return running_sum(per, ["product_id"], "seq", F.col("is_update"), "upto").select("product_id", "seq", "ts_ms", "is_update", (F.col("upto") - F.col("is_update")).cast("long").alias("g"))


def message_intervals(changes: DataFrame, ends: DataFrame, samples: DataFrame) -> DataFrame:
    """The half-open range of samples at which each quantity is seen."""
    place = samples.select("product_id", "seq", "g")
    count = samples.groupBy("product_id").agg(F.sum("is_update").cast("long").alias("last_to"))
    rows = changes.join(place, ["product_id", "seq"]).withColumnRenamed("g", "from_g")
    rows = rows.withColumn("next_g", F.lead("from_g").over(level_order()))
    end = ends.join(place.withColumnsRenamed({"seq": "end_seq", "g": "end_g"}), ["product_id", "end_seq"], "left").select("product_id", "generation", "end_g")
    rows = rows.join(end, ["product_id", "generation"], "left").join(count, "product_id").withColumn("to_g", F.coalesce("next_g", "end_g", "last_to"))
    return rows.filter("qty > 0 and from_g < to_g").select("product_id", "side", "tick", "qty", "from_g", "to_g")


def carry_forward(grid: DataFrame) -> DataFrame:
    """The book at every grid point, skipped ones filled with the latest: (product_id, g, side, tick, qty)."""
    return grid.select("product_id", F.explode(F.sequence("from_g", F.col("to_g") - 1)).alias("g"), "side", "tick", "qty")


def book_as_of(intervals: DataFrame, times: DataFrame, bucket_ms: int = 86_400_000, on: tuple = (), sizes: int = SIZES) -> DataFrame:
    """The books at the times (product_id, at_ms): the columns of times, and side, tick, qty. on: columns of a level, such as tick, that times have too: only the levels that agree in them are looked for.

    An interval is laid out in at most two blocks of 1, 2, 4 ... buckets of time each, and meets the times that lie in them; an open interval reaches to the latest time asked for.
    Both sides are shuffled: Spark takes the times for as small as they were before they were laid out in blocks, and would broadcast them."""
    latest = times.groupBy("product_id").agg(F.max("at_ms").alias("latest"))
    held = intervals.join(latest, "product_id").withColumn("until", F.least(F.coalesce("to_ms", F.col("latest") + 1), F.col("latest") + 1)).filter("from_ms < until")
    held = held.withColumns({"first": F.floor(F.col("from_ms") / bucket_ms), "end": F.floor((F.col("until") - 1) / bucket_ms) + 1})
    held = held.withColumn("part", F.explode(blocks_of("first", "end", sizes))).drop("first", "end", "latest", "to_ms")
    asked = times.withColumn("place", F.floor(F.col("at_ms") / bucket_ms)).withColumn("part", F.explode(blocks_around("place", sizes))).drop("place")
    joined = held.join(asked.hint("merge"), ["product_id", *on, "part"]).filter("from_ms <= at_ms and at_ms < until")
    return joined.select(*times.columns, *[c for c in ("side", "tick", "qty") if c not in times.columns])


def best_sweep(key: tuple, rows: pa.Table) -> pa.Table:
    """Best bid and ask of a product over a bucket of time, a row where either changes, from intervals (side, tick, a, b) that are cut to the bucket."""
    changes: dict[int, list] = {}
    sides, ticks, starts, ends = (rows[c].to_numpy(zero_copy_only=False) for c in ("side", "tick", "a", "b"))
    for place, side in enumerate(("bid", "ask")):
        own = sides == side
        sign = -1 if side == "bid" else 1
        a, b, tick = starts[own], ends[own], ticks[own] * sign
        order = np.argsort(a, kind="stable")
        a, b, tick = a[order].tolist(), b[order].tolist(), tick[order].tolist()
        heap, at, last = [], 0, None
        for t in np.unique(np.concatenate([starts[own], ends[own]])).tolist():
            while at < len(a) and a[at] == t:
                heapq.heappush(heap, (tick[at], b[at]))
                at += 1
            while heap and heap[0][1] <= t:
                heapq.heappop(heap)
            best = heap[0][0] * sign if heap else None
            if best != last or not changes:
                changes.setdefault(t, [False, None, False, None])[2 * place : 2 * place + 2] = [True, best]
                last = best
    begin, stop = rows["begin"][0].as_py(), rows["begin"][0].as_py() + rows["width"][0].as_py()
    out, now = [], [None, None]
    for t in sorted({begin, *changes}):
        if t < stop:  # what ends with the bucket is told by the next one
            for place in (0, 1):
                known, best = changes.get(t, [False, None] * 2)[2 * place : 2 * place + 2]
                now[place] = best if known else now[place]
            out.append((t, *now))
    return pa.table({"product_id": pa.array([key[0].as_py()] * len(out), pa.string()), "at_ms": pa.array([r[0] for r in out], pa.int64()), "bid": pa.array([r[1] for r in out], pa.int64()), "ask": pa.array([r[2] for r in out], pa.int64())})


def best_changes(intervals: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """(product_id, at_ms, bid, ask): the best ticks of both sides whenever either changes, null where a side is empty, over all changes of the book.

    A bucket of time is swept by a heap. It hears of the intervals that begin or end in it, and of the best of those that hold all through it: these are laid out in blocks of
    1, 2, 4 ... buckets, of a block only the best level of a side is kept, and a bucket looks up the blocks around it. So an interval counts as O(log) rows in a sum, however long it is."""
    place = lambda c: F.floor(F.col(c) / bucket_ms)
    rows = intervals.withColumns({"first": place("from_ms"), "last": place("to_ms"), "till": F.coalesce("to_ms", F.lit(FAR_MS))})
    edges = F.array_distinct(F.array_compact(F.array("first", "last")))
    cut = rows.select("product_id", "side", "tick", "from_ms", "till", F.explode(edges).alias("bucket"))
    begin = (F.col("bucket") * bucket_ms).alias("begin")
    cut = cut.select("product_id", "bucket", "side", "tick", F.greatest("from_ms", begin).alias("a"), F.least("till", begin + bucket_ms).alias("b"), begin)
    best = F.max_by("tick", -from_best(F.col("side"), F.col("tick")))
    through = rows.withColumn("end", F.coalesce("last", F.lit(FAR_MS // bucket_ms))).filter("first + 1 < end").withColumn("from_bucket", F.col("first") + 1)
    blocks = through.select("product_id", "side", "tick", F.explode(blocks_of("from_bucket", "end", SIZES)).alias("part")).groupBy("product_id", "part", "side").agg(best.alias("tick"))
    asked = cut.select("product_id", "bucket").distinct().withColumn("part", F.explode(blocks_around("bucket", SIZES)))
    base = asked.join(blocks, ["product_id", "part"]).groupBy("product_id", "bucket", "side").agg(best.alias("tick"))
    base = base.select("product_id", "bucket", "side", "tick", begin.alias("a"), (begin + bucket_ms).alias("b"), begin)
    both = cut.unionByName(base).withColumn("width", F.lit(bucket_ms).cast("long"))
    swept = both.groupBy("product_id", "bucket").applyInArrow(best_sweep, "product_id string, at_ms long, bid long, ask long")
    lagged = running_lag(swept, ["product_id"], "at_ms", F.struct("bid", "ask"), "before", 64 * bucket_ms)
    same = F.col("before.bid").eqNullSafe(F.col("bid")) & F.col("before.ask").eqNullSafe(F.col("ask"))
    return lagged.filter(~same).drop("before")


def mid_changes(intervals: DataFrame, tick_size: float = 1.0, default: float | None = None, bucket_ms: int = 3_600_000) -> DataFrame:
    """(product_id, at_ms, bid, ask, mid): the mid from each change of the best levels on: between both sides, else the side there is, else the default."""
    rows = best_changes(intervals, bucket_ms).withColumns({c: F.col(c) * tick_size for c in ("bid", "ask")})
    return rows.withColumn("mid", F.coalesce((F.col("bid") + F.col("ask")) / 2, "bid", "ask", F.lit(default).cast("double")))


def from_best(side: Column, tick: Column) -> Column:
    """Ascending from the best level: bids from high to low, asks from low to high."""
    return F.when(side == "bid", -tick).otherwise(tick)


def book_top_n(levels: DataFrame, n: int, at: str = "at_ms") -> DataFrame:
    order = Window.partitionBy("product_id", at, "side").orderBy(from_best(F.col("side"), F.col("tick")))
    return levels.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def depth_limit(levels: DataFrame, n: int = 2000, at: str = "at_ms") -> DataFrame:
    return book_top_n(levels, n, at).drop("rank")


def book_stats(levels: DataFrame, at: str = "at_ms") -> DataFrame:
    """Levels and volume of each side, and whether the side is empty."""
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, c)), F.lit(0.0))
    count = lambda s: F.count_if(F.col("side") == s)
    out = levels.groupBy("product_id", at).agg(count("bid").alias("bid_levels"), count("ask").alias("ask_levels"), side("bid", F.col("qty")).alias("bid_volume"), side("ask", F.col("qty")).alias("ask_volume"))
    return out.withColumn("is_empty", (F.col("bid_levels") == 0) & (F.col("ask_levels") == 0))


def stats_changes(intervals: DataFrame, bucket_ms: int = 86_400_000) -> DataFrame:
    """book_stats() from each change of a level on, over all changes of the book: (product_id, at_ms, bid_levels, ask_levels, bid_volume, ask_volume, is_empty).

    Running sums of what intervals bring at their beginning and take at their end, by buckets of time, so that no book is written out and no task orders a whole product. Volumes
    run in decimals, so nothing is left over of an empty book. Rows of a time count together; other sides than bid and ask count for neither."""
    amount, keys = F.col("qty").cast("decimal(30,8)"), ["product_id"]
    edge = lambda at, sign: F.struct(F.col(at).alias("at_ms"), (amount * sign).alias("volume"), F.lit(sign).cast("long").alias("levels"))
    edges = intervals.select("product_id", "side", F.explode(F.array(edge("from_ms", 1), edge("to_ms", -1))).alias("e")).select("product_id", "side", "e.*").filter("at_ms is not null")
    names = [(f"{side}_{c}", side, c) for c in ("levels", "volume") for side in ("bid", "ask")]
    each = edges.groupBy("product_id", "at_ms").agg(*[F.sum(F.when(F.col("side") == side, F.col(c))).alias(name) for name, side, c in names])
    sums = {f"_{name}": F.sum(name) for name, _, _ in names}
    carried = {f"_before_{name}": F.sum(f"_{name}").over(before(keys)) for name, _, _ in names}
    cut = with_carried(bucketed(each, keys, "at_ms", bucket_ms), keys, sums, carried)
    so_far = lambda name: F.coalesce(F.sum(name).over(within("at_ms")), F.lit(0)) + F.coalesce(f"_before_{name}", F.lit(0))
    kind = {"levels": "long", "volume": "double"}
    out = cut.select("product_id", "at_ms", *[so_far(name).cast(kind[c]).alias(name) for name, _, c in names])
    return out.withColumn("is_empty", (F.col("bid_levels") == 0) & (F.col("ask_levels") == 0))


def top_of_book(levels: DataFrame, tick_size: float = 1.0, at: str = "at_ms") -> DataFrame:
    """Best levels, spread, mid where both sides are there, and whether they cross."""
    bid, ask = F.when(F.col("side") == "bid", F.col("tick")), F.when(F.col("side") == "ask", F.col("tick"))
    best = levels.groupBy("product_id", at).agg(
        (F.max(bid) * tick_size).alias("bid"), F.max_by("qty", bid).alias("bid_size"), (F.min(ask) * tick_size).alias("ask"), F.min_by("qty", ask).alias("ask_size")
    )
    both = (F.col("bid") > 0) & (F.col("ask") > 0)
    return best.withColumns({"spread": F.when(both, F.col("ask") - F.col("bid")), "mid": F.when(both, (F.col("ask") + F.col("bid")) / 2), "crossed": F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False))})


def mid_price(levels: DataFrame, default: float = 0.0, tick_size: float = 1.0, at: str = "at_ms") -> DataFrame:
    """The middle of both sides, else the side there is, else the default."""
    best = top_of_book(levels, tick_size, at)
    return best.select("product_id", at, F.coalesce((F.col("bid") + F.col("ask")) / 2, "bid", "ask", F.lit(default)).alias("mid"))


def with_mid(levels: DataFrame, default: float = 0.0, tick_size: float = 1.0, at: str = "at_ms") -> DataFrame:
    """The levels with their book's mid_price(), in one pass: a book has few levels."""
    book = Window.partitionBy("product_id", at)
    bid = F.max(F.when(F.col("side") == "bid", F.col("tick"))).over(book) * tick_size
    ask = F.min(F.when(F.col("side") == "ask", F.col("tick"))).over(book) * tick_size
    return levels.withColumn("mid", F.coalesce((bid + ask) / 2, bid, ask, F.lit(default)))


def band_filter(levels: DataFrame, mode: str = "percent_mid", value: float = 0.01, tick_size: float = 1.0, at: str = "at_ms", unset: float = 100.0) -> DataFrame:
    """Levels within half a band of the mid; where a side would be empty its best level stays.

    mode: fixed_dollar (value is the half band), percent_mid (share of the mid), ticks (ticks of tick_size). A half band of 0 or less counts as
    unset; it is at most half of the range of prices."""
    half = {"fixed_dollar": F.lit(value), "percent_mid": F.col("mid") * value, "ticks": F.lit(value * tick_size)}[mode]
    price, book = F.col("tick") * tick_size, Window.partitionBy("product_id", at)
    rows = with_mid(levels, 0.0, tick_size, at).withColumn("span", F.max(price).over(book) - F.min(price).over(book))
    rows = rows.withColumn("half", F.when(half > 0, half).otherwise(unset)).withColumn("half", F.when(F.col("span") > 0, F.least("half", F.col("span") / 2)).otherwise(F.col("half")))
    side = Window.partitionBy("product_id", at, "side")
    inside = F.abs(price - F.col("mid")) <= F.col("half")
    rows = rows.withColumn("inside", inside).withColumn("any", F.max("inside").over(side)).withColumn("best", F.min(from_best(F.col("side"), F.col("tick"))).over(side))
    return rows.filter(F.col("inside") | (~F.col("any") & (from_best(F.col("side"), F.col("tick")) == F.col("best")))).select(*levels.columns)


def quantize_price(levels: DataFrame, resolution: float, tick_size: float = 1.0, at: str = "at_ms") -> DataFrame:
    """Sizes summed in buckets of round(price / resolution)."""
    bucket = F.round(F.col("tick") * tick_size / resolution).cast("long").alias("tick")
    return levels.groupBy("product_id", at, "side", bucket).agg(F.sum("qty").alias("qty"))


def latest_book(rows: DataFrame, key="product_id", seq="seq") -> DataFrame:
    """The last row written for each product."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("last")).select(key, "last.*")


def latest_whole_book(intervals: DataFrame) -> DataFrame:
    """The levels of each product's book after its last update: those that still hold."""
    return intervals.filter("to_ms is null").select("product_id", "side", "tick", "qty", "from_ms")


def liquidity_at(levels: DataFrame, price: float, tick_size: float = 1.0, at: str = "at_ms") -> DataFrame:
    """Size on each side at exactly this price, 0 where there is none."""
    tick = round(price / tick_size)
    size = lambda s: F.coalesce(F.sum(F.when((F.col("tick") == tick) & (F.col("side") == s), F.col("qty"))), F.lit(0.0))
    return levels.groupBy("product_id", at).agg(size("bid").alias("bid"), size("ask").alias("ask"))
