"""Books cut to a depth or to a band around the mid, as intervals: a level's stretches among the best n, or within the band, without samples.

A bucket of the grid in which any level of a product begins or ends is swept by one task, over sorted levels: a change touches the levels that come in or go out, no others. It reaches
to the next such bucket, as nothing changes between. Levels that hold all through a bucket come from blocks of 1, 2, 4 ... buckets. So there is a row for each change, and one for each level kept in each such
bucket; with a depth of n, blocks keep their n best levels alone. Sides are bid and ask, other rows are left out; a level has one quantity at a time."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.book import SIZES, from_best
from tapewright.operators.dyadic import BLOCK, blocks_around, blocks_of

#: Places of a grid in a bucket: as many as a book has changes in the time in which its levels all come once is a good choice.
BUCKET = 4096
#: Buckets that one row lists, and the size that stands for a level's first and last bucket among its blocks.
MANY, OWN = 1000, -1
SIDES = ("bid", "ask")
#: First and last tick that a side keeps; of an empty side none.
Range = tuple[int, int]
NONE: Range = (1, 0)
Ranges = Callable[[list[int], list[int]], tuple[Range, Range]]


def depth_ranges(n: int) -> Ranges:
    """The n best levels of each side."""

    def ranges(bids: list[int], asks: list[int]) -> tuple[Range, Range]:
        if n < 1:
            return NONE, NONE
        return (bids[max(0, len(bids) - n)], bids[-1]) if bids else NONE, (asks[0], asks[min(n, len(asks)) - 1]) if asks else NONE

    return ranges


def band_ranges(mode: str, value: float, tick_size: float, unset: float) -> Ranges:
    """The levels of book.band_filter()."""
    if mode not in ("fixed_dollar", "percent_mid", "ticks"):
        raise ValueError(f"no band is called {mode}")

    def ranges(bids: list[int], asks: list[int]) -> tuple[Range, Range]:
        if not bids and not asks:
            return NONE, NONE
        best = [own * tick_size for own in (bids[-1:] + asks[:1])]
        mid = sum(best) / len(best)
        half = {"fixed_dollar": value, "percent_mid": mid * value, "ticks": value * tick_size}[mode]
        half = half if half > 0 else unset
        span = max(own[-1] for own in (bids, asks) if own) * tick_size - min(own[0] for own in (bids, asks) if own) * tick_size
        half = min(half, span / 2) if span > 0 else half
        inside = lambda tick: abs(tick * tick_size - mid) <= half
        low, high = ceil((mid - half) / tick_size), floor((mid + half) / tick_size)
        while inside(low - 1):  # a division may be off by one at the edge
            low -= 1
        while inside(high + 1):
            high += 1
        while low <= high and not inside(low):
            low += 1
        while low <= high and not inside(high):
            high -= 1
        within = lambda own: bisect_left(own, low) < bisect_right(own, high)
        bid = (low, high) if within(bids) else (bids[-1], bids[-1]) if bids else NONE
        return bid, (low, high) if within(asks) else (asks[0], asks[0]) if asks else NONE

    return ranges


def stretches(levels: list[tuple], ranges: Ranges) -> list[tuple]:
    """(place of the side, tick, qty, from, to) in which levels (place, tick, qty, from, to) are kept."""
    begins, ends, out = defaultdict(list), defaultdict(list), []
    for place, tick, qty, a, b in levels:
        begins[a].append((place, tick, qty))
        ends[b].append((place, tick))
    ticks, sizes, since, kept = ([], []), ({}, {}), ({}, {}), [NONE, NONE]

    def leave(place: int, tick: int, t: int) -> None:
        start = since[place].pop(tick, t)
        if start < t:
            out.append((place, tick, sizes[place][tick], start, t))

    for t in sorted({*begins, *ends}):
        for place, tick in ends[t]:
            leave(place, tick, t)
            del ticks[place][bisect_left(ticks[place], tick)], sizes[place][tick]
        for place, tick, qty in begins[t]:
            insort(ticks[place], tick)
            sizes[place][tick] = qty
        now = ranges(*ticks)
        for place, ((low, high), (first, last)) in enumerate(zip(kept, now)):
            own = ticks[place]
            for lo, hi in ((low, min(high, first - 1)), (max(low, last + 1), high)):
                for tick in own[bisect_left(own, lo) : bisect_right(own, hi)]:
                    leave(place, tick, t)
            for lo, hi in ((first, min(last, low - 1)), (max(first, high + 1), last)):
                for tick in own[bisect_left(own, lo) : bisect_right(own, hi)]:
                    since[place].setdefault(tick, t)
        for place, tick, _ in begins[t]:
            if now[place][0] <= tick <= now[place][1]:
                since[place].setdefault(tick, t)
        kept = now
    return out


def active_buckets(rows: DataFrame) -> DataFrame:
    """(product_id, bucket, next): the buckets in which intervals begin or end, and the one of these that follows."""
    found = rows.select("product_id", F.explode(F.array("first", "last")).alias("bucket"))
    many = found.groupBy("product_id", F.floor(F.col("bucket") / MANY).alias("_bucket")).agg(F.sort_array(F.collect_set("bucket")).alias("own"))
    after = F.lead(F.col("own")[0]).over(Window.partitionBy("product_id").orderBy("_bucket"))
    pairs = F.arrays_zip(F.col("own").alias("bucket"), F.concat(F.slice("own", F.lit(2), F.size("own")), F.array("after")).alias("next"))
    return many.withColumn("after", after).select("product_id", F.explode(pairs).alias("pair")).select("product_id", "pair.bucket", "pair.next")


def kept_intervals(grid: DataFrame, ranges: Ranges, depth: int | None, bucket: int) -> DataFrame:
    """The stretches of a grid's intervals that the ranges keep. Blocks are cut to the `depth` best levels of a side, if it is given."""
    columns = ["product_id", "side", "tick", "qty", "from_g", "to_g"]
    place = lambda c: F.floor(F.col(c) / bucket)
    rows = grid.select(*columns).filter("from_g < to_g and side in ('bid', 'ask')").withColumns({"first": place("from_g"), "last": place("to_g")})
    own = lambda b: F.struct(F.lit(OWN).alias("size"), b.alias("block")).cast(BLOCK)
    ends = F.array_distinct(F.array(own(F.col("first")), own(F.col("last"))))
    inner = F.when(F.col("first") + 1 < F.col("last"), blocks_of("(first + 1)", "last", SIZES)).otherwise(F.array().cast(f"array<{BLOCK}>"))
    parts = rows.select(*columns, F.explode(F.concat(ends, inner)).alias("part"))
    if depth is not None:
        order = Window.partitionBy("product_id", "part", "side").orderBy(from_best(F.col("side"), F.col("tick")), "from_g")
        parts = parts.withColumn("rank", F.row_number().over(order)).filter((F.col("part.size") == OWN) | (F.col("rank") <= depth))
    active = active_buckets(rows)
    key = F.struct("product_id", "part").alias("key")
    asked = active.withColumn("part", F.explode(F.concat(F.array(own(F.col("bucket"))), blocks_around("bucket", SIZES)))).select("bucket", key)
    met = parts.select(*columns, key).join(asked, "key").select(*columns, "bucket")
    none = lambda kind: F.lit(None).cast(kind)
    reach = active.select("product_id", none("string").alias("side"), none("long").alias("tick"), none("double").alias("qty"), (F.col("bucket") * bucket).alias("from_g"), (F.col("next") * bucket).alias("to_g"), "bucket")

    def swept(group: tuple, table: pa.Table) -> pa.Table:
        side, tick, qty, a, b = (table[c].to_pylist() for c in columns[1:])
        at = side.index(None)
        begin, stop = a[at], b[at] if b[at] is not None else max(e for e in b if e is not None)
        levels = [(SIDES.index(s), t, q, max(f, begin), min(e, stop)) for s, t, q, f, e in zip(side, tick, qty, a, b) if s and max(f, begin) < min(e, stop)]
        out = list(zip(*stretches(levels, ranges))) or [()] * 5
        names = pa.array([SIDES[k] for k in out[0]], pa.string())
        return pa.table([pa.array([group[0].as_py()] * len(names), pa.string()), names, pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], columns)

    return met.unionByName(reach).groupBy("product_id", "bucket").applyInArrow(swept, "product_id string, side string, tick long, qty double, from_g long, to_g long")


def depth_intervals(grid: DataFrame, n: int = 2000, bucket: int = BUCKET) -> DataFrame:
    """Of the intervals of book.grid_intervals() or book.message_intervals(), the stretches in which a level is among the n best of its side; a stretch is cut where buckets meet."""
    return kept_intervals(grid, depth_ranges(n), n, bucket)


def band_intervals(grid: DataFrame, mode: str = "percent_mid", value: float = 0.01, tick_size: float = 1.0, unset: float = 100.0, bucket: int = BUCKET) -> DataFrame:
    """The stretches in which book.band_filter() keeps a level, with its modes and rules."""
    return kept_intervals(grid, band_ranges(mode, value, tick_size, unset), None, bucket)
