"""The same analytics on unbounded feeds: trades, slices that close, quotes, silence, and books and their liquidity in keyed state.

Updates of a book must come in batches in their order, which is that of the columns named `order`; within a batch they may lie anyhow. A product's book is kept
in parts, so that a busy product isn't one task, and each part hears of every snapshot."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from tapewright.operators import messages
from tapewright.sources.feed import read_feed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELTAS = "product_id string, seq bigint, side string, tick bigint, qty double"
METRICS = "product_id string, timeframe_ms bigint, slice_start bigint, side string, tick bigint, total double, snapshot_count bigint, avg double, max double, min double, first_seen bigint, own_last bigint"
#: Order of updates from read_feed().
FEED_ORDER = ("arrival_ts", "arrival_file", "seq")
#: Sums of quantities run in whole numbers of units, of which one has so many.
UNITS = 10**8


def stream_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades of a folder of messages, as files come."""
    return messages.extract_trades(messages.classify_messages(read_feed(spark, path, streaming=True)))


def stream_l2(spark: SparkSession, path: str) -> DataFrame:
    """Book updates of a folder of messages, as files come; their order is FEED_ORDER."""
    return messages.extract_l2(messages.classify_messages(read_feed(spark, path, streaming=True)))


def unique_trades(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each trade once, as long as its repeats come within the delay."""
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["product_id", "trade_id"])


def stream_slices(trades: DataFrame, timeframes: list[int], delay: str = "1 hour") -> DataFrame:
    """Volume and number of trades per product and slice of every length; in append mode a slice comes out once, when the watermark
    closes it, and in update mode the open ones come out as they grow. Rows later than the delay are dropped and counted in the query's progress."""
    rows = trades.withWatermark("ts", delay)
    parts = [
        rows.groupBy("product_id", F.window("ts", f"{t} milliseconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_trades"), F.sum("size").alias("volume"))
        .select("product_id", F.lit(t).cast("long").alias("timeframe_ms"), F.unix_millis("w.start").alias("slice_start"), "n_trades", "volume")
        for t in timeframes
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def quotes(trades: DataFrame) -> DataFrame:
    """The latest price of each product, in complete or update mode; the trigger's interval coalesces changes."""
    return trades.groupBy("product_id").agg(F.max_by("price", "ingest_seq").alias("price"), F.count(F.lit(1)).alias("n_trades"))


def with_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs RocksDB; a session that names another provider is left as it is."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_parts(l2: DataFrame, tick_size: float, parts: int, order: tuple, price: Column, *more: str) -> DataFrame:
    """Updates dealt to parts of their product's book by side and price, so that a busy product isn't one task; each part hears of every snapshot."""
    rows = l2.withColumn("tick", F.round(F.col("price") / tick_size).cast("long")).withColumn("bucket", price)
    part = F.pmod(F.xxhash64("side", "bucket"), F.lit(parts)).cast("int")
    heard = F.when(F.col("kind") == "snapshot", F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("home"))
    rows = rows.withColumn("home", part).withColumn("part", F.explode(heard)).withColumn("own", F.col("part") == F.col("home"))
    return rows.select("product_id", "part", "own", *order, "ord", "kind", "side", "tick", "bucket", "quantity", *[c for c in more if c not in order])


def in_order(rows: Iterator[pd.DataFrame], order: tuple, last: str) -> pd.DataFrame:
    """A batch in order, with message (its number in the batch), generation (the new snapshots of the batch so far) and quantities of 0 at least. last: place of the latest snapshot before."""
    batch = pd.concat(list(rows), ignore_index=True).sort_values([*order, "ord"], ignore_index=True)
    first = np.ones(len(batch), bool)
    if len(batch) > 1:
        first[1:] = np.any([batch[c].to_numpy()[1:] != batch[c].to_numpy()[:-1] for c in order], axis=0)
    begins = np.flatnonzero(first & (batch["kind"] == "snapshot").to_numpy())
    new = np.zeros(len(batch), int)
    new[[k for k in begins if place_of(batch, k, order) != last]] = 1  # else more of a snapshot that has begun before
    return batch.assign(message=np.cumsum(first), generation=np.cumsum(new), quantity=batch["quantity"].clip(lower=0.0))


def place_of(batch: pd.DataFrame, row: int, order: tuple) -> str:
    return "/".join(str(batch[c].iloc[row]) for c in order)


def plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts as objects, which any Arrow writer takes."""
    return rows.astype({c: object for c in ("product_id", "side")})


class Levels:
    """The standing levels of a part of a book in state: those without quantity, and all that a snapshot replaces, are gone from it."""

    def __init__(self, handle: StatefulProcessorHandle, order: tuple):
        self.state = handle.getMapState("levels", "side string, tick bigint", "qty double")
        self.begun = handle.getValueState("begun", "place string")
        self.order = order

    def batch(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return in_order(rows, self.order, self.begun.get()[0] if self.begun.exists() else "")

    def changes(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Changed levels of in_order() with prev, the quantity before; the last of several rows of a level in a message counts. Rows before the first snapshot are dropped."""
        begun = self.begun.exists()
        own = batch[batch["own"] & ((batch["generation"] > 0) | begun)].drop_duplicates(["message", "side", "tick"], keep="last")
        level = own.groupby(["generation", "side", "tick"], sort=False)
        prev = level["quantity"].shift().fillna(0.0)
        for k, generation, side, tick in level.head(1)[["generation", "side", "tick"]].itertuples(name=None):
            if generation == 0 and self.state.containsKey((side, int(tick))):
                prev[k] = self.state.getValue((side, int(tick)))[0]
        return own.assign(prev=prev)[own["quantity"] != prev]

    def standing(self) -> list[tuple]:
        return [(key[0], key[1], value[0]) for key, value in self.state.iterator()]

    def keep(self, batch: pd.DataFrame, changed: pd.DataFrame) -> None:
        """Stores the levels as the batch leaves them."""
        latest = int(batch["generation"].iloc[-1])
        if latest:
            self.state.clear()
            self.begun.update((place_of(batch, int((batch["generation"] == latest).to_numpy().argmax()), self.order),))
        for side, tick, qty in changed[changed["generation"] == latest].groupby(["side", "tick"], sort=False).tail(1)[["side", "tick", "quantity"]].itertuples(index=False, name=None):
            if qty > 0:
                self.state.updateValue((side, int(tick)), (float(qty),))
            elif not latest:
                self.state.removeKey((side, int(tick)))


class BookProcessor(StatefulProcessor):
    """Changes of a part of a product's book."""

    def __init__(self, order: tuple):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = Levels(handle, self.order)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = self.levels.batch(rows)
        changed = self.levels.changes(batch)
        self.levels.keep(batch, changed)
        yield plain(changed.assign(product_id=key[0]).rename(columns={"quantity": "qty"})[["product_id", "seq", "side", "tick", "qty"]])

    def close(self) -> None:
        pass


def stream_book(l2: DataFrame, tick_size: float = 1.0, parts: int = 8, order: tuple = ("seq",)) -> DataFrame:
    """Changes of book levels from a stream of updates (product_id, seq, ord, kind, side, price, quantity, and the columns of order).

    A batch is ordered within a part: the source's limit for a trigger bounds what a task holds."""
    with_rocksdb(l2.sparkSession)
    rows = in_parts(l2, tick_size, parts, order, F.col("tick"), "seq")
    return rows.groupBy("product_id", "part").transformWithStateInPandas(BookProcessor(order), outputStructType=DELTAS, outputMode="append", timeMode="none")


class LiquidityProcessor(StatefulProcessor):
    """Liquidity slices of a part of a product's book, by price bucket, on a grid of time.

    In state are the standing levels, of each price bucket what stands there and since when, and of each open slice what has been sampled of a bucket so far. A change of a
    bucket counts the samples of the quantity before it. A timer in event time at the end of each shortest slice counts up to there, brings out the
    slices that have ended and forgets them, but for the last `keep` of a length."""

    def __init__(self, timeframes: list[int], step_ms: int, order: tuple, keep: int):
        self.timeframes, self.step, self.order, self.kept = sorted(timeframes), step_ms, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = Levels(handle, self.order)
        self.sums = handle.getMapState("sums", "side string, tick bigint", "amount string, present bigint, from_g bigint")
        self.open = handle.getMapState("open", "timeframe_ms bigint, slice_start bigint, side string, tick bigint", "total double, n bigint, max double, min double, first_g bigint, last_g bigint")
        self.closed = handle.getMapState("closed", "timeframe_ms bigint, slice_start bigint, side string, tick bigint", "total double, n bigint, max double, min double, first_g bigint, last_g bigint")
        self.last = handle.getValueState("last", "g bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = self.levels.batch(rows)
        last = self.last.get()[0] if self.last.exists() else None
        if last is None:
            self.handle.registerTimer((int(batch["ts_ms"].min()) // self.timeframes[0] + 1) * self.timeframes[0])
        g = -(-batch["ts_ms"] // self.step)
        batch["g"] = np.maximum.accumulate(np.maximum(g, g.min() if last is None else last))  # time doesn't run back
        self.last.update((int(batch["g"].iloc[-1]),))
        changed = self.levels.changes(batch)
        self.count(self.edges(batch, changed))
        self.levels.keep(batch, changed)
        yield from ()

    def edges(self, batch: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
        """(side, bucket, g, units, present): by how much buckets change, by levels that change and by those that a snapshot replaces."""
        columns = ["side", "bucket", "g", "units", "present"]
        units = lambda q: np.rint(q.astype(float) * UNITS).astype(object).map(int)
        parts = [changed.assign(units=units(changed["quantity"]) - units(changed["prev"]), present=(changed["quantity"] > 0).astype(int) - (changed["prev"] > 0).astype(int))[columns]]
        begins = batch[batch["generation"] > 0].groupby("generation")["g"].first()
        if len(begins):
            ended = changed.groupby(["generation", "side", "tick"], sort=False).tail(1)
            touched = set(ended[ended["generation"] == 0][["side", "tick"]].itertuples(index=False, name=None))
            ended = ended[(ended["quantity"] > 0) & (ended["generation"] < begins.index[-1])]
            parts.append(ended.assign(g=ended["generation"].add(1).map(begins), units=-units(ended["quantity"]), present=-1)[columns])
            before = [x for x in self.levels.standing() if x[:2] not in touched]
            bucket_of = self.bucket_of
            stood = pd.DataFrame({"side": [x[0] for x in before], "bucket": [bucket_of(x[1]) for x in before], "g": begins.iloc[0]})
            parts.append(stood.assign(units=[-round(x[2] * UNITS) for x in before], present=-1)[columns])
        return pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)

    def count(self, edges: pd.DataFrame) -> None:
        """Counts the samples up to each change of a bucket, and stores what stands after the last."""
        runs = []
        edges = edges.groupby(["side", "bucket", "g"], sort=True, as_index=False).agg({"units": "sum", "present": "sum"})
        for (side, bucket), own in edges.groupby(["side", "bucket"], sort=False):
            level = (side, int(bucket))
            amount, present, since = self.sums.getValue(level) if self.sums.containsKey(level) else ("0", 0, 0)
            amount = int(amount)
            for g, units, more in zip(own["g"].tolist(), own["units"].tolist(), own["present"].tolist()):
                if present > 0 and since < g:
                    runs.append((side, int(bucket), amount / UNITS, since, int(g)))
                amount, present, since = amount + units, present + more, int(g)
            if present > 0:
                self.sums.updateValue(level, (str(amount), int(present), since))
            else:
                self.sums.removeKey(level)
        self.add(runs)

    def add(self, runs: list[tuple]) -> None:
        """Adds stretches (side, bucket, qty, from_g, to_g) to the slices that they lie in."""
        if not runs:
            return
        rows = pd.DataFrame(runs, columns=["side", "tick", "qty", "from_g", "to_g"])
        for t in self.timeframes:
            first, last = rows["from_g"] * self.step // t, (rows["to_g"] - 1) * self.step // t
            n = (last - first + 1).to_numpy()
            cut = rows.loc[rows.index.repeat(n)]
            at = np.repeat(first.to_numpy(), n) + np.arange(len(cut)) - np.repeat(np.cumsum(n) - n, n)
            cut = cut.assign(slice_start=at * t, a=np.maximum(cut["from_g"], -(-at * t // self.step)), b=np.minimum(cut["to_g"], -(-(at + 1) * t // self.step)))
            cut = cut[cut["a"] < cut["b"]].assign(n=lambda x: x["b"] - x["a"], total=lambda x: x["qty"] * (x["b"] - x["a"]))
            found = cut.groupby(["slice_start", "side", "tick"], sort=False).agg(total=("total", "sum"), n=("n", "sum"), max=("qty", "max"), min=("qty", "min"), first=("a", "min"), last=("b", "max"))
            for (start, side, tick), new in zip(found.index, found.itertuples(index=False, name=None)):
                key = (t, int(start), side, int(tick))
                total, k, most, least, a, b = float(new[0]), int(new[1]), float(new[2]), float(new[3]), int(new[4]), int(new[5]) - 1
                if self.open.containsKey(key):
                    old = self.open.getValue(key)
                    total, k, most, least, a, b = total + old[0], k + old[1], max(most, old[2]), min(least, old[3]), min(a, old[4]), max(b, old[5])
                self.open.updateValue(key, (total, k, most, least, a, b))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // self.timeframes[0] * self.timeframes[0]
        end, runs = -(-until // self.step), []
        for level, (amount, present, since) in list(self.sums.iterator()):
            if since < end:
                runs.append((*level, int(amount) / UNITS, since, end))
                self.sums.updateValue(tuple(level), (amount, present, end))
        self.add(runs)
        self.last.update((max(end, self.last.get()[0]),))
        done = [(tuple(k), tuple(v)) for k, v in self.open.iterator() if k[0] + k[1] <= until]
        for k, v in done:
            self.open.removeKey(k)
            if self.kept:
                self.closed.updateValue(k, v)
        if self.kept:
            for k, _ in list(self.closed.iterator()):
                if k[1] + self.kept * k[0] < until // k[0] * k[0]:
                    self.closed.removeKey(tuple(k))
        self.handle.registerTimer(until + self.timeframes[0])
        rows = [(key[0], *k, v[0], v[1], v[0] / v[1], v[2], v[3], v[4] * self.step, v[5] * self.step) for k, v in done]
        found = pd.DataFrame(rows, columns=[c.split()[0] for c in METRICS.split(", ")])
        yield plain(found).astype({"slice_start": "int64", "tick": "int64", "snapshot_count": "int64", "timeframe_ms": "int64", "first_seen": "int64", "own_last": "int64"})

    def bucket_of(self, tick: int) -> int:
        """As Spark rounds."""
        x = tick * self.tick_size / self.resolution
        return int(np.sign(x) * np.floor(abs(x) + 0.5))

    tick_size, resolution = 1.0, 1.0

    def close(self) -> None:
        pass


def stream_liquidity(l2: DataFrame, timeframes: list[int], step_ms: int, resolution: float, delay: str, tick_size: float = 1.0, parts: int = 8, order: tuple = ("seq",), keep: int = 0) -> DataFrame:
    """slices.slice_liquidity() of a stream of updates (product_id, ts, seq, ord, kind, side, price, quantity), METRICS but for slice_last: each slice once, when the watermark has passed its end.

    The lengths are multiples of the shortest one. keep: so many slices of each length stay in state after they have come out (closed_slices);
    open_slices() reads what has not. Rows later than the delay are dropped (LateRows counts them)."""
    if any(t % min(timeframes) for t in timeframes):
        raise ValueError("lengths must be multiples of the shortest")
    with_rocksdb(l2.sparkSession)
    bucket = F.round(F.col("tick") * tick_size / resolution).cast("long")
    rows = in_parts(l2.withColumn("ts_ms", F.unix_millis("ts")), tick_size, parts, order, bucket, "ts", "ts_ms").withWatermark("ts", delay)
    processor = LiquidityProcessor(timeframes, step_ms, order, keep)
    processor.tick_size, processor.resolution = tick_size, resolution
    return rows.groupBy("product_id", "part").transformWithStateInPandas(processor, outputStructType=METRICS, outputMode="append", timeMode="eventtime")


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a stream has in state under a name: key, user_map_key and user_map_value, as of its last batch."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def _metrics(rows: DataFrame, step_ms: int) -> DataFrame:
    k, v = F.col("user_map_key"), F.col("user_map_value")
    own = [k[c].alias(c) for c in ("timeframe_ms", "slice_start", "side", "tick")]
    return rows.select(F.col("key.product_id").alias("product_id"), *own, *[v[c].alias(c) for c in ("total", "n", "max", "min")], (v["first_g"] * step_ms).alias("first_seen"), (v["last_g"] * step_ms).alias("own_last"))


def closed_slices(spark: SparkSession, checkpoint: str, step_ms: int) -> DataFrame:
    """The slices that a stream_liquidity() keeps in state after their end."""
    rows = _metrics(state_of(spark, checkpoint, "closed"), step_ms)
    return rows.withColumn("avg", F.col("total") / F.col("n")).withColumnRenamed("n", "snapshot_count")


def open_slices(spark: SparkSession, checkpoint: str, timeframes: list[int], step_ms: int, at_ms: int) -> DataFrame:
    """The slices of a stream_liquidity() that have not ended, with samples up to at_ms: what is counted in state, and what has stood since; resting is avg after more than 2 samples, else 0."""
    k, v = F.col("user_map_key"), F.col("user_map_value")
    stands = state_of(spark, checkpoint, "sums").select(F.col("key.product_id").alias("product_id"), k["side"].alias("side"), k["tick"].alias("tick"), (v["amount"].cast("double") / UNITS).alias("qty"), v["from_g"].alias("from_g"))
    stands = stands.withColumn("to_g", F.lit(-(-at_ms // step_ms) + 1).cast("long")).filter("from_g < to_g")
    stands = stands.withColumn("timeframe_ms", F.explode(F.array(*[F.lit(t).cast("long") for t in timeframes])))
    pieces = F.sequence(F.expr(f"from_g * {step_ms} div timeframe_ms"), F.expr(f"(to_g - 1) * {step_ms} div timeframe_ms"))
    stands = stands.withColumn("slice", F.explode(pieces)).withColumn("slice_start", F.col("slice") * F.col("timeframe_ms"))
    at = lambda c: F.expr(f"({c} + {step_ms - 1}) div {step_ms}")
    stands = stands.withColumns({"a": F.greatest("from_g", at("slice_start")), "b": F.least("to_g", at("(slice_start + timeframe_ms)"))}).filter("a < b")
    n = F.col("b") - F.col("a")
    stands = stands.select("product_id", "timeframe_ms", "slice_start", "side", "tick", (F.col("qty") * n).alias("total"), n.alias("n"), F.col("qty").alias("max"), F.col("qty").alias("min"), (F.col("a") * step_ms).alias("first_seen"), ((F.col("b") - 1) * step_ms).alias("own_last"))
    rows = _metrics(state_of(spark, checkpoint, "open"), step_ms).unionByName(stands)
    sums = [F.sum("total").alias("total"), F.sum("n").alias("snapshot_count"), F.max("max").alias("max"), F.min("min").alias("min"), F.min("first_seen").alias("first_seen"), F.max("own_last").alias("own_last")]
    out = rows.groupBy("product_id", "timeframe_ms", "slice_start", "side", "tick").agg(*sums).withColumn("avg", F.col("total") / F.col("snapshot_count"))
    return out.withColumn("resting", F.when(F.col("snapshot_count") > 2, F.col("avg")).otherwise(0.0))


class GridProcessor(LiquidityProcessor):
    """The live book on a grid of time: stretches of grid points in which a level's quantity holds, brought out when they end, and at every flush_ms that the watermark passes."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.found = []
        for _ in super().handleInputRows(key, rows, timerValues):
            pass
        yield self.stretches(key)

    def add(self, runs: list[tuple]) -> None:
        self.found += runs

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.found = []
        for _ in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            pass
        yield self.stretches(key)

    def stretches(self, key) -> pd.DataFrame:
        found = pd.DataFrame(self.found, columns=["side", "tick", "qty", "from_g", "to_g"]).astype({"tick": "int64", "qty": "float64", "from_g": "int64", "to_g": "int64"})
        return plain(found.assign(product_id=key[0])[["product_id", "side", "tick", "qty", "from_g", "to_g"]])


def stream_grid(l2: DataFrame, step_ms: int, flush_ms: int, delay: str, tick_size: float = 1.0, parts: int = 8, order: tuple = ("seq",)) -> DataFrame:
    """book.grid_intervals() of a stream of updates (product_id, ts, seq, ord, kind, side, price, quantity): (product_id, side, tick, qty, from_g, to_g). Rows later than the delay are dropped (LateRows counts them)."""
    with_rocksdb(l2.sparkSession)
    rows = in_parts(l2.withColumn("ts_ms", F.unix_millis("ts")), tick_size, parts, order, F.col("tick"), "ts", "ts_ms").withWatermark("ts", delay)
    return rows.groupBy("product_id", "part").transformWithStateInPandas(
        GridProcessor([flush_ms], step_ms, order, 0), outputStructType="product_id string, side string, tick bigint, qty double, from_g bigint, to_g bigint", outputMode="append", timeMode="eventtime"
    )


class SilenceProcessor(StatefulProcessor):
    """A row for each stretch without a message: a timer is set anew by every message, and runs out at the threshold."""

    def __init__(self, threshold_ms: int, clock: bool):
        self.threshold, self.clock = threshold_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, told = self.last.get() if self.last.exists() else (None, False)
        times = np.concatenate([part["ts_ms"].to_numpy(np.int64) for part in rows])
        if self.clock:
            times[:] = timerValues.getCurrentProcessingTimeInMs()
        times = np.sort(times)
        times = times if known is None else np.maximum(np.concatenate([[known], times]), known)
        begin = times[:-1][np.diff(times) > self.threshold]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if known is not None and int(times[-1]) == known:
            self.last.update((known, told))
        else:
            self.last.update((int(times[-1]), False))
        if not (told and int(times[-1]) == known):
            self.handle.registerTimer(int(times[-1]) + self.threshold + 1)
        yield self.rows(key, begin[1:] if told and len(begin) and begin[0] == known else begin)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.last.get()[0]
        self.last.update((since, True))
        yield self.rows(key, np.array([since]))

    def rows(self, key, begin: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"feed": pd.Series([key[0]] * len(begin), dtype=object), "from_ms": begin.astype("int64"), "stale_ms": begin.astype("int64") + self.threshold})

    def close(self) -> None:
        pass


def stream_silence(rows: DataFrame, feed: str, threshold_ms: int = 10_000, delay: str | None = None) -> DataFrame:
    """(feed, from_ms, stale_ms): stretches of more than threshold_ms without a message of a feed, from rows with ts, one row for each stretch.

    With a delay time is that of ts, a stretch is told when the watermark, or a message, is past it; without one time is the clock's, and a stretch is told while it lasts, also when no data comes."""
    with_rocksdb(rows.sparkSession)
    own = rows.select(F.col(feed).alias("feed"), "ts", F.unix_millis("ts").alias("ts_ms"))
    own = own if delay is None else own.withWatermark("ts", delay)
    mode = "processingtime" if delay is None else "eventtime"
    return own.groupBy("feed").transformWithStateInPandas(SilenceProcessor(threshold_ms, delay is None), outputStructType="feed string, from_ms bigint, stale_ms bigint", outputMode="append", timeMode=mode)


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop as later than their watermark, over all batches of their lives: spark.streams.addListener(LateRows())."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        run = str(event.progress.runId)
        self.counts[run] = self.counts.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def of(self, query, seconds: float = 60.0) -> int:
        """Of a query that has ended: its events come a little later than its end."""
        self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds)
        return self.counts.get(str(query.runId), 0)


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder where the driver and all executors can write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: tasks need a folder that they share")
    base = base or "file://" + tempfile.mkdtemp(prefix="tapewright-")
    return f"{base}/{what}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, what: str) -> DataFrame:
    """Runs a stream over all there is now and reads what it has appended."""
    return drained_with_state(stream, what)[0]


def drained_with_state(stream: DataFrame, what: str) -> tuple[DataFrame, str, object]:
    """The same, with the folder of its checkpoints and the query."""
    spark = stream.sparkSession
    path = new_folder(spark, what)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), f"{path}/state", query


def _collected(stream: DataFrame, what: str, mode: str) -> DataFrame:
    """What a stream has put out in complete or update mode, with epoch, the batch it came from."""
    spark = stream.sparkSession
    path = new_folder(spark, what)
    schema = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    spark.createDataFrame([], schema).write.parquet(f"{path}/out/batch=none")  # a stream without rows has no batch

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/out/batch={epoch}")  # a batch that runs again replaces itself

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out/*")


def drained_latest(stream: DataFrame, what: str) -> DataFrame:
    """The same for a query in complete mode: the last state of its result."""
    rows = _collected(stream, what, "complete")
    last = rows.agg(F.max("epoch").alias("last"))
    return rows.join(F.broadcast(last), F.col("epoch") == F.col("last")).drop("epoch", "last")  # one row


def drained_updates(stream: DataFrame, what: str, keys: list[str]) -> DataFrame:
    """The same for a query in update mode: the latest row of each key, open groups included."""
    rows = _collected(stream, what, "update")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("latest")).select(*keys, "latest.*")
