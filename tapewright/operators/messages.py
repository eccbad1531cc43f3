"""Feed messages to trades, book updates, acknowledgements and errors; checks of a feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.parse import parse_book_side, parse_double, parse_exchange_ts, parse_side
from tapewright.operators.carry import BUCKET, running_lag
from tapewright.sources.feed import ARRIVAL

_TRADE = "struct<trade_id:string,product_id:string,price:string,size:string,side:string,time:string>"
_UPDATE = "struct<side:string,event_time:string,price_level:string,new_quantity:string>"
MESSAGE = (
    "channel string, type string, message string, timestamp string, sequence_num bigint, product_id string, "
    f"product_ids array<string>, trades array<{_TRADE}>, "
    f"events array<struct<type:string,product_id:string,product_ids:array<string>,trades:array<{_TRADE}>,updates:array<{_UPDATE}>>>"
)


def _is_message(value: str, m: Column) -> Column:
    """A JSON object with at least one of the known fields."""
    known = [m[c].isNotNull() for c in ("channel", "type", "message", "timestamp", "sequence_num", "product_id", "product_ids", "trades", "events")]
    return F.trim(F.col(value)).startswith("{") & reduce(lambda a, b: a | b, known)


def parse_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """raw text with arrival_ts and arrival_seq -> one struct column m; what isn't a JSON object is left out."""
    parsed = F.from_json(F.col(value), MESSAGE, {"mode": "PERMISSIVE"})
    return raw.withColumn("m", parsed).filter(_is_message(value, F.col("m")))


def corrupt_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """The records that parse_messages() leaves out."""
    parsed = F.from_json(F.col(value), MESSAGE, {"mode": "PERMISSIVE"})
    return raw.withColumn("m", parsed).filter(~F.coalesce(_is_message(value, F.col("m")), F.lit(False))).drop("m")


def classify_messages(raw: DataFrame) -> DataFrame:
    """Adds kind: trades, l2, ack, error, heartbeat; other messages are dropped."""
    m = parse_messages(raw)
    channel, kind = F.col("m.channel"), F.col("m.type")
    named = (
        F.when(channel == "market_trades", "trades")
        .when(channel.isin("l2_data", "level2"), "l2")
        .when(channel == "subscriptions", "ack")
        .when(channel == "heartbeats", "heartbeat")
        .when(kind == "error", "error")
    )
    return m.withColumn("kind", named).filter("kind is not null")


def arrival_columns(messages: DataFrame) -> list[str]:
    """Those of the columns that say when and where a message came in."""
    return [c for c in ARRIVAL if c in messages.columns]


def extract_trades(messages: DataFrame) -> DataFrame:
    """One row per trade, from the root array or the events' arrays; missing values are empty, 0 or the arrival time."""
    trades = F.coalesce(F.col("m.trades"), F.flatten(F.transform(F.filter("m.events", lambda e: e["trades"].isNotNull()), lambda e: e["trades"])))
    rows = messages.filter("kind = 'trades'").select(*arrival_columns(messages), F.posexplode(trades).alias("ord", "t"))
    return rows.select(
        F.coalesce("t.product_id", F.lit("")).alias("product_id"),
        F.coalesce("t.trade_id", F.lit("")).alias("trade_id"),
        parse_exchange_ts(F.col("t.time"), F.col("arrival_ts")).alias("ts"),
        parse_side(F.col("t.side")).alias("side"),
        parse_double(F.coalesce("t.price", F.lit(""))).alias("price"),
        parse_double(F.coalesce("t.size", F.lit(""))).alias("size"),
        *arrival_columns(messages),
        "ord",
    ).withColumn("side", F.coalesce("side", F.lit("Unknown")))


def extract_l2(messages: DataFrame) -> DataFrame:
    """One row per level of a snapshot or update. Incomplete levels, unknown sides and empty products are dropped, and
    levels without quantity in a snapshot."""
    rows = messages.filter("kind = 'l2'").select("m.timestamp", "m.sequence_num", *arrival_columns(messages), F.posexplode("m.events").alias("event_no", "e"))
    rows = rows.select("*", F.posexplode("e.updates").alias("level_no", "u")).filter("e.type in ('snapshot', 'update')")
    complete = F.col("u.side").isNotNull() & F.col("u.price_level").isNotNull() & F.col("u.new_quantity").isNotNull()
    rows = rows.filter(complete & (F.coalesce("e.product_id", F.lit("")) != ""))
    out = rows.select(
        F.col("e.product_id").alias("product_id"),
        parse_exchange_ts(F.col("timestamp"), F.col("arrival_ts")).alias("ts"),
        F.col("arrival_seq").alias("seq"),
        (F.col("event_no") * 1_000_000 + F.col("level_no")).alias("ord"),
        F.col("e.type").alias("kind"),
        parse_book_side(F.col("u.side")).alias("side"),
        parse_double(F.col("u.price_level")).alias("price"),
        parse_double(F.col("u.new_quantity")).alias("quantity"),
        "sequence_num",
        *[c for c in arrival_columns(messages) if c != "arrival_seq"],
    )
    return out.filter("side is not null and not (kind = 'snapshot' and quantity <= 0)")


def extract_acks(messages: DataFrame) -> DataFrame:
    ids = F.coalesce(F.col("m.product_ids"), F.flatten(F.transform(F.filter("m.events", lambda e: e["product_ids"].isNotNull()), lambda e: e["product_ids"])))
    return messages.filter("kind = 'ack'").select("arrival_seq", F.explode(ids).alias("product_id"))


def extract_errors(messages: DataFrame) -> DataFrame:
    return messages.filter("kind = 'error'").select("arrival_seq", F.coalesce("m.message", F.lit("provider error")).alias("message"))


def sequence_audit(rows: DataFrame, product="product_id", seq="sequence_num", arrival="arrival_seq", bucket: int = BUCKET) -> DataFrame:
    """Each message with the step from the product's previous numbered one: first, next, gap (missed), duplicate or regression; unnumbered without a number.

    The previous message is looked for within a bucket of the order of arrival; a bucket's first one looks back to the last of an earlier bucket.
    Rows without a product are a product of their own, rows without an order of arrival come first; arrival may be several columns, to settle ties."""
    found = running_lag(rows.withColumn("_numbered", F.col(seq).isNotNull()), [product, "_numbered"], arrival, F.col(seq), "previous", bucket)
    step = F.col(seq) - F.col("previous")
    state = F.when(~F.col("_numbered"), "unnumbered").when(F.col("previous").isNull(), "first").when(step == 1, "next").when(step > 1, "gap").when(step == 0, "duplicate").otherwise("regression")
    missed = F.when(F.col("_numbered"), F.greatest(F.coalesce(step, F.lit(0)) - 1, F.lit(0)))
    return found.withColumn("state", state).withColumn("missed", missed).drop("_numbered")


def feed_silence(rows: DataFrame, ts_ms="ts_ms", threshold_ms: int = 10_000, bucket_ms: int = 3_600_000, keys: tuple = ()) -> DataFrame:
    """Stretches of more than threshold_ms without a message. Neighbours are found per bucket of time; a bucket's first
    message looks back to the last one of the buckets before, so no task orders a whole feed."""
    bucketed = rows.withColumn("bucket", F.floor(F.col(ts_ms) / bucket_ms))
    last = bucketed.groupBy(*keys, "bucket").agg(F.max(ts_ms).alias("last"))
    carried = last.select(*keys, "bucket", F.lag("last").over(Window.partitionBy(*keys).orderBy("bucket")).alias("carried"))
    before = F.lag(ts_ms).over(Window.partitionBy(*keys, "bucket").orderBy(ts_ms))
    found = bucketed.join(carried, [*keys, "bucket"]).withColumn("from_ms", F.coalesce(before, "carried"))
    gap = F.col(ts_ms) - F.col("from_ms")
    return found.filter(gap > threshold_ms).select(*keys, "from_ms", F.col(ts_ms).alias("to_ms"), gap.alias("silent_ms"))


def throughput(rows: DataFrame, window_ms: int, ts_ms="ts_ms", keys: tuple = ("product_id",)) -> DataFrame:
    """Messages and messages per second of each window."""
    start = (F.floor(F.col(ts_ms) / window_ms) * window_ms).cast("long").alias("window_start")
    counted = rows.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("n"))
    per_second: Column = F.col("n") * 1000.0 / window_ms if window_ms > 0 else F.lit(0.0)
    return counted.withColumn("per_second", per_second)
