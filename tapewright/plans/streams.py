"""Queries that run the stream operators over the events as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import book, messages
from tapewright.plans import sqltext as S
from tapewright.plans.market import _SLICE_COLUMNS, DAY, HOUR, _as_messages, _rounded, _with
from tapewright.sources import views
from tapewright.sources.feed import read_feed, trade_sink
from tapewright.sources.filings import write_partitioned
from tapewright.streaming import streams


#: Fifths of the ids, by which the queries deal their events, and the rows of a file: what bounds a batch, and so what a task holds. Small batches cost their state stores' commits more than their rows.
SLICES, SLICE_ROWS = 5, 1_000_000


def _event_files(spark: SparkSession, d: str, order: tuple = tuple(range(SLICES))) -> str:
    """A folder of all events, one slice of ids after the other, SLICES files or more as the table grows. The table is read once and cut by slice; each slice is read from its own part. order: of the slices, in fifths."""
    events = views.table(spark, d, "events")
    low, high, n = events.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    path, cuts, each = streams.new_folder(spark, "events"), streams.new_folder(spark, "cuts"), max(1, -(-n // (SLICES * SLICE_ROWS)))
    low, width = low or 0, -(-((high or 0) - (low or 0) + 1) // SLICES)
    part = f"((event_id - {low}) % {width} * {each} + {each - 1}) div {width}"
    rows = events.withColumn("slice", F.expr(f"(event_id - {low}) div {width} * {each} + {part}"))
    rows.write.partitionBy("slice").parquet(cuts)
    cut = spark.read.schema(rows.schema).parquet(cuts)
    for k in order:
        for slice in range(k * each, (k + 1) * each):
            cut.filter(F.col("slice") == slice).drop("slice").coalesce(1).write.mode("append").parquet(path)
    return path


def _events(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """All events as a stream of several batches, a file of _event_files() at a time."""
    schema = views.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path or _event_files(spark, d))


def _trades(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    return _events(spark, d, path).selectExpr(
        "event_type AS product_id", "concat('t', event_id) AS trade_id", f"timestamp_millis({views.MS}) AS ts", "event_id AS ingest_seq", "value AS price", "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS size"
    )


def _l2(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(
        "event_type AS product_id",
        f"timestamp_millis({views.MS}) AS ts",
        "event_id AS seq",
        "0 AS ord",
        "CASE WHEN event_id % 500 = 3 THEN 'snapshot' ELSE 'update' END AS kind",
        "CASE WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side",
        "CAST(floor(value) AS DOUBLE) AS price",
        "CASE WHEN event_id % 7 = 0 THEN 0D ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END AS quantity",
    )


def r2(spark, d):
    return streams.drained(streams.stream_book(_l2(spark, d)), "book")


def _flushed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stretches of the book on an hourly grid, flushed each day, and the time of the last flush."""
    grid = streams.drained(streams.stream_grid(_l2(spark, d), HOUR, DAY, "1 hour"), "grid")
    until = views.trades(spark, d).agg((F.floor((F.max("ts_ms") - HOUR) / DAY) * DAY).alias("until"))
    return grid, F.broadcast(until)  # one row


def r6(spark, d):
    """The book at every hour, as timers bring it out."""
    grid, until = _flushed(spark, d)
    return book.carry_forward(grid).join(until, F.col("g") * HOUR < F.col("until")).drop("until")


LENGTHS = [6 * HOUR, DAY]


def _liquidity(spark, d, keep: int = 0):
    return streams.drained_with_state(streams.stream_liquidity(_l2(spark, d), LENGTHS, HOUR, 5.0, "1 hour", keep=keep), "liquidity")


def r3_liquidity(spark, d):
    """Slices with all metrics, as the stream puts them out when they end."""
    return _rounded(_liquidity(spark, d)[0], "avg")


def r5(spark, d):
    """Slices of trades as they grow: the open ones too."""
    return streams.drained_updates(streams.stream_slices(_trades(spark, d), [6 * HOUR, DAY], "1 hour"), "open", ["product_id", "timeframe_ms", "slice_start"])


def r5_liquidity(spark, d):
    """Slices with all metrics that have not ended, from the stream's state."""
    at = views.trades(spark, d).agg(F.max("ts_ms")).first()[0] or 0
    return _rounded(streams.open_slices(spark, _liquidity(spark, d)[1], LENGTHS, HOUR, at), "avg", "resting")


def r9(spark, d):
    """The last three slices of each length, which the stream keeps in state after their end."""
    return _rounded(streams.closed_slices(spark, _liquidity(spark, d, 3)[1], HOUR), "avg")


def n12_stream(spark, d):
    """Stretches of 20 minutes without a message of a product, told by timers."""
    return streams.drained(streams.stream_silence(_trades(spark, d), "product_id", 1_200_000, "1 hour"), "silence")


LATE_ORDER = (0, 1, 3, 4, 2)  # rows are late by the watermark that the batch before last has left


def r7(spark, d):
    """Trades kept of each product, and the number of rows that came too late: the third fifth of the events comes last."""
    late = streams.LateRows()
    spark.streams.addListener(late)
    kept, _, query = streams.drained_with_state(streams.unique_trades(_trades(spark, d, _event_files(spark, d, LATE_ORDER)), "1 hour"), "late")
    n = late.of(query)
    spark.streams.removeListener(late)
    counts = kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(counts.agg(F.lit("late rows").alias("product_id"), F.lit(n).cast("long").alias("n")))


def r1(spark, d):
    """Messages written to files and read as a stream, with their place in the file."""
    path = streams.new_folder(spark, "feed")
    _as_messages(spark, d, "l2").select("value").write.text(path)
    rows = streams.drained(streams.stream_l2(spark, path), "feed")
    return rows.select("product_id", F.unix_millis("ts").alias("ts_ms"), "kind", "side", "price", "quantity", F.col("sequence_num").alias("seq"))


def n11_files(spark, d):
    """The audit over files: every tenth message comes two numbers ahead, every seventeenth has none."""
    path = streams.new_folder(spark, "numbered")
    n = F.col("ingest_seq")
    number = F.when(n % 17 == 0, F.lit(None)).when(n % 10 == 4, n + 2).otherwise(n)
    body = F.to_json(F.struct(F.lit("heartbeats").alias("channel"), "product_id", number.alias("sequence_num"), n.cast("string").alias("message")))
    rows = views.trades(spark, d).select(n, body.alias("value"))
    rows.repartitionByRange(SLICES, "ingest_seq").sortWithinPartitions("ingest_seq").select("value").write.text(path)
    found = messages.classify_messages(read_feed(spark, path, by_name=True)).select("arrival_seq", "m.product_id", "m.sequence_num", "m.message")
    return messages.sequence_audit(found).select("product_id", F.col("message").cast("long").alias("place"), "sequence_num", "state", "missed")


def r3(spark, d):
    return streams.drained(streams.stream_slices(_trades(spark, d), [6 * HOUR], "1 hour"), "slices")


def r8(spark, d):
    return streams.drained_latest(streams.quotes(_trades(spark, d)), "quotes")


def r10(spark, d):
    path = _event_files(spark, d)
    twice = _trades(spark, d, path).unionByName(_trades(spark, d, path))
    return streams.drained(streams.unique_trades(twice), "unique").select("product_id", "trade_id", F.unix_millis("ts").alias("ts_ms"), "price", "size")


def s1(spark, d):
    """Messages written to files, read as a feed and parsed."""
    path = streams.new_folder(spark, "feed")
    _as_messages(spark, d, "trades").select("value").write.text(path)
    return messages.extract_trades(messages.classify_messages(read_feed(spark, path))).select("product_id", "trade_id", F.unix_millis("ts").alias("ts_ms"), "side", "price", "size")


def s8(spark, d):
    path = streams.new_folder(spark, "filings")
    write_partitioned(views.filings(spark, d), path, "2001-08-01")
    return spark.read.parquet(path).select("ticker", "accession_no", "filing_date", "form", F.col("as_of").cast("string").alias("as_of"))


def s9(spark, d):
    path = streams.new_folder(spark, "sink")
    trade_sink(_trades(spark, d), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("product_id", "trade_id", "price", "size")


_STREAM_L2 = S.L2.replace("CASE WHEN (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 500 = 0 THEN", "CASE WHEN event_id % 500 = 3 THEN")

_STREAM_BOOK = S.BOOK.replace(S.L2, _STREAM_L2)
_METRICS = _SLICE_COLUMNS.replace(", slice_last", "")
_ENDED = f"(SELECT (max(ts_ms) - {HOUR}) // {6 * HOUR} * {6 * HOUR} FROM l2)"
_UNTIL = f"(SELECT (max(ts_ms) - {HOUR}) // {DAY} * {DAY} FROM l2)"

STREAMS: dict[str, tuple] = {
    "r3_stream_liquidity": (r3_liquidity, _with(f"SELECT {_METRICS} FROM slices WHERE slice_start + timeframe_ms <= {_ENDED}", _STREAM_BOOK + S.slices(HOUR, 5, LENGTHS))),
    "r5_stream_open_liquidity": (
        r5_liquidity,
        _with(f"SELECT {_METRICS}, round(CASE WHEN snapshot_count > 2 THEN avg ELSE 0.0 END, 6) AS resting FROM slices WHERE slice_start + timeframe_ms > {_ENDED}", _STREAM_BOOK + S.slices(HOUR, 5, LENGTHS).replace("CAST(ceil(max(ts_ms) / 3600000.0) AS BIGINT) + 1 AS last_to FROM chg", "(SELECT CAST(ceil(max(ts_ms) / 3600000.0) AS BIGINT) + 1 FROM l2) AS last_to FROM chg")),
    ),
    "r7_stream_late_rows": (
        r7,
        _with(
            """SELECT product_id, count(*) AS n FROM trades, late WHERE NOT (part = 2 AND ts_ms <= mark) GROUP BY 1 UNION ALL SELECT 'late rows', count(*) FROM trades, late WHERE part = 2 AND ts_ms <= mark""",
            S.TRADES.replace("FROM events)", ", (event_id - (SELECT min(event_id) FROM events)) // CAST(ceil((SELECT max(event_id) - min(event_id) + 1 FROM events) / 5.0) AS BIGINT) AS part FROM events)"),
            f"late AS (SELECT max(ts_ms) - {HOUR} AS mark FROM trades WHERE part IN (0, 1, 3))",
        ),
    ),
    "n12_stream_silence": (
        n12_stream,
        _with(
            f"SELECT product_id AS feed, ts_ms AS from_ms, ts_ms + 1200000 AS stale_ms FROM (SELECT product_id, ts_ms, lead(ts_ms) OVER (PARTITION BY product_id ORDER BY ts_ms) AS next_ms FROM trades) WHERE next_ms - ts_ms > 1200000 OR (next_ms IS NULL AND ts_ms + 1200000 < (SELECT max(ts_ms) FROM trades) - {HOUR})",
            S.TRADES,
        ),
    ),
    "n11_sequence_audit_files": (
        n11_files,
        """WITH m AS (SELECT event_type AS product_id, event_id AS place, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 10 = 4 THEN event_id + 2 ELSE event_id END AS sequence_num FROM events),
a AS (SELECT *, lag(sequence_num) OVER (PARTITION BY product_id, sequence_num IS NULL ORDER BY place) AS p FROM m)
SELECT product_id, place, sequence_num, CASE WHEN sequence_num IS NULL THEN 'unnumbered' WHEN p IS NULL THEN 'first' WHEN sequence_num - p = 1 THEN 'next' WHEN sequence_num - p > 1 THEN 'gap' WHEN sequence_num = p THEN 'duplicate' ELSE 'regression' END AS state,
 CASE WHEN sequence_num IS NOT NULL THEN greatest(coalesce(sequence_num - p, 0) - 1, 0) END AS missed FROM a""",
    ),
    "r1_stream_feed": (r1, _with("SELECT product_id, ts_ms, kind, side, price, quantity, seq FROM l2 WHERE NOT (kind = 'snapshot' AND quantity <= 0)", S.L2)),
    "r5_stream_open_slices": (
        r5,
        _with(f"SELECT product_id, timeframe_ms, ts_ms // timeframe_ms * timeframe_ms AS slice_start, count(*) AS n_trades, sum(size) AS volume FROM trades, (SELECT unnest([{6 * HOUR}, {DAY}]::BIGINT[]) AS timeframe_ms) GROUP BY ALL", S.TRADES),
    ),
    "r6_stream_samples": (r6, _with(f"SELECT product_id, g, side, tick, qty FROM sampled WHERE g * {HOUR} < {_UNTIL}", _STREAM_BOOK + S.grid(HOUR))),
    "r9_stream_retained": (
        r9,
        _with(f"SELECT {_METRICS} FROM slices WHERE slice_start + timeframe_ms <= {_ENDED} AND slice_start + 3 * timeframe_ms >= {_ENDED} // timeframe_ms * timeframe_ms", _STREAM_BOOK + S.slices(HOUR, 5, LENGTHS)),
    ),
    "r2_stream_book": (r2, _with("SELECT product_id, seq, side, tick, qty FROM chg", S.BOOK.replace(S.L2, _STREAM_L2))),
    "r3_stream_slices": (
        r3,
        _with(
            f"SELECT product_id, {6 * HOUR}::BIGINT AS timeframe_ms, ts_ms // {6 * HOUR} * {6 * HOUR} AS slice_start, count(*) AS n_trades, sum(size) AS volume FROM trades WHERE ts_ms // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} <= (SELECT max(ts_ms) FROM trades) - {HOUR} GROUP BY ALL",
            S.TRADES,
        ),
    ),
    "r8_stream_quotes": (r8, _with("SELECT product_id, arg_max(price, ingest_seq) AS price, count(*) AS n_trades FROM trades GROUP BY 1", S.TRADES)),
    "s1_read_feed": (s1, _with("SELECT product_id, trade_id, ts_ms, side, price, size FROM trades", S.TRADES)),
    "s8_write_partitioned": (s8, _with("SELECT *, '2001-08-01' AS as_of FROM filings", S.FILINGS)),
    "s9_trade_sink": (s9, _with("SELECT product_id, trade_id, price, size FROM trades", S.TRADES)),
    "r10_stream_unique_trades": (r10, _with("SELECT product_id, trade_id, ts_ms, price, size FROM trades", S.TRADES)),
}
