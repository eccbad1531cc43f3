"""Queries on trades, books, slices and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import parse
from tapewright.operators import book, messages, slices, store, sweep, trades, viewport
from tapewright.plans import sqltext as S
from tapewright.sources import views
from tapewright.streaming.streams import new_folder

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
STEP, RESOLUTION, TIMEFRAMES = HOUR, 5.0, [HOUR, 6 * HOUR, DAY]
T0, T1 = 1_704_067_200_000, 1_706_745_600_000  # January 2024
MID = T0 + 10 * DAY
SWEEP = 24  # places of the grid that one task sweeps


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l2 = views.l2_updates(spark, d)
    return book.apply_book_updates(l2), book.generation_ends(l2)


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return book.level_intervals(*_changes(spark, d))


def _grid(spark: SparkSession, d: str, step: int = STEP) -> DataFrame:
    return book.grid_intervals(*_changes(spark, d), step)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """The book at every midnight: (product_id, g, side, tick, qty)."""
    return book.carry_forward(_grid(spark, d, DAY))


def _slices(spark: SparkSession, d: str, timeframes: list[int] = TIMEFRAMES) -> DataFrame:
    return slices.slice_liquidity(_grid(spark, d), timeframes, STEP, RESOLUTION)


def _scored(spark: SparkSession, d: str, **how) -> DataFrame:
    return slices.with_persistence(_slices(spark, d), **how)


def _in_view(spark: SparkSession, d: str, timeframe: int, t0: int, t1: int) -> DataFrame:
    """Slices of one length that a view can see; what lies outside is cut off before it is summed up."""
    return slices.slice_liquidity(viewport.in_view(_grid(spark, d), timeframe, t0, t1, STEP), [timeframe], STEP, RESOLUTION)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    t0, t1 = MID, MID + 10 * DAY
    return viewport.heatmap_cells(_in_view(spark, d, 6 * HOUR, t0, t1), 6 * HOUR, t0, t1, 0.0, 200.0, RESOLUTION)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _as_messages(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Rows of a view written as feed messages, with their order of arrival."""
    if kind == "trades":
        rows = views.trades(spark, d)
        item = F.struct("trade_id", "product_id", F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), F.upper("side").alias("side"), parse.format_exchange_ts(F.timestamp_millis("ts_ms")).alias("time"))
        body = F.struct(F.lit("market_trades").alias("channel"), F.col("ingest_seq").alias("sequence_num"), F.array(item).alias("trades"))
        order = F.col("ingest_seq")
    else:
        rows = views.l2_updates(spark, d)
        side = F.when(F.col("side") == "ask", "offer").otherwise("bid")
        level = F.struct(side.alias("side"), F.col("price").cast("string").alias("price_level"), F.col("quantity").cast("string").alias("new_quantity"))
        event = F.struct(F.col("kind").alias("type"), "product_id", F.array(level).alias("updates"))
        body = F.struct(F.lit("l2_data").alias("channel"), F.col("seq").alias("sequence_num"), parse.format_exchange_ts(F.timestamp_millis("ts_ms")).alias("timestamp"), F.array(event).alias("events"))
        order = F.col("seq")
    return rows.select(F.to_json(body).alias("value"), F.timestamp_millis(F.lit(0)).alias("arrival_ts"), order.alias("arrival_seq"))


def n1(spark, d):
    raw = _as_messages(spark, d, "trades").unionByName(_as_messages(spark, d, "l2"))
    return messages.classify_messages(raw).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def n2(spark, d):
    rows = messages.extract_trades(messages.classify_messages(_as_messages(spark, d, "trades")))
    return rows.select("product_id", "trade_id", F.unix_millis("ts").alias("ts_ms"), "side", "price", "size")


def n3(spark, d):
    rows = messages.extract_l2(messages.classify_messages(_as_messages(spark, d, "l2")))
    return rows.select("product_id", F.unix_millis("ts").alias("ts_ms"), "seq", "kind", "side", "price", "quantity")


def n4(spark, d):
    raw = views.trades(spark, d).select(
        F.to_json(F.struct(F.lit("subscriptions").alias("channel"), F.array("product_id", F.lit("ALL")).alias("product_ids"))).alias("value"), F.timestamp_millis(F.lit(0)).alias("arrival_ts"), F.col("ingest_seq").alias("arrival_seq")
    )
    return messages.extract_acks(messages.classify_messages(raw)).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


def n5(spark, d):
    text = F.when(F.col("ingest_seq") % 2 == 0, F.concat(F.lit("rejected "), F.col("trade_id")))
    raw = views.trades(spark, d).select(F.to_json(F.struct(F.lit("error").alias("type"), text.alias("message"))).alias("value"), F.timestamp_millis(F.lit(0)).alias("arrival_ts"), F.col("ingest_seq").alias("arrival_seq"))
    return messages.extract_errors(messages.classify_messages(raw))


def n6(spark, d):
    return views.table(spark, d, "events").select("event_id", parse.parse_side(F.col("event_type"), buy="purchase", sell="view").alias("side"))


def n7(spark, d):
    text = F.concat(F.col("value").cast("string"), F.lit(" units"))
    bad = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(text)
    return views.table(spark, d, "events").select("event_id", parse.parse_double(bad).alias("number"), parse.parse_int(F.concat(F.col("user_id").cast("string"), F.lit("x"))).alias("whole"))


def n8(spark, d):
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")
    broken = F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(text)
    return views.table(spark, d, "events").select("event_id", F.unix_micros(parse.parse_exchange_ts(broken, F.timestamp_millis(F.lit(0)))).alias("us"))


def n9(spark, d):
    return views.trades(spark, d).select("ingest_seq", parse.format_exchange_ts(F.timestamp_millis("ts_ms")).alias("text"))


def n10(spark, d):
    rows = views.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" "), "event_type", F.lit("-usd "))).otherwise(F.col("event_type")).alias("symbol"))
    return rows.select("event_id", parse.valid_symbol(F.col("symbol")).alias("symbol"), parse.ticker_of(F.col("symbol")).alias("ticker"))


def n11(spark, d):
    rows = views.trades(spark, d)
    return messages.sequence_audit(rows, seq="ingest_seq", arrival=["ts_ms", "ingest_seq"], bucket=DAY).select("product_id", "ingest_seq", "state", "missed")


def n12(spark, d):
    return messages.feed_silence(views.trades(spark, d), threshold_ms=600_000, bucket_ms=DAY)


def n13(spark, d):
    return messages.throughput(views.trades(spark, d), HOUR)


def b1(spark, d):
    return _changes(spark, d)[0].drop("ts_ms")


def b4(spark, d):
    noon = views.l2_updates(spark, d).select("product_id", F.sequence(F.lit(T0 + DAY), F.lit(T0 + 29 * DAY), F.lit(7 * DAY)).alias("t")).distinct()
    return book.book_as_of(_intervals(spark, d), noon.select("product_id", F.explode("t").alias("at_ms")))


def b5(spark, d):
    return book.book_top_n(_daily(spark, d), 5, "g")


def b9(spark, d):
    return book.band_filter(_daily(spark, d), "percent_mid", 0.25, at="g")


def b9_modes(spark, d):
    """All three modes, and a half band of 0, which counts as unset."""
    modes = (("fixed_dollar", 10.0), ("ticks", 8.0), ("percent_mid", 0.1), ("ticks", 0.0))
    parts = [book.band_filter(_daily(spark, d), mode, value, at="g").withColumn("band", F.lit(f"{mode} {value:g}")) for mode, value in modes]
    return reduce(DataFrame.unionByName, parts)


def _written(rows: DataFrame) -> DataFrame:
    """A table of the rows: slices read their intervals more than once, and a sweep is dearer than a scan."""
    path = new_folder(rows.sparkSession, "kept")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def a3_band(spark, d):
    kept = _written(sweep.band_intervals(_grid(spark, d, 6 * HOUR), "percent_mid", 0.25, bucket=SWEEP))
    return _rounded(slices.slice_liquidity(kept, [DAY], 6 * HOUR, RESOLUTION), "avg")


def b9_sweep(spark, d):
    """The levels within the band at every grid point, from intervals of those that the band keeps."""
    return book.carry_forward(sweep.band_intervals(_grid(spark, d, 6 * HOUR), "percent_mid", 0.1, bucket=SWEEP))


def b10_sweep(spark, d):
    return book.carry_forward(sweep.depth_intervals(_grid(spark, d, 6 * HOUR), 5, SWEEP))


def n1_kinds(spark, d):
    """Messages of every kind, and those that are dropped: of no kind, of another shape, no JSON at all."""
    texts = ("market_trades", "l2_data", "level2", "subscriptions", "heartbeats")
    text = lambda k, t: F.when(F.col("event_id") % 9 == k, t)
    message = F.coalesce(
        *[text(k, F.concat(F.lit(f'{{"channel":"{c}","sequence_num":'), "event_id", F.lit("}"))) for k, c in enumerate(texts)],
        text(5, F.concat(F.lit('{"type":"error","message":"no '), "event_id", F.lit('"}'))), text(6, F.lit('{"unknown_field":"x"}')), text(7, F.lit("soon {")), F.lit('["market_trades"]'),
    )
    raw = views.table(spark, d, "events").select(message.alias("value"), F.timestamp_millis(F.lit(0)).alias("arrival_ts"), F.col("event_id").alias("arrival_seq"))
    return messages.classify_messages(raw).select("arrival_seq", "kind")


def b12(spark, d):
    return book.latest_book(views.l2_updates(spark, d).select("product_id", "seq", "side", "price", "quantity"))


def a3(spark, d):
    return _rounded(_slices(spark, d), "avg")


def a3_messages(spark, d):
    l2 = views.l2_updates(spark, d)
    samples = book.message_samples(l2)
    intervals = book.message_intervals(book.apply_book_updates(l2), book.generation_ends(l2), samples)
    return _rounded(slices.slice_messages(intervals, samples, [6 * HOUR, DAY], RESOLUTION), "avg")


def a1(spark, d):
    return slices.sampled_levels(_grid(spark, d), RESOLUTION, depth=10)


def a3_depth(spark, d):
    return _rounded(slices.slice_liquidity(_written(sweep.depth_intervals(_grid(spark, d), 10, SWEEP)), [DAY], STEP, RESOLUTION), "avg")


def a11(spark, d):
    return _rounded(slices.rollup_pyramid(_slices(spark, d, [6 * HOUR]), 6 * HOUR, DAY), "avg")


def j7(spark, d):
    """Trades and the levels that stood at their price when they came: a range join by buckets of time."""
    rows = views.trades(spark, d).select("product_id", "trade_id", F.col("ts_ms").alias("at_ms"), F.floor("price").alias("tick"))
    return book.book_as_of(_intervals(spark, d), rows, 10 * MINUTE, ("tick",), 6).select("product_id", "trade_id", "side", "qty")


def _mids(spark, d):
    """The mid from every change of the best levels on."""
    return book.mid_changes(_intervals(spark, d), bucket_ms=DAY)


def j9(spark, d):
    return trades.mid_at_trade(views.trades(spark, d), _mids(spark, d)).select("product_id", "trade_id", "mid")


def j10(spark, d):
    every = _slices(spark, d, [DAY]).select("product_id", "timeframe_ms", "slice_start").distinct()
    return viewport.unprocessed(every, every.filter(F.col("slice_start") < MID))


def a14(spark, d):
    return trades.ohlc(views.trades(spark, d), 6 * HOUR)


def t9(spark, d):
    return _rounded(trades.significant_trades(views.trades(spark, d), _mids(spark, d)), "impact").select("product_id", "trade_id", "mid", "impact")


def _stored(spark, d) -> str:
    """Slices of all lengths as a table, made in two goes: up to the middle, and what has come since."""
    path = new_folder(spark, "slices")
    grid = _grid(spark, d)
    half = MID // STEP
    store.extend(grid.filter(F.col("from_g") < half).withColumn("to_g", F.least("to_g", F.lit(half).cast("long"))), path, TIMEFRAMES, STEP, RESOLUTION)
    store.extend(grid, path, TIMEFRAMES, STEP, RESOLUTION)
    return path


def v2_stored(spark, d):
    return _rounded(store.stored_view(spark, _stored(spark, d), 6 * HOUR, MID, MID + DAY), "avg")


def v4_stored(spark, d):
    t0, t1 = MID, MID + 10 * DAY
    return _rounded(viewport.heatmap_cells(store.stored_view(spark, _stored(spark, d), 6 * HOUR, t0, t1), 6 * HOUR, t0, t1, 0.0, 200.0, RESOLUTION), "liquidity", "intensity")


def t7_stored(spark, d):
    """What is left once the days before the middle are dropped."""
    path = _stored(spark, d)
    store.drop_days_before(spark, path, MID // DAY)
    return store.read_slices(spark, path).select(*slices.KEY, "total")


def t8_live(spark, d):
    return trades.live_batches(views.trades(spark, d), HOUR, 3).select("product_id", "trade_id", "batch")


def _with(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + sql


_BOOK_DAILY = S.BOOK + S.grid(DAY)
_SLICES = S.BOOK + S.slices(STEP, int(RESOLUTION), TIMEFRAMES)
_MIDS = """, tob AS (SELECT product_id, g, max(CASE WHEN side = 'bid' THEN tick END) * 1.0::DOUBLE AS bid, min(CASE WHEN side = 'ask' THEN tick END) * 1.0::DOUBLE AS ask FROM sampled GROUP BY ALL),
mids AS (SELECT product_id, g, coalesce((bid + ask) / 2, bid, ask, 0.0::DOUBLE) AS mid FROM tob)"""


def _band(half: str) -> str:
    """Levels of sampled within half a band of the mid, or the best of a side."""
    half = f"CASE WHEN {half} > 0 THEN {half} ELSE 100 END"
    return f"""SELECT product_id, g, side, tick, qty FROM (SELECT *, max(CASE WHEN inside THEN 1 ELSE 0 END) OVER w AS any_in, min(CASE WHEN side = 'bid' THEN -tick ELSE tick END) OVER w AS best FROM (
 SELECT s.*, abs(tick - mid) <= CASE WHEN span > 0 THEN least({half}, span / 2) ELSE {half} END AS inside
 FROM sampled s JOIN mids USING (product_id, g) JOIN (SELECT product_id, g, (max(tick) - min(tick)) * 1.0::DOUBLE AS span FROM sampled GROUP BY ALL) USING (product_id, g)) WINDOW w AS (PARTITION BY product_id, g, side))
 WHERE inside OR (any_in = 0 AND (CASE WHEN side = 'bid' THEN -tick ELSE tick END) = best)"""


_CELLS = f""", cells AS (SELECT product_id, side, slice_start, slice_start + timeframe_ms AS slice_end, tick * 5.0::DOUBLE - 2.5 AS price_low, tick * 5.0::DOUBLE + 2.5 AS price_high, avg AS liquidity,
 least(1.0::DOUBLE, avg / 1000) AS intensity, snapshot_count FROM scored WHERE timeframe_ms = {6 * HOUR} AND slice_start + timeframe_ms >= {MID} AND slice_start <= {MID + 10 * DAY} AND tick * 5 BETWEEN 0 AND 200 AND avg > 0)"""
_CHANGES = """, edges AS (SELECT product_id, from_ms AS at_ms FROM intervals UNION SELECT product_id, to_ms FROM intervals WHERE to_ms IS NOT NULL),
best AS (SELECT e.product_id, e.at_ms, max(CASE WHEN side = 'bid' THEN tick END)::DOUBLE AS bid, min(CASE WHEN side = 'ask' THEN tick END)::DOUBLE AS ask
 FROM edges e LEFT JOIN intervals i ON i.product_id = e.product_id AND i.from_ms <= e.at_ms AND (i.to_ms IS NULL OR e.at_ms < i.to_ms) GROUP BY 1, 2),
told AS (SELECT *, row_number() OVER w AS nth, lag(bid) OVER w AS bid_before, lag(ask) OVER w AS ask_before FROM best WINDOW w AS (PARTITION BY product_id ORDER BY at_ms)),
midc AS (SELECT product_id, at_ms, bid, ask, coalesce((bid + ask) / 2, bid, ask) AS mid FROM told WHERE nth = 1 OR bid IS DISTINCT FROM bid_before OR ask IS DISTINCT FROM ask_before)"""
_TRADES_MID = """, tm AS (SELECT t.*, m.mid FROM trades t ASOF LEFT JOIN midc m ON t.product_id = m.product_id AND t.ts_ms >= m.at_ms)"""
_SLICE_COLUMNS = "product_id, timeframe_ms, slice_start, side, tick, total, CAST(snapshot_count AS BIGINT) AS snapshot_count, max, min, first_seen, own_last, round(avg, 6) AS avg, slice_last"

#: name -> (query, SQL)
MARKET: dict[str, tuple] = {
    "n1_classify_messages": (n1, "SELECT 'trades' AS kind, count(*) AS n FROM events UNION ALL SELECT 'l2', count(*) FROM events"),
    "n1_message_kinds": (n1_kinds, "SELECT event_id AS arrival_seq, CASE event_id % 9 WHEN 0 THEN 'trades' WHEN 1 THEN 'l2' WHEN 2 THEN 'l2' WHEN 3 THEN 'ack' WHEN 4 THEN 'heartbeat' ELSE 'error' END AS kind FROM events WHERE event_id % 9 < 6"),
    "n2_extract_trades": (n2, _with("SELECT product_id, trade_id, ts_ms, side, price, size FROM trades", S.TRADES)),
    "n3_extract_l2": (n3, _with("SELECT product_id, ts_ms, seq, kind, side, price, quantity FROM l2 WHERE NOT (kind = 'snapshot' AND quantity <= 0)", S.L2)),
    "n4_extract_acks": (n4, "SELECT event_type AS product_id, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM events"),
    "n5_extract_errors": (n5, "SELECT event_id AS arrival_seq, CASE WHEN event_id % 2 = 0 THEN 'rejected t' || event_id ELSE 'provider error' END AS message FROM events"),
    "n6_parse_side": (n6, "SELECT event_id, CASE WHEN lower(event_type) = 'purchase' THEN 'Buy' WHEN lower(event_type) = 'view' THEN 'Sell' ELSE 'Unknown' END AS side FROM events"),
    "n7_parse_numbers": (n7, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS number, user_id AS whole FROM events"),
    "n8_parse_exchange_ts": (n8, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts) END AS us FROM events"),
    "n9_format_exchange_ts": (n9, "SELECT event_id AS ingest_seq, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM events"),
    "n10_valid_symbol": (n10, "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN upper(event_type) || '-USD' END AS symbol, CASE WHEN user_id % 2 = 0 THEN upper(event_type) END AS ticker FROM events"),
    "n11_sequence_audit": (
        n11,
        _with(
            "SELECT product_id, ingest_seq, CASE WHEN p IS NULL THEN 'first' WHEN ingest_seq - p = 1 THEN 'next' WHEN ingest_seq - p > 1 THEN 'gap' WHEN ingest_seq = p THEN 'duplicate' ELSE 'regression' END AS state, CASE WHEN p IS NULL THEN 0 ELSE greatest(ingest_seq - p - 1, 0) END AS missed FROM (SELECT *, lag(ingest_seq) OVER (PARTITION BY product_id ORDER BY ts_ms) AS p FROM trades)",
            S.TRADES,
        ),
    ),
    "n12_feed_silence": (n12, _with("SELECT p AS from_ms, ts_ms AS to_ms, ts_ms - p AS silent_ms FROM (SELECT ts_ms, lag(ts_ms) OVER (ORDER BY ts_ms) AS p FROM trades) WHERE ts_ms - p > 600000", S.TRADES)),
    "n13_throughput": (n13, _with(f"SELECT product_id, ts_ms // {HOUR} * {HOUR} AS window_start, count(*) AS n, count(*) * 1000.0::DOUBLE / {HOUR} AS per_second FROM trades GROUP BY 1, 2", S.TRADES)),
    "b1_apply_book_updates": (b1, _with("SELECT product_id, seq, generation, side, tick, qty, prev_qty FROM chg", S.BOOK)),
    "b2_level_intervals": (_intervals, _with("SELECT * FROM intervals", S.BOOK)),
    "b3_book_deltas": (lambda s, d: book.book_deltas(_changes(s, d)[0]), _with("SELECT product_id, seq, tick, qty, side FROM chg", S.BOOK)),
    "b4_book_as_of": (b4, _with(f"SELECT i.product_id, t.at_ms, side, tick, qty FROM intervals i JOIN (SELECT unnest(range({T0 + DAY}, {T0 + 29 * DAY + 1}, {7 * DAY})) AS at_ms) t ON from_ms <= at_ms AND (to_ms IS NULL OR at_ms < to_ms)", S.BOOK)),
    "b5_book_top_n": (
        b5,
        _with(
            "SELECT product_id, g, side, tick, qty, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id, g, side ORDER BY CASE WHEN side = 'bid' THEN -tick ELSE tick END) AS rk FROM sampled) WHERE rk <= 5",
            _BOOK_DAILY,
        ),
    ),
    "b6_book_stats": (
        lambda s, d: book.book_stats(_daily(s, d), "g"),
        _with(
            "SELECT product_id, g, count(*) FILTER (WHERE side = 'bid') AS bid_levels, count(*) FILTER (WHERE side = 'ask') AS ask_levels, coalesce(sum(qty) FILTER (WHERE side = 'bid'), 0.0) AS bid_volume, coalesce(sum(qty) FILTER (WHERE side = 'ask'), 0.0) AS ask_volume, false AS is_empty FROM sampled GROUP BY ALL",
            _BOOK_DAILY,
        ),
    ),
    "b7_top_of_book": (
        lambda s, d: book.top_of_book(_daily(s, d), at="g"),
        _with(
            "SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN ask - bid END AS spread, CASE WHEN bid > 0 AND ask > 0 THEN (ask + bid) / 2 END AS mid, coalesce(bid >= ask, false) AS crossed FROM (SELECT product_id, g, max(CASE WHEN side = 'bid' THEN tick END) * 1.0::DOUBLE AS bid, arg_max(qty, CASE WHEN side = 'bid' THEN tick END) AS bid_size, min(CASE WHEN side = 'ask' THEN tick END) * 1.0::DOUBLE AS ask, arg_min(qty, CASE WHEN side = 'ask' THEN tick END) AS ask_size FROM sampled GROUP BY ALL)",
            _BOOK_DAILY,
        ),
    ),
    "b8_mid_price": (lambda s, d: book.mid_price(_daily(s, d), 0.0, at="g"), _with("SELECT * FROM mids", _BOOK_DAILY + _MIDS)),
    "b6_stats_changes": (
        lambda s, d: _rounded(book.stats_changes(_intervals(s, d)), "bid_volume", "ask_volume"),
        _with(
            """SELECT product_id, at_ms, CAST(bid_levels AS BIGINT) AS bid_levels, CAST(ask_levels AS BIGINT) AS ask_levels, round(bid_volume, 6) AS bid_volume, round(ask_volume, 6) AS ask_volume, bid_levels = 0 AND ask_levels = 0 AS is_empty FROM (
 SELECT product_id, at_ms, sum(b) OVER w AS bid_levels, sum(a) OVER w AS ask_levels, CAST(sum(bq) OVER w AS DOUBLE) AS bid_volume, CAST(sum(aq) OVER w AS DOUBLE) AS ask_volume FROM edge
 WINDOW w AS (PARTITION BY product_id ORDER BY at_ms))""",
            S.BOOK,
            """edge AS (SELECT product_id, at_ms, sum(CASE WHEN side = 'bid' THEN n ELSE 0 END) AS b, sum(CASE WHEN side = 'ask' THEN n ELSE 0 END) AS a,
 sum(CASE WHEN side = 'bid' THEN n * CAST(qty AS DECIMAL(28, 8)) ELSE 0 END) AS bq, sum(CASE WHEN side = 'ask' THEN n * CAST(qty AS DECIMAL(28, 8)) ELSE 0 END) AS aq
 FROM (SELECT product_id, from_ms AS at_ms, side, qty, 1 AS n FROM intervals UNION ALL SELECT product_id, to_ms, side, qty, -1 FROM intervals WHERE to_ms IS NOT NULL) GROUP BY 1, 2)""",
        ),
    ),
    "b8_mid_changes": (_mids, _with("SELECT * FROM midc", S.BOOK + _CHANGES)),
    "b9_band_filter": (b9, _with("SELECT product_id, g, side, tick, qty FROM (" + _band("mid * 0.25") + ")", _BOOK_DAILY + _MIDS)),
    "b9_band_modes": (
        b9_modes,
        _with(" UNION ALL ".join(f"SELECT product_id, g, side, tick, qty, '{name}' AS band FROM ({_band(half)})" for name, half in (("fixed_dollar 10", "10.0"), ("ticks 8", "8.0"), ("percent_mid 0.1", "mid * 0.1"), ("ticks 0", "0.0"))), _BOOK_DAILY + _MIDS),
    ),
    "b9_band_sweep": (b9_sweep, _with("SELECT product_id, g, side, tick, qty FROM (" + _band("mid * 0.1") + ")", S.BOOK + S.grid(6 * HOUR) + _MIDS)),
    "b10_depth_sweep": (
        b10_sweep,
        _with("SELECT product_id, g, side, tick, qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id, g, side ORDER BY CASE WHEN side = 'bid' THEN -tick ELSE tick END) AS rk FROM sampled) WHERE rk <= 5", S.BOOK + S.grid(6 * HOUR)),
    ),
    "b10_depth_limit": (
        lambda s, d: book.depth_limit(_daily(s, d), 20, "g"),
        _with("SELECT product_id, g, side, tick, qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id, g, side ORDER BY CASE WHEN side = 'bid' THEN -tick ELSE tick END) AS rk FROM sampled) WHERE rk <= 20", _BOOK_DAILY),
    ),
    "b11_quantize_price": (lambda s, d: book.quantize_price(_daily(s, d), 25.0, at="g"), _with("SELECT product_id, g, side, CAST(round(tick / 25.0::DOUBLE) AS BIGINT) AS tick, sum(qty) AS qty FROM sampled GROUP BY 1, 2, 3, 4", _BOOK_DAILY)),
    "b12_latest_book": (b12, _with("SELECT product_id, seq, side, price, quantity FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) AS rk FROM l2) WHERE rk = 1", S.L2)),
    "b12_latest_whole_book": (
        lambda s, d: book.latest_whole_book(_intervals(s, d)),
        _with("SELECT product_id, side, tick, qty, from_ms FROM intervals WHERE to_ms IS NULL", S.BOOK),
    ),
    "b13_liquidity_at": (
        lambda s, d: book.liquidity_at(_daily(s, d), 20.0, at="g"),
        _with("SELECT product_id, g, coalesce(sum(qty) FILTER (WHERE tick = 20 AND side = 'bid'), 0.0) AS bid, coalesce(sum(qty) FILTER (WHERE tick = 20 AND side = 'ask'), 0.0) AS ask FROM sampled GROUP BY ALL", _BOOK_DAILY),
    ),
    "b14_carry_forward": (_daily, _with("SELECT product_id, g, side, tick, qty FROM sampled", _BOOK_DAILY)),
    "j7_levels_at_trades": (j7, _with("SELECT t.product_id, t.trade_id, i.side, i.qty FROM trades t JOIN intervals i ON t.product_id = i.product_id AND i.tick = CAST(floor(t.price) AS BIGINT) AND i.from_ms <= t.ts_ms AND (i.to_ms IS NULL OR t.ts_ms < i.to_ms)", S.TRADES, S.BOOK)),
    "j8_level_mid": (
        lambda s, d: book.with_mid(_daily(s, d), at="g").select("product_id", "g", "side", "tick", (F.col("tick") - F.col("mid")).alias("from_mid")),
        _with("SELECT product_id, g, side, tick, tick - mid AS from_mid FROM sampled JOIN mids USING (product_id, g)", _BOOK_DAILY + _MIDS),
    ),
    "j9_mid_at_trade": (j9, _with("SELECT product_id, trade_id, mid FROM tm", S.TRADES, S.BOOK + _CHANGES + _TRADES_MID)),
    "j10_unprocessed_slices": (j10, _with(f"SELECT DISTINCT product_id, timeframe_ms, slice_start FROM slices WHERE timeframe_ms = {DAY} AND slice_start >= {MID}", _SLICES)),
    "a1_snapshot_levels": (
        a1,
        _with(
            "SELECT product_id, g, side, CAST(round(tick / 5.0::DOUBLE) AS BIGINT) AS tick, sum(qty) AS qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id, g, side ORDER BY CASE WHEN side = 'bid' THEN -tick ELSE tick END) AS rk FROM sampled) WHERE rk <= 10 GROUP BY 1, 2, 3, 4",
            S.BOOK + S.grid(STEP),
        ),
    ),
    "a2_slice_bounds": (
        lambda s, d: views.trades(s, d).select("ingest_seq", slices.slice_start(F.col("ts_ms"), F.lit(HOUR)).alias("slice_start")).withColumn("slice_end", F.col("slice_start") + HOUR),
        _with(f"SELECT ingest_seq, ts_ms // {HOUR} * {HOUR} AS slice_start, ts_ms // {HOUR} * {HOUR} + {HOUR} AS slice_end FROM trades", S.TRADES),
    ),
    "a3_slice_liquidity": (a3, _with(f"SELECT {_SLICE_COLUMNS} FROM slices", _SLICES)),
    "a4_persistence_ratio": (
        lambda s, d: _rounded(_scored(s, d, mode="strict"), "persistence").select(*slices.KEY, "persistence"),
        _with("SELECT product_id, timeframe_ms, slice_start, side, tick, round(CASE WHEN own_last > first_seen THEN (own_last - first_seen) / timeframe_ms::DOUBLE ELSE 0.0 END, 6) AS persistence FROM slices", _SLICES),
    ),
    "a5_resting_liquidity": (
        lambda s, d: _rounded(_scored(s, d), "resting", "persistence").select(*slices.KEY, "is_open", "persistence", "resting"),
        _with("SELECT product_id, timeframe_ms, slice_start, side, tick, is_open, round(persistence, 6) AS persistence, round(resting, 6) AS resting FROM scored", _SLICES),
    ),
    "a6_spoof_candidates": (
        lambda s, d: slices.spoof_candidates(_scored(s, d)).select(*slices.KEY, "consistent"),
        _with("SELECT product_id, timeframe_ms, slice_start, side, tick, snapshot_count > 2 AS consistent FROM scored WHERE resting = 0", _SLICES),
    ),
    "a7_display_value": (
        lambda s, d: _rounded(_scored(s, d).select(*slices.KEY, *[slices.display_value(m).alias(m) for m in ("average", "maximum", "resting", "total", "other")]), "average", "resting", "other"),
        _with("SELECT product_id, timeframe_ms, slice_start, side, tick, round(avg, 6) AS average, max AS maximum, round(resting, 6) AS resting, total, round(avg, 6) AS other FROM scored", _SLICES),
    ),
    "a8_tick_range": (lambda s, d: slices.tick_range(_slices(s, d)), _with("SELECT product_id, timeframe_ms, slice_start, min(tick) AS min_tick, max(tick) AS max_tick FROM slices GROUP BY 1, 2, 3", _SLICES)),
    "a9_level_metrics": (lambda s, d: _rounded(slices.level_metrics(_slices(s, d), 20.0, "bid", RESOLUTION), "avg"), _with(f"SELECT {_SLICE_COLUMNS} FROM slices WHERE tick = 4 AND side = 'bid'", _SLICES)),
    "a10_add_timeframe": (
        lambda s, d: _rounded(_slices(s, d, [12 * HOUR]), "avg"),
        _with(f"SELECT {_SLICE_COLUMNS} FROM slices", S.BOOK + S.slices(STEP, int(RESOLUTION), [12 * HOUR])),
    ),
    "a11_rollup_pyramid": (a11, _with(f"SELECT {_SLICE_COLUMNS} FROM slices WHERE timeframe_ms = {DAY}", _SLICES)),
    "a12_cells_per_slice": (lambda s, d: slices.cells_per_slice(_cells(s, d)), _with("SELECT product_id, slice_start, count(*) AS cells FROM cells GROUP BY 1, 2", _SLICES + _CELLS)),
    "a13_volume_profile": (lambda s, d: trades.volume_profile(views.trades(s, d), 5.0), _with("SELECT product_id, CAST(round(price / 5.0::DOUBLE) AS BIGINT) AS price_tick, sum(size) AS volume, count(*) AS n_trades FROM trades GROUP BY 1, 2", S.TRADES)),
    "a14_ohlc": (
        a14,
        _with(
            f"SELECT *, close >= open AS bullish, high >= greatest(open, close) AND low <= least(open, close) AS valid FROM (SELECT product_id, ts_ms // {6 * HOUR} * {6 * HOUR} AS bar_start, arg_min(price, ingest_seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, ingest_seq) AS close, sum(size) AS volume, count(*) AS n_trades FROM trades GROUP BY 1, 2)",
            S.TRADES,
        ),
    ),
    "a18_timeframe_coverage": (lambda s, d: slices.timeframe_coverage(_slices(s, d)), _with("SELECT product_id, timeframe_ms, count(DISTINCT slice_start) AS points FROM slices GROUP BY 1, 2", _SLICES)),
    "a3_slice_liquidity_depth": (
        a3_depth,
        _with(
            f"""SELECT *, max(own_last) OVER (PARTITION BY product_id, slice_start) AS slice_last FROM (SELECT product_id, {DAY}::BIGINT AS timeframe_ms, g * {STEP} // {DAY} * {DAY} AS slice_start, side, tick, sum(qty) AS total, count(*) AS snapshot_count, max(qty) AS max, min(qty) AS min, min(g) * {STEP} AS first_seen, max(g) * {STEP} AS own_last, round(sum(qty) / count(*), 6) AS avg
 FROM (SELECT product_id, g, side, CAST(round(tick / 5.0::DOUBLE) AS BIGINT) AS tick, sum(qty) AS qty FROM (SELECT *, row_number() OVER (PARTITION BY product_id, g, side ORDER BY CASE WHEN side = 'bid' THEN -tick ELSE tick END) AS rk FROM sampled) WHERE rk <= 10 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4, 5)""",
            S.BOOK + S.grid(STEP),
        ),
    ),
    "a3_slice_liquidity_band": (
        a3_band,
        _with(
            f"""SELECT *, max(own_last) OVER (PARTITION BY product_id, slice_start) AS slice_last FROM (SELECT product_id, {DAY}::BIGINT AS timeframe_ms, g * {6 * HOUR} // {DAY} * {DAY} AS slice_start, side, tick, sum(qty) AS total, count(*) AS snapshot_count, max(qty) AS max, min(qty) AS min, min(g) * {6 * HOUR} AS first_seen, max(g) * {6 * HOUR} AS own_last, round(sum(qty) / count(*), 6) AS avg
 FROM (SELECT product_id, g, side, CAST(round(tick / 5.0::DOUBLE) AS BIGINT) AS tick, sum(qty) AS qty FROM ({_band("mid * 0.25")}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4, 5)""",
            S.BOOK + S.grid(6 * HOUR) + _MIDS,
        ),
    ),
    "a3_slice_liquidity_messages": (
        a3_messages,
        _with(
            f"""SELECT *, max(own_last) OVER (PARTITION BY product_id, timeframe_ms, slice_start) AS slice_last FROM (
 SELECT product_id, timeframe_ms, ts_ms // timeframe_ms * timeframe_ms AS slice_start, side, tick, sum(qty) AS total, count(*) AS snapshot_count, max(qty) AS max, min(qty) AS min, min(ts_ms) AS first_seen, max(ts_ms) AS own_last, round(sum(qty) / count(*), 6) AS avg
 FROM (SELECT product_id, g, ts_ms, side, CAST(round(tick / 5.0::DOUBLE) AS BIGINT) AS tick, sum(qty) AS qty FROM seen GROUP BY 1, 2, 3, 4, 5), (SELECT unnest([{6 * HOUR}, {DAY}]::BIGINT[]) AS timeframe_ms) GROUP BY 1, 2, 3, 4, 5)""",
            S.BOOK
            + """, msgs AS (SELECT product_id, seq, ts_ms, kind, count(*) FILTER (WHERE kind = 'update') OVER (PARTITION BY product_id ORDER BY seq) - CASE WHEN kind = 'update' THEN 1 ELSE 0 END AS g FROM l2),
mi AS (SELECT * FROM (SELECT h.product_id, h.side, h.tick, h.qty, m.g AS from_g, coalesce(lead(m.g) OVER (PARTITION BY h.product_id, h.generation, h.side, h.tick ORDER BY h.seq), e.g, c.n) AS to_g
 FROM chg h JOIN msgs m USING (product_id, seq) JOIN (SELECT product_id, count(*) AS n FROM msgs WHERE kind = 'update' GROUP BY 1) c USING (product_id)
 LEFT JOIN (SELECT product_id, generation, lead(g) OVER (PARTITION BY product_id ORDER BY generation) AS g FROM (SELECT product_id, seq AS generation, g FROM msgs WHERE kind = 'snapshot')) e ON e.product_id = h.product_id AND e.generation = h.generation)
 WHERE qty > 0 AND from_g < to_g),
seen AS (SELECT x.product_id, x.g, s.ts_ms, x.side, x.tick, x.qty FROM (SELECT *, unnest(range(from_g, to_g)) AS g FROM mi) x JOIN msgs s ON s.product_id = x.product_id AND s.g = x.g AND s.kind = 'update')""",
        ),
    ),
    "w1_last_price_change": (
        lambda s, d: _rounded(trades.last_price_change(views.trades(s, d)), "change", "change_pct").select("product_id", "trade_id", "price", "change", "change_pct"),
        _with(
            "SELECT product_id, trade_id, price, round(coalesce(price - p, 0.0), 6) AS change, round(CASE WHEN p > 0 THEN (price - p) / p * 100 ELSE 0.0 END, 6) AS change_pct FROM (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY ingest_seq) AS p FROM trades)",
            S.TRADES,
        ),
    ),
    "w1_quotes": (
        lambda s, d: _rounded(trades.quotes(views.trades(s, d)), "change", "change_pct"),
        _with(
            "SELECT product_id, price, round(coalesce(price - p, 0.0), 6) AS change, round(CASE WHEN p > 0 THEN (price - p) / p * 100 ELSE 0.0 END, 6) AS change_pct FROM (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY ingest_seq) AS p, row_number() OVER (PARTITION BY product_id ORDER BY ingest_seq DESC) AS rk FROM trades) WHERE rk = 1",
            S.TRADES,
        ),
    ),
    "w2_relative_size": (
        lambda s, d: _rounded(trades.relative_size(views.trades(s, d)), "radius").select("product_id", "trade_id", "radius"),
        _with("SELECT product_id, trade_id, round(CASE WHEN m > 0 THEN 4 + sqrt(ln(1 + greatest(size, 0)) / ln(1 + m)) * 16 ELSE 4 END, 6) AS radius FROM (SELECT *, max(size) OVER (PARTITION BY product_id) AS m FROM trades)", S.TRADES),
    ),
    "t1_recent_trades": (
        lambda s, d: trades.recent_trades(views.trades(s, d), 1000),
        _with("SELECT product_id, trade_id, ts_ms, ingest_seq, side, price, size FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingest_seq DESC) AS rk FROM trades) WHERE rk <= 1000", S.TRADES),
    ),
    "t1_recent_trades_overall": (lambda s, d: trades.recent_trades_overall(views.trades(s, d)), _with("SELECT * FROM trades ORDER BY ingest_seq DESC LIMIT 1000", S.TRADES)),
    "t2_largest_trades": (lambda s, d: trades.largest_trades(views.trades(s, d), 50.0, 500), _with("SELECT * FROM trades WHERE size >= 50 ORDER BY size DESC, trade_id LIMIT 500", S.TRADES)),
    "t3_trades_since": (
        lambda s, d: trades.trades_since(views.trades(s, d), "purchase", "t700"),
        _with("SELECT * FROM trades WHERE product_id = 'purchase' AND ingest_seq > coalesce((SELECT max(ingest_seq) FROM trades WHERE product_id = 'purchase' AND trade_id = 't700'), -1)", S.TRADES),
    ),
    "t4_trade_flow": (lambda s, d: trades.trade_flow(views.trades(s, d), 10.0, 300), _with("SELECT * FROM trades WHERE size > 0 AND size >= 10 ORDER BY ingest_seq LIMIT 300", S.TRADES)),
    "t5_newest_cells": (
        lambda s, d: _rounded(viewport.newest_cells(_cells(s, d), 400, 60.0), "liquidity", "intensity"),
        _with("SELECT product_id, side, slice_start, slice_end, price_low, price_high, round(liquidity, 6) AS liquidity, round(intensity, 6) AS intensity, snapshot_count FROM (SELECT * FROM cells ORDER BY slice_end DESC, slice_start DESC, product_id, side, price_low LIMIT 400) WHERE liquidity >= 60", _SLICES + _CELLS),
    ),
    "t7_retain": (
        lambda s, d: viewport.retain(_slices(s, d), 8).select(*slices.KEY, "total"),
        _with("SELECT product_id, timeframe_ms, slice_start, side, tick, total FROM (SELECT *, dense_rank() OVER (PARTITION BY product_id, timeframe_ms ORDER BY slice_start DESC) AS rk FROM slices) WHERE rk <= 8", _SLICES),
    ),
    "t8_trade_batches": (
        lambda s, d: trades.trade_batches(views.trades(s, d), HOUR, 3).select("product_id", "trade_id", "window", "batch"),
        _with(f"SELECT product_id, trade_id, ts_ms // {HOUR} AS \"window\", CAST(ceil(row_number() OVER (PARTITION BY product_id, ts_ms // {HOUR} ORDER BY ingest_seq) / 3.0) AS INTEGER) AS batch FROM trades", S.TRADES),
    ),
    "t9_significant_trades": (t9, _with("SELECT product_id, trade_id, mid, round(abs(price - mid) / mid, 6) AS impact FROM tm WHERE mid > 0 AND abs(price - mid) / mid > 0.001", S.TRADES, S.BOOK + _CHANGES + _TRADES_MID)),
    "v1_slice_at": (lambda s, d: _rounded(viewport.slice_at(_in_view(s, d, DAY, MID + 5000, MID + 5000), DAY, MID + 5000), "avg"), _with(f"SELECT {_SLICE_COLUMNS} FROM slices WHERE timeframe_ms = {DAY} AND slice_start <= {MID + 5000} AND slice_start + timeframe_ms > {MID + 5000}", _SLICES)),
    "v2_visible_slices": (
        lambda s, d: _rounded(viewport.visible_slices(_in_view(s, d, 6 * HOUR, MID, MID + DAY), 6 * HOUR, MID, MID + DAY), "avg"),
        _with(f"SELECT {_SLICE_COLUMNS} FROM slices WHERE timeframe_ms = {6 * HOUR} AND slice_start + timeframe_ms >= {MID} AND slice_start <= {MID + DAY}", _SLICES),
    ),
    "v2_stored_slices": (v2_stored, _with(f"SELECT {_SLICE_COLUMNS} FROM slices WHERE timeframe_ms = {6 * HOUR} AND slice_start + timeframe_ms >= {MID} AND slice_start <= {MID + DAY}", _SLICES)),
    "v4_stored_cells": (v4_stored, _with("SELECT product_id, side, slice_start, slice_end, price_low, price_high, round(liquidity, 6) AS liquidity, round(intensity, 6) AS intensity, snapshot_count FROM cells", _SLICES + _CELLS)),
    "t7_stored_retained": (t7_stored, _with(f"SELECT product_id, timeframe_ms, slice_start, side, tick, total FROM slices WHERE slice_start >= {MID // DAY * DAY}", _SLICES)),
    "t8_live_batches": (
        t8_live,
        "WITH RECURSIVE " + S.TRADES + f""", t AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingest_seq) AS pos FROM trades),
later AS (SELECT a.product_id, a.pos, min(b.pos) AS nxt FROM (SELECT *, unnest([1, 2, 3]) AS d FROM t) a JOIN t b ON a.product_id = b.product_id AND a.pos + a.d = b.pos WHERE d = 3 OR b.ts_ms - a.ts_ms >= {HOUR} GROUP BY 1, 2),
flush AS (SELECT product_id, min(pos) AS pos FROM (SELECT product_id, pos, ts_ms - min(CASE WHEN pos = 1 THEN ts_ms END) OVER (PARTITION BY product_id) AS since FROM t) WHERE pos = 3 OR (pos < 3 AND since >= {HOUR}) GROUP BY 1
 UNION ALL SELECT f.product_id, l.nxt FROM flush f JOIN later l ON f.product_id = l.product_id AND f.pos = l.pos)
SELECT t.product_id, t.trade_id, CAST(count(f.pos) OVER (PARTITION BY t.product_id ORDER BY t.pos) - CASE WHEN f.pos IS NULL THEN 0 ELSE 1 END + 1 AS BIGINT) AS batch FROM t LEFT JOIN flush f ON f.product_id = t.product_id AND f.pos = t.pos""",
    ),
    "v3_suggest_timeframe": (
        lambda s, d: viewport.suggest_timeframe(slices.lengths_with_data(_grid(s, d), TIMEFRAMES), T0, T1, 200),
        _with(f"SELECT coalesce(min(CASE WHEN {T1 - T0} // timeframe_ms <= 200 THEN timeframe_ms END), min(timeframe_ms), 100) AS timeframe_ms FROM slices", _SLICES),
    ),
    "v4_heatmap_cells": (lambda s, d: _rounded(_cells(s, d), "liquidity", "intensity"), _with("SELECT product_id, side, slice_start, slice_end, price_low, price_high, round(liquidity, 6) AS liquidity, round(intensity, 6) AS intensity, snapshot_count FROM cells", _SLICES + _CELLS)),
    "v5_log_intensity": (
        lambda s, d: _rounded(_cells(s, d).select("product_id", "side", "slice_start", "price_low", parse.log_intensity(F.col("liquidity"), 0.2).alias("intensity")), "intensity"),
        _with("SELECT product_id, side, slice_start, price_low, round(CASE WHEN liquidity > 0 THEN least(1.0::DOUBLE, ln(1 + liquidity) * 0.2) ELSE 0.0 END, 6) AS intensity FROM cells", _SLICES + _CELLS),
    ),
    "v6_price_resolution": (
        lambda s, d: views.trades(s, d).groupBy("product_id", F.floor(F.col("ts_ms") / DAY).alias("day")).agg(parse.price_resolution(F.max("price") - F.min("price")).alias("resolution")),
        _with(f"SELECT product_id, ts_ms // {DAY} AS day, CASE WHEN max(price) - min(price) > 500 THEN 25.0 WHEN max(price) - min(price) > 100 THEN 5.0 WHEN max(price) - min(price) > 50 THEN 1.0 WHEN max(price) - min(price) > 10 THEN 0.5 ELSE 0.25 END::DOUBLE AS resolution FROM trades GROUP BY 1, 2", S.TRADES),
    ),
    "v7_data_extent": (lambda s, d: viewport.data_extent(_slices(s, d)), _with("SELECT timeframe_ms, min(slice_start) AS oldest, max(slice_start + timeframe_ms) AS newest FROM slices GROUP BY 1", _SLICES)),
    "v8_available_timeframes": (lambda s, d: viewport.available_timeframes(slices.lengths_with_data(_grid(s, d), TIMEFRAMES)), _with("SELECT DISTINCT timeframe_ms FROM slices", _SLICES)),
}
