"""Rules of the operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tapewright.functions import parse
from tapewright.operators import book, filings, messages, slices, trades, viewport
from tapewright.sources import filings as sources
from tapewright.sources.feed import read_feed
from tapewright.streaming import streams


def feed(spark, *texts):
    rows = [(t if isinstance(t, str) else json.dumps(t), 5, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "value string, s long, arrival_seq long").withColumn("arrival_ts", F.timestamp_seconds("s"))


def trade(**k):
    return {"trade_id": "1", "product_id": "BTC-USD", "price": "10.5", "size": "2", "side": "BUY", "time": "2024-01-01T00:00:00.123456789Z"} | k


def of(spark, *items, **root):
    raw = feed(spark, {"channel": "market_trades", "trades": list(items)} | root)
    return messages.extract_trades(messages.classify_messages(raw)).orderBy("ord").collect()


def test_trade_sides_and_missing_fields(spark):
    got = of(spark, trade(), trade(side="SELL"), trade(side="buy"), trade(side="offer"), {"trade_id": "9"}, trade(time="x", price="12abc"))
    assert [r.side for r in got] == ["Buy", "Sell", "Buy", "Unknown", "Unknown", "Buy"]
    assert (got[4].price, got[4].size, got[4].product_id) == (0.0, 0.0, "")
    assert got[5].price == 12.0 and got[5].ts.second == 5 and got[0].ts.microsecond == 123456


def test_trades_of_events_and_a_batch_of_100(spark):
    raw = feed(spark, {"channel": "market_trades", "events": [{"trades": [trade()] * 60}, {"trades": [trade()] * 40}]})
    assert messages.extract_trades(messages.classify_messages(raw)).count() == 100


def test_malformed_messages_are_set_aside(spark):
    raw = feed(spark, "not json", "[1]", "", "{", {"unknown_field": "x"}, {"channel": "other"}, {"channel": "heartbeats"})
    assert [r.kind for r in messages.classify_messages(raw).collect()] == ["heartbeat"]
    assert messages.corrupt_messages(raw).count() >= 4


def test_book_messages(spark):
    level = lambda side, q, p="1.5": {"side": side, "price_level": p, "new_quantity": q}
    events = [{"type": "snapshot", "product_id": "A-B", "updates": [level("bid", "1"), level("offer", "2"), level("bid", "0")]}, {"type": "update", "product_id": "A-B", "updates": [level("bid", "0"), level("x", "1"), {"side": "bid"}]}, {"type": "update", "product_id": "", "updates": [level("bid", "1")]}]
    got = messages.extract_l2(messages.classify_messages(feed(spark, {"channel": "l2_data", "timestamp": "2024-01-01T00:00:00Z", "events": events}))).orderBy("ord").collect()
    assert [(r.kind, r.side, r.quantity) for r in got] == [("snapshot", "bid", 1.0), ("snapshot", "ask", 2.0), ("update", "bid", 0.0)]


def test_errors_and_acks(spark):
    m = messages.classify_messages(feed(spark, {"type": "error"}, {"type": "error", "message": "m"}, {"channel": "subscriptions", "product_ids": ["a", "b"]}))
    assert sorted(r.message for r in messages.extract_errors(m).collect()) == ["m", "provider error"]
    assert sorted(r.product_id for r in messages.extract_acks(m).collect()) == ["a", "b"]


L2 = "product_id string, ts_ms long, seq long, ord long, kind string, side string, price double, quantity double"


@pytest.fixture(scope="module")
def l2(spark):
    rows = [
        ("p", 0, 0, 0, "update", "bid", 9.0, 9.0),  # before any snapshot
        ("p", 10, 1, 0, "snapshot", "bid", 10.0, 1.0),
        ("p", 10, 1, 1, "snapshot", "ask", 12.0, 2.0),
        ("p", 20, 2, 0, "update", "bid", 10.0, 1.0),  # no change
        ("p", 30, 3, 0, "update", "bid", 10.0, 5.0),
        ("p", 30, 3, 1, "update", "bid", 10.0, 4.0),  # the last of a message counts
        ("p", 40, 4, 0, "update", "ask", 12.0, -1.0),
        ("p", 50, 5, 0, "snapshot", "bid", 11.0, 7.0),  # replaces the book
    ]
    return spark.createDataFrame(rows, L2)


def test_changes_intervals_and_books(spark, l2):
    changes = book.apply_book_updates(l2)
    assert [(r.seq, r.side, r.tick, r.qty, r.prev_qty) for r in changes.orderBy("seq", "side").collect()] == [(1, "ask", 12, 2.0, 0.0), (1, "bid", 10, 1.0, 0.0), (3, "bid", 10, 4.0, 1.0), (4, "ask", 12, 0.0, 2.0), (5, "bid", 11, 7.0, 0.0)]
    held = book.level_intervals(changes, book.generation_ends(l2))
    assert {(r.side, r.tick, r.qty, r.from_ms, r.to_ms) for r in held.collect()} == {("ask", 12, 2.0, 10, 40), ("bid", 10, 1.0, 10, 30), ("bid", 10, 4.0, 30, 50), ("bid", 11, 7.0, 50, None)}
    times = spark.createDataFrame([("p", t) for t in (9, 10, 39, 40, 60)], "product_id string, at_ms long")
    levels = book.book_as_of(held, times, bucket_ms=7)
    assert sorted((r.at_ms, r.side, r.tick, r.qty) for r in levels.collect()) == [(10, "ask", 12, 2.0), (10, "bid", 10, 1.0), (39, "ask", 12, 2.0), (39, "bid", 10, 4.0), (40, "bid", 10, 4.0), (60, "bid", 11, 7.0)]
    tops = {r.at_ms: r for r in book.top_of_book(levels).collect()}
    assert (tops[39].mid, tops[39].spread, tops[39].crossed) == (11.0, 2.0, False) and tops[60].mid is None
    assert {r.at_ms: r.mid for r in book.mid_price(levels).collect()}[60] == 11.0
    assert {r.at_ms: (r.bid, r.ask) for r in book.liquidity_at(levels, 12.0).collect()}[10] == (0.0, 2.0)


def test_level_key_is_rounded_not_cut(spark):
    assert spark.sql("select round((75000.01D - 75000D) / 0.01D) a, cast((75000.01D - 75000D) / 0.01D as long) b").first() == (1.0, 0)


def test_band_keeps_the_best_level_of_an_empty_side(spark):
    rows = [("p", 0, "bid", 90, 1.0), ("p", 0, "bid", 50, 1.0), ("p", 0, "ask", 110, 1.0), ("p", 0, "ask", 150, 1.0)]
    levels = spark.createDataFrame(rows, "product_id string, at_ms long, side string, tick long, qty double")
    assert sorted(r.tick for r in book.band_filter(levels, "percent_mid", 0.01).collect()) == [90, 110]
    assert sorted(r.tick for r in book.band_filter(levels, "fixed_dollar", 45.0).collect()) == [90, 110]
    assert sorted(r.tick for r in book.band_filter(levels, "ticks", 0).collect()) == [50, 90, 110, 150]


def test_counted_slices_equal_sampled_ones(spark, l2):
    grid = book.grid_intervals(book.apply_book_updates(l2), book.generation_ends(l2), 3)
    for tfs in ([6, 12], [7]):  # also where a slice isn't a multiple of the step
        a = slices.slice_liquidity(grid, tfs, 3, 5.0)
        b = slices.slice_samples(slices.sampled_levels(grid, 5.0), tfs, 3)
        key = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
        assert key(a) == key(b)
        for r in slices.with_persistence(a).collect():
            assert r["min"] <= r.avg <= r["max"] and abs(r.total - r.avg * r.snapshot_count) < 1e-9 and r.resting in (0.0, r.avg)


def test_persistence_modes(spark):
    rows = [("p", 10, 0, "bid", 1, 8.0, 8, 1.0, 1.0, 0, 9, 1.0, 9), ("p", 10, 0, "bid", 2, 2.0, 2, 1.0, 1.0, 0, 1, 1.0, 9), ("p", 10, 10, "bid", 2, 2.0, 2, 1.0, 1.0, 10, 11, 1.0, 11)]
    names = "product_id string, timeframe_ms long, slice_start long, side string, tick long, total double, snapshot_count long, max double, min double, first_seen long, own_last long, avg double, slice_last long"
    table = spark.createDataFrame(rows, names)
    assert [r.resting for r in slices.with_persistence(table).orderBy("slice_start", "tick").collect()] == [1.0, 1.0, 0.0]
    assert [r.resting for r in slices.with_persistence(table, "strict").orderBy("slice_start", "tick").collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        slices.rollup_pyramid(table, 100, 250)


def test_newest_cells_are_cut_before_the_volume_filter(spark):
    cells = spark.createDataFrame([("p", "bid", t, t + 1, 0.0, float(t % 2)) for t in range(10)], "product_id string, side string, slice_start long, slice_end long, price_low double, liquidity double")
    assert [r.slice_start for r in viewport.newest_cells(cells, 4, 1.0).collect()] == [9, 7]


def test_trades_rings_and_cursors(spark):
    rows = spark.createDataFrame([("a" if i % 6 else "b", f"id{i}", i, i, "Buy", float(i), float(i)) for i in range(1, 1441)], "product_id string, trade_id string, ts_ms long, ingest_seq long, side string, price double, size double")
    kept = trades.recent_trades(rows, 1000)
    assert kept.filter("product_id = 'a'").count() == 1000 and kept.filter("product_id = 'b'").count() == 240
    assert trades.trades_since(rows, "a", "id1439").count() == 0 and trades.trades_since(rows, "a", "?").count() == 1200 and trades.trades_since(rows, "a").count() == 1200
    changes = trades.last_price_change(rows, bucket=100).orderBy("ingest_seq").collect()
    assert changes[0].change == 0.0 and all(r.change in (1.0, 2.0, 6.0) for r in changes if r.ingest_seq > 6)


def test_numbers_symbols_and_scores(spark):
    row = spark.range(1).select(
        parse.parse_double(F.lit("1.5e2x")).alias("a"), parse.parse_double(F.lit("x")).alias("b"), parse.parse_int(F.lit("-12.9")).alias("c"), parse.valid_symbol(F.lit(" btc-usd ")).alias("d"), parse.valid_symbol(F.lit("btc")).alias("e"),
        parse.log_intensity(F.lit(0.0), 1.0).alias("f"), parse.log_intensity(F.lit(1e9), 1.0).alias("g"), parse.price_resolution(F.lit(60.0)).alias("h"), F.round(F.lit(2.5)).alias("i"), F.round(F.lit(-2.5)).alias("j"),
    ).first()
    assert tuple(row) == (150.0, 0.0, -12, "BTC-USD", None, 0.0, 1.0, 1.0, 3.0, -3.0)


def test_form4_documents(spark):
    tx = "<nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{}</value></transactionShares></transactionAmounts></nonDerivativeTransaction>"
    head = "<ownershipDocument><issuer><issuerTradingSymbol>X</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>true</isOfficer></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{}</nonDerivativeTable></ownershipDocument>"
    docs = spark.createDataFrame([("a", head.format(tx.format("10"))), ("b", head.format(tx.format("1") + tx.format("-3"))), ("c", "<broken"), ("d", None)], "accession_no string, xml string")
    got = filings.parse_form4(docs).orderBy("accession_no", "shares").collect()
    assert [(r.accession_no, r.shares, r.position, r.owner_name) for r in got] == [("a", 10.0, "Director, Officer", "N/A"), ("b", 0.0, "Director, Officer", "N/A"), ("b", 1.0, "Director, Officer", "N/A")]


def test_document_choice_takes_the_last_of_priority(spark):
    docs = spark.createDataFrame([("a", 0, "x.htm", ""), ("a", 1, "form4.xml", ""), ("a", 2, "f345.xml", ""), ("a", 3, "a-index.html", "XML"), ("b", 0, "u.htm", ""), ("b", 1, "v.htm", "")], "accession_no string, pos int, name string, type string")
    assert {r.accession_no: r.name for r in filings.pick_primary_document(docs).collect()} == {"a": "f345.xml", "b": "u.htm"}
    assert [r.name for r in filings.pick_form4_xml(docs).collect()] == ["f345.xml"]


def test_filings_arrays_are_cut_to_the_shortest(spark):
    body = {"cik": "0000000012", "tickers": ["T"], "filings": {"recent": {"accessionNumber": ["1-2", "3"], "filingDate": ["2024-01-01", "2024-01-02"], "form": ["4", "4"], "reportDate": ["2024-01-01"]}}}
    rows = filings.explode_filings(sources.parse_submissions(spark.createDataFrame([(json.dumps(body),), ("{",)], "value string"))).collect()
    assert [(r.accession_no, r.url, r.primary_document) for r in rows] == [("1-2", "https://www.sec.gov/Archives/edgar/data/12/12/", None)]


def test_streams_of_messages(spark, tmp_path):
    for k in range(3):
        lines = [json.dumps({"channel": "market_trades", "sequence_num": k, "trades": [trade(trade_id=str(k)), trade(trade_id=str(k))]}), "junk"]
        (tmp_path / f"{k}.json").write_text("\n".join(lines))
    assert read_feed(spark, str(tmp_path)).count() == 6
    got = streams.drained(streams.unique_trades(streams.stream_trades(spark, str(tmp_path))), "test")
    assert sorted(r.trade_id for r in got.collect()) == ["0", "1", "2"]
