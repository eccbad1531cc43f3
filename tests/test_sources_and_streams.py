"""Readers of files, streams over several batches, and plans in which no task orders a whole product."""

import json
import math
import random
import re
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tapewright.operators import book, dyadic, filings, messages, slices, trades
from tapewright.plans.catalog import queries
from tapewright.sources import filings as sources
from tapewright.sources.feed import read_feed, tail_trades
from tapewright.streaming import streams

SF = "/root/testdata/sf0.001"


def put(folder, **files):
    for name, content in files.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
    return str(folder)


def test_readers_of_companies(spark, tmp_path):
    recent = {"accessionNumber": ["1-2-3", "4"], "filingDate": ["2024-01-02", "x"], "form": ["4", "10-K"], "reportDate": ["2024-01-01", ""]}
    path = put(tmp_path / "s", one={"cik": "0000000320", "name": "A", "tickers": ["AA"], "filings": {"recent": recent}}, two="not json", three={"name": "no number"})
    (company,) = sources.read_submissions(spark, path).collect()
    assert (company.ticker, company.cik, company.name) == ("AA", "0000000320", "A")
    rows = filings.explode_filings(sources.read_submissions(spark, path)).orderBy("accession_no").collect()
    assert [(r.accession_no, str(r.filing_date), r.form) for r in rows] == [("1-2-3", "2024-01-02", "4"), ("4", "None", "10-K")]
    facts = {"cik": 7, "entityName": "A", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2024-01-01", "val": 5, "form": "10-K"}, {"end": "2024-02-01", "val": 6.5, "form": "10-Q"}]}}}}}
    got = sources.read_company_facts(spark, put(tmp_path / "f", a=facts, b="{")).orderBy("pos").collect()
    assert [(r.cik, r.concept, r.unit, str(r.end_date), r.val, r.form) for r in got] == [(7, "Assets", "USD", "2024-01-01", 5.0, "10-K"), (7, "Assets", "USD", "2024-02-01", 6.5, "10-Q")]
    ciks = sources.read_cik_map(spark, put(tmp_path / "c", m={"0": {"ticker": "aa", "cik_str": 320}, "1": {"ticker": "b"}, "2": {"ticker": "cc", "cik_str": "12"}}))
    assert sorted(map(tuple, ciks.collect())) == [("AA", "0000000320"), ("CC", "0000000012")]


def test_readers_of_filings(spark, tmp_path):
    item = lambda *names: {"directory": {"item": [{"name": n, "type": "XML", "size": "1"} for n in names]}}
    folder = tmp_path / "i"
    put(folder, **{"000-24-1__index.json": item("a.xml", "", "b.htm"), "000-24-2__index.json": item("c.xml"), "000-24-3.json": item("d.xml"), "000-24-4__index.json": "broken"})
    found = sources.read_filing_index(spark, f"{folder}/*/*.json").unionByName(sources.read_filing_index(spark, f"{folder}/*.json"))
    assert sorted((r.accession_no, r.name) for r in found.collect()) == [("000-24-1", "a.xml"), ("000-24-1", "b.htm"), ("000-24-2", "c.xml"), ("000-24-3", "d.xml")]
    xml = "<ownershipDocument><issuer><issuerTradingSymbol>AA</issuerTradingSymbol></issuer><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    forms = sources.read_form4(spark, put(tmp_path / "x", **{"000-24-9.xml": xml}))
    (row,) = filings.parse_form4(forms).collect()
    assert (row.accession_no, row.ticker, row.transaction_code, row.shares) == ("000-24-9", "AA", "P", 0.0)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def batches(folder, *parts):
    """A file, and so a batch, for each list of rows, in this order."""
    import os

    folder.mkdir()
    for k, rows in enumerate(parts):
        path = folder / f"{k:03}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))


L2 = "product_id string, ts timestamp, seq long, ord long, kind string, side string, price double, quantity double"


def update(seq, side, price, quantity, kind="update", product="p", order=0):
    return {"product_id": product, "ts": f"2024-01-01T{seq // 60:02}:{seq % 60:02}:00Z", "seq": seq, "ord": order, "kind": kind, "side": side, "price": price, "quantity": quantity}


def test_a_snapshot_in_two_batches_is_one(spark, tmp_path):
    first = [update(0, "bid", 1, 9), update(1, "bid", 10, 5, "snapshot"), update(1, "ask", 11, 6, "snapshot", order=1)]
    second = [update(1, "bid", 9, 4, "snapshot", order=2), update(2, "bid", 10, 5), update(3, "bid", 10, 0)]
    third = [update(4, "ask", 12, 7, "snapshot"), update(5, "bid", 10, 5), update(6, "bid", 9, 4), update(6, "bid", 9, 3, order=1)]
    batches(tmp_path / "l2", first, second, third)
    out = streams.drained(streams.stream_book(stream_of(spark, tmp_path / "l2", L2), parts=3), "book")
    assert sorted((r.seq, r.side, r.tick, r.qty) for r in out.collect()) == [(1, "ask", 11, 6), (1, "bid", 9, 4), (1, "bid", 10, 5), (3, "bid", 10, 0), (4, "ask", 12, 7), (5, "bid", 10, 5), (6, "bid", 9, 3)]


def test_the_grid_of_a_book_comes_out_by_timers(spark, tmp_path):
    """Two levels of which one never changes; seq is in minutes. The last batch only moves the watermark."""
    batches(tmp_path / "l2", [update(1, "bid", 10, 5, "snapshot"), update(1, "ask", 11, 6, "snapshot", order=1)], [update(25, "ask", 11, 7)], [update(200, "ask", 11, 0)])
    grid = streams.stream_grid(stream_of(spark, tmp_path / "l2", L2), step_ms=600_000, flush_ms=3_600_000, delay="1 minute", parts=2)
    rows = streams.drained(grid, "grid").collect()
    base = 1_704_067_200_000 // 600_000
    points = sorted((g - base, r.side, r.qty) for r in rows for g in range(r.from_g, r.to_g))
    wanted = [(g, "bid", 5.0) for g in range(1, 18)] + [(g, "ask", 6.0) for g in (1, 2)] + [(g, "ask", 7.0) for g in range(3, 20)]
    assert points == sorted(wanted)  # the bid up to the flush at three hours, the ask up to its end


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    trade = lambda minute, n: {"product_id": "p", "ts": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00Z", "size": float(n)}
    batches(tmp_path / "t", [trade(10, 1), trade(300, 2)], [trade(301, 3)], [trade(5, 4), trade(302, 5)])
    rows = stream_of(spark, tmp_path / "t", "product_id string, ts timestamp, size double")
    path = tmp_path / "out"
    sliced = streams.stream_slices(rows, [3_600_000], "10 minutes")
    late = streams.LateRows()
    spark.streams.addListener(late)
    query = sliced.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert late.of(query) == 1
    spark.streams.removeListener(late)
    assert sum(r.volume for r in spark.read.parquet(f"{path}/out").collect()) == 1.0  # the slice of 05:00 is still open
    batches(tmp_path / "u", [trade(10, 1), trade(300, 2)], [trade(301, 3)])
    opened = streams.drained_updates(streams.stream_slices(stream_of(spark, tmp_path / "u", rows.schema), [3_600_000], "10 minutes"), "open", ["product_id", "timeframe_ms", "slice_start"])
    assert sorted(r.volume for r in opened.collect()) == [1.0, 5.0]


def test_feed_stream_and_tail(spark, tmp_path):
    text = lambda n: {"channel": "market_trades", "sequence_num": n, "trades": [{"trade_id": str(n), "product_id": "A-B", "price": "1", "size": "2", "side": "BUY", "time": "2024-01-01T00:00:00Z"}]}
    batches(tmp_path / "feed", [text(1), text(2)], [text(3), {"odd": 1}])
    found = streams.drained(streams.stream_trades(spark, str(tmp_path / "feed")), "feed")
    assert sorted((r.trade_id, r.arrival_seq == 0) for r in found.collect()) == [("1", True), ("2", False), ("3", True)]
    query = tail_trades(streams.stream_trades(spark, str(tmp_path / "feed")), rows=2)
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None


def test_audit_looks_back_over_buckets(spark):
    numbers = [5, 6, 6, 9, 8, 9, None, 11]
    rows = spark.createDataFrame([("p", n, 7 * i) for i, n in enumerate(numbers)] + [("q", 3, 1)], "product_id string, sequence_num long, arrival_seq long")
    for bucket in (1, 10, 1000):
        got = {r.arrival_seq: (r.state, r.missed) for r in messages.sequence_audit(rows, bucket=bucket).filter("product_id = 'p'").collect()}
        assert [got[7 * i][0] for i in range(6)] == ["first", "next", "duplicate", "gap", "regression", "next"] and got[21][1] == 2


@pytest.mark.parametrize("name", ["b1_apply_book_updates", "a5_resting_liquidity", "v4_heatmap_cells", "n11_sequence_audit", "w1_last_price_change", "j9_mid_at_trade"])
def test_no_window_over_all_events_of_a_product(spark, name):
    """A window by product alone reads a table that has a row for each bucket of the product's order, never the events."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    for at, line in enumerate(lines):
        if re.search(r"Window \[.*\], \[(product_id|event_type)#\d+\]", line):
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for x in lines[at + 1 :]:
                if len(x) - len(x.lstrip(" :+-")) <= depth:
                    break
                below.append(x.strip(" :+-"))
            assert any(x.startswith("Aggregate") for x in below[:4]), (name, line)


def heartbeat(n):
    return json.dumps({"channel": "heartbeats", "sequence_num": n} if n is not None else {"channel": "heartbeats"})


@pytest.mark.parametrize("split", [60, 10_000])
def test_messages_keep_their_order_of_arrival(spark, tmp_path, split):
    """Whatever their numbers, without any, and however the files are split."""
    numbers = [1, 2, 5, 3, 4, None, 6, 6] + list(range(7, 40))
    for k in range(3):
        (tmp_path / f"part {k}.json").write_text("".join(heartbeat(n) + "\n" for n in numbers[k * 15 : k * 15 + 15]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    found = messages.classify_messages(read_feed(spark, str(tmp_path), by_name=True)).select("arrival_seq", F.lit(None).cast("string").alias("product_id"), "m.sequence_num")
    got = messages.sequence_audit(found).orderBy("arrival_seq").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.sequence_num for r in got] == numbers
    assert [(r.state, r.missed) for r in got[:8]] == [("first", 0), ("next", 0), ("gap", 2), ("regression", 0), ("next", 0), ("unnumbered", None), ("gap", 1), ("duplicate", 0)]


def test_a_feed_without_numbers_makes_a_book(spark, tmp_path):
    level = lambda side, price, size: {"side": side, "price_level": price, "new_quantity": size, "event_time": "x"}
    message = lambda kind, *levels: {"channel": "l2_data", "timestamp": "2024-01-01T00:00:00Z", "events": [{"type": kind, "product_id": "A-B", "updates": list(levels)}]}
    rows = [message("snapshot", level("bid", "10", "5"), level("offer", "11", "6")), message("update", level("bid", "10", "0")), message("update", level("bid", "9", "1"))]
    batches(tmp_path / "feed", rows[:2], rows[2:])
    l2 = messages.extract_l2(messages.classify_messages(read_feed(spark, str(tmp_path / "feed")))).withColumn("ts_ms", F.unix_millis("ts"))
    assert [(r.side, r.tick, r.qty, r.prev_qty) for r in book.apply_book_updates(l2).orderBy("seq", "side").collect()] == [("ask", 11, 6, 0), ("bid", 10, 5, 0), ("bid", 10, 0, 5), ("bid", 9, 1, 0)]
    stream = streams.stream_book(streams.stream_l2(spark, str(tmp_path / "feed")), order=streams.FEED_ORDER, parts=2)
    assert sorted((r.side, r.tick, r.qty) for r in streams.drained(stream, "book").collect()) == [("ask", 11, 6), ("bid", 9, 1), ("bid", 10, 0), ("bid", 10, 5)]


def test_no_row_is_lost_to_a_null(spark):
    rows = [("p", 1, 10, 1.0, 5.0), (None, 2, 20, 2.0, 6.0), ("p", None, 30, 3.0, 7.0), (None, 3, None, 4.0, None), ("p", 4, 40, 5.0, 8.0)]
    frame = spark.createDataFrame(rows, "product_id string, ingest_seq long, ts_ms long, price double, size double")
    changes = {r.price: r.change for r in trades.last_price_change(frame).collect()}
    assert changes == {1.0: -2.0, 2.0: 0.0, 3.0: 0.0, 4.0: 2.0, 5.0: 4.0}  # a trade without a number comes first
    assert trades.relative_size(frame).count() == trades.relative_size(frame, scope=()).count() == 5
    mids = spark.createDataFrame([("p", 15, 1.5), (None, 5, 9.0), ("p", 35, None)], "product_id string, at_ms long, mid double")
    assert {r.price: r.mid for r in trades.mid_at_trade(frame, mids, 10).collect()} == {1.0: None, 2.0: 9.0, 3.0: 1.5, 4.0: None, 5.0: None}
    audit = messages.sequence_audit(frame, seq="ingest_seq", arrival="ts_ms")
    assert {r.price: r.state for r in audit.collect()} == {1.0: "first", 2.0: "regression", 3.0: "unnumbered", 4.0: "first", 5.0: "gap"}


def test_best_levels_over_time_and_long_intervals(spark):
    """Against every moment by hand: deletions of the best level, one side empty, levels that stand over many buckets, an open one."""
    rng = random.Random(4)
    rows = [(p, s, rng.randrange(20), 1.0, a, a + rng.choice([1, 3, 50, 400]) if rng.random() < 0.9 else None) for p in "pq" for s in ("bid", "ask") for a in rng.sample(range(1000), 25)]
    frame = spark.createDataFrame(rows, "product_id string, side string, tick long, qty double, from_ms long, to_ms long")
    at = lambda p, s, t: [r[2] for r in rows if r[0] == p and r[1] == s and r[4] <= t and (r[5] is None or t < r[5])]
    for bucket in (7, 100, 5000):
        got = sorted(map(tuple, book.best_changes(frame, bucket).collect()))
        wanted = []
        for p in "pq":
            last = (None, None)
            for t in range(1500):
                now = (max(at(p, "bid", t), default=None), min(at(p, "ask", t), default=None))
                wanted += [(p, t, *now)] if now != last else []
                last = now
        assert got == sorted(wanted)
        times = spark.createDataFrame([(p, t) for p in "pq" for t in range(0, 1500, 37)], "product_id string, at_ms long")
        books = book.book_as_of(frame, times, bucket).groupBy("product_id", "at_ms").count().collect()
        assert {(r.product_id, r.at_ms): r["count"] for r in books} == {(p, t): n for p in "pq" for t in range(0, 1500, 37) if (n := len(at(p, "bid", t)) + len(at(p, "ask", t)))}


def test_blocks_make_up_their_interval_and_are_few(spark):
    pairs = [(a, a + n) for a in (0, 1, 6, 1000, 12345) for n in (1, 2, 3, 17, 64, 1000, 70_000)]
    frame = spark.createDataFrame(pairs, "a long, b long").withColumn("blocks", dyadic.blocks_of("a", "b", 20))
    for r in frame.collect():
        covered = sorted(x for size, block in r.blocks for x in range(block << size, (block + 1) << size))
        assert covered == list(range(r.a, r.b)) and len(r.blocks) <= max(1, 2 * math.log2(r.b - r.a))


def live_updates(minutes, generations):
    """A book of 20 levels a side that a snapshot replaces again and again, and updates that add and remove levels."""
    rng, rows = random.Random(1), []
    for seq in range(minutes):
        if seq % (minutes // generations) == 0:
            base = 100 + seq
            rows += [update(seq, side, base + k * sign, 1 + k, "snapshot", order=k) for side, sign in (("bid", -1), ("ask", 1)) for k in range(1, 21)]
        else:
            rows.append(update(seq, rng.choice(["bid", "ask"]), base + rng.randrange(-30, 30), rng.choice([0, 0, 2.5, 7])))
    return rows


@pytest.mark.parametrize("files", [1, 12])
def test_liquidity_slices_close_on_a_stream(spark, tmp_path, files):
    """All metrics of the closed slices, once each, equal to the batch operator; the open ones and the kept ones from state; state stays flat over ten generations."""
    rows = live_updates(600, 10)
    each = -(-600 // files)
    batches(tmp_path / "l2", *[[r for r in rows if k * each <= r["seq"] < (k + 1) * each] for k in range(files)])
    step, lengths = 60_000, [600_000, 3_600_000]
    stream = streams.stream_liquidity(stream_of(spark, tmp_path / "l2", L2), lengths, step, 5.0, "30 minutes", parts=3, keep=2)
    out, state, _ = streams.drained_with_state(stream, "liquidity")
    l2 = spark.createDataFrame([(*list(r.values())[:6], float(r["price"]), float(r["quantity"])) for r in rows], L2.replace("ts timestamp", "ts string"))
    l2 = l2.withColumn("ts_ms", F.unix_millis(F.to_timestamp("ts")))
    changes = book.apply_book_updates(l2)
    batch = slices.slice_liquidity(book.grid_intervals(changes, book.generation_ends(l2), step), lengths, step, 5.0)
    last = l2.agg(F.max("ts_ms")).first()[0]
    ended = (last - 1_800_000) // 600_000 * 600_000
    columns = ["product_id", "timeframe_ms", "slice_start", "side", "tick", "total", "snapshot_count", "max", "min", "first_seen", "own_last"]
    of = lambda frame: sorted(map(tuple, frame.select(*columns).collect()))
    closed = F.col("slice_start") + F.col("timeframe_ms") <= ended
    assert of(out) == of(batch.filter(closed))
    assert {r[2] for r in of(streams.closed_slices(spark, state, step)) if r[1] == 600_000} == {ended - 600_000, ended - 1_200_000}
    opened = streams.open_slices(spark, state, lengths, step, changes.agg(F.max("ts_ms")).first()[0])
    assert of(opened) == of(batch.filter(~closed))
    assert all((r.resting == r.avg) == (r.snapshot_count > 2) or r.resting == 0 for r in opened.collect())
    assert streams.state_of(spark, state, "levels").count() < 120  # of 400 that there were, and 600 updates
    book_out, book_state, _ = streams.drained_with_state(streams.stream_book(stream_of(spark, tmp_path / "l2", L2), parts=3), "book")
    assert book_out.count() == changes.count() and streams.state_of(spark, book_state, "levels").count() < 120


def test_silence_is_told_once(spark, tmp_path):
    beat = lambda s, feed="a": {"feed": feed, "ts": f"2024-01-01T00:{s // 60:02}:{s % 60:02}Z"}
    batches(tmp_path / "f", [beat(0), beat(5), beat(40)], [beat(41), beat(3, "b")], [beat(100)], [beat(101), beat(200, "c")], [beat(210)])
    rows = streams.drained(streams.stream_silence(stream_of(spark, tmp_path / "f", "feed string, ts timestamp"), "feed", 10_000, "1 second"), "silence").collect()
    base = 1_704_067_200_000
    assert sorted((r.feed, (r.from_ms - base) // 1000, (r.stale_ms - r.from_ms)) for r in rows) == [("a", 5, 10_000), ("a", 41, 10_000), ("a", 101, 10_000), ("b", 3, 10_000)]


def test_silence_by_the_clock_without_data(spark, tmp_path):
    """One row while nothing comes, though batches go on."""
    batches(tmp_path / "f", [{"feed": "a", "ts": "2024-01-01T00:00:00Z"}])
    stream = streams.stream_silence(stream_of(spark, tmp_path / "f", "feed string, ts timestamp"), "feed", 1000)
    query = stream.writeStream.format("memory").queryName("silence").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    end = time.time() + 60
    while time.time() < end and not spark.table("silence").count():
        time.sleep(1)
    time.sleep(5)
    query.stop()
    assert [r.feed for r in spark.table("silence").collect()] == ["a"]


def test_late_rows_count_over_a_whole_life():
    """A query's progress remembers a hundred batches, the listener all."""
    late = streams.LateRows()
    progress = SimpleNamespace(runId="r", stateOperators=[SimpleNamespace(numRowsDroppedByWatermark=2), SimpleNamespace(numRowsDroppedByWatermark=1)])
    for _ in range(250):
        late.onQueryProgress(SimpleNamespace(progress=progress))
    late.onQueryTerminated(SimpleNamespace(runId="r"))
    assert late.of(SimpleNamespace(runId="r")) == 750 and late.of(SimpleNamespace(runId="other"), 0.01) == 0


def test_streams_of_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    rows = stream_of(spark, tmp_path / "none", "product_id string, ts timestamp, size double, price double, ingest_seq long")
    assert streams.drained_latest(streams.quotes(rows), "quotes").count() == 0
    assert streams.drained_updates(streams.stream_slices(rows, [1000]), "open", ["product_id", "timeframe_ms", "slice_start"]).count() == 0
