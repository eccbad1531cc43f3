"""What would grow faster than its input: files and batches, broadcasts, repeated parsing, and ties that only larger tables have."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapewright.operators import book, filings
from tapewright.plans import market, streams
from tapewright.sources import filings as sources


def put_events(spark, tmp_path, rows):
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_batches_of_events_grow_slower_than_50_000_rows(spark, tmp_path):
    rows = spark.range(300_000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'view' AS event_type", "1D AS value", "'{\"k\": 1}' AS props")
    path = streams._event_files(spark, put_events(spark, tmp_path, rows)).removeprefix("file://")
    files = sorted((f.path for f in os.scandir(path) if f.name.endswith(".parquet")), key=lambda f: os.stat(f).st_mtime_ns)
    bounds = [tuple(spark.read.parquet(f).agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()) for f in files]
    assert bounds == [(k * 60_000, k * 60_000 + 59_999, 60_000) for k in range(5)]


def test_slices_of_events_in_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "SLICE_ROWS", 4)
    rows = spark.range(3, 103, 2).filter("id < 40 or id > 60").selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "1L AS user_id", "'view' AS event_type", "1D AS value", "'' AS props")
    path = streams._event_files(spark, put_events(spark, tmp_path, rows), (0, 1, 3, 4, 2)).removeprefix("file://")
    files = sorted((f.path for f in os.scandir(path) if f.name.endswith(".parquet")), key=lambda f: os.stat(f).st_mtime_ns)
    ids = [[r.event_id for r in spark.read.parquet(f).collect()] for f in files]
    flat = [x for file in ids for x in sorted(file)]
    assert len(files) == 10 and sorted(flat) == [r.event_id for r in rows.orderBy("event_id").collect()]
    late = [x for x in flat if 3 + 2 * 20 <= x < 3 + 3 * 20]
    assert late and flat[-len(late) :] == late


def test_audit_settles_ties_by_number(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(n, at + timedelta(minutes=n // 10), 1, "view", 1.0, '{"k": 1}') for n in range(39, -1, -1)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1)
    got = {r.ingest_seq: r.state for r in market.n11(spark, put_events(spark, tmp_path, frame)).collect()}
    assert got == {n: "next" if n else "first" for n in range(40)}


def test_times_in_blocks_are_not_broadcast_and_levels_meet_by_tick(spark):
    held = [("a", "bid", tick, 1.0 + n, 100 * n, 100 * n + 90 if n < 30 else None) for tick in (5, 6) for n in range(31)]
    intervals = spark.createDataFrame(held, "product_id string, side string, tick long, qty double, from_ms long, to_ms long")
    times = spark.createDataFrame([("a", f"t{n}", 37 * n, 5 + n % 3) for n in range(100)], "product_id string, trade_id string, at_ms long, tick long")
    out = book.book_as_of(intervals, times, 16, ("tick",), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "SortMergeJoin" in line and "part#" in line]
    wanted = times.alias("t").join(intervals.alias("i"), F.expr("t.tick = i.tick and from_ms <= at_ms and (to_ms is null or at_ms < to_ms)")).selectExpr("t.product_id", "trade_id", "at_ms", "t.tick", "side", "qty")
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in wanted.collect()) and out.count() > 50


def test_companies_share_a_file(spark, tmp_path):
    one = lambda cik, v: json.dumps({"cik": cik, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2024-01-01", "val": v, "form": "10-K"}]}}}}})
    (tmp_path / "facts.txt").write_text(one(1, 2.0) + "\n" + one(7, 3.0) + "\n")
    assert sorted((r.cik, r.val) for r in sources.read_company_facts(spark, f"file://{tmp_path}/facts.txt", by_line=True).collect()) == [(1, 2.0), (7, 3.0)]


def test_a_document_is_parsed_once(spark):
    docs = spark.createDataFrame([(1, "<ownershipDocument></ownershipDocument>")], "accession_no long, xml string")
    plan = filings.parse_form4(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1


def test_recent_filings_hold_dates_not_filings(spark):
    """As a rank over all rows has them: filings of a day by number, a number filed twice by its date, dates and tickers that are null, tickers with few filings."""
    rows = spark.range(6000).selectExpr(
        "if(id % 11 = 0, null, concat('T', id % 7)) AS ticker",
        "if(id < 3, id, pmod(xxhash64(id), 900)) AS accession_no",
        "if(id % 13 = 0, null, date_add(DATE'2024-01-01', int(pmod(xxhash64(id, 1), 40)))) AS filing_date",
        "id AS tx",
    )
    few = spark.createDataFrame([("U", 1, "2024-01-01", -1), ("U", 1, "2023-01-01", -2), ("U", 2, None, -3)], "ticker string, accession_no long, filing_date string, tx long")
    view = rows.unionByName(few.withColumn("filing_date", F.to_date("filing_date"))).localCheckpoint()
    for limit in (0, 1, 2, 10):
        out = filings.recent_filings(view, limit)
        ranked = view.selectExpr("tx", "dense_rank() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, accession_no DESC) AS n").filter(f"n <= {limit}")
        assert out.columns == view.columns and sorted(r.tx for r in out.collect()) == sorted(r.tx for r in ranked.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and not [line for line in plan.splitlines() if "Aggregate" in line and "accession_no#" in line]


def test_joins_of_filings_have_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(filings, "JOINED_ROWS", 500)
    tx = spark.range(20_000).selectExpr("concat('T', id % 5) AS ticker", "id div 4 AS accession_no", "1D AS shares", "2D AS price_per_share", "false AS is_derivative")
    own = spark.range(10_000).selectExpr("id AS accession_no", "date_add(DATE'2024-01-01', int(id % 300)) AS filing_date")
    out = filings.insider_view(tx, own, 20_000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 40 and max(sizes) < 1500
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, filings.insider_view(tx, own).collect()))
