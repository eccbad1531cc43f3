"""Stored slices that are extended, read and dropped by parts; live batches; windows in the plans of all queries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tapewright.operators import slices, store, trades, viewport
from tapewright.plans.catalog import queries

SF = "/root/testdata/sf0.001"
DAY = store.DAY_MS
STEP = 3_600_000


def grid(spark, days, upto=None):
    rng = random.Random(9)
    rows = []
    for p in ("p", None):
        for side in ("bid", "ask"):
            for tick in range(4):
                at = rng.randrange(5)
                while at < days * 24:
                    to = at + rng.choice([1, 2, 30, 60])
                    rows.append((p, side, tick, float(rng.randrange(1, 9)), at, to))
                    at = to + rng.choice([0, 0, 3])
    rows = [(*r[:5], min(r[5], upto or r[5])) for r in rows if upto is None or r[4] < upto]
    return spark.createDataFrame(rows, "product_id string, side string, tick long, qty double, from_g long, to_g long")


def test_a_store_is_extended_read_and_dropped_by_parts(spark, tmp_path):
    path, lengths = str(tmp_path / "slices"), [STEP * 2, STEP * 6, DAY]
    for upto in (30, 30, 75, None):  # cut short within a day, run twice, and on
        store.extend(grid(spark, 5, upto), path, lengths, STEP, 1.0)
    whole = slices.slice_liquidity(grid(spark, 5), lengths, STEP, 1.0)
    of = lambda rows: sorted(map(str, rows.select(sorted(whole.columns)).collect()))
    assert of(store.read_slices(spark, path)) == of(whole)
    view = store.stored_view(spark, path, STEP * 6, DAY, 2 * DAY)
    assert of(view) == of(viewport.visible_slices(whole, STEP * 6, DAY, 2 * DAY))
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*timeframe_ms.*day", plan) and "Exchange" not in plan
    assert store.drop_days_before(spark, path, 2) == 6
    assert of(store.read_slices(spark, path)) == of(whole.filter(F.col("slice_start") >= 2 * DAY))
    with pytest.raises(ValueError):
        store.extend(grid(spark, 1), path, [STEP * 2, STEP * 3], STEP, 1.0)


def test_a_store_of_nothing(spark, tmp_path):
    store.extend(grid(spark, 1).limit(0), str(tmp_path / "none"), [DAY], STEP, 1.0)
    assert store.latest_day(spark, str(tmp_path / "none"), DAY) is None and store.drop_days_before(spark, str(tmp_path / "none"), 9) == 0


def plain_batches(rows, ms, n):
    out, clock, size, batch = {}, None, 0, 1
    for key, ts in rows:
        clock = ts if clock is None else clock
        out[key], size = batch, size + 1
        if ts - clock >= ms or size >= n:
            clock, size, batch = ts, 0, batch + 1
    return out


@pytest.mark.parametrize("block", [5, 8, 64, 100_000])
@pytest.mark.parametrize("ms, n", [(75, 5), (1000, 3), (20, 1)])
def test_live_batches_equal_a_running_buffer(spark, block, ms, n):
    """Bursts, pauses, times that run back, several products and none, ties of the number, and products shorter than a batch."""
    rng = random.Random(block + ms)
    rows = []
    for p, count in (("p", 200), (None, 60), ("short", 2), ("one", 1)):
        ts = 0
        for k in range(count):
            ts += rng.choice([0, 1, 5, 30, 200, -3])
            rows.append((p, f"t{k:04}", k // 2, ts, 1.0))
    frame = spark.createDataFrame(rows, "product_id string, trade_id string, ingest_seq long, ts_ms long, price double")
    got = {(r.product_id, r.trade_id): r.batch for r in trades.live_batches(frame, ms, n, block).collect()}
    wanted = {}
    for p in ("p", None, "short", "one"):
        wanted |= plain_batches([((p, r[1]), r[3]) for r in rows if r[0] == p], ms, n)
    assert got == wanted


def test_live_batches_of_nothing(spark):
    frame = spark.createDataFrame([], "product_id string, trade_id string, ingest_seq long, ts_ms long")
    assert trades.live_batches(frame).count() == 0


#: Windows by a product, or none, over a table that has few rows for each: what it is.
FEW = {
    "_bucket": "a row for each bucket of a product's order",
    "generation": "a row for each snapshot",
    "slice_start": "a row for each slice",
}


def windows(plan):
    """(keys, order) of all windows of a plan."""
    return [(re.sub(r"#\d+L?", "", keys), re.sub(r"#\d+L?", "", order)) for keys, order in re.findall(r"Window \[.*?\], \[([^\[\]]*(?:\[[^\]]*\])?[^\[\]]*)\](?:, \[(.*?)\])?\n", plan + "\n")]


@pytest.mark.parametrize("name", sorted(n for n in queries() if re.match("[bajwvt]\\d", n) and "stored" not in n and "live" not in n))
def test_windows_are_of_a_bucket_or_of_few_rows(spark, name):
    """No window holds the events of a product, or of a price bucket: it is within a bucket (_key), a level of one snapshot, a book, a slice or a filing, or runs over a table of a row per bucket."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for keys, order in windows(plan):
        if re.fullmatch(r"(product_id|event_type)?", keys) or keys == "product_id, side, tick":
            assert any(f in order for f in FEW) or "rank" in plan, (keys, order)
