"""Depth and band kept as intervals, against books written out at every grid point."""

import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import book, slices, sweep

LEVELS = "product_id string, side string, tick long, qty double, from_g long, to_g long"


def grid(spark, seed, until=90, extra=""):
    """Two products, one without a name; levels that flicker, stand for long, cross, and a stretch in which nothing changes."""
    rng, rows = random.Random(seed), []
    for product in ("p", None):
        for side, ticks in (("bid", range(-3, 8)), ("ask", range(4, 15))):
            for tick in ticks:
                at = rng.randrange(-5, 20)
                while at < until:
                    to = at + rng.choice([1, 1, 2, 3, 9, 40])
                    rows.append((product, side, tick, float(rng.randrange(1, 9)), at, to if not 50 < to < 70 else 70))
                    at = rows[-1][5] + rng.choice([0, 0, 1, 7])
                    at = at if not 50 < at < 70 else 70
    return spark.createDataFrame(rows, LEVELS)


def written_out(rows):
    found = [tuple(r) for r in book.carry_forward(rows).select("product_id", "g", "side", "tick", "qty").collect()]
    return sorted(found, key=str)


@pytest.mark.parametrize("bucket", [1, 8, 4096])
def test_depth_as_intervals(spark, bucket):
    rows = grid(spark, bucket)
    for n in (1, 3, 100):
        got = written_out(sweep.depth_intervals(rows, n, bucket))
        assert got == sorted((tuple(r) for r in book.depth_limit(book.carry_forward(rows), n, "g").select("product_id", "g", "side", "tick", "qty").collect()), key=str)
    assert sweep.depth_intervals(rows, 0, bucket).count() == 0


@pytest.mark.parametrize("mode, value, unset", [("percent_mid", 0.3, 100.0), ("fixed_dollar", 0.3, 100.0), ("ticks", 2.0, 100.0), ("ticks", 0.0, 0.7)])
def test_band_as_intervals(spark, mode, value, unset):
    rows = grid(spark, 5)
    wanted = book.band_filter(book.carry_forward(rows), mode, value, 0.1, "g", unset)
    got = sweep.band_intervals(rows, mode, value, 0.1, unset, 8)
    assert written_out(got) == sorted((tuple(r) for r in wanted.select("product_id", "g", "side", "tick", "qty").collect()), key=str)


def test_rows_grow_with_changes_and_not_with_the_grid(spark):
    rows = grid(spark, 3)
    fine = rows.withColumns({c: F.col(c) * 1000 for c in ("from_g", "to_g")})
    few, many = (sweep.depth_intervals(r, 3, b).count() for r, b in ((rows, 8), (fine, 8000)))
    assert few == many < book.carry_forward(rows).count()


def test_slices_of_a_depth_and_a_band(spark):
    rows, lengths = grid(spark, 7).filter("from_g >= 0 and product_id is not null"), [6, 24]
    for kept, cut in ((sweep.depth_intervals(rows, 3, 8), {"depth": 3}), (sweep.band_intervals(rows, "percent_mid", 0.2, bucket=8), {"band": {"mode": "percent_mid", "value": 0.2}})):
        wanted = slices.slice_samples(slices.sampled_levels(rows, 2.0, **cut), lengths, 1)
        got = slices.slice_liquidity(kept, lengths, 1, 2.0)
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, wanted.select(sorted(got.columns)).collect()))


def test_nothing_other_sides_and_unknown_bands(spark):
    rows = spark.createDataFrame([("p", "bid", 1, 1.0, 0, 2), ("p", None, 1, 1.0, 0, 2), ("p", "ask", 3, 1.0, 5, 5)], LEVELS)
    assert [tuple(r) for r in sweep.depth_intervals(rows, 1, 4).collect()] == [("p", "bid", 1, 1.0, 0, 2)]
    assert sweep.band_intervals(rows.limit(0)).count() == 0 and sweep.depth_intervals(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sweep.band_intervals(rows, "share")


@pytest.mark.parametrize("bucket", [1, 8, 4096])
def test_statistics_from_each_change_on(spark, bucket):
    """As of the books written out at the times of the changes; a book is empty where none is written; open intervals never end."""
    rows = grid(spark, bucket)
    open_end = F.when(F.col("to_g") < 90, F.col("to_g"))
    got = book.stats_changes(rows.select("product_id", "side", "tick", "qty", F.col("from_g").alias("from_ms"), open_end.alias("to_ms")), bucket).collect()
    times = {(p, t) for p, a, b in rows.select("product_id", "from_g", "to_g").collect() for t in (a, b) if t < 90}
    assert {(r.product_id, r.at_ms) for r in got} == times and len(got) == len(times)
    wanted = {(r.product_id, r.g): tuple(r)[2:] for r in book.book_stats(book.carry_forward(rows), "g").collect()}
    assert any(key not in wanted for key in times) or all(tuple(r)[2:4] != (0, 0) for r in got)
    for r in got:
        assert tuple(r)[2:] == wanted.get((r.product_id, r.at_ms), (0, 0, 0.0, 0.0, True))
    assert book.stats_changes(spark.createDataFrame([], "product_id string, side string, tick long, qty double, from_ms long, to_ms long")).count() == 0
