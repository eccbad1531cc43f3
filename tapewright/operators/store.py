"""Liquidity slices kept as a table: parted by length and day, extended by what is new, read and dropped by parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.slices import rollup_pyramid, slice_liquidity
from tapewright.operators.viewport import visible_slices

DAY_MS = 86_400_000
COLUMNS = (
    "product_id string, slice_start long, side string, tick long, total double, snapshot_count long, max double, min double, first_seen long, own_last long, avg double, slice_last long, timeframe_ms long, day long"
)


def write_slices(slices: DataFrame, path: str) -> None:
    """Writes slices; a part (length, day) that has rows among them is replaced as a whole, so a job that runs again changes nothing."""
    rows = slices.withColumn("day", F.expr(f"slice_start div {DAY_MS}")).select(*[c.split()[0] for c in COLUMNS.split(", ")])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe_ms", "day").parquet(path)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(path)


def latest_day(spark: SparkSession, path: str, timeframe_ms: int) -> int | None:
    """The last day that is stored, of a length; None without any."""
    if not exists(spark, path):
        return None
    return read_slices(spark, path).filter(F.col("timeframe_ms") == timeframe_ms).agg(F.max("day")).first()[0]


def extend(grid: DataFrame, path: str, timeframes: list[int], step_ms: int, resolution: float, tick_size: float = 1.0) -> None:
    """Brings the table up to a grid that has grown: from the last stored day on, which may have been cut short, the shortest length is summed up anew; the others,
    multiples of it that part a day, are rolled up from what is stored of it. What lies before that day isn't read."""
    spark, (fine, *coarse) = grid.sparkSession, sorted(timeframes)
    if any(t % fine or DAY_MS % t for t in timeframes):
        raise ValueError("lengths must part a day and be multiples of the shortest")
    day = latest_day(spark, path, fine)
    if day is not None:
        low = -(-day * DAY_MS // step_ms)
        grid = grid.filter(F.col("to_g") > low).withColumn("from_g", F.greatest("from_g", F.lit(low).cast("long")))
    write_slices(slice_liquidity(grid, [fine], step_ms, resolution, tick_size), path)
    if not exists(spark, path):
        return
    for t in coarse:
        stored = read_slices(spark, path).filter(F.col("timeframe_ms") == fine)
        write_slices(rollup_pyramid(stored if day is None else stored.filter(F.col("day") >= day), fine, t), path)


def stored_view(spark: SparkSession, path: str, timeframe_ms: int, t0: int, t1: int) -> DataFrame:
    """visible_slices() of the table: only the parts of the length and of the days in view are read."""
    rows = read_slices(spark, path).filter(F.col("day").between((t0 - timeframe_ms) // DAY_MS, t1 // DAY_MS))
    return visible_slices(rows, timeframe_ms, t0, t1).drop("day")


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _folder(spark, path)
    return fs.exists(p)


def drop_days_before(spark: SparkSession, path: str, day: int) -> int:
    """Deletes the parts of earlier days, of all lengths; returns how many there were. Files are not opened."""
    p, fs = _folder(spark, f"{path}/timeframe_ms=*/day=*")
    old = [x.getPath() for x in fs.globStatus(p) or [] if int(x.getPath().getName().split("=")[1]) < day]
    for part in old:
        fs.delete(part, True)
    return len(old)
