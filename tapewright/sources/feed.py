"""Raw feed messages from files or a stream, and the sink for trades."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "value string, arrival_ts timestamp, arrival_file string, arrival_seq long"
#: Places of a file, by which the number of a file counts in arrival_seq.
PLACES = 1 << 40
#: What orders the messages of a stream.
ARRIVAL = ["arrival_ts", "arrival_file", "arrival_seq"]


def file_numbers(spark: SparkSession, path: str, by_name: bool) -> dict[str, int]:
    """The files in the order in which they came, by time and name or by name alone. The driver lists a scan's files in any case; none is opened."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").collect()
    return {unquote(name): n for n, (_, name) in enumerate(sorted((None if by_name else when, name) for name, when in files))}


def read_feed(spark: SparkSession, path: str, streaming: bool = False, by_name: bool = False) -> DataFrame:
    """(value, arrival_ts, arrival_file, arrival_seq) of files with a message per line, numbered or not: the file's time, its path, and the message's place.

    A task sees the lines of its part of a file in order, so a line's place is the part's first byte and the lines of the part before it:
    it grows along the file, however that is split. In a batch arrival_seq counts on over the files, in order of their time and name (by_name: of their name).
    In a stream it is the place in the file, and ARRIVAL is the order of messages."""
    numbers = {} if streaming else file_numbers(spark, path, by_name)

    def placed(batches):
        part, n = None, 0
        for batch in batches:
            files, begins = batch.column("arrival_file").to_pylist(), batch.column("begin").to_pylist()
            places = []
            for name, begin in zip(files, begins):
                if (name, begin) != part:
                    part, n = (name, begin), 0
                places.append(numbers.get(unquote(name), len(numbers)) * PLACES + begin + n)
                n += 1
            yield pa.record_batch([batch.column("value"), batch.column("arrival_ts"), batch.column("arrival_file"), pa.array(places, pa.int64())], ["value", *ARRIVAL])

    reader = spark.readStream if streaming else spark.read
    own = F.col("_metadata")
    rows = reader.text(path).select("value", own["file_modification_time"].alias("arrival_ts"), own["file_path"].alias("arrival_file"), own["file_block_start"].alias("begin"))
    return rows.mapInArrow(placed, FEED)


def trade_sink(trades: DataFrame, path: str, checkpoint: str):
    """Writes a stream of trades as parquet; what is there already when it starts is taken first, then it ends."""
    return trades.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tail_trades(trades: DataFrame, rows: int = 50):
    """Shows new trades on the console."""
    return trades.writeStream.format("console").option("numRows", rows).option("truncate", False).outputMode("append").start()
