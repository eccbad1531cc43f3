"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: White space of the contracts: space and bytes 9 to 13.
SPACES = (9, 10, 11, 12, 13, 32)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: tasks need a folder that they share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tapewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Paths of the tables that written() has made in this session and that are not deleted.
TABLES: list[str] = []


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    TABLES.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ranges whose bounds the driver and each task hold; beyond MOST_RANGES * RANGE_BYTES of text (4.8 TB) ranges grow with the data instead, nothing else changes.
MOST_RANGES = 100_000
RANGE_BYTES = 48 << 20
LEAST_ID = -(1 << 63)


def with_integer_id(docs: DataFrame, doc_id: str) -> DataFrame:
    """docs, if the column is of an integer type; operators that number documents in order of their id take no others."""
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{doc_id} is {kind.simpleString()}: an integer id is needed")
    return docs


def id_number(doc_id: str) -> Column:
    """An integer id in its order, nulls first."""
    return F.coalesce(F.greatest(F.col(f"`{doc_id}`").cast("long"), F.lit(LEAST_ID + 1)), F.lit(LEAST_ID))


@dataclass(frozen=True)
class Ranges:
    """Least (number, tie) of consecutive ranges, ascending; a tie of LEAST_ID stands for any."""

    numbers: np.ndarray
    ties: np.ndarray

    def place(self, number: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The range of each pair."""
        at = np.searchsorted(self.numbers, number, "right") - 1
        low = np.searchsorted(self.numbers, number, "left")
        at -= (low == at) & (self.numbers[at] == number) & (tie < self.ties[at])
        for start in np.unique(low[low < at]).tolist():  # numbers that several ranges share
            rows = np.flatnonzero((low == start) & (self.numbers[np.minimum(low, len(self.numbers) - 1)] == number))
            if len(rows):
                stop = np.searchsorted(self.numbers, self.numbers[start], "right")
                at[rows] = start + np.searchsorted(self.ties[start:stop], tie[rows], "right") - 1
        return np.maximum(at, 0)


def ranges_of(rows: DataFrame) -> Ranges:
    """Ranges of about RANGE_BYTES of text, or one for each task of a shuffle if that is more, of rows (number long, tie long, size long).

    A number that alone fills more than a range is cut along its ties, which are hashes. At most MOST_RANGES rows come to the driver."""
    spark = rows.sparkSession
    size = rows.agg(F.sum("size")).first()[0] or 0
    n = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, size // RANGE_BYTES))
    spread = rows.agg(F.percentile_approx("number", [x / n for x in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0]
    bounds = np.unique(np.array(spread or [0], np.int64))

    def starts(found: Ranges, ties: bool) -> list:
        """Least rows of the ranges, their rows, and how many of these have the number that a range begins with."""

        def placed(batches):
            for batch in batches:
                number = batch.column("number").to_numpy()
                tie = batch.column("tie").to_numpy() if ties else np.full(len(number), LEAST_ID, np.int64)
                at = found.place(number, tie)
                yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(number == found.numbers[at]), batch.column("number"), pa.array(tie)], ["at", "equal", "number", "tie"])

        per = rows.select("number", *["tie"] * ties).mapInArrow(placed, "at int, equal boolean, number long, tie long").groupBy("at")
        return sorted(per.agg(F.min(F.struct("number", "tie")).alias("least"), F.count(F.lit(1)).alias("n"), F.count_if("equal").alias("equal")).select("least.number", "least.tie", "n", "equal", "at").collect())

    found = starts(Ranges(bounds, np.full(len(bounds), LEAST_ID, np.int64)), False)
    each = sum(r["n"] for r in found) / n
    if any(r["equal"] > 2 * each for r in found):  # only then texts are read for their hashes
        numbers, ties = [], []
        equal = {r["at"]: r["equal"] for r in found}
        for at, number in enumerate(bounds.tolist()):
            parts = max(1, math.ceil(equal.get(at, 0) / each)) if equal.get(at, 0) > 2 * each else 1
            numbers += [number] * parts
            ties += [LEAST_ID + (k << 64) // parts for k in range(parts)]
        found = starts(Ranges(np.array(numbers, np.int64), np.array(ties, np.int64)), True)
    return Ranges(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64))


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Deletes a table of written() once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)
        TABLES[:] = [t for t in TABLES if t.rsplit("/", 1)[-1] != path.rsplit("/", 1)[-1]]


def drop_tables(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since there were so many, but for the one that keep reads: what a result was made of, once that is written itself."""
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    for path in TABLES[since:]:
        if path.rsplit("/", 1)[-1] not in kept:
            drop_path(spark, path)
    TABLES[since:] = [t for t in TABLES[since:] if t.rsplit("/", 1)[-1] in kept]


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its rows, without copying a row alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def small_batches(batches, column: str = "text", most: int = 1 << 20):
    """The same rows in batches of about so many bytes of text: bounds what a task holds at once, whatever the rows' lengths."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def release_memory() -> None:
    """Gives memory that a task has freed back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function for mapInArrow() that keeps no freed memory when its partition is done."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return inner


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[list(SPACES)] = False


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes for which inside is true, in order, and the n + 1 places of the rows among them."""
    n = len(raw)
    word = inside[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, stop = word & edge[:-1], word & edge[1:]
    if n > 1:
        start[1:] |= word[1:] & ~word[:-1]
        stop[:-1] |= word[:-1] & ~word[1:]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def running_hash(raw: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """Sums from which span_hashes() has the hash of any span of bytes, each byte first replaced as table says."""
    values = mixed(np.arange(1, 257, dtype=np.uint64))[table]
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[raw] * power_tables(len(raw))[0][: len(raw)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes, equal hash, wherever they stand."""
    inverse = power_tables(len(sums))[1]
    return mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ of the rows, in order, and the n + 1 places of the rows among them."""
    starts, stops, bounds = word_spans(raw, offsets)
    return span_hashes(running_hash(raw, table), starts, stops), bounds


_POWERS: dict[str, np.ndarray] = {}
POWERS_KEPT = 1 << 22  # a longer table is made for the one text that needs it


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2^64, and their inverses, up to the exponent n."""
    if len(_POWERS.get("up", ())) > n:
        return _POWERS["up"], _POWERS["down"]
    found = {}
    for name, base in (("up", int(_MULTIPLIER)), ("down", pow(int(_MULTIPLIER), -1, 1 << 64))):
        out = np.full(max(1 << 16, int(n * 1.05) + 2), base, np.uint64)
        out[0] = 1
        found[name] = np.cumprod(out, dtype=np.uint64)
    if n < POWERS_KEPT:
        _POWERS.update(found)
    return found["up"], found["down"]
