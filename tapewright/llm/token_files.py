"""Token ids in files of canonical length-limited Huffman codes.

Documents are encoded once and put in ascending order of their id by ranges. The counts of all ids over the whole
corpus give optimal code lengths of at most LONGEST bits (package-merge); canonical codes follow from the lengths
alone, so a file needs no more than these. A block holds whole documents of about BLOCK_IDS ids; it is decoded
without any other block. Every CHECKPOINT ids a block notes its bit offset, and all these stretches are decoded side by side by a
table of the next LONGEST bits.

A folder of files has two tables: codes (id, length), the length of each id's code, from which a reader makes the codes; and blocks: range,
block (of the range), start (ids of all documents before it), doc_ids, counts, n, checkpoints, payload. Reading needs the folder alone.

Defined cases: null text is empty and is written as its end id alone; rows with one id stand side by side, ordered by a hash of the text;
null ids come first; ids that never occur have no code; an empty table gives empty files; document ids must be of an integer type, others raise
TypeError; a vocabulary of more than 65536 ids raises ValueError, as ids are kept in two bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.bpe import tokenizer_path
from tapewright.llm.common import drop_table, id_number, lean, ranges_of, read_table, shared_dir, small_batches, text_bytes, with_integer_id, written
from tapewright.llm.words import table

LONGEST = 18
BLOCK_IDS = 1 << 16
CHECKPOINT = 512
END_ID = 2  # appended to each document

_U = np.uint64


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal lengths of prefix codes of at most longest bits; 0 for ids without a count. By package-merge."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit in codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate([single, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(single))
        merged = merged[place]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take = 2 * len(single) - 2
    for is_single in reversed(levels):
        leaves = int(is_single[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        step = (_U(1) << (_U(LONGEST) - lengths[order].astype(_U)))
        codes[order] = np.concatenate([np.zeros(1, _U), np.cumsum(step)[:-1]]) >> (_U(LONGEST) - lengths[order].astype(_U))
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """id and code length for every value of the next LONGEST bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    times = 1 << (LONGEST - lengths[order])
    ids, bits = np.zeros(1 << LONGEST, np.uint32), np.ones(1 << LONGEST, np.int64)
    ids[: times.sum()] = np.repeat(order, times)
    bits[: times.sum()] = np.repeat(lengths[order], times)
    return ids, bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids in a row, first bit first, and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    begin = ends - size
    word = begin >> 5
    value = codes[ids] << (_U(64) - ((begin & 31) + size).astype(_U))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(ids) else np.zeros(0, np.int64)
    sums = np.add.reduceat(value, first) if len(ids) else value
    out = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 0, _U)
    out[word[first]] += sums >> _U(32)
    out[word[first] + 1] += sums & _U(0xFFFFFFFF)
    return out.astype(">u4").tobytes(), begin[::CHECKPOINT]


def unpack(payload: bytes, n: int, checkpoints: np.ndarray, decoding: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block; all stretches between checkpoints advance together."""
    words = np.frombuffer(payload, ">u4").astype(_U)
    words = (words << _U(32)) | np.append(words[1:], _U(0))
    table_ids, table_bits = decoding
    out = np.zeros((CHECKPOINT, len(checkpoints)), np.uint32)
    at = checkpoints.astype(np.int64).copy()
    rest = n - CHECKPOINT * (len(checkpoints) - 1)
    for step in range(min(n, CHECKPOINT)):
        if step == rest:
            at = at[:-1]
        peek = (words[at >> 5] >> (_U(64 - LONGEST) - (at & 31).astype(_U))).astype(np.int64) & ((1 << LONGEST) - 1)
        out[step, : len(at)] = table_ids[peek]
        at += table_bits[peek]
    return out.T.ravel()[:n] if rest == CHECKPOINT else np.concatenate([out.T[:-1].ravel(), out[:rest, -1]])


BLOCKS = "range int, block int, start long, doc_ids array<bigint>, counts array<bigint>, ids binary"
FILES = "range int, block int, start long, doc_ids array<bigint>, counts array<bigint>, n long, checkpoints array<bigint>, payload binary"


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents; rows come sorted by range and document."""
    state = {"range": None, "block": 0, "start": 0}
    held: list[tuple[int | None, bytes]] = []
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def block() -> pa.RecordBatch:
        counts = [len(x) // 2 for _, x in held]
        row = [state["range"], state["block"], state["start"], [d for d, _ in held], counts, b"".join([x for _, x in held])]
        state["block"] += 1
        state["start"] += sum(counts)
        held.clear()
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], ["range", "block", "start", "doc_ids", "counts", "ids"])

    total = 0
    for batch in small_batches(batches, "ids"):
        ids = batch.column("ids").to_pylist()
        for place, doc, found in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), ids):
            if held and (place != state["range"] or total >= BLOCK_IDS):
                yield block()
                total = 0
            if place != state["range"]:
                state.update(range=place, block=0, start=0)
            held.append((doc, found))
            total += len(found) // 2
    if held:
        yield block()


def token_blocks(docs: DataFrame, path: str, text="text", doc_id="doc_id", end_id: int = END_ID) -> DataFrame:
    """Written table of blocks of ids, in ascending order of the documents' ids within and across ranges."""
    value = F.col(f"`{text}`").cast("string")
    rows = with_integer_id(docs, doc_id).select(id_number(doc_id).alias("number"), F.xxhash64(value).alias("tie"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), value.alias("text"))
    ranges = ranges_of(rows.select("number", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table(path)
        if words.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        for batch in small_batches(batches, most=2 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            ids, bounds = words.encode(raw, offsets)
            ids = np.insert(ids.astype("<u2"), bounds[1:], end_id)
            data, at = ids.tobytes(), (2 * (bounds + np.arange(len(bounds)))).tolist()
            place = ranges.place(batch.column("number").to_numpy(), batch.column("tie").to_numpy())
            yield pa.record_batch([pa.array(place.astype(np.int32)), batch.column("doc_id"), batch.column("tie"), pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary())], ["range", "doc_id", "tie", "ids"])

    found = rows.mapInArrow(lean(encoded), "range int, doc_id long, tie long, ids binary")
    found = found.repartition(max(1, len(ranges.numbers)), "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "tie", "ids")
    return written(found.mapInArrow(lean(in_blocks), BLOCKS), "blocks")


def id_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """Number of each id over all blocks: at most size rows come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                sums += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=size)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["id", "n"])

    rows = blocks.select("ids").mapInArrow(lean(counted), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r[0]] = r[1]
    return out


def write_files(docs: DataFrame, path: str, folder: str, **columns) -> None:
    """Writes the files of all documents to a new folder."""
    spark = docs.sparkSession
    blocks = token_blocks(docs, path, **columns)
    lengths = code_lengths(id_counts(blocks, 1 << 16))
    totals = {r[0]: r[1] for r in blocks.groupBy("range").agg(F.sum(F.length("ids").cast("long")) / 2).collect()}  # one row for each range
    before, sum_so_far = {}, 0
    for place in sorted(totals):
        before[place] = sum_so_far
        sum_so_far += int(totals[place])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), "<u2")
                payload, checkpoints = pack(ids, lengths, codes)
                start = row.column("start").to_numpy() + before[row.column("range")[0].as_py()]
                more = [pa.array([len(ids)]), pa.array([checkpoints.tolist()], pa.list_(pa.int64())), pa.array([payload])]
                yield pa.record_batch([*row.columns[:2], pa.array(start), *row.columns[3:5], *more], [*batch.schema.names[:5], "n", "checkpoints", "payload"])

    blocks.mapInArrow(lean(coded), FILES).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    used = np.flatnonzero(lengths)
    codes = pa.table({"id": pa.array(used.astype(np.int32)), "length": pa.array(lengths[used].astype(np.int32))})
    spark.createDataFrame(codes).coalesce(1).write.parquet(f"{folder}/codes")  # at most 65536 rows
    drop_table(blocks)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files of a folder."""
    found = spark.read.schema("id int, length int").parquet(f"{folder}/codes").toArrow()
    lengths = np.zeros(1 << 16, np.int64)
    lengths[found.column("id").to_numpy()] = found.column("length").to_numpy()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = decoding_table(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = unpack(row.column("payload")[0].as_buffer(), row.column("n")[0].as_py(), row.column("checkpoints").flatten().to_numpy(), decoding)
                counts = row.column("counts").flatten().to_numpy()
                ends = np.cumsum(counts)
                data, at = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], ends])).tolist()
                check = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
                yield pa.record_batch([row.column("doc_ids").flatten(), pa.array(row.column("start").to_numpy() + ends - counts), pa.array(counts), pa.array(check, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(FILES).parquet(f"{folder}/blocks").mapInArrow(lean(decoded), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(read_table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_files(spark, folder)


QUERIES = {"op9_huffman_token_files": op9_huffman_token_files}
