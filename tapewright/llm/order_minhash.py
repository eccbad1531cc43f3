"""Fingerprints by Order MinHash: likeness of texts under edits.

A text's k-mers of K code points are numbered by occurrence, so that a repeat is another element. For each of SIZE hash
functions the TAKEN elements of least hash are selected and put back in text order; the hash of that tuple is one
component. Two components agree if the same elements come in the same order, which makes the share of equal components
follow edit distance, not only the sets of k-mers.

Defined cases: null text is empty; a text shorter than K is one k-mer, the empty text one empty k-mer, so equal texts always have equal fingerprints and
likeness 1. Neighbours are taken in ascending order of the id, nulls first, equal ids by a hash of the text; the first follows the last. with_edits() needs
ids of an integer type and raises TypeError for others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import LEAST_ID, id_number, lean, mixed, power_tables, ranges_of, read_table, small_batches, with_integer_id

K, SIZE, TAKEN = 8, 32, 2
LIKELY = 16  # candidates that a text has for the least hashes on average; all its elements are looked at if they are too few

_U = np.uint64
_FACTORS = (mixed(np.arange(101, 101 + SIZE, dtype=_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers of all texts, in text order, and the n + 1 places of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    powers, inverse = power_tables(len(points) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((points.astype(_U) + _U(1)) * powers[: len(points)], dtype=_U)])
    counts = np.maximum(sizes - K + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], counts)
    width = _U(K)
    every = mixed((sums[K:] - sums[:-K]) * inverse[: max(0, len(sums) - K)] + width) if len(sums) > K else np.zeros(0, _U)
    kmers = every[np.minimum(starts, len(every) - 1)] if len(every) else np.zeros(len(starts), _U)
    short = np.flatnonzero(sizes < K)  # one k-mer of what there is
    kmers[bounds[short]] = mixed((sums[offsets[short + 1]] - sums[offsets[short]]) * inverse[offsets[short]] + sizes[short].astype(_U))

    own = kmers ^ np.repeat(mixed(np.arange(1, len(texts) + 1, dtype=_U)), counts)  # equal only within a text
    ordered = np.sort(own)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):  # most k-mers occur once: only those that share a bucket with a repeated one are numbered
        bucket = np.zeros(1 << 20, bool)
        bucket[again >> _U(44)] = True
        some = np.flatnonzero(bucket[own >> _U(44)])
        order = some[np.argsort(own[some], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = own[order[1:]] != own[order[:-1]]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        later = order[nth > 0]
        kmers[later] = mixed(kmers[later] + nth[nth > 0].astype(_U) * _U(0x632BE59BD9B4E019))
    return kmers, bounds


def fingerprints(texts: list[str]) -> np.ndarray:
    """SIZE components of 32 bits for every text."""
    keys, bounds = elements(texts)
    counts, n = np.diff(bounds), len(texts)
    short = keys.astype(np.uint32)
    most = np.minimum((LIKELY / counts) * 2.0**32, 2.0**32 - 1).astype(np.uint32)
    limit, row = np.repeat(most, counts), np.repeat(np.arange(n, dtype=np.int32), counts)
    out = np.zeros((n, SIZE), np.uint32)
    wanted = np.minimum(counts, TAKEN)
    for j in range(SIZE):
        hashed = short * _FACTORS[j]
        at = np.flatnonzero(hashed <= limit)
        few = np.flatnonzero(np.bincount(row[at], minlength=n) < wanted)
        if len(few):
            at = np.unique(np.concatenate([at, *[np.arange(bounds[x], bounds[x + 1]) for x in few]]))
        of = row[at]
        order = np.lexsort((keys[at], (of.astype(_U) << _U(32)) | hashed[at]))  # by text, then hash; the whole key breaks ties
        first = np.searchsorted(of, np.arange(n))
        chosen = np.stack([at[order[first + np.minimum(t, wanted - 1)]] for t in range(TAKEN)])
        chosen.sort(0)
        value = np.full(n, j + 1, _U)
        for t in range(TAKEN):
            value = mixed(value * _U(0x9E3779B97F4A7C15) + keys[chosen[t]])
        out[:, j] = (value >> _U(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components."""
    return (a == b).mean(1)


def as_text(prints: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in prints.astype(">u4")]


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of the id, each sorted, and at the end of a range the first rows of the next one (ahead = 1)."""
    rows = docs.select("doc_id", "text", id_number("doc_id").alias("number"), F.xxhash64("text").alias("tie"))
    ranges = ranges_of(rows.select("number", "tie", F.octet_length("text").cast("long").alias("size")))
    n = max(1, len(ranges.numbers))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            number, tie = batch.column("number").to_numpy(), batch.column("tie").to_numpy()
            at = ranges.place(number, tie)
            lead = np.flatnonzero((number == ranges.numbers[at]) & ((tie == ranges.ties[at]) | (ranges.ties[at] == LEAST_ID)))
            of = pa.array(np.concatenate([np.arange(len(number)), lead]))
            place = np.concatenate([at, (at[lead] - 1) % n]).astype(np.int32)
            ahead = np.concatenate([np.zeros(len(number), np.int32), np.ones(len(lead), np.int32)])
            yield pa.record_batch([pa.array(place), pa.array(ahead), *[batch.column(c).take(of) for c in ("tie", "doc_id", "text")]], ["range", "ahead", "tie", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt_rows = rows.mapInArrow(lean(dealt), f"range int, ahead int, tie long, doc_id {kind}, text string")
    return dealt_rows.repartition(n, "range").sortWithinPartitions("range", "ahead", "doc_id", "tie", "text")


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one of its range; a row is held until the next one is there."""
    held: pa.RecordBatch | None = None
    for batch in small_batches(batches, most=1 << 20):
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held = batch.slice(batch.num_rows - 1)
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        place, ahead = (batch.column(c).to_numpy() for c in ("range", "ahead"))
        rows = np.flatnonzero((ahead[:-1] == 0) & (place[:-1] == place[1:]))
        if not len(rows):
            continue
        changed = [edited(texts[i], texts[i + 1]) for i in rows.tolist()]
        prints, after = fingerprints(texts), fingerprints(changed)
        yield pa.record_batch(
            [
                batch.column("doc_id").take(pa.array(rows)),
                pa.array([len(texts[i]) for i in rows.tolist()], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed]),
                pa.array(as_text(prints[rows])),
                pa.array(as_text(after)),
                pa.array(likeness(prints[rows], after)),
                pa.array(likeness(prints[rows], prints[rows + 1])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def with_edits(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    docs = with_integer_id(docs, doc_id)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(rows).mapInArrow(lean(compared), schema)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_order_minhash": op7_order_minhash}
