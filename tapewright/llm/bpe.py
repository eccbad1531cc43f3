"""BPE encoding and decoding with chunks that documents share encoded once.

A text is cut where a rolling hash of its last bytes says so: equal passages in different documents are cut alike, so their chunks are equal.
What a chunk holds between its first and last white space is its body, encoded once for all texts of a task, as long as it is
remembered. What stands between two bodies, a join, was split by the cut; it is repaired by re-encoding
it from white space to white space, where both sides agree exactly with the encoding of the whole: the tokenizer drops white space and
lets no token, special token or normalisation reach over it, which is tested when a vocabulary is loaded. Texts are decoded from their ids.

So that shared chunks meet, texts are put in order of their least chunk hash first: near copies, which share most chunks, stand side by side,
and a small memory serves. This is one shuffle of the texts, by ranges that are cut within large groups of copies too.

Defined cases: a null text is empty and has no ids; a text without white space is one body; special tokens in a text are read as the library
reads them; ids of documents may have any type that casts to text, be null or repeated; an empty table gives no rows; a vocabulary that keeps
white space raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import SPACES, lean, mixed, read_table, running_hash, small_batches, span_hashes, text_bytes
from tapewright.llm.words import library, table

WINDOW = 16  # bytes under the rolling hash
CHUNK_BITS = 9  # a cut each 512 bytes or so
LEAST_CHUNK = 128
REMEMBERED_BYTES = 8 << 20  # of pieces and their ids in a task; then all are forgotten


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_texts(path: str, texts: list[bytes]) -> list[bytes]:
    """Ids of each text, two bytes each, or four for more than 65536 ids."""
    sizes = np.cumsum([0] + [len(t) for t in texts])
    ids, bounds = table(path).encode(np.frombuffer(b"".join(texts), np.uint8), sizes)
    kind = np.dtype(id_kind(path))
    data, at = ids.astype(kind).tobytes(), (bounds * kind.itemsize).tolist()
    return [data[x:y] for x, y in zip(at, at[1:])]


def id_kind(path: str) -> str:
    return "<u2" if library(path).get_vocab_size() <= 1 << 16 else "<u4"


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Positions before which a rolling hash of the last WINDOW bytes asks for a cut."""
    if len(raw) <= WINDOW:
        return np.zeros(0, np.int64)
    rolled, width, factor = (raw.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1), 1, 0x85EBCA6B
    while width < WINDOW:  # sums over twice as many bytes at each step
        rolled = rolled[:-width] * np.uint32(factor) + rolled[width:]
        width, factor = 2 * width, factor * factor % (1 << 32)
    hit = (rolled * np.uint32(0xC2B2AE35)) >> np.uint32(32 - CHUNK_BITS) == 0
    return np.flatnonzero(hit) + WINDOW


def edges_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of all rows, the rows' beginnings among them, and which are such."""
    hits = cut_points(raw)
    row = np.searchsorted(offsets, hits, "right") - 1
    hits = hits[(hits >= offsets[row] + WINDOW) & (hits < offsets[np.minimum(row + 1, len(offsets) - 1)])]
    starts = np.unique(offsets)
    edges = np.union1d(hits, starts)
    short = np.flatnonzero(np.diff(edges) < LEAST_CHUNK)
    if len(short):
        is_start = np.isin(edges, starts).tolist()
        kept, last = [], -LEAST_CHUNK
        for at, fixed in zip(edges.tolist(), is_start):
            if fixed or at - last >= LEAST_CHUNK:
                kept.append(at)
                last = at
        edges = np.array(kept, np.int64)
    return edges, np.isin(edges, starts)


_SAME = np.arange(256, dtype=np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def bodies_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the bodies of all chunks, and the n + 1 places of the rows among them. What lies between are the joins."""
    edges, is_start = edges_of(raw, offsets)
    if len(edges) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    spaces = np.flatnonzero(_SPACE[raw])
    a, b = edges[:-1], edges[1:]
    first, last = np.searchsorted(spaces, a), np.searchsorted(spaces, b) - 1
    spaced = first <= last
    padded = np.append(spaces, 0)
    begin = np.where(is_start[:-1], a, np.where(spaced, padded[np.minimum(first, len(spaces))], b))
    end = np.where(is_start[1:], b, np.where(spaced, padded[last] + 1, a))
    some = end - begin > 1 if len(begin) else np.zeros(0, bool)
    some |= is_start[:-1] & is_start[1:] & (end > begin)  # a text of a single byte
    begin, end = begin[some], end[some]
    return begin, end, np.searchsorted(begin, offsets)


class Encoder:
    """Ids of texts, piece by piece: a body or join that is remembered isn't encoded again."""

    def __init__(self, path: str):
        self.path, self.known, self.size = path, {}, 0
        self.places = self.encoded = 0

    def learn(self, pieces: dict[bytes, None]) -> None:
        new = [p for p in pieces if p not in self.known]
        if self.size > REMEMBERED_BYTES:
            self.known, self.size = {}, 0
            new = list(pieces)
        found = encoded_texts(self.path, new)
        self.known.update(zip(new, found))
        self.size += sum(map(len, new)) + sum(map(len, found))
        self.encoded += len(new)

    def rows(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a batch."""
        raw, offsets = text_bytes(texts)
        begin, end, at = bodies_of(raw, offsets)
        data = raw.tobytes()
        begin, end, at, limits = begin.tolist(), end.tolist(), at.tolist(), offsets.tolist()
        plans = []
        for row, before in enumerate(limits[:-1]):
            plan = []
            for k in range(at[row], at[row + 1]):
                plan += [data[before : begin[k]], data[begin[k] : end[k]]]
                before = end[k]
            plan.append(data[before : limits[row + 1]])
            plans.append([p for p in plan if p])
        self.places += sum(map(len, plans))
        self.learn(dict.fromkeys(p for plan in plans for p in plan))
        return [b"".join([self.known[p] for p in plan]) for plan in plans]


def with_least_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's chunks: texts that share passages often have it in common."""
    for batch in small_batches(batches):
        raw, offsets = text_bytes(batch.column("text"))
        edges, _ = edges_of(raw, offsets)
        least = np.zeros(batch.num_rows, np.int64)
        if len(edges) > 1:
            hashes = span_hashes(running_hash(raw, _SAME), edges[:-1], edges[1:]).astype(np.int64)
            filled = np.flatnonzero(np.diff(offsets))
            found = np.minimum.reduceat(hashes, np.searchsorted(edges[:-1], offsets[filled]))
            least[filled] = mixed(found.astype(np.uint64)).astype(np.int64)  # long texts have low ones: scrambled, they don't stand together
        yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(least)], ["doc_id", "text", "least"])


def side_by_side(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, text) in ranges of the texts' least chunks, sorted: texts that share chunks come to one task, one after another. A group that is
    larger than a range is cut by the texts' and the ids' hashes, so that none comes to one task as a whole."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = ["least", F.xxhash64("text"), F.xxhash64(F.col("doc_id").cast("string"))]
    ordered = rows.mapInArrow(lean(with_least_chunks), f"doc_id {kind}, text string, least long").repartitionByRange(*order)
    return ordered.sortWithinPartitions(*order[:2]).select("doc_id", "text")


def chunk_use(docs: DataFrame, path: str, **columns) -> DataFrame:
    """One row: n_places where pieces stand, and n_encoded, how many of them had to be encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in small_batches(batches):
            encoder.rows(batch.column("text"))
        yield pa.record_batch([pa.array([encoder.places]), pa.array([encoder.encoded])], ["n_places", "n_encoded"])

    used = side_by_side(docs, **columns).mapInArrow(lean(run), "n_places long, n_encoded long")
    return used.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_places", "n_encoded")])


def decoded_texts(path: str, ids: list[bytes]) -> list[str]:
    kind = id_kind(path)
    return library(path).decode_batch([np.frombuffer(x, kind).tolist() for x in ids], skip_special_tokens=False)


def encode(docs: DataFrame, path: str, doc_id="doc_id", text="text", decoded: bool = True) -> DataFrame:
    """doc_id, ids array<int> and, if asked, the text decoded from them, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = Encoder(path), np.dtype(id_kind(path))
        for batch in small_batches(batches):
            found = encoder.rows(batch.column("text"))
            ends = np.cumsum([0] + [len(x) // kind.itemsize for x in found])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), kind).astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), ids, *([pa.array(decoded_texts(path, found), pa.string())] if decoded else [])], ["doc_id", "ids", "decoded"][: 2 + decoded])

    rows = side_by_side(docs, doc_id, text)
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def encode_digests(docs: DataFrame, path: str, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, number of ids, and hashes of the ids and of the text decoded from them, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = Encoder(path), np.dtype(id_kind(path))
        for batch in small_batches(batches):
            found = encoder.rows(batch.column("text"))
            n = [len(x) // kind.itemsize for x in found]
            once = list(dict.fromkeys(found))  # exact copies stand side by side
            ids = [hashlib.sha256(np.frombuffer(x, kind).astype("<u4").tobytes()).hexdigest() for x in once]
            texts = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in decoded_texts(path, once)]
            of = dict(zip(once, zip(ids, texts)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array([of[x][k] for x in found], pa.string()) for k in (0, 1)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = side_by_side(docs, doc_id, text)
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op10_chunked_bpe": op10_chunked_bpe}
