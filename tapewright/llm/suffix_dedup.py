"""Removal of every byte that a repeated string of SPAN bytes covers, by suffix arrays.

Which strings can repeat is found first: every window of SPAN bytes has an anchor, the least hashed K-byte string in it, so
equal windows share an anchor at the same place in them. Around each anchor that occurs more than once, the bytes that
its windows can reach (a piece) go to the task of the anchor; equal pieces are sent once with their number. Anchors with very many
different pieces are split by longer strings around them until each group is small.

A task sorts the suffixes of its pieces in two stages: those smaller than their successors directly, the others by one
scan over the buckets of first bytes, and compares neighbours. Windows with a common prefix of SPAN bytes at the same
place around the same anchor in two pieces (or in one that stands for several) are repeated.

Defined cases: null text is empty; texts shorter than SPAN bytes lose nothing; equal texts of SPAN bytes or more vanish
wholly, the first of them too; overlaps within one text count; repeated rows and equal ids are separate texts; a text of 1 GiB or more
raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import drop_table, lean, mixed, power_tables, read_table, running_hash, small_batches, span_hashes, text_bytes, written

SPAN, K = 200, 64
REACH = SPAN - K  # bytes on either side of an anchor that a window with it can cover
GROUP_PIECES = 1 << 15  # different pieces of an anchor that one task takes: 10 MB of text
SPLITS = (8, REACH + 1)  # parts into which the windows of a larger group go, then of one still too large
BLOCK_BYTES = 1 << 20
PLACE_BITS = 30

_U = np.uint64
_SAME = np.arange(256, dtype=np.uint8)


def anchors_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all texts, and their hashes."""
    n, windows = len(raw), REACH + 1
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n >> PLACE_BITS:
        raise ValueError(f"a text of {n} bytes: {1 << PLACE_BITS} is the limit")
    sums = running_hash(raw, _SAME)
    inverse = power_tables(n)[1]
    full = mixed((sums[K:] - sums[:-K]) * inverse[: n - K + 1])
    least = (full >> _U(PLACE_BITS) << _U(PLACE_BITS)) | np.arange(len(full), dtype=_U)
    span = 1
    while span * 2 <= windows:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (windows - span)], least[windows - span :])  # of window j, as it starts at byte j
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least = least[np.arange(len(least)) + SPAN <= ends]
    places = np.unique((least & _U((1 << PLACE_BITS) - 1)).astype(np.int64))
    return places, full[places].astype(np.int64)


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        raw, offsets = text_bytes(batch.column("text"))
        places, hashes = anchors_of(raw, offsets)
        row = np.searchsorted(offsets, places, "right") - 1
        keys = batch.column("key").take(pa.array(row))
        yield pa.record_batch([pa.array(hashes), keys, pa.array((places - offsets[row]).astype(np.int32))], ["anchor", "key", "place"])


PIECES = "anchor long, piece long, key binary, start int, place int, bytes binary"


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The piece around each repeated anchor: what its windows can cover. place: of the anchor in the piece."""
    for batch in small_batches(batches, most=1 << 20):
        raw, offsets = text_bytes(batch.column("text"))
        if not len(raw):
            continue
        places, anchors = batch.column("places"), batch.column("anchors")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(places).to_numpy(zero_copy_only=False))
        at = places.flatten().to_numpy().astype(np.int64) + offsets[row]
        a, b = np.maximum(at - REACH, offsets[row]), np.minimum(at + SPAN, offsets[row + 1])
        data = raw.tobytes()
        found = pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
        hashes = span_hashes(running_hash(raw, _SAME), a, b)
        hashes = mixed(hashes + (at - a).astype(_U)).astype(np.int64)
        yield pa.record_batch([anchors.flatten(), pa.array(hashes), batch.column("key").take(pa.array(row)), pa.array((a - offsets[row]).astype(np.int32)), pa.array((at - a).astype(np.int32)), found], ["anchor", "piece", "key", "start", "place", "bytes"])


def split_pieces(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Smaller pieces: the windows of a piece in parts by their start, each keyed by the string that all windows of the part share."""
    step = -(-(REACH + 1) // parts)
    for batch in small_batches(batches, "bytes", 1 << 20):
        raw, offsets = text_bytes(batch.column("bytes"))
        data, sums = raw.tobytes(), running_hash(raw, _SAME)
        anchor, size = batch.column("anchor").to_numpy().astype(_U), np.diff(offsets)
        start, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "place"))
        for first in range(0, REACH + 1, step):  # windows that start first to last bytes before the anchor
            last = min(first + step - 1, REACH)
            at = np.flatnonzero(np.maximum(first, place + SPAN - size) <= np.minimum(last, place))
            if not len(at):
                continue
            a, b = np.maximum(0, place[at] - last), np.minimum(size[at], place[at] - first + SPAN)
            base = offsets[at]
            group = mixed(span_hashes(sums, base + place[at] - first, base + place[at] - last + SPAN) ^ anchor[at] ^ _U(first + 1))
            piece = mixed(span_hashes(sums, base + a, base + b) + (place[at] - a + REACH).astype(_U))
            found = pa.array([data[x:y] for x, y in zip((base + a).tolist(), (base + b).tolist())], pa.binary())
            columns = [pa.array(group.astype(np.int64)), pa.array(piece.astype(np.int64)), batch.column("key").take(pa.array(at))]
            yield pa.record_batch([*columns, pa.array((start[at] + a).astype(np.int32)), pa.array((place[at] - a).astype(np.int32)), found], ["anchor", "piece", "key", "start", "place", "bytes"])


def once_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal pieces of a batch as one row with their number."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["anchor", "piece"], use_threads=False).aggregate([("place", "first"), ("bytes", "first"), ("place", "count")])
        for out in table.select(["anchor", "piece", "place_first", "bytes_first", "place_count"]).combine_chunks().to_batches():
            yield pa.record_batch(out.columns, ["anchor", "piece", "place", "bytes", "n"])


def suffix_array(raw: np.ndarray, depth: int = SPAN, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of suffixes in the order of their first depth bytes, by two-stage sorting: of all, or of the wanted ones and
    those that follow from the same directly sorted ones."""
    n, data = len(raw), raw.tobytes()
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is small if the next differing byte rises; the last one is large, as the end of the text is least.
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(raw[1:].astype(np.int16) - raw[:-1])
    rise[-1] = -1
    differs = np.where(rise != 0, np.arange(n), n)
    small = rise[np.minimum.accumulate(differs[::-1])[::-1]] > 0
    direct = np.flatnonzero(small)
    if wanted is not None:  # the small suffixes that are wanted, and the first one after each wanted large one
        before = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))  # the last wanted place up to here
        last = np.concatenate([[-1], direct[:-1]])
        direct = direct[before[direct] > last]
    direct = direct[np.argsort(raw[direct], kind="stable")]
    cuts = np.searchsorted(raw[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[raw[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        wave = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        large = []
        while len(wave):  # a run of the same byte is induced from within its bucket
            large.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(raw[before] == byte) & ~small[before]]
        sorted_small = sorted(direct[cuts[byte] : cuts[byte + 1]].tolist(), key=lambda i: data[i : i + depth])
        bucket = np.concatenate([*large, np.array(sorted_small, np.int64)])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(raw[before] > byte) & ~small[before]]
        order = np.argsort(raw[before], kind="stable")
        before = before[order]
        first = raw[before]
        for part in np.split(before, np.flatnonzero(first[1:] != first[:-1]) + 1) if len(before) else ():
            induced[raw[part[0]]].append(part)
    return np.concatenate(out)


def repeated_windows(anchor: np.ndarray, place: np.ndarray, n: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts, in raw, of the windows of pieces that occur again at the same place of the same anchor."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    wanted = np.arange(len(raw)) + SPAN <= ends
    order = suffix_array(raw, SPAN, wanted)
    order = order[wanted[order]]
    if not len(order):
        return order
    # adjacent common prefixes: of SPAN bytes or less; those that look equal by hash are compared byte by byte
    hashes = span_hashes(running_hash(raw, _SAME), order, order + SPAN)
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    windows = np.lib.stride_tricks.sliding_window_view(raw, SPAN)
    for at in range(0, len(same), 4096):
        some = same[at : at + 4096]
        same[at : at + 4096] = np.where((windows[order[some]] == windows[order[some + 1]]).all(1), some, -1)
    new = np.ones(len(order), bool)
    new[same[same >= 0] + 1] = False
    group = np.cumsum(new)
    piece = np.searchsorted(offsets, order, "right") - 1
    _, code = np.unique(anchor, return_inverse=True)
    where = order - offsets[piece] - place[piece] + 2 * REACH  # the same string may hold several anchors: each counts by itself
    key = (group * (code.max() + 1) + code[piece]) * (4 * SPAN) + where
    _, code, times = np.unique(key, return_inverse=True, return_counts=True)
    weight = np.bincount(code, n[piece])
    return order[weight[code] > 1]


def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed runs of bytes of each piece; input is sorted by anchor and a block takes whole anchors."""
    held: list[pa.RecordBatch] = []

    def merged_rows(table: pa.Table) -> pa.Table:
        """Equal pieces as one row with their number."""
        out = table.group_by(["anchor", "piece"], use_threads=False).aggregate([("place", "first"), ("bytes", "first"), ("n", "sum")])
        return out.rename_columns(["anchor", "piece", "place", "bytes", "n"])

    def solve(table: pa.Table) -> pa.RecordBatch:
        merged = merged_rows(table)
        raw, offsets = text_bytes(merged.column("bytes"))
        anchor, place, n = (merged.column(c).to_numpy() for c in ("anchor", "place", "n"))
        starts = np.sort(repeated_windows(anchor, place.astype(np.int64), n, raw, offsets))
        piece = np.searchsorted(offsets, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (starts[1:] > starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts))[: len(first)] - 1
        rows = pa.array(piece[first])
        low, high = starts[first] - offsets[piece[first]], starts[last] + SPAN - offsets[piece[first]]
        return pa.record_batch([merged.column("anchor").combine_chunks().take(rows), merged.column("piece").combine_chunks().take(rows), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["anchor", "piece", "low", "high"])

    size, limit = 0, 8 * BLOCK_BYTES
    for batch in small_batches(batches, "bytes", BLOCK_BYTES // 4):
        anchor = batch.column("anchor").to_numpy()
        at = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
        if size + batch.nbytes > BLOCK_BYTES and (at or (held and held[-1].column("anchor")[-1].as_py() != anchor[0])):
            yield solve(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held, size = [batch.slice(at)], batch.slice(at).nbytes
        else:
            held.append(batch)
            size += batch.nbytes
            if size > limit:  # one anchor, with many equal pieces
                held = merged_rows(pa.Table.from_batches(held)).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
                limit = max(limit, 2 * size)
    if held:
        yield solve(pa.Table.from_batches(held))


def cleaned(batches: Iterator[pa.RecordBatch], names: list[str], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """The kept bytes of every text; as text without characters that a cut has split."""
    for batch in small_batches(batches):
        raw, offsets = text_bytes(batch.column("text"))
        change = np.zeros(len(raw) + 1, np.int64)
        lists = batch.column("runs")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        np.add.at(change, flat.field("low").to_numpy().astype(np.int64) + offsets[row], 1)
        np.add.at(change, flat.field("high").to_numpy().astype(np.int64) + offsets[row], -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | edge[1:-1]
        sums, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
        kept = raw[~gone].tobytes()
        at = (offsets - sums[offsets]).tolist()
        found = [kept[a:b] for a, b in zip(at, at[1:])]
        own = [batch.column(c) for c in names]
        value = pa.array([x.decode("utf-8", "ignore") for x in found], pa.string()) if as_text else pa.array(found, pa.binary())
        yield pa.record_batch([*own, pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets])), pa.array(np.diff(spans[offsets])), value], [*names, "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, text="text", keep=("doc_id",), as_text: bool = False) -> DataFrame:
    """The columns of keep with n_bytes, n_removed, n_spans and kept (the remaining bytes, or text) of every row of docs.

    The columns of keep may have any names but these four, text and runs, for which they stand as own_0, own_1 ... on the way."""
    names = [f"own_{k}" for k in range(len(keep))]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]).alias("own"), value.alias("text"), F.unhex(F.md5(value.cast("binary"))).alias("key"))
    long = rows.filter(F.octet_length("text") >= SPAN).select("key", "text")
    anchors = written(long.mapInArrow(lean(find_anchors), "anchor long, key binary, place int"), "anchors")
    again = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    found = anchors.join(again, "anchor").groupBy("key").agg(F.collect_set(F.struct("place", "anchor")).alias("found"))
    found = written(found.select("key", F.col("found.place").alias("places"), F.col("found.anchor").alias("anchors")), "found")
    drop_table(anchors)
    pieces = written(long.join(found, "key").select("text", "key", "places", "anchors").mapInArrow(lean(cut_pieces), PIECES), "pieces")

    runs = []
    for parts in (*SPLITS, 0):
        sized = pieces.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("n"))
        large = sized.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter(F.col("different") > GROUP_PIECES).select("anchor")
        large = written(large, "large") if parts else None
        some = large is not None and not large.isEmpty()
        take = pieces.join(large, "anchor", "left_anti") if some else pieces
        once = take.mapInArrow(lean(once_each), "anchor long, piece long, place int, bytes binary, n long")
        solved = once.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(sorted_blocks), "anchor long, piece long, low int, high int")
        solved = written(solved, "solved")
        at = pieces.select("anchor", "piece", "key", "start").join(solved, ["anchor", "piece"])
        runs.append(at.select("key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")))
        if not some:
            break
        hot = pieces.join(large, "anchor", "left_semi").select("anchor", "piece", "key", "start", "place", "bytes")
        split = hot.mapInArrow(lean(lambda it, parts=parts: split_pieces(it, parts)), PIECES)
        split = written(split, "pieces")
        twice = split.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
        pieces = split.join(twice, "anchor").select("anchor", "piece", "key", "start", "place", "bytes")
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    removed = every.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    dealt = rows.join(removed, "key", "left").select("own.*", "text", "runs")
    fields = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "string" if as_text else "binary")):
        fields = fields.add(name, kind)
    out = dealt.mapInArrow(lean(lambda it: cleaned(it, names, as_text)), fields)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_bytes", "n_removed", "n_spans", "kept")


def deduplicated(docs: DataFrame, text="text") -> DataFrame:
    """docs with the repeated strings cut out of the text; characters that a cut has split are dropped. A text that is cut away wholly is left empty."""
    others = [c for c in docs.columns if c != text]
    plain = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(others)])
    kept = without_repeats(plain, "text", [f"kept_{k}" for k in range(len(others))], as_text=True)
    back = {text: F.col("kept")} | {c: F.col(f"kept_{k}") for k, c in enumerate(others)}
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
