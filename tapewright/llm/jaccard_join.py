"""Near-duplicate texts: all pairs whose word shingles have a Jaccard similarity of 0.8 or more, by chosen paths.

A text is the set of its hashed five-word shingles; equal sets are one class. Each class has a sketch of COORDINATES
minima, its tokens. A run splits the classes recursively: at a node, every token is chosen with
probability 1 / (SIMILARITY * COORDINATES) by a hash of the node and the token, and a class goes to the children of the chosen tokens that it
has. So two classes meet wherever they share a chosen token, and a pair at the threshold reaches the next level with one child on average. Buckets of
few classes are compared by brute force on the sketches. A larger one is compared with PIVOTS of its own classes first. What these link to one
group, as in a bucket of near copies, is compared exactly later, so no pair of it can be missed; if few classes are left over, they are compared with the
whole bucket, which ends there. Else it is split further, and below MAX_DEPTH compared block by block. Runs are repeated until a pair at the threshold is met with probability TARGET even if all its buckets are split to MAX_DEPTH.

The compared pairs that look similar give a spanning forest, not all pairs; its components are compared again pair by pair
on the exact sets, in blocks, which counts the links of every class without writing a row for each pair.

Defined cases: null, empty and blank texts have no shingles and are alone in their class without links; a text of one to four words
has all its words as one shingle; copies are linked to each other and to all that their text is linked to; repeated
rows are copies; an empty table gives no rows. Words are runs other than space and bytes 9 to 13, A-Z lowered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import drop_table, lean, mixed, read_table, small_batches, text_bytes, word_hashes, written
from tapewright.llm.components import components

WORDS, SIMILARITY = 5, 0.8
COORDINATES = 128
LOOKS_SIMILAR = 0.6  # on the sketch: less than 1e-7 of the pairs at the threshold fall below; the exact sets decide
FIRST_DEPTH, MAX_DEPTH = 3, 7  # a crowded bucket goes down two levels at once
REPEATS = 3  # splits of a crowded bucket
BUCKET = 128
PIVOTS = 8
SLICE = 8192  # classes of a crowded bucket that one task compares with its pivots
BLOCK = 1024
BLOCK_BYTES = 8 << 20
TARGET = 0.999

_U = np.uint64
_PICK = _U(int(2**64 / (SIMILARITY * COORDINATES)))


def survival(depth: int, similarity: float = SIMILARITY, shared: int | None = None) -> float:
    """Chance that a pair of this similarity, or with so many shared tokens, still shares a bucket at this depth of one run.

    Below FIRST_DEPTH, where only crowded buckets are split, each is split REPEATS times, and these parts once more."""
    alive, shared = 1.0, round(similarity * COORDINATES) if shared is None else shared
    for level in range(depth, 0, -1):
        alive = 1 - (1 - alive / (SIMILARITY * COORDINATES)) ** shared
        if level > FIRST_DEPTH and (level - FIRST_DEPTH) % 2:
            alive = 1 - (1 - alive) ** REPEATS
    return alive


def missed(runs: int, depth: int, similarity: float = SIMILARITY) -> float:
    """Chance that a pair of this similarity is not met in any run or doesn't look similar: one sketch serves all runs, so its shared tokens are drawn once."""
    out = 0.0
    for k in range(COORDINATES + 1):
        chance = math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k)
        out += chance * ((1 - survival(depth, shared=k)) ** runs if k / COORDINATES >= LOOKS_SIMILAR else 1)
    return out


def runs_needed(target: float = TARGET, depth: int | None = None) -> int:
    """Runs for this recall where buckets stay crowded down to this depth; MAX_DEPTH if none is given."""
    depth, runs = MAX_DEPTH if depth is None else depth, 1
    if missed(10**6, depth) > 1 - target:
        raise ValueError(f"no number of runs reaches {target}: LOOKS_SIMILAR drops more")
    while missed(runs, depth) > 1 - target:
        runs += 1
    return runs


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and the n + 1 places of the rows."""
    raw, offsets = text_bytes(texts)
    hashes, bounds = word_hashes(raw, offsets)
    n = len(bounds) - 1
    counts = np.diff(bounds)
    rolled = hashes.copy()
    for k in range(1, WORDS):
        rolled[: len(hashes) - k] = mixed(rolled[: len(hashes) - k] * _U(0x9E3779B97F4A7C15) + hashes[k:]) if len(hashes) > k else rolled[: len(hashes) - k]
    row = np.repeat(np.arange(n), counts)
    left = bounds[1:][row] - np.arange(len(hashes))  # words from here to the end of the row
    full = left >= WORDS
    parts, rows = [rolled[full]], [row[full]]
    for at in np.flatnonzero((counts > 0) & (counts < WORDS)):  # all words of a short text
        x = np.array([counts[at]], _U)
        for k in range(bounds[at], bounds[at + 1]):
            x = mixed(x * _U(0x9E3779B97F4A7C15) + hashes[k : k + 1])
        parts.append(x)
        rows.append(np.array([at]))
    keys, row = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(keys)
    order = order[np.argsort(row[order], kind="stable")]
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[new], row[new]
    return keys, np.searchsorted(row, np.arange(n + 1))


def set_keys(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each row's set; 0 for an empty one."""
    sums = np.zeros(len(keys) + 1, _U)
    np.cumsum(mixed(keys ^ _U(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    sizes = np.diff(bounds).astype(_U)
    return np.where(sizes > 0, (mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes) >> _U(1)) | _U(1), _U(0)).astype(np.int64)


_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=_U)) | _U(1)


def sketches(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """COORDINATES minima of each non-empty row, 16 bits each."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint16)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        starts, step = bounds[:-1][some], 0
        while step < len(some):  # pieces that stay in the processor's cache
            stop = max(step + 1, int(np.searchsorted(starts, starts[step] + (1 << 15))))
            a, b = starts[step], bounds[some[stop - 1] + 1]
            part, at = keys[a:b], starts[step:stop] - a
            for j in range(COORDINATES):
                least = np.minimum.reduceat(part * _FACTORS[j], at)
                out[some[step:stop], j] = (mixed(least) >> _U(48)).astype(np.uint16)
            step = stop
    return out


def token_hashes(sketch: np.ndarray) -> np.ndarray:
    return mixed((np.arange(COORDINATES, dtype=_U) << _U(16)) + sketch.astype(_U) + _U(1))


def children(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the children that the classes with these tokens have below their nodes."""
    value = mixed(node[:, None] ^ tokens)
    row, j = np.nonzero(value < _PICK)
    return row, mixed(value[row, j] + _U(0x632BE59BD9B4E019))


def first_paths(batches: Iterator[pa.RecordBatch], runs: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        key = batch.column("key").to_numpy()
        for at in range(0, len(key), 512):
            tokens, own = token_hashes(sketch[at : at + 512]), key[at : at + 512]
            for run in range(runs):
                row = np.arange(len(own))
                node = np.full(len(own), mixed(np.array([run + 1], _U))[0])
                for _ in range(depth):
                    up, node = children(node, tokens[row])
                    row = row[up]
                yield pa.record_batch([pa.array(node.astype(np.int64)), pa.array(own[row])], ["path", "key"])


def next_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        node, key = batch.column("path").to_numpy().astype(_U), batch.column("key").to_numpy()
        for at in range(0, len(key), 4096):
            tokens = token_hashes(sketch[at : at + 4096])
            for repeat in range(REPEATS):
                row, child = children(mixed(node[at : at + 4096] + _U(repeat)), tokens)
                up, child = children(child, tokens[row])
                yield pa.record_batch([pa.array(child.astype(np.int64)), pa.array(key[at : at + 4096][row[up]])], ["path", "key"])


def spanning(sketch: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that look similar: each row is compared with those not reached yet."""
    left, out = np.arange(len(sketch)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = (sketch[left] == sketch[one]).mean(1) >= LOOKS_SIMILAR
            out += [(one, x) for x in left[near].tolist()]
            todo += left[near].tolist()
            left = left[~near]
    return out


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within the buckets of a partition that is sorted by bucket."""
    held: list[pa.Table] = []

    def edges(table: pa.Table) -> pa.RecordBatch:
        key = table.column("key").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        path, block = table.column("path").to_numpy(), table.column("block").to_numpy()
        cuts = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
        a, b = [], []
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if stop - start == 2:
                if (sketch[start] == sketch[start + 1]).mean() >= LOOKS_SIMILAR:
                    a.append(key[start]), b.append(key[start + 1])
            elif stop - start > 2:
                for x, y in spanning(sketch[start:stop]):
                    a.append(key[start + x]), b.append(key[start + y])
        pair = np.unique(np.array([a, b], np.int64), axis=1) if a else np.zeros((2, 0), np.int64)
        return pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        path = table.column("path").to_numpy()
        last = int(np.searchsorted(path, path[-1]))  # the last bucket may go on
        if last == 0 and held and held[-1].column("path")[0].as_py() == path[0]:
            held.append(table)
            continue
        if last:
            yield edges(pa.concat_tables([*held, table.slice(0, last)]))
            held = [table.slice(last)]
        else:
            if held:
                yield edges(pa.concat_tables(held))
            held = [table]
    if held:
        yield edges(pa.concat_tables(held))


def led_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(path, slice), the leaders' keys and sketches, and keys and sketches of some members; a partition is sorted by (path, slice, member), leaders first."""
    own, keys, sketch = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("path", "slice", "member")], 1)
        key = batch.column("key").to_numpy()
        every = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        for start, stop in zip(cuts, cuts[1:]):
            path, part, member = at[start].tolist()
            if (path, part) != own:
                own, keys, sketch = (path, part), [], []
            if not member:
                keys.append(key[start:stop])
                sketch.append(every[start:stop])
            elif keys:
                yield own, np.concatenate(keys), np.concatenate(sketch), key[start:stop], every[start:stop]


def likeness(members: np.ndarray, leaders: np.ndarray) -> np.ndarray:
    """Whether each member looks similar to each leader."""
    out = np.zeros((len(members), len(leaders)), bool)
    for at in range(0, len(members), 256):
        out[at : at + 256] = (members[at : at + 256, None] == leaders[None]).mean(2, dtype=np.float32) >= LOOKS_SIMILAR
    return out


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of crowded buckets with the pivot that they are linked to; loose are those not linked to the group of the first pivot."""
    own, among, main = None, None, None
    for at, keys, sketch, key, every in led_rows(batches):
        a, b = [], []
        if at != own:
            own, among = at, likeness(sketch, sketch)
            reached = among[0]
            while (more := among[reached].any(0)).sum() > reached.sum():
                reached = more
            main = np.flatnonzero(reached)
            if at[1] == 0:
                a, b = (keys[x] for x in np.nonzero(np.triu(among, 1)))
        near = likeness(every, sketch[main])
        some = near.any(1)
        yield pa.record_batch([pa.array(np.full(len(key), at[0])), pa.array(key), pa.array(keys[main][near.argmax(1)], mask=~some), pa.array(~some)], ["path", "key", "pivot", "loose"])
        if len(a):
            yield pa.record_batch([pa.array(np.full(len(a), at[0])), pa.array(b), pa.array(a), pa.array(np.zeros(len(a), bool))], ["path", "key", "pivot", "loose"])


def outer_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the loose classes of a bucket, its leaders here: among themselves, and of each to one other member of a slice if there is any."""
    own, left = None, None
    for at, keys, sketch, key, every in led_rows(batches):
        a, b = [], []
        if at != own:
            own, left = at, np.ones(len(keys), bool)
            if at[1] == 0:
                pairs = spanning(sketch)
                a, b = [keys[x] for x, _ in pairs], [keys[y] for _, y in pairs]
        others = np.flatnonzero(~np.isin(key, keys))
        if left.any() and len(others):
            todo = np.flatnonzero(left)
            near = likeness(every[others], sketch[todo])
            found = near.any(0)
            a += keys[todo[found]].tolist()
            b += key[others[near.argmax(0)[found]]].tolist()
            left[todo[found]] = False
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def led_by(crowded: DataFrame, leaders: DataFrame) -> DataFrame:
    """The classes (path, key, n, sketch) of crowded buckets in slices of SLICE, and in front of each slice the bucket's leaders (path, key), few."""
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    members = crowded.select("path", F.pmod("key", slices).cast("int").alias("slice"), F.lit(1).alias("member"), "key", "sketch")
    first = crowded.join(leaders.select("path", "key").distinct(), ["path", "key"], "left_semi")
    first = first.select("path", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(0).alias("member"), "key", "sketch")
    return members.unionByName(first).repartition("path", "slice").sortWithinPartitions("path", "slice", "member", "key")


def pivots_of(crowded: DataFrame) -> DataFrame:
    """(path, key): the classes of each bucket of least key under PIVOTS orders."""
    masks = [int(x) for x in mixed(np.arange(1, PIVOTS + 1, dtype=_U)).astype(np.int64)]
    least = crowded.groupBy("path").agg(*[F.min(F.col("key").bitwiseXOR(F.lit(m))).alias(f"p{j}") for j, m in enumerate(masks)])
    return least.select("path", F.explode(F.array(*[F.col(f"p{j}").bitwiseXOR(F.lit(m)) for j, m in enumerate(masks)])).alias("key"))


def exact_links(keys: np.ndarray, weights: np.ndarray, sides: np.ndarray, low: int, high: int, texts: pa.Array) -> list[np.ndarray]:
    """Links within a block of a component, or between two, on exact sets: key, links and texts of each class, and the root of its part of a spanning forest."""
    sets, bounds = shingle_sets(texts)
    _, first = np.unique(keys, return_index=True)
    first = first[set_keys(sets, bounds)[first] == keys[first]]
    keys, weights, sides, sizes = keys[first], weights[first], sides[first], np.diff(bounds)[first]
    n = len(keys)
    picked = np.concatenate([np.arange(bounds[x], bounds[x + 1]) for x in first] or [np.zeros(0, np.int64)])
    row = np.repeat(np.arange(n), sizes)
    shared, code, times = np.unique(sets[picked], return_inverse=True, return_counts=True)
    kept = times[code] > 1
    order = np.argsort(code[kept], kind="stable")
    row, code = row[kept][order], code[kept][order]
    columns = np.cumsum(times > 1) - 1
    code = columns[code]
    across, a, b = low != high, np.flatnonzero(sides == low), np.flatnonzero(sides == high)
    both = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, 2048):  # columns of the incidence matrix, some at a time
        p, q = np.searchsorted(code, [start, start + 2048])
        some = np.zeros((n, 2048), np.float32)
        some[row[p:q], code[p:q] - start] = 1
        both += some[a] @ some[b].T if across else some @ some.T
    close = np.zeros(both.shape, bool)
    for start in range(0, len(a), 64):
        part = both[start : start + 64]
        close[start : start + 64] = part >= np.ceil(SIMILARITY * (sizes[a[start : start + 64], None] + sizes[None, b] - part) - 1e-6)
    if not across:
        np.fill_diagonal(close, False)
    links, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    links[a], counts[a] = close @ weights[b], close.sum(1)
    if across:
        links[b], counts[b] = close.T @ weights[a], close.sum(0)
    root, left = np.arange(n), np.ones(n, bool)
    at_a, at_b = np.full(n, -1), np.full(n, -1)
    at_a[a], at_b[b] = np.arange(len(a)), np.arange(len(b))
    for start in np.flatnonzero(counts).tolist():
        if left[start]:
            left[start], todo = False, [start]
            while todo:
                x = todo.pop()
                reached = b[close[at_a[x]]] if at_a[x] >= 0 else a[close[:, at_b[x]]]
                reached = reached[left[reached]]
                left[reached] = False
                root[reached] = start
                todo += reached.tolist()
    return [keys, links, counts, keys[root]]


def exact_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """exact_links() of every pair of blocks; a partition is sorted by these. Small ones share a batch of results."""
    names = ["key", "links", "texts", "root"]
    held: list[pa.RecordBatch] = []
    own = None
    done: list[list[np.ndarray]] = []

    def finished() -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        key, weight, side = (rows.column(c).to_numpy() for c in ("key", "weight", "side"))
        done.append(exact_links(key, weight, side, *own[1:], rows.column("text")))

    def results() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*done)], names)
        done.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("label", "low", "high")], 1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            this = tuple(at[start].tolist())
            if this != own:
                if held:
                    finished()
                    held.clear()
                own = this
            held.append(batch.slice(start, stop - start))
        if len(done) >= 256:
            yield results()
    if held:
        finished()
    if done:
        yield results()


def linked(docs: DataFrame, text="text", doc_id="doc_id", target: float = TARGET) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its linked group), n_copies (rows with an equal set),
    n_links (other rows of similarity SIMILARITY or more) and n_texts (other sets of that similarity)."""
    return labelled(docs, text, doc_id, target).drop("text_hash", "label")


def labelled(docs: DataFrame, text="text", doc_id="doc_id", target: float = TARGET) -> DataFrame:
    """The rows of linked() with the hash of the text, and the label of the linked group: null for texts without shingles."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys, bounds = shingle_sets(batch.column("text"))
            sketch = sketches(keys, bounds)
            own = set_keys(keys, bounds)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(own), pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "text_hash", "key", "sketch"])

    members = written(rows.mapInArrow(lean(described), f"doc_id {kind}, text_hash long, key long, sketch binary"), "members")
    one = F.min(F.struct("doc_id", "text_hash"))  # a row with the class's text
    least = F.min("doc_id")
    classes = members.filter("key <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("weight"), least.alias("doc_id"), one.alias("one"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    tokens = classes.select("key", "sketch")

    runs = runs_needed(target)
    paths = written(tokens.mapInArrow(lean(lambda it: first_paths(it, runs, FIRST_DEPTH)), "path long, key long").distinct(), "paths")
    found = []
    for depth in range(FIRST_DEPTH, MAX_DEPTH + 1, 2):
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = paths.join(sizes, "path")
        small = sized.filter(F.col("n") <= BUCKET).select("path", "key", F.lit(0).alias("block"))
        crowded = written(sized.filter(F.col("n") > BUCKET).join(tokens, "key").select("path", "key", "sketch", "n"), "crowded")
        rest = None
        if not crowded.isEmpty():
            held = written(led_by(crowded, pivots_of(crowded)).mapInArrow(lean(judged), "path long, key long, pivot long, loose boolean"), "judged")
            found.append(held.filter("pivot is not null and pivot <> key").select(F.col("pivot").alias("a"), F.col("key").alias("b")))
            loose = held.filter("loose").select("path", "key")
            counts = written(loose.groupBy("path").agg(F.count(F.lit(1)).alias("loose")), "loose")
            if not counts.isEmpty():
                some = counts.filter(F.col("loose") <= BUCKET).select("path")
                outer = led_by(crowded.join(some, "path", "left_semi"), loose.join(some, "path", "left_semi"))
                found.append(written(outer.mapInArrow(lean(outer_edges), "a long, b long").distinct(), "edges"))
                rest = crowded.join(counts.filter(F.col("loose") > BUCKET).select("path"), "path", "left_semi")
        if depth == MAX_DEPTH and rest is not None:  # blocks of a large bucket that its pivots don't link are compared two by two
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            own = F.pmod("key", blocks).cast("int")
            other = F.explode(F.sequence(F.lit(0), blocks - 1))
            large = rest.select("path", "key", own.alias("own"), blocks.alias("blocks"), other.alias("other"))
            large = large.select("path", "key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"))
            small = small.unionByName(large)
        of = small.join(tokens, "key").repartition("path", "block").sortWithinPartitions("path", "block", "key")
        found.append(written(of.mapInArrow(lean(compared), "a long, b long").distinct(), "edges"))
        if depth == MAX_DEPTH or rest is None:
            break
        deeper = written(rest.select("path", "key", "sketch").mapInArrow(lean(next_paths), "path long, key long").distinct(), "paths")
        drop_table(paths), drop_table(crowded)
        paths = deeper
        if paths.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    group = components(edges)

    # exact comparison within the components, block by block: blocks are bounded in classes and in bytes
    one_text = classes.select("key", "weight", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
    of = group.join(one_text, F.col("node") == F.col("key"))
    found_rows = of.join(rows, (F.col("text_hash") == F.col("one_hash")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).dropDuplicates(["key"]).select("label", "key", "weight", "text")
    found_rows = written(found_rows, "component-texts")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    sizes = found_rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).select("label", blocks)
    texts = (
        found_rows.join(sizes, "label")
        .withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "key", "weight", "side", "text")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = texts.repartition(tasks, "label", "low", "high").sortWithinPartitions("label", "low", "high")
    exact = texts.mapInArrow(lean(exact_blocks), "key long, links long, texts long, root long")
    exact = written(exact, "exact")
    counted = exact.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    joined = components(exact.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")

    of_class = (
        classes.select("key", "weight", F.col("doc_id").alias("first_id"))
        .join(counted, "key", "left")
        .join(joined, "key", "left")
        .withColumn("label", F.coalesce("label", "key"))
    )
    of_class = written(of_class, "of-class")
    least = of_class.groupBy("label").agg(F.min("first_id").alias("least_id"))
    of_class = of_class.join(least, "label")
    return (
        members.select("doc_id", "text_hash", "key")
        .join(of_class, "key", "left")
        .select(
            "doc_id",
            F.coalesce("least_id", "doc_id").alias("class_id"),
            F.coalesce("weight", F.lit(1)).alias("n_copies"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("texts", F.lit(0)).alias("n_texts"),
            "text_hash",
            "label",
        )
    )


def one_of_each(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """The rows of docs without near-duplicates: of each linked group the row with the least id stays, one without an id only if none has one.

    Rows are told apart by id and text, so different texts with one id, or without, are judged each by itself."""
    its_id = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))  # never null
    rows = labelled(docs, text, doc_id).filter("label is not null").select("label", "doc_id", its_id.alias("at_id"), F.col("text_hash").alias("at_hash"))
    rows = written(rows.groupBy("label", "doc_id", "at_id", "at_hash").agg(F.count(F.lit(1)).alias("n")), "linked")
    heads = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at_id", "at_hash")).alias("head")).select("label", "head.at_id", "head.at_hash")
    same = ["label", "at_id", "at_hash"]
    gone = rows.join(heads, same, "left_anti").select("at_id", "at_hash")
    repeated = written(rows.filter("n > 1").join(heads, same, "left_semi").select("at_id", "at_hash"), "repeated")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("at_hash"))
    whole = whole.select("whole", its_id.alias("at_id"), "at_hash")
    at = ["at_id", "at_hash"]
    if repeated.isEmpty():
        return whole.join(gone, at, "left_anti").select("whole.*")
    kept = whole.join(gone.unionByName(repeated), at, "left_anti")
    one = whole.join(repeated, at, "left_semi").dropDuplicates(at)  # only rows that repeat a head with its id and text
    return kept.unionByName(one).select("whole.*")


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_chosen_path_join": op8_chosen_path_join}
