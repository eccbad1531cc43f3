"""Prefix trie of conversations: which turns are shared from the beginning by how many of them.

A conversation is the string of its turns, a turn 44 characters: the hash of role and text, then the text's bytes. Distinct conversations are sorted over
all partitions; the number of turns that neighbours have in common (LCP) is an edge between them. Within a partition a
union-find takes the edges in descending depth: a merge makes, or widens, the branching node at the depth of its edge, and what was
merged into it is a finished chain of nodes, written as one record. An edge waits if a side of it first has to meet, deeper, what lies beyond the partition. What is
left of a partition is a row of merged components along its two borders, at most two for each depth; FAN neighbouring partitions' rows make one more
row, merged the same way, and so on until one is left. Records are then spelled out into a row per node.

What a node sums up is kept for components, as sums over their conversations: all in whole numbers. The ids that end at a node are sorted over all
partitions, joined to pieces where they lie, and a node's pieces run through its SHA-256 one after the other.

Defined cases: turns are in order of their number, nulls first, then of the hash of role and text; a null role or text is an empty one; rows without a
conv_id belong to no conversation and are left out; repeated rows are turns of their own; equal conversations are members of the same nodes; a conversation without turns
is a member of the root; an empty table gives no nodes, not even a root; other columns are ignored, whatever their names. A conversation's hashes are held
by one task, its texts are not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import drop_table, lean, read_table, small_batches, text_bytes, with_integer_id, written

#: Characters of a turn: its hash, and the bytes of its text in decimal.
HASH, DIGITS = 32, 12
TURN = HASH + DIGITS
#: Conversations that share a prefix, and the modulus of its length, in the query.
GROUP, MOST_SHARED = 5, 9
#: Characters of conversations in a partition, about, and partitions that are merged at once.
PART_CHARS, FAN = 16 << 20, 64
#: Ids of a piece.
PIECE = 1024
NO_IDS = hashlib.sha256(b"").hexdigest()

#: Of a component: its first conversation, its depth, children there, members, the least of them, leaves, members' bytes, and of the conversations but for the
#: first, and for the first, the bytes that the one before hasn't.
SUMS = ["sid", "high", "kids", "n", "least", "leaves", "whole", "fresh", "first_fresh"]
STATE = "kind int, part long, pos int, lo int, hi int, low int, sid string, high int, kids long, n long, least long, leaves long, whole long, fresh long, first_fresh long"


def turn_strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, item) of rows (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    item = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.octet_length(text).cast("string"), DIGITS, "0"))
    return with_integer_id(conversations, "conv_id").filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", item.alias("item"))


def whole(turns: DataFrame) -> DataFrame:
    """(conv_id, key): conversations as they are."""
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "item"))).alias("t"))
    return ordered.select("conv_id", F.array_join("t.item", "").alias("key"))


def rebuilt(turns: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """(conv_id, key): the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(decimal c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).repartition("base")  # a conversation and its base lie together
    own = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "item"))).alias("t")).select("base", "conv_id", F.col("t.item").alias("t"))
    heads = own.filter("base = conv_id").select("base", F.slice("t", 1, most - 1).alias("head"))
    both = own.join(heads, "base", "left").withColumn("h", h)
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.array_join(F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>")), rest), "").alias("key"))


def ids_hashed(members: DataFrame) -> DataFrame:
    """(sid, sha256) of the decimal conv_ids of each sid, ascending, joined by commas, of rows (sid, conv_id)."""

    def pieces(batches):
        for batch in batches:
            sid, ids = batch.column("sid"), batch.column("conv_id").to_numpy()
            code = sid.dictionary_encode().indices.to_numpy()
            cuts = np.union1d(np.flatnonzero(np.diff(code, prepend=-1)), np.arange(0, len(ids), PIECE))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.record_batch([sid.take(pa.array(cuts)), pa.array(ids[cuts]), pa.array(texts, pa.string())], ["sid", "first", "ids"])

    def hashed(batches):
        now, sha = None, None
        for batch in batches:
            done = []
            for sid, text in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
                if sid == now:
                    sha.update(b",")
                else:
                    done += [(now, sha.hexdigest())] if sha else []
                    now, sha = sid, hashlib.sha256()
                sha.update(text.encode())
            yield pa.record_batch([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["sid", "ends"])
        if sha:
            yield pa.record_batch([pa.array([now]), pa.array([sha.hexdigest()])], ["sid", "ends"])

    joined = members.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(pieces, "sid string, first long, ids string")
    return joined.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(hashed, "sid string, ends string")


def spelled(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The turns' hashes as four numbers each, their bytes, and the n + 1 places of the conversations among them."""
    raw, offsets = text_bytes(keys)
    turns = raw.reshape(-1, TURN)
    sizes = (turns[:, HASH:].astype(np.int64) - 48) @ 10 ** np.arange(DIGITS - 1, -1, -1, dtype=np.int64)
    return np.ascontiguousarray(turns[:, :HASH]).view(np.uint64), sizes, offsets // TURN


def common_prefixes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each conversation and the next: the turns in common from the beginning."""
    n = np.diff(at)
    most = np.minimum(n[:-1], n[1:])
    pair = np.repeat(np.arange(len(most)), most)
    depth = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
    same = (hashes[at[:-2][pair] + depth] == hashes[at[1:-1][pair] + depth]).all(1)
    out = most.copy()
    np.minimum.at(out, pair[~same], depth[~same])
    return out


def merged(lo: int, edges: list[int], hi: int, rows: dict[str, list]) -> tuple[list[tuple], list[tuple]]:
    """Records (low, *SUMS) of the chains that are finished, and the components left (lo, hi, *SUMS), of a row of components with edges between and at both ends."""
    m = len(edges) + 1
    sid, high, kids, n, least, leaves, whole_, fresh, first = (rows[c] for c in SUMS)
    up, last, records = list(range(m)), list(range(m)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def close(x: int, low: int) -> int:
        """Children that a component makes for the node at this depth; its chain below is finished."""
        if high[x] == low:
            return kids[x]
        records.append((low, sid[x], high[x], kids[x], n[x], least[x], leaves[x], whole_[x], fresh[x], first[x]))
        return 1

    for e in np.argsort(-np.array(edges, np.int64), kind="stable").tolist():
        d, x, y = edges[e], root(e), e + 1
        if (edges[x - 1] if x else lo) > d or (edges[last[y]] if last[y] < m - 1 else hi) > d:
            continue  # a side meets its other neighbour first, beyond the border
        kids[x], high[x] = close(x, d) + close(y, d), d
        n[x], least[x], leaves[x], whole_[x] = n[x] + n[y], min(least[x], least[y]), leaves[x] + leaves[y], whole_[x] + whole_[y]
        fresh[x] += first[y] + fresh[y]
        last[x], up[y] = last[y], x
    if lo < 0 and hi < 0:  # nothing lies beyond: the root
        kids[0], high[0] = close(0, 0), 0
        close(0, -1)
        return records, []
    left = [x for x in range(m) if up[x] == x]
    of = lambda x: (sid[x], high[x], kids[x], n[x], least[x], leaves[x], whole_[x], fresh[x], first[x])
    return records, [(edges[x - 1] if x else lo, edges[last[x]] if last[x] < m - 1 else hi, *of(x)) for x in left]


def state(part: int, records: list[tuple], left: list[tuple]) -> pa.Table:
    """Both as rows of one table: kind 0 and 1."""
    rows = [(0, part, None, None, None, *r) for r in records] + [(1, part, pos, r[0], r[1], None, *r[2:]) for pos, r in enumerate(left)]
    kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = [c.split()[0] for c in STATE.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds))})


def first_forest(key: tuple, rows: pa.Table, border: pa.Table) -> pa.Table:
    """Components of one conversation each, merged within their partition."""
    rows = rows.take(pc.sort_indices(rows["key"])).combine_chunks()
    before, after = (border[c][0].as_py() for c in ("before", "after"))
    keys = pa.concat_arrays([pa.array([before or ""], pa.large_string()), rows["key"].combine_chunks().cast(pa.large_string()), pa.array([after or ""], pa.large_string())])
    hashes, sizes, at = spelled(keys)
    lcp = common_prefixes(hashes, at)
    lcp[0], lcp[-1] = (-1 if before is None else lcp[0]), (-1 if after is None else lcp[-1])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    begin, length = at[1:-2], np.diff(at)[1:-1]
    total = upto[begin + length] - upto[begin]
    n = rows["n"].to_numpy()
    sums = {
        "sid": rows["sid"].to_pylist(), "high": length.tolist(), "kids": [0] * len(n), "n": n.tolist(), "least": rows["least"].to_pylist(), "leaves": (lcp[1:] < length).astype(int).tolist(),
        "whole": (n * total).tolist(), "fresh": [0] * len(n), "first_fresh": (upto[begin + length] - upto[begin + np.maximum(lcp[:-1], 0)]).tolist(),
    }
    return state(key[0].as_py(), *merged(int(lcp[0]), lcp[1:-1].tolist(), int(lcp[-1]), sums))


def joined_forests(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of neighbouring partitions as one, merged."""
    rows = rows.sort_by([("part", "ascending"), ("pos", "ascending")])
    lo, hi = rows["lo"].to_pylist(), rows["hi"].to_pylist()
    return state(key[0].as_py(), *merged(lo[0], hi[:-1], hi[-1], {c: rows[c].to_pylist() for c in SUMS}))


def sorted_parts(seqs: DataFrame) -> DataFrame:
    """seqs with part, in the order of their keys."""
    chars = seqs.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    rows = seqs.select("sid", "key", "n", "least").repartitionByRange(max(1, -(-chars // PART_CHARS)), "key")
    return written(rows.withColumn("part", F.spark_partition_id().cast("long")), "trie-sorted")


def chains(seqs: DataFrame) -> DataFrame:
    """(low, *SUMS): the chains of nodes below depth low down to depth high that the component of the first conversation sid has."""
    rows = sorted_parts(seqs)
    order = Window.orderBy("part")  # of a row for each partition
    borders = rows.groupBy("part").agg(F.min("key").alias("least_key"), F.max("key").alias("most_key"))
    borders = borders.select(F.col("part").alias("p"), F.lag("most_key").over(order).alias("before"), F.lead("least_key").over(order).alias("after"))
    now = written(rows.groupBy("part").cogroup(borders.groupBy("p")).applyInArrow(first_forest, STATE), "trie-forest")
    drop_table(rows)
    tables = [now]
    while not (left := now.filter("kind = 1")).isEmpty():
        group = F.floor(F.col("part") / FAN).alias("group")
        now = written(left.withColumn("group", group).groupBy("group").applyInArrow(joined_forests, STATE), "trie-forest")
        tables.append(now)
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    return found.filter("kind = 0").select("low", *SUMS)


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def spell_nodes(batches):
    """A row for each node of each chain."""
    for batch in small_batches(batches, "key", 4 << 20):
        _, sizes, at = spelled(batch.column("key"))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        low, high, kids, n, least, leaves, whole_, fresh = (batch.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "kids", "n", "least", "leaves", "whole", "fresh"))
        row = np.repeat(np.arange(len(low)), high - low)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row] + 1
        before = upto[at[row] + np.maximum(depth - 1, 0)] - upto[at[row]]
        own = upto[at[row + 1]] - upto[at[row]]
        bottom, top = depth == high[row], depth == low[row] + 1
        parent = pc.if_else(pa.array(top), batch.column("parent").take(pa.array(row)), pa.array(least[row]))
        ends = pc.if_else(pa.array(depth == np.diff(at)[row]), batch.column("ends").take(pa.array(row)), NO_IDS)
        saved = whole_[row] - n[row] * before - (own - before) - fresh[row]
        columns = [least[row], depth, parent, n[row], np.where(bottom, kids[row], 1), leaves[row], saved, ends]
        yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in NODES.split(", ")])


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, key): its least member, depth, parent's least member, members, children, leaves and bytes saved below, ids that end there."""
    rows = written(conversations.select("conv_id", "key", F.md5(F.col("key").cast("binary")).alias("sid")), "trie-rows")
    seqs = rows.groupBy("key").agg(F.first("sid").alias("sid"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    seqs = written(seqs.join(ids_hashed(rows.select("sid", "conv_id")), "sid"), "trie-conversations")
    drop_table(rows)
    prefix = lambda depth: F.md5(F.substring("key", F.lit(1), F.col(depth) * TURN).cast("binary"))
    found = chains(seqs).join(seqs.select("sid", "key"), "sid")
    found = written(found.withColumns({"own": prefix("high"), "up": F.when(F.col("low") >= 0, prefix("low"))}).drop("key"), "trie-chains")
    parents = found.select(F.col("own").alias("up"), F.col("least").alias("parent"))
    linked = found.drop("own").join(parents, "up", "left").join(seqs.select("sid", "key", "ends"), "sid")
    return linked.mapInArrow(lean(spell_nodes), NODES)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turn_strings(read_table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')])),
  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"""

ORACLE = {
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS item, strlen(text) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS side, o.i, o.item, o.bytes FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, o.i, o.item, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY side, i) AS d FROM b),
paths AS (SELECT conv_id, d, bytes, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM paths GROUP BY 1, 2),
up AS (SELECT n.node, p.node AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent, count(*) AS kids FROM up GROUP BY 1),
below AS (SELECT p.node, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (WHERE k.kids IS NULL) AS leaves FROM nodes n LEFT JOIN kids k ON k.parent = n.node JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY 1),
ends AS (SELECT p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN (SELECT conv_id, max(d) AS d FROM paths GROUP BY 1) l ON p.conv_id = l.conv_id AND p.d = l.d GROUP BY 1)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN up u ON u.node = n.node AND n.d > 0 LEFT JOIN nodes q ON q.node = u.parent LEFT JOIN kids k ON k.parent = n.node LEFT JOIN ends e ON e.node = n.node
"""
}
