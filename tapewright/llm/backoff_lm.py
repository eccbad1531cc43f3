"""Language model scores by a weighted backoff automaton.

The smoothed word n-grams (here pairs) of the corpus are an automaton: a state for every context seen, an arc for every word seen after
it with its interpolated probability, and a failure arc to the state of the shorter context, whose weight is the mass
that smoothing has set aside. One traversal of a text from left to right carries the state and adds up log10 probabilities; a word without an arc takes
failure arcs until it has one. The root has an arc for every known word and one for all unknown ones.

  p1(w)   = (max(c(w) - D1, 0) + D1 V / (V + 1)) / N
  p2(w|v) = max(c(v w) - D2, 0) / c(v) + D2 n(v) / c(v) p1(w),   n(v): different words seen after v

with discounts D = n1 / (n1 + 2 n2) from the numbers of n-grams seen once and twice. All of it sums to 1 over the V known
words and one unknown.

The model is never in one place. Documents are dealt to chunks of CHUNK_BYTES; a chunk asks for the words and pairs that
it holds, once each with its own training counts, and the ranges of words (of contexts) add these up and answer with corpus counts. So each chunk gets
the part of the automaton that its texts can reach. With more than FAN chunks requests go through several rounds, in which the requests of FAN sources are
combined and their ranges narrowed, so that what moves, and its number of blocks, grows with the corpus but not with its square.
Words are 64-bit hashes; the second word of a pair is told apart from others after the same first word by 40 bits.

Defined cases: null text is empty: its only token is the end. A null id is learned from as its crc says (the empty
text's). Repeated rows count each. Without any training row all words are unknown and scores are 0 bits of knowledge: p = 1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import crc_mod, mixed, read_table, text_bytes, word_hashes

CHUNK_BYTES = 9 << 20
FAN = 128  # ranges of words that a chunk has blocks for; with more chunks, more rounds
LANE = 4096  # words of a text that are scored one after another
BASE_EXTRA = 0.1  # added to each count by the base model of the contract
END = np.uint64(0x5BD1E9955BD1E995)  # stands for the end of a text, and for what is before its first word
_U = np.uint64
_SECOND_BITS = 40
_SECOND = _U((1 << _SECOND_BITS) - 1)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as one compressed string."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 5, 8) if top < 1 << (8 * w))
        raw = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        packed = zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)  # bytes of one place together
        parts += [width.to_bytes(1, "little"), len(a).to_bytes(8, "little"), len(packed).to_bytes(8, "little"), packed]
    return b"".join(parts)


def expand(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        width, n, size = data[at], int.from_bytes(data[at + 1 : at + 9], "little"), int.from_bytes(data[at + 9 : at + 17], "little")
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(zstandard.decompress(data[at + 17 : at + 17 + size]), np.uint8).reshape(width, n).T
        out.append(raw.view("<u8").ravel().astype(_U))
        at += 17 + size
    return out


class Chunk:
    """Tokens of the texts of a chunk, as places in its sorted word list; pairs as places in its sorted list of pairs."""

    def __init__(self, text: pa.ChunkedArray):
        raw, offsets = text_bytes(text)
        hashes, bounds = word_hashes(raw, offsets)
        n = len(bounds) - 1
        tokens = np.full(len(hashes) + n, END, _U)
        self.ends = bounds[1:] + np.arange(n)  # place of each text's end token
        tokens[np.delete(np.arange(len(tokens)), self.ends)] = hashes
        self.words, self.word = np.unique(np.append(tokens, END), return_inverse=True)
        self.word = self.word[:-1]
        self.end_word = int(np.searchsorted(self.words, END))
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[np.concatenate([[0], self.ends[:-1] + 1]) if n else []] = self.end_word
        self.before = before
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.sizes = self.ends + 1 - self.starts
        self.second = mixed(self.words + _U(1)) & _SECOND

    def keys(self) -> np.ndarray:
        """Of each token the key of the pair that it ends: the context's place, the second word's bits."""
        return (self.before.astype(_U) << _U(_SECOND_BITS)) | self.second[self.word]


def range_cuts(words: np.ndarray, part: int, parts: int, fan: int) -> np.ndarray:
    """Places where words of range part of parts / fan ranges are cut into fan of the parts ranges."""
    edges = np.array([(s << 64) // parts for s in range(part * fan + 1, (part + 1) * fan)], dtype=object)
    return np.concatenate([[0], np.searchsorted(words, np.array(edges, _U)), [len(words)]]).astype(np.int64)


def ask(fan: int):
    """Requests of a chunk: for each of fan ranges of words those it has, their training counts, and the pairs that begin with them."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text"))
        learn = np.repeat(~table.column("held_out").to_numpy(), chunk.sizes)
        count = np.bincount(chunk.word[learn], minlength=len(chunk.words))
        key = chunk.keys()
        pairs = np.unique(key)
        pair_count = np.bincount(np.searchsorted(pairs, key[learn]), minlength=len(pairs))
        context = (pairs >> _U(_SECOND_BITS)).astype(np.int64)
        own = Counts(chunk.words, count, context, pairs & _SECOND, pair_count)
        return blocks(table.column("chunk")[0].as_py(), 0, own.parts(0, fan, fan))

    return run


BLOCKS = "source int, part long, blob binary"


def blocks(source: int, first: int, blobs: list[bytes]) -> pa.Table:
    n = len(blobs)
    return pa.table({"source": pa.array([source] * n, pa.int32()), "part": pa.array(range(first, first + n), pa.int64()), "blob": pa.array(blobs, pa.binary())})


class Counts:
    """Words with counts, and pairs (place of the first word, bits of the second) with counts; all sorted."""

    def __init__(self, words, count, context, second, pair_count):
        self.words, self.count, self.context, self.second, self.pair_count = words, count, context, second, pair_count

    def parts(self, part: int, parts: int, fan: int) -> list[bytes]:
        """The counts of one of parts / fan ranges of words, cut into fan of the parts ranges."""
        cuts = range_cuts(self.words, part, parts, fan)
        after = np.bincount(self.context, minlength=len(self.words))
        pair_cuts = np.concatenate([[0], np.cumsum(after)])[cuts]
        return [squeeze(self.words[a:b], self.count[a:b], after[a:b], self.second[p:q], self.pair_count[p:q]) for a, b, p, q in zip(cuts[:-1], cuts[1:], pair_cuts[:-1], pair_cuts[1:])]


def merged(asked: list[list[np.ndarray]]) -> tuple[Counts, np.ndarray, np.ndarray]:
    """The sum of several requests, and the places of their words and pairs in it."""
    words, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    count = np.bincount(place, np.concatenate([a[1] for a in asked]).astype(np.float64), len(words)).astype(np.int64)
    context = np.repeat(place, np.concatenate([a[2] for a in asked]).astype(np.int64))
    key = (context.astype(_U) << _U(_SECOND_BITS)) | np.concatenate([a[3] for a in asked])
    pairs, pair_place = np.unique(key, return_inverse=True)
    pair_count = np.bincount(pair_place, np.concatenate([a[4] for a in asked]).astype(np.float64), len(pairs)).astype(np.int64)
    return Counts(words, count, (pairs >> _U(_SECOND_BITS)).astype(np.int64), pairs & _SECOND, pair_count), place, pair_place


def answers_for(table: pa.Table, asked: list, place: np.ndarray, pair_place: np.ndarray, sums, count, total, kinds, pair_count) -> pa.Table:
    """What a request of each row of the table is answered: the range's sums, then counts in the order asked."""
    at = np.concatenate([[0], np.cumsum([len(a[0]) for a in asked])])
    pair_at = np.concatenate([[0], np.cumsum([len(a[3]) for a in asked])])
    blobs = []
    for k in range(len(asked)):
        own, own_pairs = place[at[k] : at[k + 1]], pair_place[pair_at[k] : pair_at[k + 1]]
        blobs.append(squeeze(sums, count[own], total[own], kinds[own], pair_count[own_pairs]))
    return pa.table({"source": table.column("source"), "part": table.column("part"), "blob": pa.array(blobs, pa.binary())})


def answer(table: pa.Table) -> pa.Table:
    """Corpus counts for all requests of a range, in the order asked, and the range's totals."""
    asked = [expand(b.as_py()) for b in table.column("blob")]
    own, place, pair_place = merged(asked)
    total = np.bincount(own.context, own.pair_count, len(own.words)).astype(np.int64)  # of each context
    kinds = np.bincount(own.context[own.pair_count > 0], minlength=len(own.words))
    sums = np.array([own.count.sum(), (own.count > 0).sum(), (own.count == 1).sum(), (own.count == 2).sum(), (own.pair_count == 1).sum(), (own.pair_count == 2).sum()])
    return answers_for(table, asked, place, pair_place, sums, own.count, total, kinds, own.pair_count)


def combine(parts: int, fan: int):
    """The requests of fan sources for one of parts ranges as one, cut into fan narrower ranges."""

    def run(table: pa.Table) -> pa.Table:
        own, _, _ = merged([expand(b.as_py()) for b in table.column("blob")])
        part = table.column("part")[0].as_py()
        return blocks(table.column("source")[0].as_py() // fan, part * fan, own.parts(part, parts * fan, fan))

    return run


def divide(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to a combined request, dealt to its sources."""
    asked = [expand(b.as_py()) for b in table.column("blob")]
    _, place, pair_place = merged(asked)
    rows = sorted(zip(answers.column("part").to_pylist(), answers.column("blob")), key=lambda r: r[0])
    found = [expand(b.as_py()) for _, b in rows]
    whole = [np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(1, 5)]
    return answers_for(table, asked, place, pair_place, np.sum([f[0].astype(np.int64) for f in found], 0), *whole)


def exchanged(requests: DataFrame, parts: int, rounds: int, fan: int) -> DataFrame:
    """Answers to requests (source, part, blob) for parts ranges of words.

    A source has fan blocks in every round, each of about the size of the first, so blocks grow with the data and not with its square: before the last round, fan
    sources are combined and their ranges narrowed by as much."""
    if rounds == 1:
        return requests.groupBy("part").applyInArrow(answer, BLOCKS)
    group = [F.floor(F.col("source") / fan).cast("int").alias("group"), "part"]
    narrower = requests.groupBy(*group).applyInArrow(combine(parts, fan), BLOCKS)
    found = exchanged(narrower, parts * fan, rounds - 1, fan)
    back = found.groupBy(F.col("source").alias("group"), F.floor(F.col("part") / fan).cast("long").alias("part"))
    return requests.groupBy(*group).cogroup(back).applyInArrow(divide, BLOCKS)


class Automaton:
    """States are 0, the root, and 1 + the place of each context word with training counts; arcs are sorted by (state, word)."""

    def __init__(self, chunk: Chunk, answers: list[list[np.ndarray]]):
        whole = [np.concatenate([a[k] for a in answers]).astype(np.int64) for k in range(1, 5)]
        self.count, total, kinds, pair_count = whole
        self.n, self.v, once, twice, pair_once, pair_twice = np.sum([a[0].astype(np.int64) for a in answers], 0)
        d1 = once / (once + 2 * twice) if once else 0.5
        d2 = pair_once / (pair_once + 2 * pair_twice) if pair_once else 0.5
        d1, d2 = (min(max(d, 0.1), 0.95) for d in (d1, d2))
        unseen = d1 * self.v / (self.v + 1)  # of a word's share in counts
        root = (np.maximum(self.count - d1, 0) + unseen) / self.n if self.n else np.ones(len(self.count))
        self.root = np.log10(root)
        pairs, first = np.unique(chunk.keys(), return_index=True)
        context, seen = (pairs >> _U(_SECOND_BITS)).astype(np.int64), pair_count > 0
        self.fail = np.zeros(len(total) + 1)  # log10 weight of each state's failure arc
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(total > 0, d2 * kinds / total, 1.0)
        self.fail[1:] = np.log10(share)
        self.state_after = np.where(total > 0, np.arange(1, len(total) + 1), 0)  # of a word: its own context, or the root
        word = chunk.word[first[seen]]  # a pair's second word, whose own probability its arc needs
        arc = np.maximum(pair_count[seen] - d2, 0) / total[context[seen]] + share[context[seen]] * root[word]
        self.keys = ((context[seen] + 1).astype(_U) << _U(_SECOND_BITS)) | (pairs[seen] & _SECOND)
        self.arcs = np.log10(arc)

    def score(self, chunk: Chunk) -> np.ndarray:
        """log10 probability of every text. Texts advance together, a word at a step, each carrying its state; a long one in lanes of LANE words, the
        first state of a lane being that after the word before it."""
        n_lanes = -(-chunk.sizes // LANE)
        text = np.repeat(np.arange(len(chunk.sizes)), n_lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        starts = chunk.starts[text] + nth * LANE
        sizes = np.minimum(LANE, chunk.sizes[text] - nth * LANE)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, text = starts[order], sizes[order], text[order]
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")  # lanes longer than t
        state = self.state_after[chunk.before[starts]] if len(starts) else np.zeros(0, np.int64)
        total = np.zeros(len(starts))
        last = max(len(self.keys) - 1, 0)
        for t, n in enumerate(active.tolist()):
            word, now = chunk.word[starts[:n] + t], state[:n]
            key = (now.astype(_U) << _U(_SECOND_BITS)) | chunk.second[word]
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, key), last)
                total[:n] += np.where(self.keys[at] == key, self.arcs[at], self.fail[now] + self.root[word])
            else:
                total[:n] += self.fail[now] + self.root[word]
            state[:n] = self.state_after[word]
        return np.bincount(text, total, len(chunk.sizes))


def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
    chunk = Chunk(docs.column("text"))
    rows = sorted(zip(answers.column("part").to_pylist(), answers.column("blob")), key=lambda r: r[0])
    model = Automaton(chunk, [expand(b.as_py()) for _, b in rows])
    seen = np.concatenate([[0], np.cumsum(model.count[chunk.word] > 0)])
    base = np.log10((model.count + BASE_EXTRA) / (model.n + BASE_EXTRA * (model.v + 1)))
    ends, starts = chunk.ends + 1, chunk.starts
    base_score = np.add.reduceat(base[chunk.word], starts) if len(starts) else np.zeros(0)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(chunk.sizes, pa.int64()),
            "n_known": pa.array(seen[ends] - seen[starts], pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), model.n), pa.int64()),
            "base_score": pa.array(base_score, pa.float64()),
            "score": pa.array(model.score(chunk), pa.float64()),
        }
    )


def score(docs: DataFrame, held_out, text="text", doc_id="doc_id") -> DataFrame:
    """Scores every row of docs by a model of those rows for which the column held_out is false."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    rounds = 1
    while FAN**rounds < chunks:
        rounds += 1
    fan = max(1, math.ceil(chunks ** (1 / rounds) - 1e-9))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
    requests = dealt.groupBy("chunk").applyInArrow(ask(fan), BLOCKS)
    answers = exchanged(requests, fan, rounds, fan)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy(F.col("source").alias("chunk"))).applyInArrow(finish, schema)


def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


QUERIES = {"op1_backoff_lm": op1_backoff_lm}
