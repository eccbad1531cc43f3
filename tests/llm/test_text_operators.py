"""Each operator against a brute-force version on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import backoff_lm, bpe, jaccard_join, mixing, order_minhash, suffix_dedup, token_files, toxicity, webp
from tapewright.llm.common import crc_mod, mixed, ranges_of
from tapewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, `label` int, `size` int, copies string, whole string, key string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def some_rows(seed=7, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choices(words, k=k))
    passage = text(60)
    texts = [None, "", "   ", "One", "a b", "é漢😀 x\x1cy", text(6000), "z" * 3000, passage, passage]
    for _ in range(n):
        t = text(rnd.randint(1, 150))
        texts.append(t if rnd.random() < 0.7 else t + "\n" + passage + " " + text(5))
    near = text(150).split(" ")
    for k in range(6):
        copy = list(near)
        copy[10 * k] = "changed"
        texts.append(" ".join(copy))
    rows = [(i, t, rnd.choice(["b", "a", None, "ä"]), 1, 2, "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[-1], rows[5], (None, passage, "a", 0, 0, "", "", ""), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_orders_all_suffixes():
    rnd = random.Random(2)
    for n in (1, 2, 5, 50, 700):
        for letters in (1, 2, 4, 200):
            x = bytes(rnd.randrange(letters) for _ in range(n))
            assert suffix_dedup.suffix_array(np.frombuffer(x, np.uint8), 10**6).tolist() == sorted(range(n), key=lambda i: x[i:])


@pytest.mark.parametrize("group", [1 << 15, 1])
def test_suffix_dedup_removes_what_repeats(docs, empty, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_PIECES", group)  # 1: every group is split
    rows = docs.collect()
    data = [(r.text or "").encode() for r in rows]
    seen = Counter(x[j : j + 200] for x in data for j in range(len(x) - 199))
    wanted = Counter()
    for r, x in zip(rows, data):
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - 199):
            if seen[x[j : j + 200]] > 1:
                gone[j : j + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        wanted[r.doc_id, len(x), int(gone.sum()), spans, bytes(np.frombuffer(x, np.uint8)[~gone])] += 1
    got = suffix_dedup.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == wanted
    if group == 1:
        assert suffix_dedup.without_repeats(empty).count() == 0
        texts = suffix_dedup.deduplicated(docs)
        assert texts.columns == docs.columns and texts.count() == len(rows)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1 if w else 0)))


def test_jaccard_join_counts_all_links(docs, empty):
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    linked = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    wanted = Counter()
    for i, a in enumerate(sets):
        links = sum(linked(a, b) for j, b in enumerate(sets) if j != i)
        group, grown = {i}, True
        while grown:
            more = {j for j, b in enumerate(sets) if any(linked(sets[k], b) for k in group)} | group
            grown, group = more != group, more
        ids = [rows[j].doc_id for j in group if rows[j].doc_id is not None]
        wanted[rows[i].doc_id, min(ids) if ids else None, links] += 1
    got = jaccard_join.linked(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == wanted
    assert jaccard_join.linked(empty).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    heads = {c for _, c, _ in wanted if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(heads)


def test_jaccard_runs_reach_the_target():
    for depth in range(jaccard_join.FIRST_DEPTH, jaccard_join.MAX_DEPTH + 1, 2):
        assert jaccard_join.missed(jaccard_join.runs_needed(), depth) <= 1 - jaccard_join.TARGET


def pairs_of_sketches(n, shared):
    """Sketches of n pairs, a pair's after one another, that agree in so many coordinates."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 15, (n, jaccard_join.COORDINATES)).astype(np.uint16)
    b = a.copy()
    for x, k in zip(b, np.broadcast_to(shared, n)):
        x[rng.permutation(jaccard_join.COORDINATES)[k:]] += np.uint16(1 << 15)
    return np.stack([a, b], 1).reshape(2 * n, -1)


def share_met(sketch, depth):
    """Share of the pairs with a common path at this depth, by the runs that a join makes."""
    text = [x.tobytes() for x in sketch]
    batch = pa.record_batch([pa.array(range(len(sketch)), pa.int64()), pa.array(text)], ["key", "sketch"])
    found = pa.Table.from_batches(jaccard_join.first_paths([batch], jaccard_join.runs_needed(), jaccard_join.FIRST_DEPTH)).to_pandas().drop_duplicates()
    shared = lambda x: x[x.assign(pair=x["key"] // 2).groupby(["path", "pair"])["key"].transform("nunique") == 2]
    found = shared(found)
    for _ in range(jaccard_join.FIRST_DEPTH, depth, 2):
        batch = pa.record_batch([pa.array(found["path"]), pa.array(found["key"]), pa.array([text[k] for k in found["key"]])], ["path", "key", "sketch"])
        found = shared(pa.Table.from_batches(jaccard_join.next_paths([batch])).to_pandas().drop_duplicates())
    return (found["key"] // 2).nunique() / (len(sketch) // 2)


def test_jaccard_recall_holds_where_buckets_stay_crowded():
    assert 1 - (1 - jaccard_join.survival(jaccard_join.MAX_DEPTH)) ** jaccard_join.runs_needed() >= jaccard_join.TARGET
    shared = round(jaccard_join.SIMILARITY * jaccard_join.COORDINATES)
    assert share_met(pairs_of_sketches(1500, shared), jaccard_join.MAX_DEPTH) >= 0.997


def test_jaccard_recall_counts_what_the_sketch_loses():
    p, n = jaccard_join.SIMILARITY, jaccard_join.COORDINATES
    chance = lambda k: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    kept = [k for k in range(n + 1) if jaccard_join.spanning(pairs_of_sketches(1, k))]  # of two sketches with k equal coordinates
    assert 1 - sum(chance(k) for k in kept) < 1e-6
    runs = jaccard_join.runs_needed()
    assert sum(chance(k) * (1 - (1 - jaccard_join.survival(jaccard_join.MAX_DEPTH, k / n)) ** runs) for k in kept) >= jaccard_join.TARGET
    shared = np.random.default_rng(5).binomial(n, p, 3000)
    assert share_met(pairs_of_sketches(3000, shared), jaccard_join.MAX_DEPTH) >= 0.998


def test_jaccard_links_of_a_poor_sketch_are_kept(spark):
    """Pairs of exactly 0.8, each alone in its group: those whose sketches agree in less than 0.7 count too."""
    word = lambda i, k: f"p{i}w{k}"
    rows = []
    for i in range(1200):  # 40 and 41 shingles, 36 of 45 shared
        rows += [(2 * i, " ".join(word(i, k) for k in range(44))), (2 * i + 1, " ".join(word(i, k) for k in range(4, 49)))]
    sets = [shingles(t) for _, t in rows[:2]]
    assert len(sets[0] & sets[1]) == 0.8 * len(sets[0] | sets[1])
    keys, bounds = jaccard_join.shingle_sets(pa.array([t for _, t in rows]))
    sketch = jaccard_join.sketches(keys, bounds)
    assert ((sketch[::2] == sketch[1::2]).mean(1) < 0.7).any()
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_links == 1 for r in got) >= 0.999 * len(rows)


def test_jaccard_large_groups_are_split_and_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "MAX_DEPTH", 3)
    rnd = random.Random(1)
    base = [str(rnd.randrange(10**6)) for _ in range(200)]
    rows = [(i, " ".join(base[: i % 200] + [f"w{i}"] + base[i % 200 + 1 :])) for i in range(60)]
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in rows]
    for r in got:
        assert r.n_links == sum(len(sets[r.doc_id] & b) >= 0.8 * len(sets[r.doc_id] | b) - 1e-9 for j, b in enumerate(sets) if j != r.doc_id)
    assert {r.class_id for r in got} == {0}


@pytest.mark.parametrize(("bucket", "pivots"), [(6, 8), (40, 1)])
def test_jaccard_crowded_buckets_of_several_groups(spark, monkeypatch, bucket, pivots):
    """Groups of near copies that share half of their words: pivots link some of a crowded bucket's classes only, and the rest goes down."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket), monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16), monkeypatch.setattr(jaccard_join, "SLICE", 50)
    rnd = random.Random(3)
    word = lambda: str(rnd.randrange(10**7))
    common, rows = [word() for _ in range(150)], []
    for group in range(6):
        own = common[: 25 * group] + [word() for _ in range(150 - 25 * group)]
        for _ in range(25):
            text = list(own)
            for _ in range(rnd.randrange(4)):
                text[rnd.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    close = [[i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    wanted = [sum(x) for x in close]
    got = {r.doc_id: r.n_links for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(abs(got[i] - n) for i, n in enumerate(wanted)) <= 0.002 * sum(wanted)


def test_components_by_contraction(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(4000), rnd.randrange(4000)) for _ in range(1800)] + [(10_000 + i, 10_001 + i) for i in range(40)] + [(20_000, 20_001 + i) for i in range(50)] + [(5, 5), (30_000, 30_000)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("fan", "lane"), [(128, 4096), (2, 7)])
def test_language_model_matches_formulas(docs, empty, monkeypatch, fan, lane):
    monkeypatch.setattr(backoff_lm, "CHUNK_BYTES", 9000)  # several chunks, and rounds where the fan is small
    monkeypatch.setattr(backoff_lm, "FAN", fan), monkeypatch.setattr(backoff_lm, "LANE", lane)
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [WORD.findall(lower(r.text or "")) + [0] for r in rows]
    c, p, total, kinds = Counter(), Counter(), Counter(), Counter()
    for r, w in zip(rows, tokens):
        if not held(r.doc_id):
            c.update(w)
            p.update(zip([0, *w], w))
    for (v, _), k in p.items():
        total[v] += k
        kinds[v] += 1
    n, v_all = sum(c.values()), len(c)
    discount = lambda counts: min(max(counts[1] / (counts[1] + 2 * counts[2]), 0.1), 0.95)
    d1, d2 = discount(Counter(c.values())), discount(Counter(p.values()))
    p1 = lambda w: (max(c[w] - d1, 0) + d1 * v_all / (v_all + 1)) / n
    p2 = lambda v, w: max(p[v, w] - d2, 0) / total[v] + d2 * kinds[v] / total[v] * p1(w) if total[v] else p1(w)
    some = next(w for w in c if w != 0)
    assert abs(sum(p2(some, w) for w in c) + p2(some, "never seen") - 1) < 1e-9
    key = lambda *x: tuple(round(y, 6) if isinstance(y, float) else y for y in x)
    wanted = Counter()
    for r, w in zip(rows, tokens):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v_all + 1))) for x in w)
        wanted[key(r.doc_id, held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, base, sum(math.log10(p2(a, b)) for a, b in zip([0, *w], w)))] += 1
    got = backoff_lm.score(docs, crc_mod("doc_id", 10) == 0).collect()
    assert Counter(key(*r) for r in got) == wanted
    assert backoff_lm.score(empty, crc_mod("doc_id", 10) == 0).count() == 0


def test_an_arc_takes_the_chance_of_its_own_second_word(monkeypatch):
    """Words that share their bits with others of a chunk, but not with others after the same first word, keep their own chances."""
    words = [w for k in range(300) for w in (f"a{k}", f"b{k % 7}")]
    docs = pa.table({"doc_id": [1, 2], "text": [" ".join(words), " ".join(words[:200])], "held_out": [False, False], "chunk": [0, 0]})
    chunk = backoff_lm.Chunk(docs.column("text"))
    pairs = len(np.unique(chunk.keys()))

    def with_bits(bits: int) -> "backoff_lm.Chunk":
        monkeypatch.setattr(backoff_lm, "_SECOND_BITS", bits), monkeypatch.setattr(backoff_lm, "_SECOND", np.uint64((1 << bits) - 1))
        return backoff_lm.Chunk(docs.column("text"))

    scores = lambda: backoff_lm.finish(docs, backoff_lm.answer(backoff_lm.ask(1)(docs))).column("score").to_pylist()
    wanted, tried = scores(), 0
    for bits in range(10, 24):
        few = with_bits(bits)
        if len(np.unique(few.keys())) == pairs and len(np.unique(few.second)) < len(few.second):
            assert scores() == wanted
            tried += 1
    assert tried


def test_fingerprints(docs, empty):
    rows = docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie, r.text or ""))
    got = order_minhash.with_edits(docs).collect()
    wanted = Counter()
    likeness = lambda x, y: sum(x[8 * k : 8 * k + 8] == y[8 * k : 8 * k + 8] for k in range(order_minhash.SIZE)) / order_minhash.SIZE
    for i, r in enumerate(rows):
        a, b = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(a) // 2
        changed = a[: len(a) - half] + b[:half]
        own, after, following = (order_minhash.as_text(order_minhash.fingerprints([t]))[0] for t in (a, changed, b))
        wanted[r.doc_id, len(a), hashlib.sha256(changed.encode()).hexdigest(), own, after, likeness(own, after), likeness(own, following)] += 1
    assert Counter(tuple(r) for r in got) == wanted
    assert order_minhash.with_edits(empty).count() == 0


def test_fingerprint_takes_least_elements_in_text_order():
    text = "abcabcabc the order of elements counts abcabcabc" * 3
    keys, _ = order_minhash.elements([text])
    assert len(set(keys.tolist())) == len(keys)  # repeats are numbered
    wanted = []
    for j, factor in enumerate(order_minhash._FACTORS.tolist()):
        least = sorted(((int(k) & 0xFFFFFFFF) * factor & 0xFFFFFFFF, int(k), i) for i, k in enumerate(keys))[: order_minhash.TAKEN]
        value = np.array([j + 1], np.uint64)
        for _, k, _ in sorted(least, key=lambda x: x[2]):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + np.array([k], np.uint64))
        wanted.append(int(value[0] >> np.uint64(32)))
    assert order_minhash.fingerprints([text])[0].tolist() == wanted
    moved = order_minhash.fingerprints([text, text[60:] + text[:60]])
    assert order_minhash.likeness(moved[:1], moved[1:])[0] < 1


LIBRARY = bpe.library(bpe.tokenizer_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_bpe_agrees_with_the_library(spark, docs, empty, monkeypatch):
    rnd = random.Random(1)
    letters = list("abc dé ' \t\n\x85\xa0 　\x1c\x1fΣσÍİ漢字😀1 2.,!'s're<|endoftext|>́​ﬁ") + ["<|endoftext|>", "'ll", "<|ENDOFTEXT|>"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 300))) for _ in range(400)] + [None, "x", " ", "a" * 5000, "é" * 3000, "ab. cd, " * 300, "z " * 4000]
    texts += ["".join(rnd.choices(letters, k=9000)) for _ in range(3)]
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(table, bpe.tokenizer_path()).collect()}
    for i, text in enumerate(texts):
        assert got[str(i)].ids == ids_of(text) and got[str(i)].decoded == LIBRARY.decode(ids_of(text), skip_special_tokens=False)
    rows = docs.collect()
    wanted = Counter((r.doc_id, tuple(ids_of(r.text))) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, bpe.tokenizer_path()).collect()) == wanted
    for remembered in (0, 3000):
        monkeypatch.setattr(bpe, "REMEMBERED_BYTES", remembered)
        assert Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(docs.unionByName(docs), bpe.tokenizer_path()).collect()) == Counter({k: 2 * n for k, n in wanted.items()})
    digest = lambda r: (r.doc_id, len(ids_of(r.text)), hashlib.sha256(np.array(ids_of(r.text), "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids_of(r.text), skip_special_tokens=False).encode()).hexdigest())
    assert Counter(tuple(r) for r in bpe.encode_digests(docs, bpe.tokenizer_path()).collect()) == Counter(map(digest, rows))
    assert bpe.encode_digests(empty, bpe.tokenizer_path()).count() == 0
    assert bpe.chunk_use(empty, bpe.tokenizer_path()).collect() == [(0, 0)]
    with pytest.raises(ValueError):
        bpe.library(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_bpe_encodes_shared_chunks_once(spark):
    rnd = random.Random(5)
    words = lambda k: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(k))
    rows = []
    for _ in range(40):
        passage = words(800)
        rows += [(len(rows) + i, f"{words(20)} {passage} {words(20)}") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    places, encoded = bpe.chunk_use(table, bpe.tokenizer_path()).first()
    assert encoded < places / 3


def test_huffman_round_trip_and_length_limit():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (5, 3), (513, 40), (50_000, 5000), (512 * 3, 7)):
        ids = (rng.pareto(0.7, n) * 3).astype(int) % kinds
        lengths = token_files.code_lengths(np.bincount(ids, minlength=1 << 16))
        payload, checkpoints = token_files.pack(ids, lengths, token_files.canonical_codes(lengths))
        assert (token_files.unpack(payload, n, checkpoints, token_files.decoding_table(lengths)) == ids).all()
    steep = np.array([1 << k for k in range(30)])
    lengths = token_files.code_lengths(steep, 8)
    assert lengths.max() == 8 and sum(2.0 ** -lengths) == 1


READ = """
import sys
from pyspark.sql import SparkSession
from tapewright.llm import token_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for r in token_files.read_files(spark, sys.argv[1]).collect():
    print(r.doc_id, r.start, r.n_tokens, r.ids_crc32, sep="\t")
"""


def test_token_files_read_back(spark, docs, empty, tmp_path):
    """From the folder alone, in another process; the least id, a null one, and one id on a third of all rows stay apart."""
    docs = docs.unionByName(docs.limit(40).withColumns({"doc_id": F.lit(-(1 << 63)), "text": F.concat(F.coalesce("text", F.lit("")), F.monotonically_increasing_id().cast("string"))}))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    folder = f"file://{tmp_path}/files"
    token_files.write_files(docs, bpe.tokenizer_path(), folder)
    done = subprocess.run([sys.executable, "-c", READ, folder], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[2])
    got = sorted((tuple(None if x == "None" else int(x) for x in line.split("\t")) for line in done.stdout.splitlines()), key=lambda r: r[1])
    order = lambda i: (i is not None, i or 0)
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=order)
    start = 0
    for r in got:
        assert r[1] == start
        start += r[2]
    wanted = Counter((r.doc_id, len(ids_of(r.text)) + 1, zlib.crc32(np.array([*ids_of(r.text), 2], "<u4").tobytes())) for r in docs.collect())
    assert Counter((i, n, crc) for i, _, n, crc in got) == wanted
    token_files.write_files(empty, bpe.tokenizer_path(), f"{folder}-empty")
    assert token_files.read_files(spark, f"{folder}-empty").count() == 0
    with pytest.raises(TypeError):
        token_files.write_files(docs.withColumn("doc_id", F.lit("a")), bpe.tokenizer_path(), f"{folder}-text")
    with pytest.raises(TypeError):
        order_minhash.with_edits(docs.withColumn("doc_id", F.lit("a")))


def test_ranges_cut_a_number_that_many_rows_share(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(-500, 500), rnd.randrange(-(1 << 63), 1 << 63)) for _ in range(900)] + [(77, rnd.randrange(-(1 << 63), 1 << 63)) for _ in range(600)]
    found = ranges_of(spark.createDataFrame([(a, b, 1) for a, b in pairs], "number long, tie long, size long"))
    at = found.place(*(np.array(x, np.int64) for x in zip(*sorted(pairs))))
    assert (np.diff(at) >= 0).all() and at[0] == 0 and at[-1] == len(found.numbers) - 1
    assert np.bincount(at).max() < 500
    starts = list(zip(found.numbers.tolist(), found.ties.tolist()))
    assert [sorted(pairs)[i] for i in np.flatnonzero(np.diff(at, prepend=-1))] == starts


def test_toxicity_learns_from_confirmed_and_unlabelled(spark, empty):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = rnd.choices(words, k=rnd.randint(5, 80)) + (rnd.choices(["idiot,", "SCUM", "clown"], k=3) if toxic else [])
        rnd.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            labels.append((i, int(toxic)))
    rows += [(None, None), (5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (0, 1), (None, 1), (77777, 1), (4, None)], "doc_id long, toxic int")
    train = crc_mod("doc_id", 4) != 2
    got = toxicity.score(docs, toxicity.fit(docs.filter(train), known.filter(train))).collect()
    assert len(got) == len(rows)
    wrong = sum((r.toxicity_score >= 0.3) != (r.doc_id % 8 == 0) for r in got if r.doc_id is not None and r.doc_id < 5000)
    assert wrong <= 15
    assert toxicity.without_toxic(docs.selectExpr("*", "1 as toxicity_score", "2 as whole"), known).columns == ["doc_id", "text", "toxicity_score", "whole"]
    none = toxicity.score(docs, toxicity.fit(docs, known.filter("toxic = 0"))).collect()
    assert {r.toxicity_score for r in none} == {0.0}
    assert toxicity.without_toxic(empty, known).count() == 0


def test_webp_round_trip(docs):
    texts = [None, "", "a", "ab" * 5000, "x" * 20000, "é漢😀" * 3000, "0" * 575, "1" * 576, "2" * 577] + [r.text for r in docs.collect()]
    media, _ = webp.stored(pa.array(texts))
    for text, back in zip(texts, webp.read_back(media)):
        data = (text or "").encode()
        assert back.tobytes() == data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    with pytest.raises(ValueError):
        webp.read_back([media[3][: len(media[3]) // 2]])


def test_mixing_meets_targets(docs, empty):
    rows = docs.collect()
    size = lambda t: len(WORD.findall(t or ""))
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    assert all(r.copies <= 2 and r.taken == r.copies * r.size for r in got)
    assert sorted(got) == sorted(mixing.mix(docs).collect()) if all(r.doc_id is not None for r in got) else True
    total = sum(r.size for r in got)
    targets = {r.source_size: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets.items())
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_of_a_source_met_by_whole_copies(spark):
    rows = [(3 * i + k, "" if i < 5 else "w " * 4, s) for i in range(40) for k, s in enumerate("abc")] + [(1000, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")  # three equal sources: the first stops at twice its size
    sizes = docs.selectExpr("doc_id", "source", "cast(4 * cast(length(text) > 0 as int) as long) as size", "md5(text) as tie")
    cuts = {r.its_source: r.cut_slice for r in mixing.mix_plan(sizes).collect()}
    assert cuts["a"] is None and cuts["b"] is not None and cuts["c"] is not None
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert {got[i].copies for i, _, s in rows if s == "a"} == {2}
    assert len(got) == len(rows) and got[1000].taken == 0


def test_mixing_by_documents_own_weights(spark, monkeypatch):
    """Shares of seeds in which documents are taken follow their own inclusion chances; those stopped at two copies have two."""
    weights = [0.0, None, 1.0, 2.0, 4.0, 8.0, 300.0, -1.0]
    rows = [(i, "w " * 10, "a", weights[i % 8]) for i in range(800)] + [(1000 + i, "w " * 10, "b", 1.0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    share = lambda c: [min(2.0, c * max(0.0, w or 0.0)) for w in weights]
    taken, seeds = Counter(), 6
    for seed in range(seeds):
        monkeypatch.setattr(mixing, "SEED", f"s{seed}")
        got = mixing.mix(docs, weight="weight", weights=(1, 1), share=1.0).collect()
        for r in got:
            if r.doc_id < 1000:
                taken[r.doc_id % 8] += r.copies
        assert abs(sum(r.taken for r in got if r.doc_id < 1000) - next(r.target for r in got if r.doc_id < 1000)) <= 10
    target = next(r.target for r in got if r.doc_id < 1000)
    low, high = 0.0, 100.0  # the factor of source a by bisection
    for _ in range(100):
        c = (low + high) / 2
        low, high = (c, high) if sum(share(c)) * 100 * 10 < target else (low, c)
    for k, chance in enumerate(share(c)):
        n = 100 * seeds
        error = 4 * math.sqrt(max((chance % 1) * (1 - chance % 1), 1e-12) / n) + 0.02
        assert abs(taken[k] / n - chance) <= error, (k, taken[k] / n, chance)


def test_one_of_each_judges_rows_by_id_and_text(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    near = lambda k: text(k) + " more"
    rows = [
        (1, text(1)), (2, near(1)), (2, text(2)),  # id 2: a near-duplicate of 1, and a text of its own
        (3, text(3)), (3, text(3)), (3, text(4)),  # a repeated row, and another text with its id
        (5, text(5)), (None, near(5)), (None, text(6)), (None, near(6)), (None, text(7)),
        (8, None), (8, ""), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect())
    one_of_6 = [x for x in kept if x in ((None, text(6)), (None, near(6)))]
    assert len(one_of_6) == 1
    assert kept == Counter([(1, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (5, text(5)), one_of_6[0], (None, text(7)), (8, None), (8, ""), (None, None)])
