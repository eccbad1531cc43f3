"""Conversation tries, propagated trust and source divergence against plain versions, with the cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import conversation_trie, divergence, link_graph

CONV = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    kids = Counter(node[:-1] for node in members if node)
    for node, who in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][0] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
            below[node[:d]][1] += not kids[node]
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node], below[node][1], below[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if c % 11 == 3:
            continue
        for turn in range(rng.choice([1, 2, 3, 3, 8, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn > 4 else "user", rng.choice(["a", "b", "ü" * 40, "long " * 50]) if rng.random() < 0.3 else "same"))
    return rows


@pytest.mark.parametrize("chars, fan", [(16 << 20, 64), (700, 2), (2000, 3)])
def test_trie_of_random_conversations(spark, monkeypatch, chars, fan):
    """One partition, and many whose forests are merged in several rounds."""
    monkeypatch.setattr(conversation_trie, "PART_CHARS", chars)
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    rows = random_conversations(120, 5)
    got = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.turn_strings(spark.createDataFrame(rows, CONV))))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(plain_rebuilt(rows))


def test_trie_of_odd_rows(spark, monkeypatch):
    """Nulls everywhere, turns of one number, repeated rows, empty texts, one very long conversation with a branch near its end, copies, clashing columns."""
    monkeypatch.setattr(conversation_trie, "PART_CHARS", 5000)
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 0, "user", ""), (7, 0, None, "x")]
    rows += [(c, t, "user", f"turn {t}" if t < 395 else f"{c % 3} {t}") for c in (1000, 1005, 1010) for t in range(400)]
    rows += [(c, t, "user", "copy") for c in range(2000, 2400) for t in range(2)]
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONV + ", key string, item int, n int")
    got = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.turn_strings(frame))).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(plain_rebuilt(rows))


def test_trie_of_turnless_and_of_no_conversations(spark):
    alone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)  # no base, and its only turn is among the shared
    for rows in ([(alone, 0, "user", "x")], [(alone, 0, "user", "x"), (900, 0, "user", "y")]):
        got = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.turn_strings(spark.createDataFrame(rows, CONV)))).collect()
        assert sorted(map(tuple, got), key=str) == plain_trie(plain_rebuilt(rows))
    assert conversation_trie.trie(conversation_trie.whole(conversation_trie.turn_strings(spark.createDataFrame([], CONV)))).count() == 0


def test_trie_of_conversations_as_they_are(spark):
    rows = [(c, t, "user", x) for c, text in enumerate(["ab", "abc", "abd", "", "b", "ab"]) for t, x in enumerate(text)]
    whole = conversation_trie.whole(conversation_trie.turn_strings(spark.createDataFrame(rows, CONV)))
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in conversation_trie.trie(whole).collect()}
    assert got == {(0, 0): (5, 2, 3, 6), (0, 1): (4, 1, 2, 6), (0, 2): (4, 2, 2, 3), (1, 3): (1, 0, 1, 0), (2, 3): (1, 0, 1, 0), (4, 1): (1, 0, 1, 0)}


def test_many_ids_of_one_node(spark):
    """More ids than a piece holds, over several partitions."""
    members = spark.range(0, 30_000, 1, 7).selectExpr("CASE WHEN id % 3 = 0 THEN 'one' ELSE concat('x', id % 50) END AS sid", "id * 7 - 900 AS conv_id")
    got = {r.sid: r.ends for r in conversation_trie.ids_hashed(members).collect()}
    ids = defaultdict(list)
    for sid, c in members.collect():
        ids[sid].append(c)
    assert got == {s: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for s, v in ids.items()}


def plain_judge(pages, rules, steps, passed=85):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = re.match("[^/?#]*", url.split("://", 1)[1])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[0])
        return host, re.match("[^?#]*", url.split("://", 1)[1][rest.end() :])[0]

    def rule(host, path):
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fit, key=lambda r: len(r[0] + r[1]), default=None)

    seeds, edges = {"allow": Counter(), "block": Counter()}, Counter()
    for _, url, html in pages:
        host, path = split(url)
        if r := rule(host, path):
            seeds[r[2]][host] += 1
        for b in {m.lower() for m in re.findall(link_graph.HREF, html or "")}:
            if host and b != host:
                edges[host, b] += 1
    scores = {}
    for kind, arcs in (("allow", edges), ("block", {(b, a): w for (a, b), w in edges.items()})):
        total, out = sum(seeds[kind].values()), Counter()
        for (a, _), w in arcs.items():
            out[a] += w
        seed = {h: link_graph.ONE * n // total for h, n in seeds[kind].items()}
        score = dict(seed)
        for _ in range(steps):
            new = Counter({h: s * (100 - passed) // 100 for h, s in seed.items()})
            for (a, b), w in arcs.items():
                if a in score:
                    new[b] += score[a] * w * passed // (out[a] * 100)
            score = new
        scores[kind] = score
    rows = []
    for page_id, url, _ in pages:
        host, path = split(url)
        r, t, d = rule(host, path), scores["allow"].get(host, 0), scores["block"].get(host, 0)
        rows.append((page_id, host, path, r[0] + r[1] if r else None, r[2] if r else ("block" if d > t else "allow"), t, d))
    return sorted(rows, key=str)


def test_judged_pages_equal_plain_propagation(spark):
    """Chains of links to trusted and blocked hosts, hubs, cycles, nulls, odd urls, links of all kinds, repeated pages, clashing columns."""
    rng = random.Random(3)
    hosts = [f"h{k}.{top}" for k in range(12) for top in ("com", "net", "org", "example.com", "www.example.com")]
    pages = [(i, f"HTTP://{rng.choice(hosts).upper()}{rng.choice(['', '/', '/en/1', '/es/2', '/fr/', '/En/x?y=/en/', '#/es/'])}", None) for i in range(300)]
    link = lambda: rng.choice(['<a href="https://{}/x">', "<A HREF='//{}'>", "<a class=b href=http://{}:80/>", '<a href="/own/{}">', "text {}"]).format(rng.choice(hosts).title())
    pages = [(i, url, "".join(link() for _ in range(rng.choice([0, 1, 4, 9])))) for i, url, _ in pages]
    pages += [(1, None, "<a href=https://h1.com>"), (None, "no scheme/en/", None), (7, "https://", ""), (8, "x://É.COM/é/", None), *pages[:20], (9, "a://b://c/en/", "<a href='x://y.org'>" * 50)]
    frame = spark.createDataFrame([(*p, "no", 1, 2) for p in pages], "page_id long, url string, html string, host string, seed int, trust int")
    got = sorted(map(tuple, link_graph.judge(frame).collect()), key=str)
    assert got == plain_judge(pages, link_graph.RULES, link_graph.STEPS)
    own = [r for r in got if r[3] is None]
    assert {r[4] for r in own} == {"allow", "block"} and any(r[5] and r[6] for r in own)


def test_rules_and_edges_of_rules(spark):
    urls = ["http://a.com/x", "http://xcom/en/", "http://com/", "http://a.com", "http://example.com/en/", "http://example.com/enx/", "http://sub.www.example.com/en/1", "http://www.example.com/de", "ftp://q.net/es/", "q.net/es/"]
    rows = link_graph.with_rules(spark.createDataFrame([(u,) for u in urls], "url string"), link_graph.RULES).collect()
    assert [r.rule for r in rows] == ["com/", None, "com/", None, "example.com/en/", "com/", "www.example.com/en/", "com/", "net/es/", None]
    assert [r.verdict for r in rows] == ["allow", None, "allow", None, "block", "allow", "allow", "allow", "block", None]


def test_no_pages_no_rules_and_rules_without_pages(spark):
    schema = "page_id long, url string, html string"
    assert link_graph.judge(spark.createDataFrame([], schema)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/es/", "<a href=http://b.org>"), (2, "http://b.org/", None)], schema)
    assert [r.verdict for r in link_graph.judge(pages, rules=()).collect()] == ["allow", "allow"]
    only_blocked = {r.page_id: (r.verdict, r.rule) for r in link_graph.judge(pages).collect()}
    assert only_blocked == {1: ("block", "net/es/"), 2: ("allow", None)}


def plain_audit(docs, min_df, top=10):
    lower = str.maketrans(link_graph.UPPER, link_graph.LOWER)
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang, source))
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, k in seen[lang].items() if k >= min_df]
        sums = lambda s: [sum(count[lang, x][t] for x in s) for t in kept]
        p_of = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        mates = [s for g, s in groups if g == lang]
        own = sums([source])
        p, q = p_of(own), p_of(sums(mates))
        pairs = [(-sum(map(f, p, p_of(sums([s])))), s.encode(), s) for s in mates if s != source]
        terms = [(-f(x, y), t.encode(), t) for x, y, n, t in zip(p, q, own, kept) if n and x > y]
        out += [(lang, source, "pair", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_audit_equals_plain_counts(spark, monkeypatch, block):
    """Groups of all sizes, one without terms, a lang without kept terms, nulls, case, digits, terms beyond ASCII, ties, repeated rows, a long text, clashing columns."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(11)
    words = ["the", "The", "ÉCOLE", "école", "日本", "x", "b2b", "naïve", "zz", *[f"w{chr(97 + k)}" for k in range(20)]]
    docs = [(" ".join(rng.choices(words, range(1, len(words) + 1), k=rng.choice([0, 3, 30]))), rng.choice(["en", "fr"]), f"s{rng.randrange(9) ** 2 // 9}") for _ in range(300)]
    docs += [("one two", "de", "s0"), ("three", "de", "s1"), (None, None, None), ("a " * 3, None, "s1"), ("12 34", "en", "no words"), ("the " * 60_000, "en", "s1"), *docs[:30], ("the", "fr", None)]
    frame = spark.createDataFrame([(*d, 1, "t", 2) for d in docs], "text string, lang string, source string, n int, terms string, doc_id long")
    got = sorted(map(tuple, divergence.audit(frame, min_df=10).collect()))
    assert got == plain_audit(docs, 10)
    assert {r[0] for r in got} == {"en", "fr", "de", ""} and any(r[0] == "de" and r[4] == 0 for r in got)


def test_audit_of_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_tiles_of_many_sources(monkeypatch):
    rng = np.random.default_rng(2)
    entries = pa.table({"term": pa.array([f"t{t}" for t in range(30) for _ in range(8)]), "no": np.concatenate([rng.choice(25, 8, False) for _ in range(30)]), "p": rng.integers(1, 10**9, 240)})
    groups = pa.table({"place": np.arange(25), "p0": rng.integers(1, 10**6, 25)})
    key = lambda tile: tuple(pa.scalar(x) for x in ("en", 0, tile))
    value = defaultdict(int)
    dense = np.repeat(groups["p0"].to_numpy()[:, None], 30, 1)
    dense[entries["no"].to_numpy(), np.repeat(np.arange(30), 8)] = entries["p"].to_numpy()
    f = lambda x, y: (x - y) ** 2 // (x + y)
    p0 = groups["p0"].to_numpy()
    for tiles, size in (([0], 1024), ([0, 1, 2], 10)):
        monkeypatch.setattr(divergence, "TILE", size)
        value.clear()
        for t in tiles:
            for r in divergence.block_sums(key(t), entries, groups).to_pylist():
                value[r["a"], r["b"]] += r["value"]
        for a in range(25):
            for b in range(a + 1, 25):
                assert value[a, b] == (f(dense[a], dense[b]) - f(p0[a], p0[b])).sum()
