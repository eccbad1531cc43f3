"""The native operators against plain versions, and the pipeline against one made of brute-force stages."""

import re
from collections import Counter

import corpus_pipeline

from tapewright.llm import preference, toxicity

SF = "/root/testdata/sf0.001"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        head, end = at + len(r) + 5, at + len(r) + 5 + len(t) + 8
        if r == "assistant":
            out.append((head, end))
        at = end
    return out


def test_preference_pairs(spark):
    turn = lambda *x: list(x)
    rows = [
        (1, turn(("user", "hi"), ("assistant", "a")), turn(("user", "hi"), ("assistant", "b"), ("user", "c")), 7),
        (2, turn(("user", "x"),), turn(("user", "x"),), 7),
        (3, [], turn(("assistant", "é😀")), 7),
        (4, None, None, 7),
        (5, turn((None, None), ("assistant", None)), turn(("", ""), ("assistant", "z" * 50_000)), 7),
        (6, turn(("user", "same"), ("user", "other")), turn(("system", "same")), 7),
    ]
    kind = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}, prompt_size int")
    got = {r.pair_id: r for r in preference.format_pairs(pairs).collect()}
    for key, a, b, _ in rows:
        a, b = ([(r or "", t or "") for r, t in x or []] for x in (a, b))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        r = got[key]
        assert (r.prompt, r.n_common, r.chosen, r.rejected) == (render(a[:n]), n, render(a[n:]), render(b[n:]))
        assert [tuple(s) for s in r.chosen_mask] == spans(a[n:]) and [tuple(s) for s in r.rejected_mask] == spans(b[n:])
        assert all(r.rejected[s:e].endswith("<|end|>\n") for s, e in r.rejected_mask)


def test_preference_pairs_from_a_table(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "p"), (1, 1, "assistant", "a1"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (2, 1, "assistant", "x"), (5, None, None, None), (None, 0, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as chosen", "2 as turns")
    got = {r.conv_id: r for r in preference.pairs_of(turns).collect()}
    text = lambda x: [(t.role, t.text) for t in x]
    assert text(got[0].rejected) == [("user", "q"), ("assistant", "a1")] and text(got[1].rejected)[-1] == ("assistant", "a0")
    assert text(got[2].rejected) == [("user", "alone")] and text(got[5].chosen) == [("", "")] and text(got[None].chosen) == [("user", "u")]
    assert preference.pairs_of(turns.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    states, own = [docs], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, SF).cache()
        assert own.columns == columns, name
        states.append(own)
    rows = [[r.asDict() for r in s.collect()] for s in states]
    clean, apart, cut, mixed = rows[1:]

    scores = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, toxicity.fit(*[x.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2") for x in (docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))])).collect()}
    assert Counter(r["doc_id"] for r in clean) == Counter(i for i, s in scores.items() if s < toxicity.THRESHOLD)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        return frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1 if w else 0)))

    sets = {r["doc_id"]: shingles(r["text"]) for r in clean}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if label[j] < label[i] and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                    label[i], changed = label[j], True
    assert sorted(r["doc_id"] for r in apart) == sorted(i for i, k in label.items() if i == k)

    data = {r["doc_id"]: r["text"].encode() for r in apart}
    seen = Counter(x[j : j + 200] for x in data.values() for j in range(len(x) - 199))
    for r in cut:
        x, gone = data[r["doc_id"]], set()
        for j in range(len(x) - 199):
            if seen[x[j : j + 200]] > 1:
                gone.update(range(j, j + 200))
        assert r["text"] == bytes(c for j, c in enumerate(x) if j not in gone).decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])

    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in cut} and max(times.values()) <= 2
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == times


def test_pipeline_of_nulls_clashes_and_nothing(spark, tmp_path):
    """Rows without an id, a text or a source, and columns named as those of the operators: the stages run, no id is made up; an empty table gives none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.limit(1).selectExpr(*[f"cast(null as {t}) as {c}" for c, t in docs.dtypes])
    clashing = lambda rows: rows.selectExpr("*", "'x' as label", "1 as size", "2 as copies", "3 as key")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in (("some", docs.unionByName(odd)), ("none", docs.limit(0))):
        clashing(rows).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    own = clashing(docs.unionByName(odd))
    assert corpus_pipeline.drop_toxic(spark, own, f"{tmp_path}/some").columns == own.columns
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    assert got and {r.doc_id for r in got} <= known | {None} and all(r.n_tokens == len(r.ids) for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
