"""The registered queries of this folder on the smallest tables, and the estimator of the toxicity classifier in dense form."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tapewright.llm import catalog, preference, toxicity, webp

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got, wanted = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    order = sorted(got.columns)
    rows = lambda f: sorted(map(str, f[order].astype(object).itertuples(index=False, name=None)))
    assert sorted(wanted.columns) == order and len(got) == len(wanted) > 0
    numbers = got.select_dtypes("number").columns
    assert np.allclose(got[numbers].sum(), wanted[numbers].sum())
    texts = [c for c in order if c not in numbers]
    if texts:
        order = texts
        assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_gives_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert not got.isna().any().any()


def test_media_columns_by_hand(spark):
    """Every column of the media query from the text and the stored bytes alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    stored = {r.doc_id: bytes(r.media) for r in webp.store(docs).collect()}
    got = {r.doc_id: r for r in webp.op4_lossless_webp(spark, SF).collect()}
    for doc_id, text in docs.collect():
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(stored[doc_id]), hashlib.sha256(stored[doc_id]).hexdigest())
        x = np.frombuffer(payload, np.uint8)
        bins = [int((x // 16 == k).sum()) * 255 // len(x) for k in range(16)]
        assert r.feature == f"{x.mean():.3f};{x.std():.3f};" + bytes(bins).hex()


def test_pixels_replace_columns_of_their_names(spark):
    media = webp.stored(pa.array(["x" * 700]))[0][0]
    files = spark.createDataFrame([(5, 6, "s", bytearray(media))], "width long, pixels int, sizes string, media binary")
    row = webp.pixels(files).first()
    assert (row.width, row.height, len(row.pixels)) == (576, 2, 1152)


def test_preference_keeps_other_columns_apart(spark):
    turns = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([([("user", "q")], [("user", "q"), ("assistant", "a")], 1, 2, 3, 4)], f"chosen {turns}, rejected {turns}, prompt int, n_common int, a int, _n int")
    out = preference.format_pairs(pairs)
    assert out.columns == ["a", "_n", *preference.OUTPUT]
    assert tuple(out.first()[:4]) == (3, 4, "<|user|>\nq<|end|>\n", 1)
    with pytest.raises(TypeError):
        preference.pairs_of(spark.createDataFrame([("null", 1, "user", "x")], "conv_id string, turn int, role string, text string"))


def test_nnpu_matches_a_dense_estimator():
    """Risk, correction where its clean part is negative, and the bias at the prior, written out over whole matrices."""
    rng = np.random.default_rng(3)
    n_p, n_u, d, prior, steps, rate, decay = 30, 80, 12, 0.4, 60, 0.1, 1e-3
    dense = rng.random((n_p + n_u, d)) * (rng.random((n_p + n_u, d)) < 0.4)
    dense[:n_p, 0] += 1.5  # stands out: the clean part goes below zero on the way
    dense[n_p : n_p + 35, 0] += 1.5
    sparse = [(np.flatnonzero(x).astype(np.int32) + 100, x[x > 0].astype(np.float32)) for x in dense]
    model = toxicity.nnpu(sparse[:n_p], sparse[n_p:], prior, steps, rate, decay)
    used = model.features - 100
    x = dense.astype(np.float32).astype(np.float64)[:, used]
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    loss = lambda f, y: np.log1p(np.exp(-f)) if y else np.log1p(np.exp(f))
    slope = lambda f, y: 1 / (1 + np.exp(-f)) - y
    turned = 0
    for t in range(1, steps + 1):
        f = x @ w + b
        p, u = f[:n_p], f[n_p:]
        clean = loss(u, 0).mean() - prior * loss(p, 0).mean()
        g_clean = (x[n_p:].T @ slope(u, 0) / n_u - prior * x[:n_p].T @ slope(p, 0) / n_p, slope(u, 0).mean() - prior * slope(p, 0).mean())
        g_toxic = (prior * x[:n_p].T @ slope(p, 1) / n_p, prior * slope(p, 1).mean())
        turned += clean < 0
        g, gb = (g_clean[0] + g_toxic[0], g_clean[1] + g_toxic[1]) if clean >= 0 else (-g_clean[0], -g_clean[1])
        g = g + decay * prior * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    assert turned > 0
    assert np.allclose(model.weights, w, atol=1e-4)
    assert abs((1 / (1 + np.exp(-(x[n_p:] @ model.weights + model.bias)))).mean() - prior) < 1e-6


def test_scores_of_texts_are_those_of_their_features(spark):
    texts = ["one two three two", None, "", "Ünder ÜNDER under"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, toxicity_score string")
    row, bucket, value = toxicity.features(pa.array(texts))
    names = np.unique(bucket)
    model = toxicity.Model(names, np.linspace(-1, 1, len(names)), -0.3)
    weight = dict(zip(names.tolist(), model.weights.tolist()))
    wanted = [1 / (1 + np.exp(0.3 - sum(weight[b] * v for r, b, v in zip(row.tolist(), bucket.tolist(), value.tolist()) if r == i))) for i in range(len(texts))]
    got = pd.DataFrame(toxicity.score(docs, model).collect(), columns=["doc_id", "text", "score"]).sort_values("doc_id")
    assert np.allclose(got["score"], wanted)


def test_a_share_of_a_hash_is_exact_however_small(spark):
    hashed = spark.createDataFrame([(-(1 << 63),), (-(1 << 63) + 10,), (0,), ((1 << 63) - 1,)], "h long")
    counts = [hashed.filter(toxicity.below(hashed.h, share)).count() for share in (1.0, 0.75, 0.5, 1e-12, 0.0)]
    assert counts == [4, 3, 2, 2, 0]


def test_tables_of_the_way_are_deleted(spark):
    import corpus_pipeline
    from tapewright.llm import common

    at = len(common.TABLES)
    rows = corpus_pipeline.run(spark, SF).count()
    assert rows > 0 and [t.rsplit("/", 1)[-1].rsplit("-", 1)[0] for t in common.TABLES[at:]] == ["stage-3"]


def test_mix_sql_on_empty_texts_of_stopped_sources(spark, tmp_path):
    """Sources that stop at whole copies: their empty texts are taken as often as the others, in the query and in its SQL."""
    from tapewright.llm import mixing

    rows = [(k, "a b c" if k % 10 < 5 else "", f"s{k // 10}") for k in range(30)] + [(90, None, None), (91, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.sql(mixing.ORACLE["op3_pareto_mix"]).df()
    got = mixing.op3_pareto_mix(spark, str(tmp_path)).toPandas()[wanted.columns]
    as_rows = lambda f: sorted(f.itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(wanted) and got["copies"].max() <= 2


def test_vocabularies_that_read_over_white_space_are_refused(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    from tapewright.llm import bpe, words

    found = Tokenizer.from_file(bpe.tokenizer_path())
    found.add_special_tokens([AddedToken("<|end of text|>")])
    found.save(str(tmp_path / "spaces.json"))
    with pytest.raises(ValueError, match="added tokens"):
        words.library(str(tmp_path / "spaces.json"))
    own = Tokenizer.from_file(bpe.tokenizer_path())
    own.add_special_tokens([AddedToken("[CLS]")])
    own.save(str(tmp_path / "upper.json"))
    table = words.WordTable(str(tmp_path / "upper.json"))
    text = "The [CLS] END. x[CLS]y"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert table.encode(raw, np.array([0, len(raw)]))[0].tolist() == own.encode(text, add_special_tokens=False).ids


def test_toxicity_query_never_sees_held_out_labels(spark, tmp_path):
    """Rows held out by the crc of their id, the verdict at 0.3, and the same scores whatever the labels of those rows, and other columns, say."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"
    kind = labels.schema["toxic"].dataType.simpleString()
    turned = labels.selectExpr("doc_id", f"cast(if({held}, 1 - cast(toxic as int), cast(toxic as int)) as {kind}) as toxic")
    docs.selectExpr("doc_id", "text", "'own' as source", "'own' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    assert turned.exceptAll(labels.select("doc_id", "toxic")).count() > 0
    got, other = (toxicity.op2_toxicity(spark, d).toPandas().sort_values("doc_id", ignore_index=True) for d in (SF, str(tmp_path)))
    assert np.allclose(got["score"], other["score"], atol=1e-6) and got["score"].between(0, 1).all() and got["score"].nunique() > 1
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    assert got["predicted"].tolist() == (got["score"] >= 0.3).astype(int).tolist()


def test_toxicity_model_is_fit_on_what_the_labels_say(spark):
    """The prior is the share of label 1 among labelled rows; features are those that stand out; without toxic rows, or without others, all scores are 0."""
    rows = [(i, f"plain words number{i} of a text" + (" awfulword" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    scores = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, model).collect()}
    assert abs(np.mean(list(scores.values())) - 0.2) < 0.02
    assert min(s for i, s in scores.items() if i % 5 == 0) > max(s for i, s in scores.items() if i % 5)
    own = set(np.unique(toxicity.features(pa.array(["awfulword"]))[1]).tolist())
    assert set(model.features.tolist()) <= own and len(model.features)
    for label in (0, 1):
        every = spark.createDataFrame([(i, label) for i in range(400)], "doc_id long, toxic int")
        assert toxicity.fit(docs, every) is None
    assert {r.toxicity_score for r in toxicity.score(docs, None).collect()} == {0.0}
