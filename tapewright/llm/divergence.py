"""Source divergence audit: how far the sources of a language are from each other in their words, and which words tell a source from its language.

Terms are runs of letters (A-Z lower-cased) and of any characters beyond ASCII. For each language a CountVectorizer with minDF and the largest
vocabSize fits the vocabulary and makes an exact sparse vector of each document; vectors are summed by source, as a Summarizer does, but in integers: entries meet in a
partial sum of their task, then by (source, term). A pair of sources is evaluated on the terms that either has: the terms of a language are cut into blocks, a task
compares the sparse rows of a block, what two sources lack together is one value times its number, and the blocks' sums are added up. All values are integers.

The texts are cut into terms once and written by language, so that each fit reads its own rows. A vocabulary is with the driver and with each
executor for its language's time, as a CountVectorizer has it: the terms that stand in at least min_df documents, whatever the number of documents is. Languages
are taken one after the other: they should be few.

Defined cases: a null text, lang or source is an empty one; a text without terms counts as a document of its group; a lang without kept terms gives pairs of
value 0 and no terms; a lang of one source gives no pairs; equal values are ranked by item; repeated rows count each; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import LOWER, drop_path, lean, read_table, shared_dir, small_batches, text_bytes, word_spans, written

MIN_DF = 10
TOP_TERMS = 10
#: The largest vocabulary that CountVectorizer takes.
MOST_TERMS = 2**31 - 1
#: Sums that a task holds at once.
SUMS_KEPT = 1 << 22
#: Entries (source, term) of a block of terms, about.
BLOCK = 1 << 17
#: Sources whose pairs a task sums up at once.
TILE = 1024
ONE = 10**9
NO_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())]).empty_table()
#: Bytes of a term: letters and everything beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True


def terms_of(texts: pa.Array) -> pa.Array:
    """The terms of each text, in order."""
    raw, offsets = text_bytes(texts)
    starts, stops, bounds = word_spans(raw, offsets, INSIDE)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=at[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(LOWER[raw[INSIDE[raw]]]))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words)


def with_terms(docs: DataFrame) -> DataFrame:
    """(tag, lang, source, terms) of docs (text, lang, source); the tag of a lang is its hash, a name for a folder."""

    def run(batches):
        for batch in small_batches(batches):
            yield pa.record_batch([batch.column("lang"), batch.column("source"), terms_of(batch.column("text"))], ["lang", "source", "terms"])

    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return rows.mapInArrow(lean(run), "lang string, source string, terms array<string>").select(F.sha2("lang", 256).alias("tag"), "lang", "source", "terms")


def written_by_lang(terms: DataFrame) -> tuple[DataFrame, str]:
    """terms as a table with a folder for each lang, and its path."""
    path = f"{shared_dir(terms.sparkSession)}/terms-{uuid.uuid4().hex}"
    terms.write.partitionBy("tag").option("compression", "snappy").parquet(path)  # read twice: cheap to decode
    return terms.sparkSession.read.schema(terms.schema).parquet(path), path


def fitted(terms: DataFrame, min_df: int = MIN_DF) -> CountVectorizerModel | None:
    """The vocabulary of the rows (terms); None if no term stands in so many of them."""
    try:
        return CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=MOST_TERMS).fit(terms)
    except IllegalArgumentException as error:
        if "vocabulary size" not in str(error):
            raise
        return None


def vector_sums(vectors: DataFrame, key: str) -> DataFrame:
    """(key, place, n): the sums of sparse vectors of whole numbers by key, as a row per entry.

    A task adds its vectors up in an array for each key, and hands them on once they take SUMS_KEPT numbers."""

    def flush(sums: dict):
        for name, total in sums.items():
            place = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(place), pa.string()), pa.array(place.astype(np.int32)), pa.array(total[place])], [key, "place", "n"])
        sums.clear()

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(key).dictionary_encode()
            places, size = batch.column("indices"), batch.column("size")[0].as_py()
            codes = np.repeat(names.indices.to_numpy(), np.diff(places.offsets.to_numpy()))
            at, n = places.flatten().to_numpy(), batch.column("values").flatten().to_numpy().astype(np.int64)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
            for code, name in enumerate(names.dictionary.to_pylist()):
                if name not in sums:
                    if (len(sums) + 1) * size > SUMS_KEPT:
                        yield from flush(sums)
                    sums[name] = np.zeros(size, np.int64)
                own = order[bounds[code] : bounds[code + 1]]
                np.add.at(sums[name], at[own], n[own])
        yield from flush(sums)

    sparse = vectors.select(key, F.unwrap_udt("vector").alias("v")).select(key, "v.size", "v.indices", "v.values")
    return sparse.mapInArrow(lean(run), f"{key} string, place int, n long").groupBy(key, "place").agg(F.sum("n").alias("n"))


def vocabulary(model: CountVectorizerModel, spark: SparkSession) -> DataFrame:
    """(place, term), as the model is stored: the terms don't pass through the driver's Python."""
    path = f"{shared_dir(spark)}/vocabulary-{uuid.uuid4().hex}"
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("place", "term"))


def counted(docs: DataFrame, min_df: int = MIN_DF) -> tuple[DataFrame, DataFrame]:
    """Of docs (text, lang, source): (lang, source, term, n) for all kept terms that a group has, and (lang, source) of all groups."""
    spark = docs.sparkSession
    terms, path = written_by_lang(with_terms(docs))
    groups = written(terms.select("lang", "source").distinct(), "groups")
    parts = [spark.createDataFrame([], "lang string, source string, term string, n long")]
    for tag, lang in groups.select(F.sha2("lang", 256), "lang").distinct().sort("lang").collect():
        rows = terms.filter(F.col("tag") == tag).select("source", "terms")
        if model := fitted(rows, min_df):
            sums = vector_sums(model.transform(rows), "source").join(vocabulary(model, spark), "place")
            parts.append(written(sums.select(F.lit(lang).alias("lang"), "source", "term", "n"), "term-sums"))
    drop_path(spark, path)
    return reduce(DataFrame.unionByName, parts), groups


def likelihood(n, of) -> Column:
    """1 + floor(ONE * (n + 2) / of), exactly."""
    return F.lit(1).cast("long") + F.expr(f"CAST({ONE} AS DECIMAL(10)) * CAST({n} + 2 AS DECIMAL(19)) div CAST({of} AS DECIMAL(19))")


def distance(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def with_sizes(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """groups with no (place in its lang), n_terms (that it has), kept (V) and of (N + 2 V), and the sources and entries of its lang."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("n_terms"))
    langs = counts.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("k")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("k").alias("entries"))
    numbered = groups.withColumn("no", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    rows = numbered.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(sources, "lang").na.fill(0)
    return rows.withColumn("of", F.col("N") + 2 * F.col("kept")).drop("N")


def block_sums(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Of a block of terms: for sources a of the tile and all others b what the terms of a add to a pair over two absent terms: (lang, a, b, value).

    entries: term, no, p of the terms' sources. groups: place (no) and p0 (of an absent term) of all sources of the lang."""
    lang, _, tile = (k.as_py() for k in key)
    n = groups.num_rows
    absent = np.empty(n, np.int64)
    absent[groups["place"].to_numpy()] = groups["p0"].to_numpy()
    _, term = np.unique(entries["term"].combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
    order = np.argsort(term, kind="stable")
    term, no, p = term[order], entries["no"].to_numpy()[order], entries["p"].to_numpy()[order]
    bounds = np.concatenate([np.searchsorted(term, np.arange(term[-1] + 1)), [len(term)]])
    by_source = np.argsort(no, kind="stable")
    own = np.searchsorted(no[by_source], np.arange(n + 1))
    f = lambda x, y: (x - y) * (x - y) // (x + y)
    found = []
    for a in range(tile * TILE, min(n, tile * TILE + TILE)):
        rows = by_source[own[a] : own[a + 1]]
        if not len(rows):
            continue
        values, times = np.unique(p[rows], return_counts=True)
        sums = np.zeros(n, np.int64)
        for at in range(0, len(values), max(1, (1 << 20) // n)):  # a has the term, b has not
            v = values[at : at + max(1, (1 << 20) // n), None]
            sums += ((f(v, absent) - f(absent[a], absent)) * times[at : at + len(v), None]).sum(0)
        lows, sizes = bounds[term[rows]], np.diff(bounds)[term[rows]]
        each = np.repeat(np.arange(len(rows)), sizes)
        shared = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lows[each]
        b = no[shared]
        x, y = p[rows][each][b > a], p[shared][b > a]  # both have it; the pair comes from its lesser source
        b = b[b > a]
        np.add.at(sums, b, f(x, y) - f(x, absent[b]) - f(absent[a], y) + f(absent[a], absent[b]))
        sums[a] = 0
        others = np.flatnonzero(sums)
        found.append((np.minimum(others, a), np.maximum(others, a), sums[others]))
    a, b, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a.astype(np.int32), "b": b.astype(np.int32), "value": value.astype(np.int64)})


def pair_values(sized: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, other, value) of all ordered pairs of sources of a lang."""
    p = counts.join(sized.select("lang", "source", "no", "of", "sources", "entries"), ["lang", "source"])
    blocks = F.expr(f"(entries + {BLOCK - 1}) div {BLOCK}")
    tiles = F.explode(F.sequence(F.lit(0), F.expr(f"(sources - 1) div {TILE}").cast("int"))).alias("tile")
    left = p.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "term", "no", likelihood("n", "of").alias("p"), tiles)
    some = sized.filter("kept > 0")
    right = some.select("lang", F.col("no").alias("place"), likelihood("0", "of").alias("p0"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "sources").select("lang", "block", "place", "p0", tiles)
    key = ["lang", "block", "tile"]
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda k, x, y: block_sums(k, x, y) if x.num_rows else NO_SUMS, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    side = lambda c, n: sized.select("lang", F.col("source").alias(c), F.col("no").alias(n), "kept", F.when(F.col("kept") > 0, likelihood("0", "of")).alias(f"p_{n}"))
    pairs = side("source", "a").join(side("other", "b").drop("kept"), "lang").filter("a <> b")  # the rows of the result
    pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(sums.withColumnsRenamed({"a": "lo", "b": "hi"}), ["lang", "lo", "hi"], "left")
    value = F.coalesce(F.col("kept") * distance("p_a", "p_b"), F.lit(0)) + F.coalesce("more", F.lit(0))
    return pairs.select("lang", "source", "other", value.cast("long").alias("value"))


def telling_terms(sized: DataFrame, counts: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, term, value, rank) of the terms that a source has more than its lang, by distance."""
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    of = whole.groupBy("lang").agg((F.sum("all") + 2 * F.count(F.lit(1))).alias("of_all"))
    q = whole.join(of, "lang").select("lang", "term", likelihood("all", "of_all").alias("q"))
    p = counts.join(sized.select("lang", "source", "of"), ["lang", "source"]).select("lang", "source", "term", likelihood("n", "of").alias("p"))
    rows = p.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", "term", distance("p", "q").alias("value"))
    return ranked(rows, "term").filter(F.col("rank") <= top)


def ranked(rows: DataFrame, item: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), item)))


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has a row for each other source of the lang, part `term` the source's most telling terms."""
    counts, groups = counted(docs, min_df)
    sized = written(with_sizes(groups, counts), "sizes")
    pairs, terms = ranked(pair_values(sized, counts), "other"), telling_terms(sized, counts, top)
    part = lambda rows, name, item: rows.select("lang", "source", F.lit(name).alias("part"), F.col(item).alias("item"), "value", "rank")
    return part(pairs, "pair", "other").unionByName(part(terms, "term", "term"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}

ORACLE = {
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
size AS (SELECT g.lang, g.source, v.v, coalesce(sum(c.n), 0) + 2 * v.v AS size FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2, 3, v.v),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // s.size AS p FROM size s JOIN kept k ON s.lang = k.lang
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q FROM kept k JOIN v ON k.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
}
