"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings learns from confirmed toxic texts and from texts without
labels. With the share of toxic texts (the class prior) known, the risk of calling unlabelled texts clean is corrected for the toxic ones among
them; where the corrected part falls below zero, the step goes the other way (non-negative estimator), which keeps the
model from fitting the unlabelled toxic texts as clean. The prior is the share of label 1 among the labelled rows.

Only the fit uses a bounded sample, of POSITIVES and UNLABELLED documents (parameters); every document is scored whole. The sample is drawn
among ids: texts are never shuffled to meet labels, the few ids drawn are broadcast against the documents, and their texts are written once.

Defined cases: null text is empty and has the score of the bias alone; labels that are null or whose document is missing
are left out; of several labels of a document, any 1 counts; a repeated row counts once in a sample; rows without an id are never drawn as
confirmed; without any confirmed toxic text all scores are 0; a column toxicity_score that is there already is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import crc_mod, drop_table, lean, read_table, running_hash, small_batches, span_hashes, text_bytes, word_spans, written

POSITIVES, UNLABELLED = 3000, 12000
DIMENSIONS = 1 << 18
LEAST_POSITIVES = 3  # confirmed toxic texts that a feature must be in
STANDS_OUT = 5.0  # standard errors by which its share among them must exceed that among unlabelled texts
BEGINNINGS = (4, 6)  # bytes of a word's beginning that are features too
THRESHOLD = 0.3
STEPS, RATE, DECAY = 300, 0.05, 1e-3

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted bucket numbers
    weights: np.ndarray
    bias: float


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin letters that UTF-8 writes with the lead byte C3."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
    out[second] += 32
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the distinct features of a batch, by row: of each the log of its number and its share of the words."""
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    starts, stops, bounds = word_spans(raw, offsets, _LETTERS)
    sums = running_hash(lowered(raw), np.arange(256, dtype=np.uint8))
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(bounds))
    keys = [row * np.uint64(DIMENSIONS) + span_hashes(sums, starts, stops) % np.uint64(DIMENSIONS)]
    for k in BEGINNINGS:
        long = stops - starts > k
        some = span_hashes(sums, starts[long], starts[long] + k) + np.uint64(k)
        keys.append(row[long] * np.uint64(DIMENSIONS) + some % np.uint64(DIMENSIONS))
    found, count = np.unique(np.concatenate(keys), return_counts=True)
    row, bucket = (found // DIMENSIONS).astype(np.int64), (found % DIMENSIONS).astype(np.int64)
    rate = np.minimum(1, count * 50 / np.maximum(50, np.diff(bounds))[row])
    both = np.stack([np.log1p(count), rate], 1).astype(np.float32).ravel()
    return np.repeat(row, 2), np.stack([bucket, bucket + DIMENSIONS], 1).ravel(), both


def spread(docs: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a bounded sample that are in at least so many of its texts, and in how many: at most 2 * DIMENSIONS come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            bucket, n = np.unique(features(batch.column("text"))[1], return_counts=True)
            yield pa.record_batch([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    counts = docs.mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = counts.toArrow().sort_by("bucket")
    return found.column("bucket").to_numpy(), found.column("n").to_numpy()


def gathered(docs: DataFrame, within: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of a bounded sample, a pair of arrays for each text; only those in within, few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            row, bucket, value = features(batch.column("text"))
            kept = np.isin(bucket, within)
            row, bucket, value = row[kept], bucket[kept], value[kept]
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            yield pa.record_batch([pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()) for x in (bucket.astype("<i4"), value.astype("<f4"))], ["bucket", "value"])

    rows = docs.mapInArrow(lean(run), "bucket binary, value binary").collect()  # at most POSITIVES or UNLABELLED
    return [(np.frombuffer(r[0], "<i4"), np.frombuffer(r[1], "<f4")) for r in rows]


def below(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash falls into this share of all values: exact however small the share is."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(math.floor((2 * share - 1) * 2.0**63)))


def drawn(docs: DataFrame, ids: DataFrame | None, n: int, most: int, salt: str) -> DataFrame:
    """Written texts of about most of the rows of docs (doc_id, text) whose id is among ids (id; all rows for None), of which there are n.

    Ids are drawn by their hash. Where one id stands on so many rows that far more come out, rows are drawn by id and text from those."""
    share = min(1.0, most / max(n, 1))
    if ids is None:
        rows = docs.filter(below(F.xxhash64(F.lit(salt), "doc_id"), share))
    else:
        few = ids.filter(below(F.xxhash64(F.lit(salt), "id"), share)).distinct()  # about most at the most
        rows = docs.join(F.broadcast(few), F.col("doc_id") == F.col("id"), "left_semi")
    n_rows = rows.count()
    if n_rows > 2 * most:
        rows = rows.filter(below(F.xxhash64(F.lit(salt + " row"), "doc_id", "text"), most / n_rows))
    return written(rows.dropDuplicates(["doc_id", "text"]).select("text"), "sample")


def nnpu(positive: list, unlabelled: list, prior: float, steps=STEPS, rate=RATE, decay=DECAY) -> Model:
    """Minimises prior * E_p[l(f, 1)] + max(0, E_u[l(f, 0)] - prior * E_p[l(f, 0)]) with the logistic loss."""
    names, code = np.unique(np.concatenate([b for b, _ in positive + unlabelled] or [np.zeros(0, np.int32)]), return_inverse=True)
    value = np.concatenate([v for _, v in positive + unlabelled] or [np.zeros(0, np.float32)])
    n_p, n_u = len(positive), len(unlabelled)
    row = np.repeat(np.arange(n_p + n_u), [len(b) for b, _ in positive + unlabelled])
    weights, bias = np.zeros(len(names)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, steps + 1):
        score = bias + np.bincount(row, weights[code] * value, n_p + n_u)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        as_clean = np.logaddexp(0, score)
        negative_part = as_clean[n_p:].mean() - prior * as_clean[:n_p].mean()
        slope = np.concatenate([-prior * p[:n_p] / n_p, p[n_p:] / n_u])  # of the negative part
        if negative_part >= 0:
            slope[:n_p] += prior * (p[:n_p] - 1) / n_p
        else:
            slope = -slope
        g, gb = np.bincount(code, slope[row] * value, len(names)) + decay * prior * weights, slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        weights -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    # The mean probability over unlabelled texts is the prior: holds the bias where the estimator's last steps have moved it.
    score = np.bincount(row, weights[code] * value, n_p + n_u)[n_p:]
    low, high = -40.0, 40.0
    for _ in range(60):
        bias = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(score + bias, -30, 30)))).mean() > prior:
            high = bias
        else:
            low = bias
    return Model(names, weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", positives=POSITIVES, unlabelled=UNLABELLED) -> Model | None:
    """docs: the rows to learn from. labels: (doc_id, toxic). None without confirmed toxic texts or without others: then every score is 0."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))  # ids alone are shuffled
    joined = ids.join(known, F.col("doc_id") == F.col("id"), "left")
    n, n_known, n_toxic = joined.agg(F.sum("rows"), F.sum(F.when(F.col("toxic").isNotNull(), F.col("rows"))), F.sum(F.col("toxic") * F.col("rows"))).first()
    if not n_toxic or n_toxic == n:
        return None
    prior = min(max(n_toxic / n_known, 1e-4), 0.9)
    confirmed = drawn(rows, joined.filter("toxic = 1").select("id"), n_toxic, positives, "positive")
    others = drawn(rows, None, n, unlabelled, "unlabelled")
    model = None
    if (n_confirmed := confirmed.count()) and (n_others := others.count()):
        # features that stand out among the confirmed texts: the shares of texts with them differ by more than chance allows
        within, times = spread(confirmed, LEAST_POSITIVES)
        every, among = spread(others, 1)
        share_u = np.zeros(len(within))
        share_u[np.isin(within, every)] = among[np.isin(every, within)] / n_others
        within = within[times / n_confirmed - share_u > STANDS_OUT * np.sqrt(np.maximum(share_u, 1 / n_others) / n_confirmed)]
        model = nnpu(gathered(confirmed, within), gathered(others, within), prior)
    drop_table(confirmed), drop_table(others)
    return model


def score(docs: DataFrame, model: Model | None, text="text") -> DataFrame:
    """docs with toxicity_score, in 0 to 1, of every whole text."""
    docs = docs.drop("toxicity_score")
    names = docs.columns
    schema = docs.withColumn("toxicity_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(2 * DIMENSIONS)
        if model is not None:
            weights[model.features] = model.weights
        for batch in small_batches(batches, text):
            sums = np.full(batch.num_rows, -np.inf)
            if model is not None:
                row, bucket, value = features(batch.column(names.index(text)).cast(pa.string()))
                sums = model.bias + np.bincount(row, weights[bucket] * value, batch.num_rows)
            out = 1 / (1 + np.exp(-np.clip(sums, -50, 50))) if model is not None else np.zeros(batch.num_rows)
            yield pa.record_batch([*batch.columns, pa.array(out)], [*names, "toxicity_score"])

    return docs.mapInArrow(lean(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs.filter(~held_out), labels.filter(~held_out))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with the columns of docs."""
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs.select("doc_id", "text").filter(~held_out), labels.select("doc_id", "toxic").filter(~held_out))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("text").cast("string").alias("text"))
    return score(rows, model).filter(F.col("toxicity_score") < threshold).select("whole.*")


QUERIES = {"op2_toxicity": op2_toxicity}
