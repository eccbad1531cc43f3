"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words; a document's expected copies are its weight times a factor of its source, so chosen that the expected
words meet the target. Their whole part are certain copies; the rest is the document's inclusion probability. Documents are
ranked by their random odds divided by their inclusion odds; a source takes the lowest ranks until its target of words is met. Without weights
the factor is target / source size, one chance for all documents of a source.

Only DataFrame operations: one pass sizes the documents, the rest works on (id, source, size). The running sum of sizes
in rank order is taken over slices of the ranking first, so that no task orders a whole source; a source met by whole copies alone has no cut.

Defined cases: null or empty text has size 0 and is taken as its rank says, adding no words; a null source is a source,
last in order; a null id counts as an empty one; repeated rows count each and have one random number; an empty table gives no row; a
source without words has target 0; a weight that is null or not positive is 0: such a document is never taken, and a source's target is
met as far as max_copies of the others allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import drop_table, read_table, written

WEIGHTS = (3, 1, 2)  # fixed values of the production mix, repeating over the sources in code point order
SHARE = 1.5
SEED = "mix"
MAX_COPIES = 2
SLICE_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 20_000


def random_number(seed: str) -> Column:
    """Uniform in (0, 1), from the id and the text's digest: reruns agree, and rows that share an id, or have none, are spread."""
    own = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("tie"))
    return (F.conv(F.substring(F.md5(own.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """Per source: rows, size and target. A target above max_copies times the size stops there and the excess goes to the others by weight.

    With the sources ordered by limit / weight the stopped ones come first: one ordered pass over the few source rows finds them."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(max_copies))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stopped", F.col("most") * F.col("left_weight") <= F.col("left") * F.col("weight"))
        .withColumn("rest", F.min(F.when(~F.col("stopped"), F.struct((-F.col("left_weight")).alias("o"), "left", "left_weight"))).over(every))
    )
    target = F.when(F.col("stopped"), F.col("most")).otherwise(F.col("weight") * F.col("rest.left") / F.col("rest.left_weight"))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


MOST_FITS = 40  # rounds in which a source's factor is found where documents stop at max_copies


def with_factors(sizes: DataFrame, per: DataFrame, max_copies: float) -> DataFrame:
    """per with each source's factor: the sum of min(max_copies, factor * weight) * size is its target. One small aggregate a round:
    documents that a factor stops at max_copies stay stopped as it grows."""
    per = written(per.withColumn("factor", F.lit(0.0)), "mix-factors")
    few = per.count() <= BROADCAST_SOURCES
    for _ in range(MOST_FITS):
        own = per.select("its_source", "target", "factor")
        rows = sizes.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("its_source")))
        stopped = F.col("factor") * F.col("weight") >= max_copies
        sums = rows.groupBy("source").agg(
            F.sum(F.when(stopped, F.col("size") * float(max_copies)).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("size") * F.col("weight"))).alias("free"),
        )
        nxt = F.greatest(F.col("factor"), F.coalesce(F.try_divide(F.col("target") - F.col("fixed"), F.col("free")), F.col("factor")))
        after = per.join(sums, F.col("its_source").eqNullSafe(F.col("source")), "left").select(*[c for c in per.columns if c != "factor"], nxt.alias("factor"), F.col("factor").alias("old"))
        after = written(after, "mix-factors")
        same = after.filter(F.col("factor") > F.col("old") * (1 + 1e-12)).isEmpty()
        drop_table(per)
        per = after.drop("old")
        if same:
            break
    return per


def with_ranks(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, ...) with their source's figures, certain copies, place in Pareto order and slice of it."""
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    if "factor" in per.columns:
        rate = F.least(F.col("factor") * F.col("weight"), F.col("max_copies"))
    u = random_number(SEED)
    odds = F.try_divide(u / (1 - u), F.col("chance") / (1 - F.col("chance")))
    return (
        rows.join(per, F.col("source").eqNullSafe(F.col("its_source")), "left")
        .withColumn("certain", F.floor(rate))
        .withColumn("chance", rate - F.col("certain"))
        .withColumn("wanted", F.col("expected") if "factor" in per.columns else F.col("target") - F.col("certain") * F.col("source_size"))
        .withColumn("never", (F.col("chance") == 0) & (F.lit("factor" in per.columns) | (F.col("source_size") > 0)))  # beyond its certain copies
        .withColumn("order", F.coalesce(odds / (1 + odds), F.lit(1.0)))
        .withColumn("slices", F.ceil(F.col("n_docs") / SLICE_ROWS))
        .withColumn("slice", F.least(F.floor(F.col("order") * F.col("slices")), F.col("slices") - 1))
    )


def mix_plan(sizes: DataFrame, max_copies=MAX_COPIES, **targets) -> DataFrame:
    """Per source: size, target, and the slice of the Pareto order in which its target is reached with the words before it.

    A table with a row for each source; joined by broadcast only while its counted rows are few."""
    per = written(source_targets(sizes, max_copies=max_copies, **targets).withColumnRenamed("source", "its_source"), "mix-targets")
    few = per.count() <= BROADCAST_SOURCES
    if "weight" in sizes.columns:
        per = with_factors(sizes, per, max_copies).withColumns({"max_copies": F.lit(float(max_copies)), "expected": F.lit(0.0)})
        left = with_ranks(sizes, F.broadcast(per) if few else per).groupBy(F.col("its_source").alias("source")).agg(F.sum(F.col("chance") * F.col("size")).alias("left"))
        per = per.drop("expected").join(left, F.col("its_source").eqNullSafe(F.col("source")), "left").withColumn("expected", F.coalesce("left", F.lit(0.0))).drop("source", "left")
        per = written(per, "mix-factors")
    ranked = with_ranks(sizes, F.broadcast(per) if few else per).filter("chance > 0")  # whole copies only: nothing to cut
    sums = ranked.groupBy("its_source", "slice").agg(F.sum("size").alias("words"), F.max("wanted").alias("wanted"))
    upto = F.sum("words").over(Window.partitionBy("its_source").orderBy("slice"))
    cut = (
        sums.withColumn("upto", upto)
        .filter(F.col("upto") > F.col("wanted"))
        .groupBy("its_source")
        .agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
        .select(F.col("its_source").alias("cut_source"), F.col("cut.slice").alias("cut_slice"), F.col("cut.before").alias("before"))
    )
    plan = written(per.join(cut, F.col("its_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "mix-plan")
    return F.broadcast(plan) if few else plan


def copies(rows: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """rows (doc_id, source, size and those of keep) with source_size, target and copies."""
    ranked = with_ranks(rows, plan)
    at_cut = F.coalesce(F.col("slice") == F.col("cut_slice"), F.lit(False)) & ~F.col("never")
    below = F.col("cut_slice").isNull() | (F.col("slice") < F.col("cut_slice"))
    plain = ranked.filter(~at_cut).withColumn("more", (~F.col("never") & below).cast("int"))

    # In the slice that the cut falls into: the ranks that fit, then the one document nearest to what is left, if it helps.
    of = Window.partitionBy("its_source")
    left = F.col("wanted") - F.col("before")
    gap = F.abs(F.col("size") - F.col("left"))
    edge = (
        ranked.filter(at_cut)
        .withColumn("sum", F.sum("size").over(of.orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("fits", F.col("sum") <= left)
        .withColumn("left", left - F.coalesce(F.max(F.when(F.col("fits"), F.col("sum"))).over(of), F.lit(0)))
        .withColumn("nth", F.row_number().over(Window.partitionBy("its_source", "fits").orderBy(gap, "order", "doc_id", "size")))
        .withColumn("more", (F.col("fits") | ((F.col("nth") == 1) & (gap < F.col("left")))).cast("int"))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "certain", "more", *keep]
    both = plain.select(*columns).unionByName(edge.select(*columns))
    return both.withColumn("copies", (F.col("certain") + F.col("more")).cast("long")).drop("certain", "more")


def word_count(text: str):
    return F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame, text: str, doc_id: str, source: str, weight: str | None) -> list[Column]:
    tie = F.substring(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")), 1, 16)
    own = [F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), tie.alias("tie")]
    return own if weight is None else [*own, F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")]


def mix(docs: DataFrame, text="text", doc_id="doc_id", source="source", weight: str | None = None, **targets) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies and taken = copies * size. weight: a column of relative inclusion chances within a source."""
    sizes = written(docs.select(*sized(docs, text, doc_id, source, weight)), "mix-sizes")
    out = copies(sizes, mix_plan(sizes, **targets), [])
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text="text", doc_id="doc_id", source="source", weight: str | None = None, **targets) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with all its columns. Texts are not shuffled, but for those at a cut."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(*sized(docs, text, doc_id, source, weight), whole)
    sizes = written(rows.drop("whole"), "mix-sizes")
    taken = copies(rows, mix_plan(sizes, **targets), ["whole"]).filter("copies > 0")
    return taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_pareto_mix": op3_pareto_mix}

ORACLE = {
    "op3_pareto_mix": """
WITH d AS (SELECT doc_id, source, substr(md5(coalesce(text, '')), 1, 16) AS tie, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
p AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
  source_size * 2.0::DOUBLE AS most FROM p),
l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest_weight
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, most * rest_weight <= rest * weight AS stopped FROM l),
t AS (SELECT *, CASE WHEN stopped THEN most ELSE weight * arg_max(CASE WHEN NOT stopped THEN rest END, CASE WHEN NOT stopped THEN rest_weight END) OVER ()
   / max(CASE WHEN NOT stopped THEN rest_weight END) OVER () END AS target FROM s),
r AS (SELECT d.doc_id, d.source, d.size, t.n_docs, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  (CAST('0x' || substr(md5('mix' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '/' || d.tie), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(rate) AS certain, rate - floor(rate) AS chance, target - floor(rate) * source_size AS wanted FROM r),
o AS (SELECT *, CASE WHEN chance > 0 THEN ((u / (1 - u)) / (chance / (1 - chance))) / (1 + ((u / (1 - u)) / (chance / (1 - chance)))) ELSE 1.0 END AS pos,
  ceil(n_docs / 4096.0::DOUBLE) AS slices FROM q),
c AS (SELECT *, least(floor(pos * slices), slices - 1) AS slice, chance = 0 AND source_size > 0 AS never FROM o),
b AS (SELECT source, slice, sum(size) AS words, max(wanted) AS wanted FROM c WHERE chance > 0 GROUP BY source, slice),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY slice) AS upto FROM b),
k AS (SELECT source, min(slice) AS cut_slice, arg_min(upto - words, slice) AS before FROM u WHERE upto > wanted GROUP BY source),
m AS (SELECT c.*, k.cut_slice, k.before FROM c LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source),
e AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM m WHERE slice = cut_slice AND NOT never),
f AS (SELECT *, cum <= wanted - before AS fits FROM e),
g AS (SELECT *, wanted - before - coalesce(max(CASE WHEN fits THEN cum END) OVER (PARTITION BY source), 0) AS lacking FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - lacking), pos, doc_id, size) AS nth FROM g),
z AS (SELECT doc_id, size, source_size, target, certain + CASE WHEN fits OR (nth = 1 AND abs(size - lacking) < lacking) THEN 1 ELSE 0 END AS copies FROM h
 UNION ALL SELECT doc_id, size, source_size, target, certain + CASE WHEN NOT never AND (cut_slice IS NULL OR slice < cut_slice) THEN 1 ELSE 0 END FROM m WHERE slice IS DISTINCT FROM cut_slice OR never)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM z
"""
}
