"""Preference formatting: chosen and rejected conversations as one prompt and a pair of masked completions.

The longest run of equal turns (role and text) at the beginning of both conversations is rendered once as the prompt; what follows on either
side is its completion. A completion's mask lists the spans of characters that a model is trained on: the texts of the
trained role's turns with their closing mark. Only DataFrame operations.

Pairs come as rows with two arrays of turns (role, text). pairs_of() makes such pairs from a table of conversations:
conversations 2k and 2k + 1 are partners; a conversation is chosen, and rejected is the same conversation with its last
answer replaced by its partner's last answer.

Defined cases: a null role or text is an empty one; turns are in order of their number, nulls first, then of role and text; repeated
turns stay; rows with a null id are one conversation without a partner; pairs_of() needs ids of an integer type and raises TypeError for others; without a partner, or without an answer on either
side, the rejected side is the conversation without its last answer; an empty array has an empty completion; equal
conversations have empty completions; an empty table gives no rows. pairs_of() ignores extra columns, format_pairs() keeps them, but for those of
its results' names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import read_table, with_integer_id

# Fixed values of the chat format.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def common_turns(a: Column, b: Column) -> Column:
    """Number of equal turns at the beginning of both."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(F.least(F.size(a), F.size(b)))


def trained_spans(turns: Column) -> Column:
    """[begin, end) of the texts, with closing marks, of the trained role in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["role"]) + len(OPEN) + len(MIDDLE)
        end = begin + F.length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))
        spans = F.when(turn["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


OUTPUT = ("prompt", "n_common", "chosen", "rejected", "chosen_mask", "rejected_mask")


def format_pairs(pairs: DataFrame, chosen="chosen", rejected="rejected") -> DataFrame:
    """Replaces the two arrays, and other columns of the names in OUTPUT, by prompt, n_common, chosen, rejected (texts) and their masks; keeps the other columns."""
    kept = [c for c in pairs.columns if c not in (chosen, rejected, *OUTPUT)]
    clean = lambda c: F.coalesce(F.transform(F.col(f"`{c}`"), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), F.array().cast(TURNS))
    others = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("no other column")).alias("others")  # apart from the columns of the way
    both = pairs.select(others, clean(chosen).alias("a"), clean(rejected).alias("b"))
    both = both.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.withColumns({"p": F.slice("a", F.lit(1), F.col("n")), "x": rest("a"), "y": rest("b")})
    found = (rendered(F.col("p")), F.col("n"), rendered(F.col("x")), rendered(F.col("y")), trained_spans(F.col("x")), trained_spans(F.col("y")))
    return both.select(*[F.col("others").getField(c).alias(c) for c in kept], *[c.alias(name) for c, name in zip(found, OUTPUT)])


def pairs_of(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) from rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = with_integer_id(turns, "conv_id")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    whole = turns.groupBy(key.alias("key")).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), last.alias("last"))
    partner = whole.filter("conv_id is not null and last is not null").select(F.col("conv_id").alias("partner_id"), F.element_at("turns", F.col("last") + 1).alias("answer"))
    paired = whole.join(partner, whole["conv_id"].bitwiseXOR(F.lit(1)) == F.col("partner_id"), "left")
    before = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.col("last")))
    other = F.when(F.col("last").isNotNull() & F.col("answer").isNotNull(), F.concat(before, F.array("answer"))).otherwise(before)
    return paired.select("conv_id", F.col("turns").alias("chosen"), other.alias("rejected"))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_pairs(pairs_of(read_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return pairs.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


QUERIES = {"op5_preference_format": op5_preference_format}

_SIDE = """
{n}_r AS (SELECT conv_id, i, role, text, n_common, 2 + length(role) + 3 AS head, length(text) + 8 AS tail FROM {n} JOIN common USING (conv_id)),
{n}_s AS (SELECT *, sum(head + tail) FILTER (WHERE i >= n_common) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM {n}_r),
{n}_t AS (SELECT conv_id,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i < n_common), '') AS prompt,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i >= n_common), '') AS body,
  coalesce(string_agg(CAST(upto - tail AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY i) FILTER (WHERE i >= n_common AND role = 'assistant'), '') AS mask
  FROM {n}_s GROUP BY conv_id)"""

ORACLE = {
    "op5_preference_format": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations),
l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id),
a AS (SELECT t.conv_id, t.role, t.text FROM t JOIN l ON t.conv_id = l.conv_id AND t.i = l.last),
chosen_side AS (SELECT * FROM t),
rejected_side AS (SELECT t.conv_id, t.role, t.text, t.i FROM t JOIN l USING (conv_id) WHERE l.last IS NULL OR t.i < l.last
  UNION ALL SELECT l.conv_id, a.role, a.text, l.last FROM l JOIN a ON xor(l.conv_id, 1) = a.conv_id WHERE l.last IS NOT NULL),
common AS (SELECT c.conv_id, coalesce(min(CASE WHEN r.conv_id IS NULL OR r.role <> c.role OR r.text <> c.text THEN c.i END), count(*)) AS n_common
  FROM chosen_side c LEFT JOIN rejected_side r ON c.conv_id = r.conv_id AND c.i = r.i GROUP BY c.conv_id),"""
    + _SIDE.format(n="chosen_side")
    + ","
    + _SIDE.format(n="rejected_side")
    + """
SELECT c.conv_id, c.prompt, CAST(m.n_common AS INTEGER) AS n_common, c.body AS chosen, coalesce(r.body, '') AS rejected, c.mask AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM chosen_side_t c JOIN common m USING (conv_id) LEFT JOIN rejected_side_t r USING (conv_id)
"""
}
