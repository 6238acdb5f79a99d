"""Preference formatting of chosen and rejected conversations, in DataFrame
functions.

The longest common turn prefix of the two (equal role and text, from the
first turn on) is rendered once as the prompt; what remains of each is its
completion, with the spans that are trained on: the text and end mark of
assistant turns, in code points, end exclusive.

Both sides meet in one shuffle by pair; a conversation is the unit that one
task holds, each turn once, however often its row is repeated: repeats go before the
shuffle. Very long texts are held with their conversation. Rows: turns go by
number, and ties by role, then text (nulls first); repeated rows count once; a null text is empty, a null role is ``unknown``. A
side without rows is an empty conversation. Pairs without id are left out.
Empty tables give an empty result. Extra columns are not read. Texts cannot
forge marks: ``<|`` in them becomes ``< |``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
SPANS = "array<struct<start:int,end:int>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def trained(turns: Column, role: str = "assistant") -> Column:
    """Spans of the rendered turns that count in training."""
    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(turns, first, step, lambda a: a["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """(pair, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans)
    from two tables of (pair, turn, role, text)."""
    def side(df: DataFrame, n: int) -> DataFrame:
        text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
        return df.where(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair"), F.lit(n).alias("side"), F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text")).alias("t"))

    def turns(n: int) -> Column:
        return F.array_sort(F.array_distinct(F.collect_set(F.when(F.col("side") == n, F.col("t")))))

    both = side(chosen, 0).unionByName(side(rejected, 1)).groupBy("pair").agg(turns(0).alias("a"), turns(1).alias("b"))
    both = both.withColumn("k", common_turns(F.col("a"), F.col("b")))
    rest = {c: F.slice(c, F.col("k") + 1, F.size(c)) for c in "ab"}
    both = both.select("pair", "k", F.slice("a", F.lit(1), F.col("k")).alias("prompt"), rest["a"].alias("a"), rest["b"].alias("b"))
    return both.select(
        F.col("pair").alias(pair_col), F.col("k").alias("n_common"), rendered(F.col("prompt")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"), trained(F.col("a")).alias("chosen_spans"),
        rendered(F.col("b")).alias("rejected"), trained(F.col("b")).alias("rejected_spans"))


def swapped_answers(conversations: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Pairs out of plain conversations: each one as it is, and with its last
    assistant turn's text taken from its neighbour (ids 2i and 2i + 1). Without
    an answer in the neighbour, the rejected side ends before that turn."""
    turns = conversations.select(F.col(id_col).alias("pair_id"), "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("other"))
    marked = turns.join(last.select("pair_id", "last.turn").withColumnRenamed("turn", "last"), "pair_id", "left").join(other, "pair_id", "left")
    is_last = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.lit(False))
    rejected = marked.where(~is_last | F.col("other").isNotNull()).select("pair_id", "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text"))
    return turns, rejected
