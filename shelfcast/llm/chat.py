"""Chat formatting (operator 3): preference pairs with one prompt and two masked completions.

Two conversations are compared turn by turn. The turns that agree from the first one on are the
prompt, which is rendered once; what follows on either side is its completion, of which only the
assistant's words are trained on. A row is a rendered turn with its place in its part, so no
conversation, however long, is gathered into one row or task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import table


@dataclass(frozen=True)
class ChatParams:
    """The template: ``<|im_start|>role\\n text <|im_end|>\\n``; only ``trained`` roles are learnt."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    trained: str = "assistant"
    block_turns: int = 256


def paired(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected answer of pair k."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.coalesce(F.pmod("conv_id", F.lit(2)) == 0, F.lit(True)).alias("is_chosen"),
        "turn",
        "role",
        "text",
    )


def _plain(text: Column) -> Column:
    """The text without anything that reads like the template's own marks."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def preferences(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """pair_id, part, turn, role, rendered, start, train_start, train_end, is_paired.

    ``turns`` has pair_id, is_chosen, turn, role and text. ``part`` is prompt, chosen or rejected.
    ``start`` is the turn's place in its part, in characters; the trained characters, the words and
    closing mark of trained roles in completions, run from ``train_start`` to ``train_end``; both
    are null in turns that are not trained on.

    A turn is the set of a side's rows with one turn number: repeated rows count once, different
    rows stand in order of role and text. Two turns agree if their sets do; the first that doesn't,
    or that only one side has, ends the prompt. Equal sides are all prompt. A pair with one side has
    no prompt, and ``is_paired`` is false. A null turn number comes first, null roles and texts are
    compared as such and rendered empty; rows without a pair_id are a pair of their own. An empty
    table gives no rows; other columns are ignored.

    Rows are compared by one aggregation on all of their columns, and a pair's only shared value is
    the turn at which its sides part, so long conversations spread over tasks.
    """
    held = turns.groupBy("pair_id", "turn", "role", "text").agg(
        F.bool_or("is_chosen").alias("chosen"), F.bool_or(~F.col("is_chosen")).alias("rejected")
    )
    order = F.struct(F.isnotnull("turn").alias("known"), "turn")
    parts = held.groupBy(F.col("pair_id").alias("pair")).agg(
        F.min(F.when(~(F.col("chosen") & F.col("rejected")), order)).alias("fork"),
        (F.bool_or("chosen") & F.bool_or("rejected")).alias("is_paired"),
    )
    joined = held.join(parts, F.col("pair_id").eqNullSafe(F.col("pair")))
    sides = (
        F.when(F.isnull("fork") | (order < F.col("fork")), F.array(F.lit("prompt")))
        .when(F.col("chosen") & F.col("rejected"), F.array(F.lit("chosen"), F.lit("rejected")))
        .otherwise(F.array(F.when(F.col("chosen"), "chosen").otherwise("rejected")))
    )
    head = F.concat(F.lit(params.opening), _plain(F.col("role")), F.lit("\n"))
    body = F.concat(_plain(F.col("text")), F.lit(params.closing))
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == params.trained, F.lit(False))
    rows = joined.select("pair_id", F.explode(sides).alias("part"), "turn", "role", "text", "is_paired")
    rows = rows.withColumns({"head": head, "body": body}).select(
        "pair_id", "part", "turn", "role", "text", "is_paired",
        F.concat("head", "body", F.lit("\n")).alias("rendered"),
        F.when(trained, F.length("head")).alias("from_"),
        F.when(trained, F.length("head") + F.length("body")).alias("to_"),
        F.floor(F.col("turn") / params.block_turns).alias("block"),
    )
    # Places are running sums: within blocks of turns, and over the blocks of a part.
    block = ["pair_id", "part", "block"]
    size = F.length("rendered").cast("long")
    earlier = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*block).agg(F.sum(size).alias("size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"of_{c}") for c in block], "before")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in block]
    inside = Window.partitionBy(*block).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(sums, same)
    start = F.col("before") + F.col("within")
    return placed.select(
        "pair_id", "part", "turn", "role", "rendered", start.alias("start"),
        (start + F.col("from_")).alias("train_start"), (start + F.col("to_")).alias("train_end"), "is_paired",
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(paired(table(spark, sf_dir, "conversations")))


ORACLE = """
WITH held AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, turn, role, text,
         bool_or(conv_id % 2 = 0) AS chosen, bool_or(conv_id % 2 <> 0) AS rejected
  FROM conversations GROUP BY 1, 2, 3, 4
), forks AS (
  SELECT pair_id, min(CASE WHEN NOT (chosen AND rejected) THEN turn END) AS fork,
         bool_or(chosen) AND bool_or(rejected) AS is_paired
  FROM held GROUP BY pair_id
), parts AS (
  SELECT h.pair_id, turn, role, text, is_paired,
         unnest(CASE WHEN fork IS NULL OR turn < fork THEN ['prompt']
                     WHEN chosen AND rejected THEN ['chosen', 'rejected']
                     WHEN chosen THEN ['chosen'] ELSE ['rejected'] END) AS part
  FROM held h JOIN forks USING (pair_id)
), shown AS (
  SELECT *, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
         replace(text, '<|', '< |') || '<|im_end|>' AS body
  FROM parts
), placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY pair_id, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM shown
)
SELECT pair_id, part, turn, role, head || body || chr(10) AS rendered, start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(head) END AS train_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(head) + length(body) END AS train_end,
       is_paired
FROM placed
"""
