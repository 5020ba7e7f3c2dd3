"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation again and again, each time with more turns. Every turn-prefix of a conversation gets a
rolling hash: the sum over its turns of a hash of (position, role, text), kept in two independent
64-bit parts, so a prefix's hash comes from the one before by one addition. A conversation whose whole hash is
a proper prefix of another's is a snapshot; an anti-join drops it. Of conversations that are equal turn by
turn the smallest id stays. What is left is rendered with the template.

A first turn or a conversation that very many logs share is one row after the grouped aggregation, which starts in the
tasks. Windows run over the turns of one conversation.

Defined cases: turns are ordered by turn, then role and text where that ties; identical repeated rows of a conversation
count once; a null turn is ordered first; a null role or text is empty; rows with a null conversation id are ignored; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    return rows.distinct().withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): the conversations that stay, and how many logs equal each of them, itself included."""
    turns = _turns(conversations)
    # a hash of the turn's hash makes the two parts independent; decimal sums do not overflow
    h1 = F.xxhash64("pos", F.lit("a"), "role", "text").cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit("b"), "text", "pos", "role").cast("decimal(38,0)")
    w = Window.partitionBy("conv_id").orderBy("pos")
    prefixes = turns.select("conv_id", "pos", h1.alias("a"), h2.alias("b"))
    prefixes = prefixes.select("conv_id", "pos", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"), F.lead("pos").over(w).isNull().alias("whole"))
    of = prefixes.groupBy("a", "b", "pos").agg(
        F.bool_or(~F.col("whole")).alias("goes_on"),
        F.min(F.when(F.col("whole"), F.col("conv_id"))).alias("conv_id"),
        F.expr("count_if(whole)").alias("copies"),
    )
    wholes = of.where("conv_id IS NOT NULL")
    longer = of.where("goes_on").select("a", "b", "pos")
    return wholes.join(longer, ["a", "b", "pos"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), F.col("copies").alias("n_equal"))


def render(conversations: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, n_equal, chat) of every conversation that stays."""
    start, middle, end = template
    turns = _turns(conversations)
    piece = F.concat(F.lit(start), "role", F.lit(middle), "text", F.lit(end))
    kept = maximal(conversations)
    texts = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"))
    chats = texts.select("conv_id", F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("chat"))
    return kept.join(chats, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_equal", "chat")


def op10_chat(spark, sf_dir):
    return render(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS chat
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
wholes AS (SELECT min(conv_id) AS conv_id, pos, count(*) AS n_equal, chat FROM p WHERE pos = n GROUP BY pos, chat)
SELECT conv_id, pos AS n_turns, n_equal, chat FROM wholes
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n > p.pos AND p.pos = wholes.pos AND p.chat = wholes.chat)
"""
