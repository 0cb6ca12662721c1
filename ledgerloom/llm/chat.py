"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions alone.

Logs often hold a conversation several times, as it was after each exchange. A conversation goes if its turns are a
prefix of another one's; of equal ones the least conv_id stays. What remains is rendered in one chat template.

Each turn is hashed with its place, role and text, twice. The exclusive or of these hashes over a conversation's first
k turns is the rolling hash of that prefix: 128 bits, one window pass, and no sequence is gathered. Prefixes are
combined to one row each before they meet whole conversations in an anti-join, so that a first turn that a third of all
conversations share is one row there.

A role or text can't forge a turn: "<|" in it is rendered as "< |".

Order: by turn, then role, then text; null turns come first. Defined results: a null text or role is rendered as
empty but differs from an empty one in comparisons; rows with a null conv_id are no conversation and are left out;
repeated rows are turns of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN_BEGIN, TURN_END = "<|im_start|>", "<|im_end|>\n"


def rendered_turn(role: Column, text: Column) -> Column:
    plain = lambda value: F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(TURN_BEGIN), plain(role), F.lit("\n"), plain(text), F.lit(TURN_END))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, at (from 1), role, text, and a and b: the rolling hash of the turns up to there."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("at", F.row_number().over(order).cast("long"))
    # A null and an empty value must differ, and xxhash64 skips nulls.
    content = [F.col("at"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    for name, salt in (("a", 1), ("b", 2)):
        numbered = numbered.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), *content)).over(upto))
    return numbered


def maximal(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv and n (turns) of the conversations that stay."""
    return _kept(prefix_hashes(_turns(conversations, conv_col, turn_col, role_col, text_col)))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text")
    ).filter("conv is not null")


def _kept(prefixes: DataFrame) -> DataFrame:
    slim = prefixes.select("conv", "at", "a", "b")
    ends = slim.groupBy("conv").agg(F.max(F.struct("at", "a", "b")).alias("end"))
    whole = ends.groupBy(F.col("end.at").alias("n"), F.col("end.a").alias("a"), F.col("end.b").alias("b")).agg(F.min("conv").alias("conv"))
    # A prefix is proper unless it is its conversation's end; an end's hash is among the proper ones if a longer one has it.
    size = F.max("at").over(Window.partitionBy("conv"))
    proper = slim.withColumn("size", size).filter("at < size").groupBy(F.col("at").alias("n"), "a", "b").agg(F.count("*").alias("c")).drop("c")
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv", "n")


def format_maximal(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, chat: the rendered maximal conversations. The result has a row a conversation, so its turns are gathered."""
    prefixes = prefix_hashes(_turns(conversations, conv_col, turn_col, role_col, text_col))
    kept = _kept(prefixes)
    turns = prefixes.select("conv", "at", "role", "text").join(kept, "conv")
    parts = F.sort_array(F.collect_list(F.struct("at", rendered_turn(F.col("role"), F.col("text")).alias("part"))))
    chats = turns.groupBy("conv").agg(F.max("n").alias("n_turns"), parts.alias("parts"))
    return chats.select(F.col("conv").alias("conv_id"), "n_turns", F.concat_ws("", F.transform("parts", lambda p: p["part"])).alias("chat"))


def oracle_sql(table: str = "conversations") -> str:
    """The same in DuckDB SQL, comparing whole prefixes as lists."""
    return f"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS "at",
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM {table} WHERE conv_id IS NOT NULL),
digests AS (
  SELECT conv_id, "at", n, md5(string_agg(md5(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')), ',') OVER (PARTITION BY conv_id ORDER BY "at")) AS digest
  FROM turns),
whole AS (SELECT min(conv_id) AS conv_id, n, digest FROM digests WHERE "at" = n GROUP BY n, digest),
kept AS (
  SELECT w.conv_id, w.n FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM digests d WHERE d."at" < d.n AND d."at" = w.n AND d.digest = w.digest))
SELECT k.conv_id, k.n AS n_turns,
       string_agg('{TURN_BEGIN}' || replace(coalesce(t.role, ''), '<|', '< |') || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t."at") AS chat
FROM kept k JOIN turns t ON t.conv_id = k.conv_id
GROUP BY k.conv_id, k.n"""
