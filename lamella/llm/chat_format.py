"""Preference formatting of chat conversations, with SQL expressions only.

A pair of conversations, one chosen and one rejected, is split at its longest
common turn prefix. The prefix is rendered once as the prompt; what follows in
each is rendered as a completion with masks that mark the characters to learn
from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a turn is rendered, and the roles that a model learns to write.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = ("assistant",)


def conversations_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns): each conversation's turns in order, as an array of (role, text).

    A conversation is one row, as it is in training; its turns are sorted by
    number, then role and text, so ties and repeated rows have a fixed order.
    """
    turn = F.struct(F.col(turn_col).alias("n"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), turn.alias("turn"))
    gathered = rows.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select("conv", F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    differs = F.zip_with(a, b, lambda x, y: x.isNull() | y.isNull() | (x != y))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1).otherwise(F.size(differs)).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def learned_spans(turns: Column) -> Column:
    """(start, length) in characters of the parts of ``rendered(turns)`` that are learned: texts and close marks."""
    role_part = len(OPEN) + len(MIDDLE)

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + role_part
        size = F.length(t["text"]) + len(CLOSE)
        span = F.struct(start.alias("start"), size.alias("length"))
        spans = F.when(t["role"].isin(*LEARNED), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + size).alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, first, step, lambda s: s["spans"])


def format_preferences(
    turns: DataFrame,
    pairs: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chosen_col: str = "chosen_id",
    rejected_col: str = "rejected_id",
) -> DataFrame:
    """A row per pair: the prompt and two masked completions.

    Returns chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected
    (rendered texts), chosen_mask and rejected_mask (arrays of start and length
    in the completion; all else is masked). Null roles and texts count as
    empty ones. Where one conversation is a prefix of the other, its
    completion is empty and has no spans; equal ones have two empty
    completions. Pairs that name a null or unknown conversation give no row;
    repeated pairs give repeated rows. A conversation that very many pairs
    share is one row on its side of the join.
    """
    whole = conversations_of(turns, conv_col, turn_col, role_col, text_col)
    asked = pairs.select(F.col(chosen_col).alias("c"), F.col(rejected_col).alias("r"))
    both = asked.join(whole.select(F.col("conv").alias("c"), F.col("turns").alias("ct")), "c").join(whole.select(F.col("conv").alias("r"), F.col("turns").alias("rt")), "r")
    return format_turns(both).withColumnsRenamed({"c": chosen_col, "r": rejected_col})


def format_turns(both: DataFrame) -> DataFrame:
    """The rows of ``format_preferences`` for pairs of arrays of turns: c, r (ids), ct, rt (arrays of role and text, without nulls)."""
    cut = both.withColumn("n", common_prefix(F.col("ct"), F.col("rt")))
    parts = cut.select(
        "c", "r", "n", F.slice("ct", F.lit(1), F.col("n")).alias("shared"), *(F.slice(t, F.col("n") + 1, F.size(t)).alias(t) for t in ("ct", "rt"))
    )
    return parts.select(
        "c", "r", F.col("n").alias("n_prompt_turns"), rendered(F.col("shared")).alias("prompt"),
        rendered(F.col("ct")).alias("chosen"), rendered(F.col("rt")).alias("rejected"),
        learned_spans(F.col("ct")).alias("chosen_mask"), learned_spans(F.col("rt")).alias("rejected_mask"),
    )


def with_other_answers(whole: DataFrame) -> DataFrame:
    """Pairs of each conversation (chosen) and itself with its last learned turn's text taken from another one (rejected).

    ``whole`` has conv and turns. Conversation c takes the last learned text of
    c xor 1, its neighbour, or an empty one where that isn't there or learns
    nothing; ``r`` is the neighbour's id, null where it isn't there. A
    conversation without a learned turn is its own rejected one.
    """
    back = F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"].isin(*LEARNED)), True)
    last = F.when(back > 0, F.size("turns") - back + 1).otherwise(0).cast("int")
    found = whole.select("conv", "turns", last.alias("last"))
    others = found.select(F.col("conv").bitwiseXOR(F.lit(1)).alias("of"), F.col("conv").alias("r"), F.when(F.col("last") > 0, F.get("turns", F.col("last") - 1)["text"]).alias("answer"))
    joined = found.join(others, F.col("conv") == F.col("of"), "left")
    changed = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.coalesce("answer", F.lit(""))).otherwise(t["text"]).alias("text")))
    return joined.select(F.col("conv").alias("c"), "r", F.col("turns").alias("ct"), changed.alias("rt"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, against itself with its neighbour's last answer; masks as text, start:length parted by commas."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = format_turns(with_other_answers(conversations_of(turns, "conv_id", "turn", "role", "text"))).withColumnsRenamed({"c": "chosen_id", "r": "rejected_id"})
    masks = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",") for c in ("chosen_mask", "rejected_mask")}
    return out.withColumns(masks)


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS turns, max(p) FILTER (WHERE role = 'assistant') AS lp FROM t GROUP BY conv_id
), answers AS (
  SELECT t.conv_id, t.text AS answer FROM t JOIN sizes s ON s.conv_id = t.conv_id AND s.lp = t.p
), pairs AS (
  SELECT s.conv_id, n.conv_id AS rejected_id, s.turns, s.lp, coalesce(a.answer, '') AS answer
  FROM sizes s LEFT JOIN sizes n ON n.conv_id = xor(s.conv_id, 1) LEFT JOIN answers a ON a.conv_id = n.conv_id
), cut AS (
  SELECT q.conv_id, rejected_id, CASE WHEN t.text IS NULL OR t.text = answer THEN turns ELSE lp - 1 END AS n
  FROM pairs q LEFT JOIN t ON t.conv_id = q.conv_id AND t.p = q.lp
), sides AS (
  SELECT conv_id, n, 'c' AS side, p, role, text FROM cut JOIN t USING (conv_id)
  UNION ALL
  SELECT conv_id, n, 'r', p, role, CASE WHEN p = lp THEN answer ELSE text END FROM cut JOIN t USING (conv_id) JOIN pairs USING (conv_id)
), drawn AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM sides
), placed AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id, side ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM drawn WHERE p > n
), texts AS (
  SELECT conv_id, side, string_agg(s, '' ORDER BY p) AS s,
         string_agg((start + length(role) + 5) || ':' || (length(text) + 8), ',' ORDER BY p) FILTER (WHERE role = 'assistant') AS m
  FROM placed GROUP BY ALL
), prompts AS (
  SELECT conv_id, string_agg(s, '' ORDER BY p) AS s FROM drawn WHERE side = 'c' AND p <= n GROUP BY conv_id
)
SELECT cut.conv_id AS chosen_id, cut.rejected_id, n::INT AS n_prompt_turns, coalesce(q.s, '') AS prompt,
       coalesce(c.s, '') AS chosen, coalesce(r.s, '') AS rejected, coalesce(c.m, '') AS chosen_mask, coalesce(r.m, '') AS rejected_mask
FROM cut LEFT JOIN prompts q USING (conv_id)
LEFT JOIN texts c ON c.side = 'c' AND c.conv_id = cut.conv_id LEFT JOIN texts r ON r.side = 'r' AND r.conv_id = cut.conv_id
"""
