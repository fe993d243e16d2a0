"""Operator 4, preference formatting, with DataFrame functions only.

Conversations 2k (chosen) and 2k + 1 (rejected) are pair k. Their longest common prefix of turns is
rendered once as the prompt; what follows on either side is that side's completion, with a loss mask.

A mask lists the completion's runs of characters as ``length:flag``: a turn's header is never trained,
the text and end mark of an assistant's turn are (flag 1), those of any other role are not.

Defined cases: a row without conv_id is in no conversation; a null turn comes before all others, a null role
or text is empty; rows of one turn are ordered by role and text, and a repeated row counts once; a pair with
one side keeps the other as an empty conversation; equal sides give two empty completions. ``<|`` inside a
text becomes ``< |``, so no text can forge a mark. One shuffle, on the pair; a pair is one row of the result,
so it must fit in a row as any document does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END, TRAINED = "<|", "|>\n", "<|end|>\n", "assistant"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        head = F.length(t["role"]) + len(HEAD) + len(MIDDLE)
        flag = F.when(t["role"] == TRAINED, ":1").otherwise(":0")
        return F.concat(head.cast("string"), F.lit(":0,"), (F.length(t["text"]) + len(END)).cast("string"), flag)

    return F.array_join(F.transform(turns, runs), ",")


def preference_pairs(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a pair: pair_id, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    plain = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(HEAD), F.lit("< |"))
    turn = F.struct(F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63))).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"))
    conv = F.col(conv_col).cast("long")
    rows = conversations.where(conv.isNotNull()).select(F.shiftright(conv, 1).alias("pair_id"), conv.bitwiseAND(1).alias("side"), turn.alias("t"))
    side = lambda k: F.array_sort(F.collect_set(F.when(F.col("side") == k, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side(0).alias("a"), side(1).alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", F.lit(1), least), F.slice("b", F.lit(1), least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    at = F.array_position(same, F.lit(False))
    cut = pairs.withColumn("n", F.when(at == 0, least).otherwise(at - 1).cast("int"))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    parts = cut.select("pair_id", F.col("n"), F.slice("a", F.lit(1), F.col("n")).alias("p"), tail("a").alias("c"), tail("b").alias("r"))
    return parts.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.size("c").cast("long").alias("n_chosen_turns"),
        F.size("r").cast("long").alias("n_rejected_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM t
), d AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
         a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM o WHERE side = 0) a FULL JOIN (SELECT * FROM o WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos
), p AS (
  SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)) AS n FROM d GROUP BY pair_id
), r AS (
  SELECT o.pair_id, side, pos, pos <= n AS common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS turn,
         (length(role) + 5) || ':0,' || (length(text) + 8) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS runs, n
  FROM o JOIN p ON o.pair_id = p.pair_id
)
SELECT pair_id, any_value(n) AS n_prompt_turns,
       count(*) FILTER (WHERE NOT common AND side = 0) AS n_chosen_turns,
       count(*) FILTER (WHERE NOT common AND side = 1) AS n_rejected_turns,
       coalesce(string_agg(turn, '' ORDER BY pos) FILTER (WHERE common AND side = 0), '') AS prompt,
       coalesce(string_agg(turn, '' ORDER BY pos) FILTER (WHERE NOT common AND side = 0), '') AS chosen,
       coalesce(string_agg(turn, '' ORDER BY pos) FILTER (WHERE NOT common AND side = 1), '') AS rejected,
       coalesce(string_agg(runs, ',' ORDER BY pos) FILTER (WHERE NOT common AND side = 0), '') AS chosen_mask,
       coalesce(string_agg(runs, ',' ORDER BY pos) FILTER (WHERE NOT common AND side = 1), '') AS rejected_mask
FROM r GROUP BY pair_id
"""
