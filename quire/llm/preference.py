"""Preference formatting with DataFrame functions only.

The chosen and the rejected conversation of a pair are gathered in one shuffle, their longest common turn prefix is found
turn by turn, rendered once as the prompt, and the turns after it become two completions with loss masks. A mask is a list of
runs ``length:flag`` in characters that covers its completion; only what an assistant says, with its end mark, counts (1).

Cases: turns sort by number (null first), then role and text; repeated turns all stay; a null role renders as ``user`` and a
null text as empty, but null differs from empty when prefixes are compared; a conversation without a partner is returned with
the other side empty and ``paired`` false; rows with a null conversation id belong to no pair and are left out; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE, AFTER = "<|im_start|>", "\n", "<|im_end|>", "\n"


def _role(m: Column) -> Column:
    return F.coalesce(m["role"], F.lit("user"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda m: F.concat(F.lit(OPEN), _role(m), F.lit(MIDDLE), F.coalesce(m["text"], F.lit("")), F.lit(CLOSE + AFTER))), "")


def _mask(turns: Column, trained: str) -> Column:
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    return F.array_join(
        F.transform(
            turns,
            lambda m: F.concat((F.length(_role(m)) + head).cast("string"), F.lit(":0,"), (F.length(F.coalesce(m["text"], F.lit(""))) + tail).cast("string"), F.when(_role(m) == trained, F.lit(":1,")).otherwise(F.lit(":0,")), F.lit(f"{len(AFTER)}:0")),
        ),
        ",",
    )


def format_pairs(turns: DataFrame, pair: Column, rejected: Column, trained: str = "assistant") -> DataFrame:
    """One row a pair. ``pair`` gives a turn's pair, ``rejected`` is true for turns of the rejected conversation.

    Returns pair_id, paired, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask.
    """
    said = turns.select(pair.alias("pair_id"), rejected.alias("side"), "turn", "role", "text").where("pair_id IS NOT NULL AND side IS NOT NULL")
    pairs = said.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("turns"))
    pairs = pairs.select("pair_id", F.filter("turns", lambda m: ~m["side"]).alias("c"), F.filter("turns", lambda m: m["side"]).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    miss = F.array_position(same, False).cast("int")
    pairs = pairs.withColumn("n_common", F.when(miss > 0, miss - 1).otherwise(F.size("c")))
    after_c, after_r = (F.slice(side, F.col("n_common") + 1, F.size(side)) for side in ("c", "r"))
    return pairs.select(
        "pair_id",
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("paired"),
        "n_common",
        _render(F.slice("c", 1, F.col("n_common"))).alias("prompt"),
        _render(after_c).alias("chosen"),
        _mask(after_c, trained).alias("chosen_mask"),
        _render(after_r).alias("rejected"),
        _mask(after_r, trained).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Pairs of a table that stores a chosen conversation under an even id and its rejected one under the next."""
    half = F.floor(F.col("conv_id") / 2)
    return format_pairs(turns, half, F.pmod(F.col("conv_id"), F.lit(2)) == 1, trained)


OP9_SQL = r"""
WITH g AS (
  SELECT floor(conv_id / 2)::BIGINT AS pair_id,
    coalesce(list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (conv_id % 2 = 0), []) AS c,
    coalesce(list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (conv_id % 2 <> 0), []) AS r
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
n AS (SELECT *, len(list_filter(range(1, 1 + least(len(c), len(r))), lambda i: len(list_filter(range(1, i + 1), lambda j: c[j].role IS DISTINCT FROM r[j].role OR c[j].text IS DISTINCT FROM r[j].text)) = 0))::INTEGER AS n_common FROM g),
h AS (SELECT *, c[n_common + 1:] AS ca, r[n_common + 1:] AS ra, c[1:n_common] AS cp FROM n)
SELECT pair_id, len(c) > 0 AND len(r) > 0 AS paired, n_common,
  array_to_string(list_transform(cp, lambda m: '<|im_start|>' || coalesce(m.role, 'user') || chr(10) || coalesce(m.text, '') || '<|im_end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(ca, lambda m: '<|im_start|>' || coalesce(m.role, 'user') || chr(10) || coalesce(m.text, '') || '<|im_end|>' || chr(10)), '') AS chosen,
  array_to_string(list_transform(ca, lambda m: (length(coalesce(m.role, 'user')) + 13)::VARCHAR || ':0,' || (length(coalesce(m.text, '')) + 10)::VARCHAR || CASE WHEN coalesce(m.role, 'user') = 'assistant' THEN ':1,' ELSE ':0,' END || '1:0'), ',') AS chosen_mask,
  array_to_string(list_transform(ra, lambda m: '<|im_start|>' || coalesce(m.role, 'user') || chr(10) || coalesce(m.text, '') || '<|im_end|>' || chr(10)), '') AS rejected,
  array_to_string(list_transform(ra, lambda m: (length(coalesce(m.role, 'user')) + 13)::VARCHAR || ':0,' || (length(coalesce(m.text, '')) + 10)::VARCHAR || CASE WHEN coalesce(m.role, 'user') = 'assistant' THEN ':1,' ELSE ':0,' END || '1:0'), ',') AS rejected_mask
FROM h
"""
