"""Chat formatting after collapsing cumulative snapshots.

A conversation logged after each of its turns leaves one log per length. Each turn gets a
rolling hash: md5(previous hash, role, text). A conversation whose last hash equals a hash that
another one has before its end is a proper prefix of that one, and goes in an anti-join; of equal
conversations the least conv_id stays. What is left is rendered in a chat template.

Defined results: turns are taken in the order of turn, null first, then role, text; repeated rows
(same conv_id, turn, role, text) count once; a null role is rendered as "user" and a null text as
empty, and both differ from the given value "user" or '' in the hash; rows of a null conv_id are left out;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _part(c: Column) -> Column:
    """A value with its length, so that no two different turns are written alike; null differs from ''."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def snapshots(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, hashes): the ordered turns and the rolling hash after each of them; one shuffle."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**62))).alias("turn"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), "role", "text"))).alias("turns"))

    def roll(hs, t):
        return F.concat(hs, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(hs, F.lit(-1)), F.lit("")), F.lit("/"), _part(t["role"]), F.lit("/"), _part(t["text"])))))

    return by.withColumn("hashes", F.aggregate("turns", F.array().cast("array<string>"), roll))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): conversations that are no prefix of another one, without equal ones."""
    s = snapshots(conversations).withColumn("last", F.try_element_at("hashes", F.lit(-1)))
    inner = s.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("last")).distinct()
    first = s.groupBy("last").agg(F.min_by(F.struct("conv_id", "turns"), "conv_id").alias("c"))
    return first.join(inner, "last", "left_anti").select("c.conv_id", "c.turns")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of every maximal conversation."""
    a, rest = TURN.split("{role}")
    b, z = rest.split("{text}")
    lines = F.transform("turns", lambda t: F.concat(F.lit(a), F.coalesce(t["role"], F.lit("user")), F.lit(b), t["t"], F.lit(z)))
    return maximal(conversations).select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.array_join(lines, "").alias("rendered"))


ORACLE = """
WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
  count(*) OVER (PARTITION BY conv_id) AS n FROM c),
s AS (SELECT conv_id, k, n,
  string_agg(coalesce(length(role) || ':' || role, '-') || '/' || coalesce(length(text) || ':' || text, '-'), '|')
    OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS whole,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '')
    OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS rendered FROM o)
SELECT conv_id, n AS n_turns, rendered FROM s
WHERE k = n AND NOT EXISTS (SELECT 1 FROM s AS p WHERE p.k < p.n AND p.whole = s.whole)
  AND conv_id = (SELECT min(q.conv_id) FROM s AS q WHERE q.k = q.n AND q.whole = s.whole)
"""
