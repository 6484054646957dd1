"""Chat formatting of logged conversations.

Logs often hold a conversation again after each turn, so that snapshots are prefixes of one another. Method: each
turn's 128-bit hash covers its place, role and text; a running exclusive-or over the turns gives a rolling hash of
every prefix. Of equal conversations the smallest id stays; an anti-join of these with the proper prefixes of all
conversations leaves the maximal ones, and only those are rendered.

Defined cases: turns are ordered by turn, then role, then text, nulls first, and repeated rows count as turns; a
null role is written as "unknown" and a null text as the empty string, which differs from a null only in the log;
rows without conversation id belong to none and are left out; very long texts are hashed and rendered whole, and turns
that tie in place, role and text are equal, so that their order makes no difference; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place ``at``, the length ``n`` of its conversation and the hash ``h1``, ``h2`` of the prefix it ends."""
    named = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = named.withColumn("at", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    hashed = placed.withColumn("digest", F.md5(F.concat_ws("\x1f", F.col("at").cast("string"), F.length("role").cast("string"), "role", "text")))
    # 15 hex digits stay within a long; the rest of the digest is taken by a second hash
    first = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    second = F.xxhash64("digest")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.withColumn("h1", F.bit_xor(first).over(running)).withColumn("h2", F.bit_xor(second).over(running)).drop("digest")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another and first among their equals."""
    rows = prefixes(turns)
    whole = rows.where("at = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = rows.where("at < n").select(F.col("at").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns and ``rendered``: each turn as begin, role, line end, text, end, line end."""
    turn = F.concat(F.lit(begin), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{end}\n"))
    # as the struct sorts: turn (nulls first), role, text
    row = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), turn.alias("line"))
    lines = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return lines.select("conv_id", "n_turns", F.array_join("rows.line", "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns, collapse(turns))


FORMAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS l,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
      FROM t GROUP BY conv_id),
firsts AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l),
inner_prefixes AS (SELECT DISTINCT l[1:k] AS p FROM c, unnest(range(1, len(l))) AS u(k))
SELECT f.conv_id, CAST(len(f.l) AS BIGINT) AS n_turns, c.rendered
FROM firsts f JOIN c USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM inner_prefixes i WHERE i.p = f.l)
"""
