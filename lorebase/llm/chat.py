"""Operator 10: chat formatting with cumulative-snapshot collapse.

A log that writes a conversation anew after every turn holds many prefixes of each conversation. Each turn is hashed
with its rank; the exclusive-or of these hashes up to a turn is the rolling hash of that prefix (two independent 64-bit
hashes). Equal conversations collapse to their smallest id, an anti-join against the proper prefixes of all
conversations keeps the maximal ones, and those are rendered.

Ranks and rolling hashes of a conversation come from windows over chunks of 512 turn numbers, with offsets from a
window over its chunks' totals, so that no task gets all turns of a very long conversation. Groups by prefix hash
combine on the map side, so a first turn shared by a third of all conversations is a row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

CHUNK, PART = 512, 1024


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with null id belong to no conversation and are left out; null roles and texts count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(F.concat(role, F.lit("\x1f"), text)).alias("c"))


def _scan(rows: DataFrame, value: str, by: str, out: str, total: str | None = None) -> DataFrame:
    """Running aggregate ``value`` (SQL with {x}) of each conversation, by chunks; ``by`` orders rows within a chunk."""
    chunk = ["conv_id", "chunk", "sub"]
    combine = "sum" if value.startswith("count") else "bit_xor"
    local = F.expr(value).over(W.partitionBy(*chunk).orderBy(*by.split(",")).rowsBetween(W.unboundedPreceding, 0))
    sums = rows.groupBy(*chunk).agg(F.expr(value).alias("v"))
    before = W.partitionBy("conv_id").orderBy("chunk", "sub")
    offset = F.coalesce(F.expr(f"{combine}(v)").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    more = [F.sum("v").over(W.partitionBy("conv_id")).alias(total)] if total else []
    joined = rows.withColumn("local", local).join(sums.select(*chunk, offset, *more), chunk)
    return joined.withColumn(out, F.col("local") + F.col("before") if combine == "sum" else F.col("local").bitwiseXOR(F.col("before"))).drop("local", "before")


def ranked(conversations: DataFrame) -> DataFrame:
    """A row for each distinct turn: (conv_id, turn, c, rank, n). Order: turn (nulls first), then content hash."""
    t = _turns(conversations).groupBy("conv_id", "turn", "c").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    t = t.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(2**62))))
    t = t.withColumn("sub", F.when(F.col("turn").isNull(), F.substring("c", 1, 2)).otherwise(""))
    return _scan(t, "count(1)", "turn,c", "rank", "n")


def maximal(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked turns, ids of the kept conversations): of equal ones the smallest id; none that prefixes a longer one."""
    rows = cut(ranked(conversations))
    hashed = rows
    for k in (1, 2):
        hashed = _scan(hashed.withColumn("h", F.xxhash64(F.lit(k), "rank", "c")), "bit_xor(h)", "rank", f"x{k}").drop("h")
    prefixes = cut(hashed.select("conv_id", "rank", "n", "x1", "x2"))
    whole = prefixes.where("rank = n").groupBy("rank", "x1", "x2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("rank < n").select("rank", "x1", "x2").distinct()
    return rows, whole.join(proper, ["rank", "x1", "x2"], "left_anti").select("conv_id")


def collapse(conversations: DataFrame) -> DataFrame:
    """Turns of the maximal conversations: (conv_id, rank, role, text), repeats of a row once."""
    rows, kept = maximal(conversations)
    keys = rows.join(kept, "conv_id", "left_semi").select("conv_id", F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "c", "rank")
    texts = _turns(conversations).withColumn("turn", F.coalesce("turn", F.lit(-(2**62))))
    texts = texts.groupBy("conv_id", "turn", "c").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return texts.join(keys, ["conv_id", "turn", "c"]).select("conv_id", "rank", "role", "text")


def render(turns: DataFrame, part: int = PART) -> DataFrame:
    """ChatML text of ranked turns: (conv_id, part, n_turns, text); a part holds ``part`` turns, most conversations one."""
    piece = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = turns.select("conv_id", F.floor((F.col("rank") - 1) / part).cast("long").alias("part"), F.struct("rank", piece.alias("piece")).alias("x"))
    got = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return got.select("conv_id", "part", F.size("xs").cast("long").alias("n_turns"), F.array_join(F.col("xs.piece"), "").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations rendered. Extra columns are ignored; an empty table gives an empty result."""
    return render(collapse(conversations))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS c
  FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, c) AS rank FROM turns),
whole AS (SELECT conv_id, list(c ORDER BY rank) AS cs FROM ranked GROUP BY conv_id),
firsts AS (SELECT min(conv_id) AS conv_id, cs FROM whole GROUP BY cs),
proper AS (SELECT DISTINCT md5(array_to_string(cs[:k], ',')) AS h FROM whole, LATERAL (SELECT unnest(range(1, len(cs))) AS k)),
kept AS (SELECT conv_id FROM firsts WHERE md5(array_to_string(cs, ',')) NOT IN (SELECT h FROM proper))
SELECT conv_id, (rank - 1) // {PART} AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY rank) AS text
FROM ranked WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY 1, 2
"""
