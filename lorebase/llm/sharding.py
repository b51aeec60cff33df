"""Operator 2: consistent shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, (offset + j * skip) mod size with offset and
skip from its hashed name. Shards take turns; each turn claims the first free slot of the shard's permutation until
the table is full. A row's slot is the hash of its key modulo the table size. The table has ``table_size`` rows
whatever the data, which bounds the broadcast; placement is one hash and one lookup a row, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, table

N_SHARDS, TABLE_SIZE, SEED = 16, 4099, "lorebase"


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def lookup_table(shards: list[str], size: int, seed: str = SEED) -> list[int]:
    """Index of the shard that owns each slot. ``size`` is a prime of at least the number of shards."""
    if size < max(2, len(shards)) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime no smaller than the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need one distinct name each")
    offset = [_number(f"{seed}:offset:{s}") % size for s in shards]
    skip = [_number(f"{seed}:skip:{s}") % (size - 1) + 1 for s in shards]
    owner, turn, filled = [-1] * size, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while owner[at := (offset[i] + turn[i] * skip[i]) % size] >= 0:
                turn[i] += 1
            owner[at], turn[i], filled = i, turn[i] + 1, filled + 1
            if filled == size:
                return owner


def table_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The lookup table as rows (slot, shard): four bytes a slot in one binary literal."""
    packed = F.unhex(F.lit("".join(f"{x:08x}" for x in owner)))
    return spark.range(len(owner), numPartitions=1).select(
        F.col("id").alias("slot"), F.conv(F.hex(F.substring(packed, F.col("id").cast("int") * 4 + 1, F.lit(4))), 16, 10).cast("int").alias("shard")
    )


def place(df: DataFrame, key: str, shards: list[str] | None = None, size: int = TABLE_SIZE, seed: str = SEED) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` (columns of those names, in any case, in ``df`` are replaced).

    A null key is placed as the text ``null``; repeated keys go to the same shard; every row is returned, an empty
    table gives an empty one.
    """
    shards = shards or [f"shard-{i:04d}" for i in range(N_SHARDS)]
    slot = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:row:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") % size
    keep = others(df, "slot", "shard")
    lookup = table_frame(df.sparkSession, lookup_table(shards, size, seed))
    return df.select(*keep, slot.alias("slot")).join(F.broadcast(lookup), "slot").select(*keep, "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, **how) -> None:
    """Write each shard as a folder of its own. Rows stay in their tasks: no shuffle, each task writes to every shard."""
    place(df, key, **how).write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5('{SEED}:offset:shard-' || lpad(i::VARCHAR, 4, '0')), 1, 13))::BIGINT % {TABLE_SIZE} AS off,
         ('0x' || substr(md5('{SEED}:skip:shard-' || lpad(i::VARCHAR, 4, '0')), 1, 13))::BIGINT % {TABLE_SIZE - 1} + 1 AS skip
  FROM range({N_SHARDS}) t(i)),
lists AS (SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM shards),
fill(n, used, slot) AS (
  SELECT 0::BIGINT, list_transform(range({TABLE_SIZE}), lambda x: false), -1::BIGINT
  UNION ALL
  SELECT n + 1, list_concat(used[:nxt], [true], used[nxt + 2:]), nxt FROM (
    SELECT n, used, list_filter(list_transform(range({TABLE_SIZE}), lambda j: (offs[n % {N_SHARDS} + 1] + j * skips[n % {N_SHARDS} + 1]) % {TABLE_SIZE}),
                                lambda s: NOT used[s + 1])[1] AS nxt
    FROM fill, lists WHERE n < {TABLE_SIZE})),
placed AS (SELECT slot, ((n - 1) % {N_SHARDS})::INT AS shard FROM fill WHERE n > 0)
SELECT d.doc_id, d.source, p.slot, p.shard
FROM (SELECT *, ('0x' || substr(md5('{SEED}:row:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
JOIN placed p USING (slot)
"""
