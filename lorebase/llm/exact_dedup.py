"""Operator 12: exact deduplication by progressive refinement.

Texts are equal when they are identical after each run of ASCII white space became one space. Three steps, each on what
the one before left: (1) the length of the normalised text; (2) the hash of its first ``PREFIX`` characters, for lengths
that occur twice; (3) SHA-256 of the whole text, for (length, prefix hash) groups of two rows or more.

The first two steps run on a narrow table of two numbers a row, written by one scan. The third must know at the scan
which rows survive, without a shuffle of texts: the surviving groups set bits in a bitmap of ``bits`` bits, whatever
the data, which is broadcast. A row whose bit is set by another group is hashed for nothing and changes no result.

Only DataFrame functions are used. Group-bys combine on the map side; every table that large ones are joined with has
a row a key and is written first, so its size is known: it is broadcast below Spark's threshold, and beyond it a hot
key is split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, others, private, release, table

PREFIX, BITS = 256, 1 << 25
#: Spark's bitmap functions make bitmaps of so many bits a row.
BUCKET = 32768


def normalised(text: Column | str) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty. Single spaces are not matched, so most text is copied whole."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[ \\t-\\r]{2,}|[\\t-\\r]", " ")


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns that Spark can hash: rows of one id are told apart by it."""
    return F.xxhash64(*[F.col(c) for c, (_, kind) in zip(others(docs), docs.dtypes) if "map<" not in kind and "variant" not in kind])


def _measured(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Rows (id, t, n, p, h): normalised text, its length in bytes, its prefix hash, the hash of the whole row."""
    rows = docs.select(F.col(id_).alias("id"), normalised(text).alias("t"), _row_hash(docs).alias("h"))
    return rows.select("id", "t", F.octet_length("t").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX)).alias("p"), "h")


def surviving(narrow: DataFrame) -> DataFrame:
    """(n, p) of steps 1 and 2: lengths of two rows or more, and in these the prefix hashes of two rows or more."""
    lengths = cut(narrow.groupBy("n").count().where("count > 1").select("n"))
    left = narrow.join(lengths, "n", "left_semi")
    return left.groupBy("n", "p").count().where("count > 1").select("n", "p")


def bitmap(groups: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, map): a bitmap of ``bits`` bits with the bit of each group set; at most ``bits / 32768`` rows of 4 KB."""
    at = F.pmod(F.xxhash64("n", "p"), F.lit(bits))
    return groups.select(F.floor(at / BUCKET).cast("int").alias("bucket"), (at % BUCKET).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))


def hashed(docs: DataFrame, id_: str = "doc_id", text: str = "text", bits: int = BITS, every: bool = False) -> DataFrame:
    """Steps 1 to 3: (id, h, live, sha, u) of every row. Rows that the first two steps showed to be alone are not
    ``live`` and have no ``sha``, unless ``every`` asks for the digest of each text; ``u`` numbers the rows."""
    narrow = cut(_measured(docs, id_, text).select("n", "p"))
    groups = cut(surviving(narrow))
    maps = cut(bitmap(groups, bits).coalesce(1))
    at = F.pmod(F.xxhash64("n", "p"), F.lit(bits))
    rows = _measured(docs, id_, text).withColumn("bucket", F.floor(at / BUCKET).cast("int")).withColumn("bit", (at % BUCKET).cast("int"))
    byte = F.conv(F.hex(F.substring("map", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    live = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1, F.lit(False))
    rows = rows.join(F.broadcast(maps), "bucket", "left").withColumn("live", live)  # ``bits / 8`` bytes at most
    sha = F.sha2("t", 256) if every else F.when(F.col("live"), F.sha2("t", 256))
    out = cut(rows.select("id", "h", "live", sha.alias("sha")).withColumn("u", F.monotonically_increasing_id()))
    release(narrow, groups, maps)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """(sha, first, size) of classes of two rows or more; ``first`` is the row that stays."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "u")).alias("first")
    return cut(rows.where("live").groupBy("sha").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1"))


def duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", bits: int = BITS, every: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha) for every row of ``docs``, dropped ones too; ``sha`` as in ``hashed``.

    Of equal texts the row with the smallest id stays; of rows that repeat it, exactly one (that of the smallest row
    hash). A null text counts as empty, and empty texts are equal. A row without id takes part and stays only if no row
    of its class has an id; ``keep_id`` is null then. Other columns may have any names; an empty table gives an empty
    result; the length of a text is bounded only by what a row can hold.
    """
    rows = hashed(docs, id_, text, bits, every)
    got = rows.join(_classes(rows), "sha", "left")
    alone = F.col("size").isNull()
    return got.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("first.u") == F.col("u"))).alias("kept"), "sha",
    )


def drop_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each class of equal texts, chosen as in ``duplicates``; all columns stay as they are.

    The texts are scanned again and meet the rows of classes of two or more by (id, row hash): of such a group one row
    stays if it leads its class, else none.
    """
    keep = others(docs)
    key, hash_, id2, hash2, leads = private(docs.columns, "id", "h", "id2", "h2", "leads")
    rows = hashed(docs, id_, text, bits)
    many = rows.join(_classes(rows), "sha").groupBy(F.col("id").alias(id2), F.col("h").alias(hash2)).agg(F.max(F.col("first.u") == F.col("u")).alias(leads))
    met = docs.withColumns({key: F.col(id_), hash_: _row_hash(docs)})
    met = met.join(cut(many), F.col(key).eqNullSafe(F.col(id2)) & (F.col(hash_) == F.col(hash2)), "left")
    return met.where(F.col(leads).isNull()).select(*keep).union(met.where(leads).dropDuplicates([key, hash_]).select(*keep))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), every=True)
    return found.withColumnRenamed("sha", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
h AS (SELECT doc_id, sha256(n) AS text_sha256, n FROM t)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY doc_id) = 1 AS kept, text_sha256
FROM h
"""
