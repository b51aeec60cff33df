"""Helpers shared by the operators: connected components, comparison groups, private columns, worker caches."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import cut, forget, made, recording, release, scratch, shared_dir  # noqa: F401

#: Edge tables of up to so many rows are finished in one task, by the same rule as larger ones; 16 bytes a row.
FINISH = 1_000_000


def private(names: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``names``, whatever their case."""
    taken, prefix = {n.lower() for n in names}, "_lb_"
    while any(n.startswith(prefix) for n in taken):
        prefix = "_" + prefix
    return [prefix + w for w in wanted]


def others(df: DataFrame, *replaced: str) -> list[str]:
    """Columns of ``df``, quoted, without those that are called ``replaced`` in any case."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in {r.lower() for r in replaced}]


def _finish(batches):
    import numpy as np
    import pyarrow as pa

    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    label = smallest_reachable(len(ids), at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label] if len(ids) else ids)], ["id", "parent"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", finish: int = FINISH) -> DataFrame:
    """Smallest reachable id of every id that occurs in ``edges``: columns ``id``, ``component``.

    Rounds of contraction. Each id points to its smallest neighbour or itself, pointers are followed until they stand
    still (each jump doubles their reach), edges are relabelled by them, loops and repeats vanish. An id that absorbs
    none in one round has a smaller neighbour in the next, so the ids at least halve in two rounds and rounds grow with
    their logarithm. When ``finish`` edges or
    fewer are left, one task gets the same labels by the same rule. Every table is written to the shared folder and
    deleted when the next one is. Null ends and self-loops link nothing. Group-bys combine on the map side and the
    joins have one row per key on one side, so a hub of millions of edges is split by adaptive skew handling.
    """
    e = cut(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    parents: list[DataFrame] = []
    while (n := e.count()) > finish:
        both = e.select(F.col("a").alias("id"), F.col("b").alias("to")).union(e.select(F.col("b"), F.col("a")))
        p = cut(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("parent")))
        while True:  # a pointer to a larger or equal id ends; others follow the pointer of where they point
            up = p.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
            far = cut(p.join(up, "parent").select("id", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
            moved = far.where("moved").limit(1).count()
            release(p)
            p = far
            if not moved:
                break
        p = p.select("id", "parent")
        p._lorebase_path = far._lorebase_path
        parents.append(p)
        pa, pb = p.select(F.col("id").alias("a"), F.col("parent").alias("pa")), p.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        new = cut(
            e.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a != b").distinct()
        )
        release(e)
        e = new
    if n:
        parents.append(cut(e.coalesce(1).mapInArrow(_finish, "id long, parent long")))
        release(e)
    if not parents:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    out = parents[0].select("id", F.col("parent").alias("component"))
    for p in parents[1:]:
        step = p.select(F.col("id").alias("component"), F.col("parent").alias("_next"))
        out = out.join(step, "component", "left").select("id", F.coalesce("_next", "component").alias("component"))
    return out


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, whichever task fills it."""
    return sys.modules["pyspark"].__dict__.setdefault("_lorebase_cache", {})


def cached(key, make):
    """The worker's value for ``key``, made once."""
    cache = worker_cache()
    if key not in cache:
        cache[key] = make()
    return cache[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches, key: str = "g", least: int = 50_000):
    """Arrow batches sorted by ``key`` regrouped into tables of whole groups, of at least ``least`` rows where possible."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held)
        g = t.column(key).to_numpy()
        at = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
        if at:
            yield t.slice(0, at)
        held, n = t.slice(at).combine_chunks().to_batches(), t.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(rows: DataFrame, keys: list[str], row: str, limit: int) -> DataFrame:
    """Rows dealt to comparison groups ``g``: a group of ``keys`` of up to ``limit`` rows is one; a larger one is cut into
    chunks by the hash of ``row``, and each pair of chunks (``lo`` <= ``hi``) is a group. ``chunk`` is a row's own."""
    hot = rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("_c"))
    hot = cut(hot.coalesce(8))  # written: its size is then known, and the rows meet it without a shuffle while it is small
    c = F.coalesce("_c", F.lit(1))
    rows = rows.join(hot, keys, "left").withColumn("chunk", F.pmod(F.xxhash64(row), c).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.struct(F.least("chunk", j).alias("lo"), F.greatest("chunk", j).alias("hi")))
    rows = rows.withColumn("_p", F.explode(pairs)).withColumn("lo", F.col("_p.lo")).withColumn("hi", F.col("_p.hi")).drop("_p", "_c")
    return rows.withColumn("g", F.xxhash64(*keys, "lo", "hi")).repartition("g").sortWithinPartitions("g")


def smallest_reachable(n: int, i, j):
    """Smallest index reachable from each of ``n`` by the links (i, j), numpy arrays."""
    import numpy as np

    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new
