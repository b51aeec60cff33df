"""Operator 1: near-duplicate embeddings by randomised-rotation binary codes.

Every distinct vector is rotated at random and cut to its signs; the code's inner product with the rotated vector is
stored as its correction factor. <code, y> / factor estimates <x, y> without bias, with an error that stays below
``ERROR_SCALE`` standard bounds sqrt((1 - f^2) / f^2 / (bits - 1)). Only pairs whose estimate plus that bound reaches
the threshold are recomputed, in double precision.

Pairs are looked for where vectors meet: in each of several tables a vector's bucket is its largest coordinate, with
sign, under one or more further random rotations. The number of rotations a table follows the number of vectors, so
that buckets stay small, and the number of tables follows the probability, measured by simulation, that a pair at the
threshold shares a bucket: such a pair is missed in all tables with probability ``MISS``, closer ones far less often.

Equal vectors meet once. A bucket of very many vectors is cut into chunks whose pairs go to different tasks. A pair
that meets in several tables counts in the first. Tasks return counts and spanning stars of links, never the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, cached, connected_components, cut, smallest_reachable, table, whole_groups

THRESHOLD, MISS, BUCKET, CHUNK_LIMIT, BITS, ERROR_SCALE, SEED, TILE = 0.9, 1e-4, 512, 4096, 128, 4.5, 20240, 1024


def rotation(dim: int, rows: int, seed: int):
    """``rows`` x ``dim`` matrix of stacked random orthonormal rotations, in single precision."""
    import numpy as np

    rng, out = np.random.default_rng([SEED, dim, seed]), []
    while sum(map(len, out)) < rows:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(out)[:rows].astype(np.float32)


def peak(x, r):
    """Index of the largest coordinate of each row of ``x`` under ``r``, doubled, plus one if it is negative."""
    import numpy as np

    y = x @ r.T
    at = np.abs(y).argmax(axis=1)
    return at * 2 + (y[np.arange(len(y)), at] < 0)


def plan(n: int, dim: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(tables, rotations a table) for ``n`` vectors."""
    import numpy as np

    rng = np.random.default_rng([SEED, dim])
    x, z = rng.standard_normal((2, 20_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
    same = np.abs(x).argmax(axis=1) == np.abs(y).argmax(axis=1)
    p = max(1e-3, float(same.mean()) - 0.01)
    k = max(1, math.ceil(math.log(max(n, 2) / BUCKET) / math.log(max(2, 2 * dim))))
    return (max(1, math.ceil(math.log(miss) / math.log(1 - min(0.999, p**k)))), k) if dim > 1 else (1, 1)


def _valid(c: str):
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & ~bad & F.exists(c, lambda x: x != 0)


def _buckets(plans: dict[int, tuple[int, int]]):
    """Adds to (rep, mult, dim, embedding) the vector as bytes and its bucket in each table."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            dims, col = b.column("dim").to_numpy(), b.column("embedding")
            flat, offsets = col.flatten().to_numpy(), col.offsets.to_numpy() - col.offsets[0].as_py()
            vec, sigs = np.empty(len(dims), object), np.empty(len(dims), object)
            for dim in np.unique(dims):
                tables, k = plans[int(dim)]
                at = np.flatnonzero(dims == dim)
                x = flat[offsets[at][:, None] + np.arange(dim)]
                unit = (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
                sig = np.zeros((len(at), tables), np.int64)
                for t in range(tables):
                    for j in range(k):
                        r = cached(("rotation", int(dim), 1 + t * k + j), lambda t=t, j=j: rotation(int(dim), int(dim), 1 + t * k + j))
                        sig[:, t] = sig[:, t] * (2 * int(dim)) + peak(unit, r)
                for i, v, s in zip(at, x.astype(np.float64), sig):
                    vec[i], sigs[i] = v.astype(np.float32).tobytes() if (v == v.astype(np.float32)).all() else v.tobytes(), s
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("mult"), b.column("dim"), pa.array(vec, pa.binary()), pa.array(list(sigs), pa.list_(pa.int64()))],
                ["rep", "mult", "dim", "vec", "sigs"],
            )

    return run


def _compare(threshold: float):
    def group(t, rep, mult, vec, sigs, chunk, lo, hi):
        """Counts of links and star of the links of one group."""
        import numpy as np

        x = np.stack(vec)
        n, dim = x.shape
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        r = cached(("rotation", dim, 0, BITS), lambda: rotation(dim, max(BITS, dim), 0))
        bits = len(r)
        y = (x.astype(np.float32) @ r.T) * np.float32(math.sqrt(dim / bits))  # unit length up to the stacking of rotations
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        code = np.where(y >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(bits))
        f = (code * y).sum(axis=1)
        slack = ERROR_SCALE * np.sqrt((1 - f * f) / (f * f) / (bits - 1))
        own = np.array([s[:t] for s in sigs], np.int64).reshape(n, t)
        count, label = np.zeros(n, np.int64), np.arange(n)
        for a in range(0, n, TILE):
            for b in range(a, n, TILE):
                est = (code[a : a + TILE] @ y[b : b + TILE].T) / f[a : a + TILE, None] + slack[a : a + TILE, None]
                i, j = np.nonzero(est >= threshold)
                i, j = i + a, j + b
                keep = (i < j) & ((chunk[i] != chunk[j]) | (lo == hi))
                i, j = i[keep], j[keep]
                for s in range(0, len(i), 1 << 17):
                    p, q = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
                    linked = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                    p, q = p[linked], q[linked]
                    if not len(p):
                        continue
                    label = smallest_reachable(n, np.r_[np.arange(n), p], np.r_[label, q])
                    first = ~(own[p] == own[q]).any(axis=1)
                    p, q = p[first], q[first]
                    np.add.at(count, p, mult[q])
                    np.add.at(count, q, mult[p])
        return count, label

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part in whole_groups(batches, least=2_000):
            g, dims, ts = (part.column(c).to_numpy() for c in ("g", "dim", "t"))
            rep, mult, chunk, los, his = (part.column(c).to_numpy() for c in ("rep", "mult", "chunk", "lo", "hi"))
            vec = part.column("vec").to_pylist()
            sigs = part.column("sigs").combine_chunks()
            wide = sigs.flatten().to_numpy()
            at_sig = sigs.offsets.to_numpy() - sigs.offsets[0].as_py()
            order = np.lexsort((rep, ts, dims, g))
            edge = np.flatnonzero(np.r_[True, (np.diff(g[order]) != 0) | (np.diff(dims[order]) != 0) | (np.diff(ts[order]) != 0), True])
            out = [[], [], []]
            for s, e in zip(edge[:-1], edge[1:]):
                if e - s < 2:
                    continue
                at = order[s:e]
                dim = int(dims[at[0]])
                own = [np.frombuffer(vec[k], np.float32 if len(vec[k]) == 4 * dim else np.float64).astype(np.float64) for k in at]
                count, label = group(int(ts[at[0]]), rep[at], mult[at], own, [wide[at_sig[k] : at_sig[k + 1]] for k in at], chunk[at], los[at[0]], his[at[0]])
                hit = np.flatnonzero((count > 0) | (label != np.arange(len(at))))
                for o, v in zip(out, (rep[at][hit], count[hit], rep[at][label[hit]])):
                    o.append(v)
            arrays = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Links join vectors of equal dimension with cosine >= ``threshold``. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without id, link with nothing: no links, their own id as component. Rows
    of equal vectors link with one another, those of one id too. Different vectors under one smallest id are one vector
    with the links of all. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("_ok", F.coalesce(F.col("vec_id").isNotNull() & _valid("embedding"), F.lit(False)))
    for k in ("k1", "k2"):
        rows = rows.withColumn(k, F.when(F.col("_ok"), F.xxhash64(F.lit(k), "embedding")))
    member = cut(rows.select("vec_id", "_ok", "k1", "k2"))
    distinct = rows.where("_ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding"))
    distinct = cut(distinct.select("k1", "k2", "rep", "mult", F.size("embedding").alias("dim"), "embedding"))
    plans = {r["dim"]: plan(r["count"], r["dim"], threshold) for r in distinct.groupBy("dim").count().collect()}  # a row a dimension
    bucketed = distinct.select("rep", "mult", "dim", "embedding").mapInArrow(_buckets(plans), "rep long, mult long, dim int, vec binary, sigs array<long>")
    met = cut(bucketed).select("*", F.posexplode("sigs").alias("t", "bucket"))
    dealt = block_pairs(met, ["dim", "t", "bucket"], "rep", CHUNK_LIMIT)
    found = cut(dealt.select("g", "dim", "t", "rep", "mult", "vec", "sigs", "chunk", "lo", "hi").mapInArrow(_compare(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    of = distinct.select("k1", "k2", "rep", "mult").join(links, "rep", "left").join(parts, "rep", "left")
    of = of.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = member.join(of, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
