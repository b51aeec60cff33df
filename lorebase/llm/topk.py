"""Operator 7: exact top-k inner products by pivot-table elimination.

The distances of every vector to many pivots are computed once and travel with it. They place a vector in the space that
the pivots span, but for its distance from it, which is known. So for a query q and a row x they give the greatest lower
bound of d(q, x) that distances to these pivots allow: that of two points on the same side of that space. It is never
below |d(q, p) - d(x, p)| for any pivot p, and it is an upper bound of <q, x> = (|q|^2 + |x|^2 - d^2) / 2. A query's
candidates are evaluated in the order of these bounds until no bound is left that reaches the k-th best exact score.
Pivots are taken from a bounded pool, each the farthest from the space of those before it, until the pool keeps less than
``REST`` of its squared length outside.

A query starts from the k-th best score among the pool, which are rows themselves. Each row's home is its nearest pivot;
<q, p> + |q| * radius bounds the scores of a home, and homes that cannot reach a query's first score never meet it. Small
homes are packed into groups, large ones cut, and groups dealt to lanes; a task holds one block of queries and streams
the groups of one lane past it, so what a query has found in one group stops it earlier in the next, and a lane returns
at most k rows a query, none below the query's first score. A window over those ranks them. There are no more lanes than
give every core one, so the rows returned are at most queries times k times lanes, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

K, SCALE, PIVOTS, REST, POOL, GROUP_ROWS, TILE, FIRST, SLACK = 20, 64, 512, 0.06, 1024, (1024, 1 << 18), 256, 64, 2e-5
#: Queries of a block, at most so many and so many bytes of components; the table is read once a block.
QUERY_BLOCK, QUERY_BYTES = 1 << 15, 1 << 25
#: The score of no row; its negative is a long too.
NONE = -(2**63 - 1)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x"))


class Pivots:
    """Pivots of one dimension, from a pool of vectors of it."""

    def __init__(self, pool, most: int = PIVOTS, rest: float = REST):
        import numpy as np

        x = np.array(pool, np.float64)
        left, chosen, axes = x.copy(), [], np.zeros((0, x.shape[1]))
        length = (x**2).sum(axis=1)
        while len(chosen) < min(most, len(x)):
            far = (left**2).sum(axis=1)
            # as a share of each vector's own length, so that one far outlier does not hide all others
            share = far / np.maximum(length, 1e-300)
            if chosen and share.mean() < rest or far.max() <= 1e-9 * length.max():
                break
            k = int(np.where(far > 1e-6 * length, far, 0).argmax()) if not chosen else int(np.where(share > 1e-6, far, 0).argmax())
            axis = left[k] - axes.T @ (axes @ left[k])
            norm = np.linalg.norm(axis)
            if norm <= 1e-6 * math.sqrt(max(length[k], 1e-300)):
                break
            axes = np.r_[axes, axis[None] / norm]
            chosen.append(k)
            left -= (left @ axes[-1])[:, None] * axes[-1]
        self.at = x[chosen] if chosen else np.zeros((1, x.shape[1]))
        self.norm = np.sqrt((self.at**2).sum(axis=1))
        unit = self.at / np.maximum(self.norm, 1e-300)[:, None]
        self.to_axes = np.linalg.inv(np.linalg.cholesky(unit @ unit.T)).T if chosen else np.zeros((1, 1))

    def distances(self, x):
        """Squared distances to every pivot."""
        import numpy as np

        return np.maximum((x * x).sum(axis=1)[:, None] + (self.norm**2)[None] - 2 * x @ self.at.T, 0)

    def place(self, far, length):
        """Coordinates in the space of the pivots, and the distance from it as the last one, from squared distances and lengths."""
        import numpy as np

        y = (length[:, None] + (self.norm**2)[None] - far) / 2 / np.maximum(self.norm, 1e-300) @ self.to_axes
        out = np.sqrt(np.maximum(length - (y * y).sum(axis=1), 0) + 1e-6 * length)  # room for rounding: never too near
        return np.c_[y, out].astype(np.float32)


def _rows(column, ids):
    """Vectors of an Arrow list column by dimension: (dimension, places, matrix of integers)."""
    import numpy as np

    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    dims = np.diff(offsets)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        if dim:
            yield int(dim), at, flat[offsets[at][:, None] + np.arange(dim)].astype(np.int64)


def _prepare(pivots: dict[int, Pivots], plan=None, pool=None, k: int = K):
    """Batches (vec_id, x) to (vec_id, dim, x, far, home, near), or for queries to (vec_id, dim, x, far, first, groups)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for dim, at, x in _rows(b.column("x"), ids):
                own = pivots.get(dim)
                wide = x.astype(np.float64)
                far = own.distances(wide) if own else np.zeros((len(at), 0))
                columns = [pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([d.tobytes() for d in far], pa.binary())]
                if plan is None:
                    home = far.argmin(axis=1) if own else np.full(len(at), -1)
                    near = np.sqrt(far[np.arange(len(at)), home]) if own else np.zeros(len(at))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(home.astype(np.int32)), pa.array(near)], ["vec_id", "dim", "x", "far", "home", "near"])
                    continue
                first, groups = np.full(len(at), -np.inf), [plan["others"]] * len(at)
                if own:
                    pool_ids, pool_x = pool[dim]
                    score = wide @ pool_x.T.astype(np.float64)
                    room = 1e-9 * np.sqrt((wide**2).sum(axis=1))[:, None] * np.sqrt((pool_x.astype(np.float64) ** 2).sum(axis=1))[None]
                    score = np.where(ids[at][:, None] == pool_ids[None], -np.inf, score - room)
                    if len(pool_ids) > k:
                        first = np.partition(score, len(pool_ids) - k, axis=1)[:, len(pool_ids) - k]
                    homes, radius, of = plan["homes"][dim]
                    length = np.sqrt((wide**2).sum(axis=1))
                    reach = wide @ own.at[homes].T + length[:, None] * (radius * (1 + 1e-6))[None] + 1e-6 * length[:, None] * (own.norm[homes] + 1)[None] + 1
                    met = reach >= first[:, None]
                    groups = [sorted({g for h in np.flatnonzero(m) for g in of[h]}) for m in met]
                columns += [pa.array(first), pa.array(groups, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "x", "far", "first", "groups"])

    return run


class Block:
    """Queries of one dimension with their best rows so far. ``evaluated`` and ``seen`` count exact scores and pairs.

    ``groups``: the groups that each query meets, as lists; without it all queries meet all rows.
    """

    def __init__(self, ids, x, y, length, first, k: int, groups=None):
        import numpy as np

        self.ids, self.x, self.y, self.length, self.first, self.k = ids, x, y, np.sqrt(length), first, k
        self.score, self.row = np.full((len(ids), k), NONE), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.wide, self.most = x.astype(np.float64), float(np.abs(x.astype(np.float64)).max())
        self.evaluated = self.seen = 0
        self.meets = None
        if groups is not None:
            each, flat = np.repeat(np.arange(len(ids)), [len(g) for g in groups]), np.array([g for own in groups for g in own])
            order = np.argsort(flat, kind="stable")
            names, at = np.unique(flat[order], return_index=True)
            self.meets = dict(zip(names.tolist(), np.split(each[order], at[1:])))

    def _keep(self, i, ids, v) -> None:
        """Take exact scores ``v`` of rows ``ids`` for the queries ``i``."""
        import numpy as np

        some = np.unique(i)
        a = np.r_[np.repeat(np.arange(len(some)), self.k), np.searchsorted(some, i)]
        score, row = np.r_[self.score[some].ravel(), v], np.r_[self.row[some].ravel(), ids]
        order = np.lexsort((row, -score, a))
        place = np.arange(len(a)) - np.searchsorted(a[order], a[order])
        order = order[place < self.k]
        self.score[some], self.row[some] = score[order].reshape(-1, self.k), row[order].reshape(-1, self.k)

    def meet(self, ids, x, y, length, group=None) -> None:
        """Hold rows, all of one ``group``, against the queries that meet it."""
        import numpy as np

        asking = np.arange(len(self.ids)) if self.meets is None else self.meets.get(group, [])
        if not len(asking):
            return
        wide = x.astype(np.float64)
        most = self.most * float(np.abs(wide).max()) * x.shape[1]
        small = most < 2**53  # then exact in double precision
        norms = np.sqrt(length)
        for s in range(0, len(asking), TILE):
            some = asking[s : s + TILE]
            bound = self.y[some] @ y.T
            bound += (SLACK * self.length[some, None] * norms[None] + 1).astype(np.float32)
            bound[self.ids[some, None] == ids[None]] = -np.inf
            self.seen += bound.size
            size = FIRST
            while True:
                reach = np.maximum(self.first[some], self.score[some, -1])  # in bound order, all others come after the exact stop
                open_ = (bound >= reach[:, None]) & (bound > -np.inf)
                n = open_.sum(axis=1)
                if not n.any():
                    break
                if size * 4 < n.max() and size < len(ids):
                    ranked = np.where(open_, bound, -np.inf)
                    open_ &= ranked >= np.partition(ranked, len(ids) - size, axis=1)[:, len(ids) - size][:, None]
                a, b = np.nonzero(open_)
                self.evaluated += len(a)
                for c in range(0, len(a), 1 << 17):
                    i, j = a[c : c + (1 << 17)], b[c : c + (1 << 17)]
                    v = np.einsum("ij,ij->i", self.wide[some[i]], wide[j])
                    if not small:  # modulo 2 ** 64, so right where the sum itself is a long
                        if most >= 2**62 and (np.abs(v) >= 2**63 * (1 - 1e-9)).any():
                            raise OverflowError("an inner product is beyond 64 bits")
                        v = np.einsum("ij,ij->i", self.x[some[i]], x[j])
                    self._keep(some[i], ids[j], v.astype(np.int64))
                bound[open_] = -np.inf
                size *= 16

    def best(self):
        """(query ids, row ids, scores) of all that were kept and can be among a query's best."""
        import numpy as np

        i, j = np.nonzero((self.score > NONE) & (self.score >= self.first[:, None]))
        return self.ids[i], self.row[i, j], self.score[i, j]


def _search(pivots: dict[int, Pivots], k: int):
    """Rows of a block and lane, its queries first, then group by group, in batches that may begin and end anywhere."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lane, waiting, blocks = None, [], {}

        def flush():
            for block in blocks.values():
                q, x, v = block.best()
                for s in range(0, len(q), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 50_000]) for c in (q, x, v)], ["query_id", "vec_id", "score"])

        def unpack(part):
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = part.take(pa.array(np.flatnonzero(dims == dim)))
                n, own = some.num_rows, pivots.get(dim)
                x = np.frombuffer(b"".join(some.column("x").to_pylist()), np.int64).reshape(n, dim)
                length = (x.astype(np.float64) ** 2).sum(axis=1)
                if own:
                    y = own.place(np.frombuffer(b"".join(some.column("far").to_pylist()), np.float64).reshape(n, -1), length)
                else:  # no pivots: lengths alone bound
                    y = np.sqrt(length)[:, None].astype(np.float32)
                yield dim, some, x, y, length

        def meet(part):
            groups = part.column("group").to_numpy()
            edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
            for s, e in zip(edge[:-1], edge[1:]):
                for dim, some, x, y, length in unpack(part.slice(s, e - s)):
                    if dim in blocks:
                        blocks[dim].meet(some.column("vec_id").to_numpy(), x, y, length, int(groups[s]))

        for batch in batches:
            g = batch.column("g").to_numpy()
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else []
            for s, e in zip(edge[:-1], edge[1:]):
                part = batch.slice(s, e - s)
                if g[s] != lane:
                    yield from flush()
                    lane, waiting, blocks = g[s], [], {}
                asks = part.column("is_query").to_numpy(zero_copy_only=False)
                n = int(asks.sum())
                if n:
                    waiting.append(part.slice(0, n))
                if n < len(asks):
                    if waiting:
                        for dim, some, x, y, length in unpack(pa.Table.from_batches(waiting).combine_chunks()):
                            blocks[dim] = Block(some.column("vec_id").to_numpy(), x, y, length, some.column("first").to_numpy(), k, some.column("groups").to_pylist())
                        waiting = []
                    for c in range(n, len(asks), 8192):
                        meet(part.slice(c, min(8192, len(asks) - c)))
        yield from flush()

    return run


def _plan(homes: list, n_blocks: int, parallelism: int) -> tuple[dict, dict, int]:
    """Groups of about equal numbers of rows: ({(dim, home): (first group, number)}, what queries need, number of groups)."""
    import numpy as np

    total = sum(n for _, _, n, _ in homes)
    limit = min(max(math.ceil(total * n_blocks / (4 * parallelism)), GROUP_ROWS[0]), GROUP_ROWS[1])
    of, at, room = {}, -1, 0
    for dim, home, n, _ in sorted(homes, key=lambda h: (h[0], h[1])):
        if n > limit // 2:  # groups of its own
            count = math.ceil(n / limit)
            of[dim, home], at, room = (at + 1, count), at + count, 0
        else:
            if n > room:
                at, room = at + 1, limit
            of[dim, home] = (at, 1)
            room -= n
    reach = {}
    for dim in {h[0] for h in homes}:
        own = sorted((h, r) for d, h, _, r in homes if d == dim)
        reach[dim] = (np.array([h for h, _ in own]), np.array([r for _, r in own]), [list(range(of[dim, h][0], sum(of[dim, h]))) for h, _ in own])
    others = list(range(of[-1, -1][0], sum(of[-1, -1]))) if (-1, -1) in of else []
    return of, {"homes": reach, "others": others}, at + 1


def top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best ``rows`` of each of ``queries``, both (vec_id, x array<long>).

    A query's own id is no candidate; vectors meet those of equal dimension; vectors of no components score nothing.
    Ties go to the smaller id; a repeated query id is one query per row and ranks its rows together; a candidate id
    that repeats is a row each time. Fewer rows than ``k`` are all returned; an inner product beyond 64 bits is an error; empty tables give an empty result. Other
    columns are ignored. A dimension that the pool of ``POOL`` rows lacks has no pivots, and lengths alone bound there.
    """
    import numpy as np

    spark = rows.sparkSession
    picked = rows.where(F.size("x") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(POOL).select("vec_id", "x").collect()
    pool = {}
    for dim in {len(r["x"]) for r in picked}:
        own = [r for r in picked if len(r["x"]) == dim]
        pool[dim] = (np.array([r["vec_id"] for r in own]), np.array([r["x"] for r in own], np.int64))
    pivots = {dim: Pivots(x) for dim, (_, x) in pool.items()}
    x = cut(rows.select("vec_id", "x").mapInArrow(_prepare(pivots), "vec_id long, dim int, x binary, far binary, home int, near double"))
    bounded = F.when(F.col("home") < 0, -1).otherwise(F.col("dim"))  # so rows of dimensions that the pool lacks are one home
    homes = [tuple(r) for r in x.groupBy(bounded.alias("d"), "home").agg(F.count(F.lit(1)), F.max("near")).collect()]  # a row a pivot at most
    n_queries = queries.count()
    n_blocks = max(1, math.ceil(n_queries / max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(pool, default=1))))))
    parallelism = spark.sparkContext.defaultParallelism
    of, plan, n_groups = _plan(homes, n_blocks, parallelism)
    lanes = max(1, min(n_groups, math.ceil(parallelism / n_blocks)))
    asked = queries.select("vec_id", "x").mapInArrow(_prepare(pivots, plan, pool, k), "vec_id long, dim int, x binary, far binary, first double, groups array<int>")
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_blocks)).cast("int")))
    number = F.col("block") * lanes + F.col("lane")
    q = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("groups", F.filter("groups", lambda g: g % lanes == F.col("lane"))).where(F.size("groups") > 0)
    q = q.select(number.alias("g"), F.lit(True).alias("is_query"), F.lit(-1).alias("group"), "vec_id", "dim", "x", "far", "first", "groups")
    dealt = spark.createDataFrame([(d, h, a, c) for (d, h), (a, c) in of.items()], "d int, home int, start int, n int")  # a row a pivot at most
    x = x.withColumn("d", bounded.cast("int")).join(F.broadcast(dealt), ["d", "home"])
    x = x.withColumn("group", (F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("n"))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = cut(asked.select("block", F.explode("groups").alias("group")).distinct())
    x = x.join(met, ["block", "group"], "left_semi").withColumn("lane", F.col("group") % lanes)
    x = x.select(number.alias("g"), F.lit(False).alias("is_query"), "group", "vec_id", "dim", "x", "far", F.lit(0.0).alias("first"), F.lit(None).cast("array<int>").alias("groups"))
    both = q.unionByName(x).repartitionById(n_blocks * lanes, F.col("g").cast("int")).sortWithinPartitions("g", F.desc("is_query"), "group")
    found = both.mapInArrow(_search(pivots, k), "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("vec_id % 20 = 0"), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: v.x[i] * q.x[i]))::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
WHERE rank <= 20
"""
