"""Operator 9: SimHash near-duplicates by BK-trees.

Fingerprints within r bits agree wholly on one of r + 1 equal blocks of bits, so each distinct fingerprint joins r + 1
shards, one a block value, and every link lies within a shard. A shard's fingerprints form a BK-tree: children are
keyed by integer Hamming distance to the parent, and a search at distance d follows only edges in [d - r, d + r]. All
trees of a task are built and searched together, level by level, on arrays.

A broadcast of all trees has no size bound, so a shard's tree is built in the task that the shuffle gives the shard's
fingerprints, which are also its queries. Copies meet once, as one fingerprint; a shard of very many fingerprints is
cut into chunks whose pairs go to different tasks. Tasks return a spanning star of the links, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import lengths_of, slices
from .common import block_pairs, connected_components, cut, private, smallest_reachable, table, whole_groups

WORDS, RADIUS, SEED, SHARD_LIMIT, FRONTIER = 3, 3, 42, 8192, 1 << 20


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the hashes of the word shingles. No words: 0."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not w:
        return 0
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    count, n, h = np.zeros(64, np.int64), len(w) - words + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        some = w[at : min(at + (1 << 16), n) + words - 1]
        hashes = np.array([h(s, seed) for s in map(b" ".join, zip(*[some[k:] for k in range(words)]))], ">u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp as signed long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column("text")
            fp = [fingerprint(t, words, seed) for s, e in slices(lengths_of(texts)) for t in texts.slice(s, e - s).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees over distinct fingerprints ``fp``, one a value of ``tree`` (sorted)."""

    def __init__(self, fp, tree):
        import numpy as np

        self.fp, n = fp, len(fp)
        first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        left = np.flatnonzero(self.root != np.arange(n))
        at, keys, children = self.root[left], [], []
        while len(left):
            key = at * 65 + np.bitwise_count(fp[left] ^ fp[at])
            new, where, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(new)
            children.append(left[where])
            at = left[where][back]
            rest = at != left
            left, at = left[rest], at[rest]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.children = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def links(self, radius: int):
        """Pieces (i, j), i < j, of all pairs of one tree within ``radius`` bits."""
        import numpy as np

        n = len(self.fp)
        stack = [(np.arange(a, min(a + FRONTIER, n)), self.root[a : a + FRONTIER]) for a in range(0, n, FRONTIER)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[FRONTIER:], node[FRONTIER:])]
                q, node = q[:FRONTIER], node[:FRONTIER]
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (q < node)
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n_edges = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - lo
            total = int(n_edges.sum())
            if total:
                start = np.repeat(lo - np.r_[0, np.cumsum(n_edges)[:-1]], n_edges)
                stack.append((np.repeat(q, n_edges), self.children[start + np.arange(total)]))


def _stars(radius: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in whole_groups(batches):
            g, rep = t.column("g").to_numpy(), t.column("rep").to_numpy()
            f = Forest(t.column("fp").to_numpy().view(np.uint64), g)
            order = np.argsort(rep, kind="stable")  # labels by rank of representative, so that the smallest one leads
            rank = np.empty(len(rep), np.int64)
            rank[order] = np.arange(len(rep))
            label = np.arange(len(rep))
            for i, j in f.links(radius):
                got = smallest_reachable(len(rep), np.r_[np.arange(len(rep)), rank[i]], np.r_[label, rank[j]])
                label = got
            at = np.flatnonzero(label != np.arange(len(rep)))
            a, b = rep[order][label[at]], rep[order][at]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that span the links of (fp, rep) rows."""
    width = 64 // (radius + 1)
    value = lambda k: F.shiftrightunsigned("fp", 64 - width * (k + 1) if k < radius else 0).bitwiseAND(
        F.lit((1 << (width if k < radius else 64 - width * radius)) - 1)
    )
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), value(k).alias("value")) for k in range(radius + 1)])
    rows = distinct.select("fp", "rep", F.explode(blocks).alias("x")).select("fp", "rep", "x.block", "x.value")
    dealt = block_pairs(rows, ["block", "value"], "fp", SHARD_LIMIT).select("g", "fp", "rep")
    return dealt.mapInArrow(_stars(radius), "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other; a row without id takes no part in linking and has
    no component; rows of the same id are rows of their own with one id; other columns are ignored; an empty table
    gives an empty result.
    """
    fps = cut(fingerprints(docs))
    distinct = cut(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(distinct, radius)).withColumnRenamed("id", "rep")
    of = distinct.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Rows without id stay.

    Of rows that repeat the kept id one stays.
    """
    (mine,) = private(docs.columns, "kept")
    kept = components(docs, radius).where("doc_id = component_id").select(F.col("doc_id").alias(mine)).distinct()
    with_id = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col(mine), "left_semi").dropDuplicates(["doc_id"])
    return with_id.unionByName(docs.where("doc_id IS NULL"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
