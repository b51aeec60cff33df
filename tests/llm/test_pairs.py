"""Operators on pairs and searches, against brute force on small tables with awkward rows."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorebase.llm import embedding_dedup, simhash, topk
from lorebase.llm.common import connected_components


def closure(n, pairs):
    label = list(range(n))
    while True:
        new = list(label)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, 1), (7, 7)], "a long, b long")).collect()}
    label = closure(400, pairs)
    assert got == {i: label[i] for p in pairs for i in p if any(i in q and q[0] != q[1] for q in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_need_few_rounds(spark):
    from lorebase.llm import common

    rng = random.Random(2)
    ids = rng.sample(range(10**6), 5000)  # a path of ids in no order, one in order, a star about its largest id
    pairs = list(zip(ids, ids[1:])) + [(2_000_000 + i, 2_000_001 + i) for i in range(4999)] + [(3_000_000 + i, 4_000_000) for i in range(3000)]
    for finish, most in ((0, 20), (common.FINISH, 1)):
        before = common.made()
        got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), finish=finish).collect()}
        left = len(common.made() - before)
        assert got == {i: min(ids) for i in ids} | {2_000_000 + i: 2_000_000 for i in range(5000)} | {i: 3_000_000 for i in [*range(3_000_000, 3_003_000), 4_000_000]}
        assert left <= most  # one table of pointers a round


def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k in range(60, 130):  # near copies at all distances about the threshold
        v = base[k % 20] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.3, 0.45])
        rows.append((k, v.tolist()))
    rows += [(200 + i, (base[0] * (i + 1)).tolist()) for i in range(30)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [float("inf")] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, [1.0, 2.0]), (307, [1.0, 2.1]), (None, base[0].tolist()), (5, base[5].tolist())]
    return rows


def test_embedding_near_duplicates(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash")).withColumn("rep", F.lit(1))
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    ok = [i for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    real = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i in ok and v and i is not None]
    pairs = [(a, b) for a in range(len(real)) for b in range(a) if len(real[a][1]) == len(real[b][1]) and real[a][1] @ real[b][1] / np.linalg.norm(real[a][1]) / np.linalg.norm(real[b][1]) >= 0.9]
    order = sorted(range(len(real)), key=lambda k: real[k][0])
    place = {k: p for p, k in enumerate(order)}
    label = closure(len(real), [(place[a], place[b]) for a, b in pairs])
    want = [(real[k][0], sum(k in p for p in pairs), real[order[label[place[k]]]][0]) for k in range(len(real))]
    want += [(-1 if i is None else i, 0, -1 if i is None else i) for i, v in rows if i is None or i not in ok]
    assert got == sorted((i, n, c, i == c) for i, n, c in want)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    r = embedding_dedup.rotation(64, 128, 0)
    x, y = rng.standard_normal((2, 400, 64))
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    rx, ry = x @ r.T / math.sqrt(2), y @ r.T / math.sqrt(2)
    code = np.where(rx >= 0, 1, -1) / math.sqrt(128)
    f = (code * rx).sum(1)
    error = (code @ ry.T) / f[:, None] - x @ y.T
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) > embedding_dedup.ERROR_SCALE * np.sqrt((1 - f**2) / f**2 / 127)[:, None]).mean() < 1e-4
    near = x + 0.1 * y
    near = near / np.linalg.norm(near, axis=1, keepdims=True) @ r.T / math.sqrt(2)
    off = (code * near).sum(1) / f - (rx * near).sum(1)
    assert (np.abs(off) < embedding_dedup.ERROR_SCALE * np.sqrt((1 - f**2) / f**2 / 127)).all()  # closer pairs err less


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-40, 40, 8).tolist()) for i in range(300)] + [(400 + i, [7] * 8) for i in range(40)] + [(500, [1, 2]), (520, [3, 4]), (540, []), (20, [7] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = {}
    for r in topk.top_k(df.where("vec_id % 20 = 0"), df.withColumn("score", F.lit("clash")).drop("score"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i, v in rows if i % 20 == 0 and v and i != 20}:
        v = next(v for i, v in rows if i == q)
        scores = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    bad = spark.createDataFrame([(1, None), (2, [None]), (3, [float("nan")]), (None, [1.0]), (4, [0.51])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.integers(bad).collect()] == [(4, [32])]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def plain_top(rows, k):
    """{query: [(rank, vec_id, score)]} by evaluating every pair."""
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k])] for q, v in rows if q % 20 == 0}


def test_top_k_with_outliers_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "POOL", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 9)
    monkeypatch.setattr(topk, "GROUP_ROWS", (40, 60))
    rng = np.random.default_rng(8)
    plain = [(i, rng.integers(-40, 40, 12).tolist()) for i in range(480)]
    clusters = [(i, (rng.integers(-3, 4, 12) + 1000 * np.eye(12, dtype=int)[i % 12]).tolist()) for i in range(480)]
    for rows in (
        [*plain, (1001, [int(64 * 2.9e7)] * 12)], [*plain, (1000, [int(64 * 2.9e7)] + [3] * 11), (1003, [-(10**9)] * 12)], clusters,
        [(i, [1] * 12) for i in range(60)], [(i, [0] * 12) for i in range(50)], [(i, [i, 1]) for i in range(30)], [(0, [5]), (1, [2])], [(0, [5])],
    ):
        got = {}
        for r in topk.top_k(*(spark.createDataFrame(rows, "vec_id long, x array<long>").where(c) for c in ("vec_id % 20 = 0", "true")), 7).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in plain_top(rows, 7).items() if v}


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(9)
    x = np.floor(64 * rng.standard_normal((4000, 64)) / 8).astype(np.int64)
    own = topk.Pivots(x[:1024])
    length = (x.astype(float) ** 2).sum(1)
    far = own.distances(x.astype(float))
    y = own.place(far, length)
    exact = x[:200] @ x.T
    bound = y[:200] @ y.T + topk.SLACK * np.sqrt(length[:200, None] * length[None]) + 1
    assert (bound >= exact).all()
    lower = np.sqrt(np.maximum(length[:200, None] + length[None] - 2 * y[:200].astype(float) @ y.T, 0))
    assert all((lower >= np.abs(np.sqrt(far[:200, p, None]) - np.sqrt(far[None, :, p])) - 1).all() for p in range(far.shape[1]))  # no pivot alone does better
    block = topk.Block(np.arange(200), x[:200], y[:200], length[:200], np.full(200, -np.inf), 20)
    for s in range(0, 4000, 1000):
        block.meet(np.arange(s, s + 1000), x[s : s + 1000], y[s : s + 1000], length[s : s + 1000])
    assert block.evaluated < 0.2 * block.seen


def test_lanes_return_few_rows(spark):
    """At most k rows a query and lane, none that cannot be among the best; ten times the rows return hardly more."""
    rng, returned = np.random.default_rng(4), []
    for n in (1500, 15000):
        x = np.floor(64 * rng.standard_normal((n, 16)) / 4).astype(np.int64)
        own = topk.Pivots(x[:1024])
        length, far = (x.astype(float) ** 2).sum(1), own.distances(x.astype(float))
        y = own.place(far, length)
        exact = (x[:40] @ x.T).astype(float)
        exact[np.arange(40), np.arange(40)] = -np.inf
        first = np.partition(exact[:, :1024], -20, axis=1)[:, -20]
        block = topk.Block(np.arange(40), x[:40], y[:40], length[:40], first, 20, [[g for g in range(n // 500) if g % 7 != q % 7] for q in range(40)])
        for g in range(n // 500):
            part = slice(g * 500, g * 500 + 500)
            block.meet(np.arange(n)[part], x[part], y[part], length[part], g)
        q, row, score = block.best()
        returned.append(len(q))
        for i in range(40):
            seen = [(-exact[i, j], j) for j in range(n) if j // 500 % 7 != i % 7 and exact[i, j] >= first[i]]
            assert sorted(zip(-score[q == i], row[q == i])) == sorted(seen)[:20]
    assert returned[1] <= 40 * 20 and returned[0] <= returned[1]


def test_scores_beyond_doubles():
    big = np.array([[2**30, 1], [2**30, 2], [2**30, 3], [2**31, 2**31]], np.int64)
    y, length = np.sqrt((big.astype(float) ** 2).sum(1))[:, None].astype(np.float32), (big.astype(float) ** 2).sum(1)
    block = topk.Block(np.array([0]), big[:1], y[:1], length[:1], np.array([-np.inf]), 2)
    block.meet(np.arange(3), big[:3], y[:3], length[:3])
    assert list(zip(*[c.tolist() for c in block.best()])) == [(0, 2, 2**60 + 3), (0, 1, 2**60 + 2)]
    huge = big[3:] * 2
    with pytest.raises(OverflowError):
        topk.Block(np.array([9]), huge, y[3:] * 2, length[3:] * 4, np.array([-np.inf]), 2).meet(np.arange(1), huge, y[3:] * 2, length[3:] * 4)


def plain_fingerprint(text):
    w, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            w, word = w + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    rng = random.Random(4)
    texts = [None, "", " \t", "One", "one  TWO", "a b c", "É é a b  x", "x" * 100_000, "w " * 70_000 + "end"]
    texts += [" ".join(rng.choice(["a", "B", "cc", "ÄÖ", "d."]) for _ in range(rng.randint(0, 30))) for _ in range(50)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_bk_forest_finds_every_link():
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    tree = np.sort(np.array([rng.randrange(3) for _ in fps]))
    f = simhash.Forest(np.array(fps, np.uint64), tree)
    got = {(int(a), int(b)) for i, j in f.links(3) for a, b in zip(i, j)}
    assert got == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if tree[a] == tree[b] and (fps[a] ^ fps[b]).bit_count() <= 3}


def test_simhash_components(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)]
    docs = [(i, rng.choice(base) + (" tail" if rng.random() < 0.5 else "")) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  "), (103, "solo"), (103, "solo"), (None, base[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("fp", F.lit(0))
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.components(df).collect()]
    ids = sorted({i for i, _ in docs if i is not None})
    fp = {i: plain_fingerprint(t) for i, t in docs if i is not None}
    label = closure(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 3])
    want = {i: ids[label[k]] for k, i in enumerate(ids)}
    assert sorted((i, f, c) for i, f, c in got if i is not None) == sorted((i, fp[i], want[i]) for i, _ in docs if i is not None)
    assert [c for i, _, c in got if i is None] == [None]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in ids if want[i] == i)
    assert simhash.components(df.limit(0)).count() == 0


def test_hot_shards_are_cut_into_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 10)
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(40) for _ in range(60)} | {1 << k for k in range(40)} | {(1 << k) | 1 for k in range(40)})
    df = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long")
    got = {r["id"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    label = closure(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert [got.get(k, k) for k in range(len(fps))] == label
