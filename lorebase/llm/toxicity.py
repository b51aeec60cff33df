"""Operator 6: toxicity by weak supervision.

Voters look at a text. Lexicon voters are words, beginnings of words (``abcd*``), and stems: beginnings that two
different words of a text share, one word in ``DENSE`` or more (``abcd**``). Pattern voters look for phrases and style.
One votes clean where no lexicon voter speaks. Lexicon voters come from a short seed list and from the labelled rows of
the training folds: greedily the one that covers most toxic rows not yet covered, among those whose precision has a
confidence bound above one half, so that a small language needs few rows; copies of one another count as one row.

A generative model of the votes (class prior, how often each voter speaks in either class, and, for each voter, how much
of it the one voter explains that it is most correlated with among toxic rows: a tree of pairwise terms) is fitted by
expectation-maximisation without labels. A logistic regression on the votes is trained on its posterior labels. Only
texts enter a score.

Training uses a bounded sample, ``SAMPLE`` labelled rows of the training folds by the order of a hash of their id; every
text of the table is scored, whole. The model is some kilobytes, whatever the data.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, others, private, release, table

SAMPLE, GAIN, SURE, PRECISION, TRUST, THRESHOLD, ROUNDS, DENSE = 20_000, 3.0, 2.0, 0.9, 0.5, 0.7, 50, 200
#: Words and phrases that start the lexicon.
SEEDS = ["idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin"]
PHRASES = ["shut up", "go to hell", "hate you", "kill you", "kill yourself", "get lost", "you people"]
#: Pattern voters: a text that any match needs, in lower case, and the pattern.
PATTERNS = [
    *[(p, re.compile(rf"\b{p}\b")) for p in PHRASES],
    ("you", re.compile(rf"\byou(?:'re| are)? (?:all )?(?:an? |such an? )?(?:\w+ )?(?:{'|'.join(SEEDS)})")),
    ("ll ", re.compile(r"\b(?:i|we)(?:'ll| will) (?:kill|hurt|beat|destroy|find)\b")),
    ("**", re.compile(r"\b[a-z]\*{2,}[a-z]")),
    ("nobody", re.compile(r"\bnobody (?:likes|wants|needs) you\b")),
]
N_PATTERNS = len(PATTERNS) + 3  # and shouting, exclamation, clean
_LETTERS = re.compile(r"[^\W\d_]+")
_LENGTHS = (4, 5, 6, 7, 8)


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in _LENGTHS if len(word) >= k]


def grams(word: str) -> list[str]:
    """A word, and its beginnings, which end in ``*``."""
    return [word, *[b + "*" for b in beginnings(word)]]


def dense(occurrences: int, different: int, words: int) -> bool:
    return different >= 2 and occurrences * DENSE >= words


def text_grams(text: str) -> set[str]:
    """All that lexicon voters can look for in a text."""
    chunks = text.split()
    count: Counter = Counter()
    for c, n in Counter(chunks).items():
        for w in _LETTERS.findall(c.lower()):
            if len(w) > 2:
                count[w] += n
    stems: dict[str, list[int]] = {}
    for w, n in count.items():
        for b in beginnings(w):
            s = stems.setdefault(b, [0, 0])
            s[0] += n
            s[1] += 1
    return {g for w in count for g in grams(w)} | {b + "**" for b, (n, k) in stems.items() if dense(n, k, len(chunks))}


def copy_key(text: str) -> int:
    """A number that near copies mostly share: the least hash of the long words."""
    return min((zlib.crc32(w.encode()) for w in set(_LETTERS.findall(text.lower())) if len(w) >= 7), default=zlib.crc32(text.encode()))


def votes(texts: list[str | None], lexicon: list[str]):
    """Votes of all voters on each text, 0 or 1: the lexicon, patterns, shouting, exclamation, and clean."""
    import numpy as np

    place = {g: i for i, g in enumerate(lexicon)}
    stems = {g[:-2]: i for g, i in place.items() if g.endswith("**")}
    split = [(t or "").split() for t in texts]
    sets = [set(s) for s in split]
    speak: dict[str, list[int]] = {}
    stemmed: dict[str, list[tuple[str, str]]] = {}  # (stem, word) pairs of a chunk
    for chunk in set().union(*sets) if sets else ():
        words = [w for w in _LETTERS.findall(chunk.lower()) if len(w) > 2]
        found = {place[g] for w in words for g in grams(w) if g in place}
        if found:
            speak[chunk] = list(found)
        if stems and (pairs := [(b, w) for w in words for b in beginnings(w) if b in stems]):
            stemmed[chunk] = pairs
    out = np.zeros((len(texts), len(lexicon) + N_PATTERNS), np.float32)
    known, rooted, n = speak.keys(), stemmed.keys(), len(lexicon)
    for k, (t, own) in enumerate(zip(texts, sets)):
        t = t or ""
        for chunk in known & own:
            out[k, speak[chunk]] = 1
        if len(some := rooted & own) > 1 or some and any(len(stemmed[c]) > 1 for c in some):
            count = Counter(c for c in split[k] if c in some)
            occurrences: Counter = Counter()
            for c, m in count.items():
                for b, _ in stemmed[c]:
                    occurrences[b] += m
            different = Counter(b for b, _ in {p for c in some for p in stemmed[c]})
            for b, m in occurrences.items():
                if dense(m, different[b], len(split[k])):
                    out[k, stems[b]] = 1
        low = t.lower()
        for j, (needs, pattern) in enumerate(PATTERNS):
            if needs in low and pattern.search(low):
                out[k, n + j] = 1
        out[k, -3] = t.isupper() and len(t) >= 20
        out[k, -2] = "!!" in t
        out[k, -1] = not out[k, :n].any()
    return out


def pairs_tree(v, q, least: float = 0.01):
    """For each voter the voter it depends on, or itself, and the share of its variance among toxic rows that this explains.

    A spanning forest of the greatest correlations within the toxic class. Voters that shun one another need no term, since
    the silent ones abstain; so does the last, which votes clean.
    """
    import numpy as np

    total = q.sum() + 1e-9
    mean = (v * q[:, None]).sum(0) / total
    cov = (v * q[:, None]).T @ v / total - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    same = np.minimum(np.maximum(cov / np.outer(deviation, deviation), 0) ** 2, 1)
    same[-1] = same[:, -1] = 0
    parent, best = np.arange(v.shape[1]), np.full(v.shape[1], least)
    left = list(range(v.shape[1]))
    while left:  # Prim's algorithm; a voter that correlates with none that is in starts a tree of its own
        j = max(left, key=lambda k: (best[k] if parent[k] != k else 0, -k))
        left.remove(j)
        for k in left:
            if same[j, k] > best[k]:
                parent[k], best[k] = j, same[j, k]
    return parent, np.where(parent == np.arange(len(parent)), 0, best)


def label_model(v, prior: float, rounds: int = ROUNDS):
    """(posterior of the toxic class for each row of votes ``v``, rates at which voters speak in it, and in the other).

    Starts from the opinion that any lexicon voter is right, which also is a prior of the rates worth ``TRUST`` of the
    rows: votes alone cannot tell a voter that speaks where no other does from the clean class. Each round re-estimates
    how often each voter speaks in either class, and the tree of dependent voters: where the voter it depends on speaks
    too, a voter counts by the share of its variance that the other leaves, so copies count once and no vote turns over.
    """
    import numpy as np

    q = first = np.where(v[:, :-N_PATTERNS].any(axis=1), 0.9, prior / 10)
    rates = [np.zeros(v.shape[1])] * 2
    for _ in range(rounds):
        seen = TRUST * first + (1 - TRUST) * q
        parent, share = pairs_tree(v, seen)
        rates = [((v * w[:, None]).sum(0) + 0.1) / (w.sum() + 1) for w in (seen, 1 - seen)]
        new_part = np.where(v[:, parent] > 0, 1 - share, 1)
        logit = np.log(prior / (1 - prior)) + (v * new_part * np.log(rates[0] / rates[1])).sum(1)  # a silent voter abstains
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return q, rates[0], rates[1]


def logistic(x, q, ridge: float = 0.05, rounds: int = 60):
    """Weights, then bias, of a ridge-penalised logistic regression on soft labels."""
    import numpy as np

    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) + penalty * w)
        size = np.abs(step).max()
        w -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _presence(wanted: list[str]):
    """(key, gram) of the wanted grams in each text."""

    def run(batches):
        import pyarrow as pa

        keep = frozenset(wanted)
        for b in batches:
            rows = [(copy_key(t), sorted(text_grams(t) & keep)) for t in (t or "" for t in b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["key", "grams"])

    return run


def precise(n: float, against: int) -> bool:
    """Whether ``n`` toxic rows against some clean ones show a voter to be right: by rate, and by Wilson's lower bound."""
    total, z = n + against, SURE
    bound = (n + z * z / 2 - z * (n * against / total + z * z / 4) ** 0.5) / (total + z * z)
    return n >= PRECISION * total and bound >= 0.5


def induce(sample: DataFrame) -> list[str]:
    """Grams of the labelled sample (text, toxic) that speak for toxicity.

    A row weighs one divided by the number of sample rows of its class that share its copy key.
    """

    def all_grams(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([copy_key(t) for t in texts], pa.int64()), pa.array([sorted(text_grams(t)) for t in texts], pa.list_(pa.string()))], ["key", "grams"])

    toxic, clean = (sample.where(f"toxic = {k}").select("text") for k in (1, 0))
    found = cut(toxic.mapInArrow(all_grams, "key long, grams array<string>"))
    weights = found.groupBy("key").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    weighed = found.join(weights, "key").select("w", F.explode("grams").alias("gram"))
    counts = {r["gram"]: r["n"] for r in weighed.groupBy("gram").agg(F.sum("w").alias("n")).collect() if precise(r["n"], 0)}  # bounded by the sample
    against = clean.mapInArrow(_presence(sorted(counts)), "key long, grams array<string>").select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()
    against = {r["gram"]: r["count"] for r in against}
    good = {g for g, n in counts.items() if precise(n, against.get(g, 0))}
    release(found)
    rows = toxic.mapInArrow(_presence(sorted(good | set(SEEDS))), "key long, grams array<string>").collect()  # of the sample's toxic rows
    shared = Counter(r["key"] for r in rows)
    cover: dict[str, set[int]] = {}
    for i, r in enumerate(rows):
        for g in r["grams"]:
            if g.rstrip("*") in SEEDS or any(w.startswith(g.rstrip("*")) for w in SEEDS if g[-1] == "*"):
                continue
            cover.setdefault(g, set()).add(i)
    weight, out = [1 / shared[r["key"]] for r in rows], []
    left = {i for i, r in enumerate(rows) if not any(g in SEEDS for g in r["grams"])}
    while cover:
        gain, _, g = max((sum(weight[i] for i in own & left), len(g), g) for g, own in cover.items())
        if gain < GAIN:
            break
        out.append(g)
        left -= cover.pop(g)
    # further grams that cover much themselves, but no variants of a chosen one
    for g in sorted(cover, key=lambda g: (-sum(weight[i] for i in cover[g]), -len(g), g)):
        stem = g.rstrip("*")
        if sum(weight[i] for i in cover[g]) >= 0.02 * sum(weight) and not any(stem.startswith(o.rstrip("*")) or o.startswith(stem) for o in out):
            out.append(g)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, from labelled rows of the training folds. Without any, or of one class alone, the seeds decide by fixed weights."""
    import numpy as np

    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    rows = cut(rows.groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))  # rows of one id are one example
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not (n.get(0) and n.get(1)):
        return {"lexicon": list(SEEDS), "weights": [6.0] * len(SEEDS) + [2.0] * len(PATTERNS) + [0.0, 0.0, -2.0, -2.0]}
    lexicon = list(SEEDS)
    lexicon += [g for g in induce(rows) if g not in lexicon]

    def cast(batches):
        import pyarrow as pa

        for b in batches:
            v = votes(b.column("text").to_pylist(), lexicon).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], ["toxic", "v"])

    got = rows.mapInArrow(cast, "toxic int, v binary").collect()  # ``sample`` rows of some hundred bytes
    release(rows)
    v = np.array([np.frombuffer(r["v"], np.uint8) for r in got], np.float64).reshape(len(got), len(lexicon) + N_PATTERNS)
    q, _, _ = label_model(v, min(0.5, max(0.01, n[1] / len(got))))
    return {"lexicon": lexicon, "weights": logistic(v, q).tolist()}


def score_texts(texts: list[str | None], model: dict):
    import numpy as np

    out, w = np.zeros(len(texts)), np.array(model["weights"])
    for s, e in slices([len(t or "") for t in texts]):
        out[s:e] = 1 / (1 + np.exp(-np.clip(votes(texts[s:e], model["lexicon"]) @ w[:-1] + w[-1], -30, 30)))
    return out


def score(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (one of that name in any case is replaced): 0 to 1, higher where toxic is likelier.

    Null and empty texts get the score of a text that no voter but the clean one speaks on. Repeated rows score alike.
    """

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series(score_texts(list(texts), model))

    return docs.select(*others(docs, out), run("text").alias(out))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches ``threshold``. Null and empty texts stay."""
    (mine,) = private(docs.columns, "score")
    scored = score(docs, fit(docs, labels), mine)
    return scored.where(F.col(mine) < threshold).drop(mine)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
