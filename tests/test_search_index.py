"""Search by posting lists: what a scan finds, from few pages."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import search as S
from lorebase.plans.knowledge_base import KnowledgeBase

LETTERS = "abcİß한𝄞. "


def counted(pages):
    """Texts of pages by path, and how many were read each time."""
    reads = []

    def texts(paths):
        got = pages.join(paths, "path", "left_semi")
        reads.append(got.count())
        return got

    return texts, reads


def by_hand(rows, query, limit):
    terms = [t.lower() for t in query.split()]
    scored = [(-sum(low.count(t) for t in terms), path) for path, low in rows if low is not None]
    return [(p, -s) for s, p in sorted(scored)[:limit] if s]


@pytest.mark.parametrize("run", [7, 1 << 22])
def test_equal_to_counting(spark, monkeypatch, run):
    monkeypatch.setattr(S, "RUN", run)
    dice = random.Random(run)
    rows = [(f"p{i:03}", "".join(dice.choices(LETTERS, k=dice.randrange(60)))) for i in range(150)]
    rows += [("p001", "abcabc"), ("p001", "abcabc"), ("none", None), ("empty", ""), ("long", "abcab" * 5000)]
    pages = spark.createDataFrame(rows, "path string, text string")
    lows = [tuple(r) for r in pages.select("path", F.lower("text")).collect()]
    own = S.postings(pages).cache()
    counts = S.gram_counts(own).cache()
    for query in ["abc", "a", "한", "𝄞a", "ab bca", "aaaa", "abc ABC b", "zzz", "zzz abcab", "ß한c", "cabcabc .", " "]:
        texts, _ = counted(pages)
        got = [(r["path"], r["score"]) for r in S.indexed_search(own, counts, texts, query, 9).collect()]
        assert got == by_hand(lows, query, 9), query
        bounds = S.candidates(own, counts, query).collect() if query.strip() else []
        for path, low in lows:
            score = sum((low or "").count(t.lower()) for t in query.split())
            assert not score or score <= max(r["bound"] for r in bounds if r["path"] == path), (query, path)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "path string, text string")
    own = S.postings(pages)
    assert S.indexed_search(own, S.gram_counts(own), lambda p: pages.join(p, "path", "left_semi"), "abc a").count() == 0


def test_few_pages_are_read(spark):
    """A rare term reads its pages; a term of all pages those whose bound reaches the last of the best."""
    rows = [(f"p{i:04}", "the " * (i % 50 + 1) + ("zebra" if i % 500 == 0 else "horse")) for i in range(2000)]
    pages = spark.createDataFrame(rows, "path string, text string")
    own = S.postings(pages).cache()
    counts = S.gram_counts(own).cache()
    for query, most in [("zebra", 4), ("the", 40), ("zebra the", 60), ("quagga", 0)]:
        texts, reads = counted(pages)
        assert [tuple(r) for r in S.indexed_search(own, counts, texts, query).select("path", "score").collect()] == by_hand(rows, query, 20)
        assert max(reads) <= most, (query, reads)


def test_posting_lists_are_pruned(spark, tmp_path):
    """A scan for a trigram reads the sorted runs' own parts: the filter reaches Parquet."""
    pages = spark.createDataFrame([("p", "some text")], "path string, text string")
    S.postings(pages).write.parquet(f"{tmp_path}/postings")
    own = spark.read.parquet(f"{tmp_path}/postings")
    counts = S.gram_counts(own)
    plan = S.candidates(own, counts, "text s")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or" in plan or "PushedFilters: [In(" in plan


def test_stores(spark, tmp_path):
    """Pages of several ingests, edits and pages made by hand, all found; only what the index names or people edited is read."""
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store")
    for name in ("Alpha", "Beta"):
        (tmp_path / f"{name}.txt").write_text(f"{name} Trust and Use\n\nAbstract\nThe purpose of this study is to examine technology acceptance of {name}.\n\nKeywords: trust, {name} payment\n")
        kb.ingest(f"{tmp_path}/{name}.txt")
    scan = lambda q: [tuple(r) for r in S.keyword_search(kb.pages().select("path", "text"), q).collect()]
    read = []
    standing = kb._standing

    def spied(paths):
        read.append(paths.count())
        return standing(paths)

    kb._standing = spied
    found = lambda q: [tuple(r) for r in kb.search(q).collect()]
    n = kb.pages().count()
    for q in ("beta", "trust", "a", "alpha beta", "quokka"):
        assert found(q) == scan(q), q
    read.clear()
    assert found("examine") and max(read) < n
    read.clear()
    assert found("quokka") == [] and max(read) == 0
    page = tmp_path / "store/wiki/concepts/trust.md"
    page.write_text(page.read_text() + "\nquokka\n")
    (tmp_path / "store/wiki/concepts/own.md").write_text("# Own\n\nquokka quokka\n")
    read.clear()
    assert [x[0] for x in found("quokka")] == ["wiki/concepts/own.md", "wiki/concepts/trust.md"] == [x[0] for x in scan("quokka")]
    assert max(read) == 2
    page.unlink()
    assert [x[0] for x in found("quokka")] == ["wiki/concepts/own.md"]
