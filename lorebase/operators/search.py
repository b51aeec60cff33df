"""Keyword search over pages, by a scan or by an index of trigrams, and the digest of a knowledge base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import cut

WIDTH = 120
#: Posting lists: how often each trigram occurs in a page. A trigram is a number of three code points of 21 bits, so that
#: those that begin alike are neighbours; a page ends with two zeros, so that each of its characters begins one.
POSTINGS, GRAMS, BITS = "gram long, path string, n long", "gram long, df long", 21
#: Characters that are sorted together as one run of a file; trigrams of a term that are looked up, the rarest ones.
RUN, RAREST = 1 << 22, 4


def occurrences(low: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term in lower-cased text."""
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("int")


def snippet(text: Column | str, terms: list[str], width: int = WIDTH) -> Column:
    """Text around the first term, in query order, that occurs."""
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.instr(low, t), F.lit(0)) for t in terms])
    start = F.greatest(at - 1 - width // 2, F.lit(0)) + 1
    return F.coalesce(T.collapse(F.substring(text, start, F.lit(width))), F.lit(""))


def keyword_search(pages: DataFrame, query: str, limit: int = 20, keep: list[str] | None = None) -> DataFrame:
    """(path, title, score, snippet) of the best pages (path, text): by summed substring counts, ties by path.

    Any term may match, repeated terms count again. Titles and snippets are made for the chosen rows alone.
    """
    terms = [t.lower() for t in query.split()]
    if not terms:
        return pages.limit(0).selectExpr("path", "'' AS title", "0 AS score", "'' AS snippet")
    low = F.lower("text")
    scored = pages.withColumn("score", sum((occurrences(low, t) for t in terms), F.lit(0)).cast("int"))
    best = scored.orderBy(F.desc("score"), "path").limit(limit).where("score > 0")  # before the limit the sum would be made twice
    heading = T.nonempty(F.regexp_extract("text", r"(?md)^# (.*)$", 1))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return best.select("path", F.coalesce(F.trim(heading), stem).alias("title"), "score", snippet("text", terms).alias("snippet"), *(keep or []))


def postings(pages: DataFrame) -> DataFrame:
    """``POSTINGS`` of pages (path, text), in runs sorted by trigram, without a shuffle.

    Null texts have none, an empty one has none either; a page of several runs, or a repeated one, has several rows a trigram.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def sorted_run(paths, pieces):
            grams, pages_ = [], []
            for k, codes in enumerate(pieces):
                c = codes.astype(np.int64)
                grams.append(c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])
                pages_.append(np.full(len(c) - 2, k, np.int32))
            gram, page = np.concatenate(grams), np.concatenate(pages_)
            order = np.argsort(gram, kind="stable")  # pages stay in order within a trigram
            gram, page = gram[order], page[order]
            at = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (page[1:] != page[:-1])])
            n, names = np.diff(np.r_[at, len(gram)]), pa.array(paths, pa.string())
            for s in range(0, len(at), 100_000):
                e = at[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(gram[e]), names.take(pa.array(page[e])), pa.array(n[s : s + 100_000])], ["gram", "path", "n"])

        paths, pieces, room = [], [], RUN
        for batch in batches:
            for path, low in zip(batch.column(0), batch.column(1)):
                codes = np.frombuffer((low.as_py() + "\0\0").encode("utf-32-le", "replace"), np.uint32)
                for s in range(0, len(codes) - 2, RUN):
                    piece = codes[s : s + RUN + 2]
                    if len(piece) - 2 > room and pieces:
                        yield from sorted_run(paths, pieces)
                        paths, pieces, room = [], [], RUN
                    paths.append(path.as_py())
                    pieces.append(piece)
                    room -= len(piece) - 2
        if pieces:
            yield from sorted_run(paths, pieces)

    return pages.where("text IS NOT NULL AND path IS NOT NULL").select("path", F.lower("text").alias("low")).mapInArrow(run, POSTINGS)


def gram_counts(own: DataFrame) -> DataFrame:
    """``GRAMS``: how many rows of the postings each trigram has."""
    return own.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def _number(piece: str) -> int:
    return reduce(lambda a, c: a << BITS | ord(c), piece, 0) << BITS * (3 - len(piece))


def candidates(own: DataFrame, counts: DataFrame, query: str) -> DataFrame:
    """(path, bound): pages in which a term of the query may occur, and a number that their score cannot exceed.

    An occurrence of a term has each of its trigrams at a place of its own, so the rarest of them bounds how many there
    are, and a page that lacks one of them has none. Terms of one or two characters begin trigrams: they are a range.
    """
    terms = Counter(t.lower() for t in query.split())
    grams = {t: {_number(t[i : i + 3]) for i in range(len(t) - 2)} for t in terms if len(t) > 2}
    asked = sorted(set().union(*grams.values()))
    df = dict(counts.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("df")).collect()) if asked else {}  # a row a trigram of the query
    tests: dict[str, list[Column]] = {}
    for t in terms:
        if len(t) > 2 and all(g in df for g in grams[t]):
            tests[t] = [F.col("gram") == g for g in sorted(grams[t], key=lambda g: (df[g], g))[:RAREST]]
        elif len(t) < 3:
            tests[t] = [F.col("gram").between(_number(t), _number(t) + (1 << BITS * (3 - len(t))) - 1)]
    if not tests:
        return own.limit(0).select("path", F.lit(0).cast("long").alias("bound"))
    named = {(t, i): f"c{k}_{i}" for k, t in enumerate(tests) for i in range(len(tests[t]))}
    found = own.where(reduce(lambda a, b: a | b, [c for cs in tests.values() for c in cs]))
    found = found.groupBy("path").agg(*[F.sum(F.when(tests[t][i], F.col("n"))).alias(c) for (t, i), c in named.items()])

    def most(t: str) -> Column:
        own_ = [F.col(named[t, i]) for i in range(len(tests[t]))]
        return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in own_]), F.array_min(F.array(*own_)) * terms[t]).otherwise(0)

    return found.select("path", sum((most(t) for t in tests), F.lit(0)).cast("long").alias("bound")).where("bound > 0")


def indexed_search(own: DataFrame, counts: DataFrame, texts: Callable[[DataFrame], DataFrame], query: str, limit: int = 20, also: DataFrame | None = None) -> DataFrame:
    """What ``keyword_search`` finds, by postings and their counts: texts are read of those pages alone whose bound
    reaches the last score of the pages with the greatest bounds.

    ``texts`` gives (path, text) of pages (path) as they stand; ``also`` (path) are looked at whatever the index says,
    which may be out of date about them. Outdated postings beside new ones cost reads, never results.
    """
    if not query.split() or limit < 1:
        return keyword_search(texts(own.limit(0).select("path")), query, max(limit, 0))
    bound = candidates(own, counts, query)
    if also is not None:
        bound = bound.join(also.select("path"), "path", "left_anti").unionByName(also.select("path", F.lit((1 << 62) - 1).alias("bound")))
    bound = cut(bound)
    best = keyword_search(texts(cut(bound.orderBy(F.desc("bound"), "path").limit(limit).select("path"))), query, limit)
    n, last = best.agg(F.count(F.lit(1)), F.min("score")).first()
    reach = cut(bound.where(F.col("bound") >= (last if n >= limit else 1)).select("path"))  # of known size, so that texts need no shuffle to meet few
    return keyword_search(texts(reach), query, limit)


def digest(sources: DataFrame, pages: DataFrame, page_sections: DataFrame) -> DataFrame:
    """(metric, key, value): source and page counts, open questions, concept pages with conflicting findings.

    ``page_sections`` (page_type, slug, section, body): bodies, or the single lines of the sections that matter.
    """
    row = lambda df, metric, key: df.groupBy(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    one = lambda df, metric: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "value")
    conflicts = page_sections.where("page_type = 'concepts' AND lower(section) = 'conflicting findings'").where(T.strip("body") != "")
    out = one(sources, "total_sources").unionByName(row(sources, "sources_by_type", "source_type")).unionByName(row(pages, "wiki_pages", "page_type"))
    return out.unionByName(one(pages.where("page_type = 'questions'"), "open_questions")).unionByName(one(conflicts.select("page_type", "slug").distinct(), "contradictions"))


def render_digest(rows: DataFrame, title: str = "Digest") -> DataFrame:
    """The digest as one text; its rows are as many as there are kinds of sources and pages."""
    value = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0)).cast("string")
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("metric") == m, F.struct("key", "value")))), lambda x: F.concat(F.lit("\n- "), x["key"], F.lit(": "), x["value"])), "")
    return rows.agg(
        F.concat(
            F.lit(f"# {title}\n\n**Total sources:** "), value("total_sources"), listed("sources_by_type"), F.lit("\n\n**Wiki pages:**"), listed("wiki_pages"),
            F.lit("\n\n**Open questions:** "), value("open_questions"), F.lit("\n**Contradictions flagged:** "), value("contradictions"),
        ).alias("text")
    )
