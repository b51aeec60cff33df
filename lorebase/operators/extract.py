"""Structured fields of papers: one row in, one row out, built-in expressions alone, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Replaces the extraction of a knowledge base: (source rows with ``text``) -> (rows of ``EXTRACTION``).
Extractor = Callable[[DataFrame], DataFrame]

LISTS = [
    "authors", "keywords", "research_questions", "theoretical_background", "key_concepts", "independent_variables",
    "dependent_variables", "mediating_variables", "moderating_variables", "control_variables", "analysis_methods",
    "models", "algorithms", "evaluation_metrics", "key_findings", "significant_relationships",
    "nonsignificant_relationships", "theoretical_contributions", "practical_contributions", "limitations", "future_work",
]
STRINGS = ["title", "journal", "doi", "language", "purpose", "methodology", "research_design", "data", "sample", "study_period", "unit_of_analysis", "abstract"]
EXTRACTION = "source_id string, year int, " + ", ".join([f"{c} string" for c in STRINGS] + [f"{c} array<string>" for c in LISTS])


def _empty() -> Column:
    return F.array().cast("array<string>")


def find(text: Column | str, p: str, group: int = 0, flags: str = "i") -> Column:
    """First match, or null."""
    return T.let(F.regexp_extract(text, T.pattern(p, flags), group), T.nonempty)


def doi(text: Column, known: Column) -> Column:
    return F.rtrim(F.coalesce(T.nonempty(known), F.when(F.contains(text, F.lit("10.")), find(text, V.DOI))), F.lit(".,;"))


def language(text: Column | str) -> Column:
    only = lambda letters: F.length(F.regexp_replace(text, f"[^{letters}]+", ""))
    korean, latin = only("가-힣"), only("A-Za-z")
    return F.when(T.korean(text) & (korean > latin * 0.3), "ko").otherwise("en")


def journal(text: Column | str) -> Column:
    return F.trim(find(text, V.JOURNAL, 1, "m"))


def year(text: Column | str) -> Column:
    line = find(text, V.JOURNAL + ".*", 0, "m")
    # V.YEAR with the border of the word looked for after the first digit
    own = r"[12](?<=\b1(?=9)|\b2(?=0))[09]\d{2}\b"
    at = [find(line, own, 0, ""), F.when(F.contains(text, F.lit("제")), find(text, V.VOLUME_YEAR, 1, "")), find(text, own, 0, "")]
    return F.coalesce(*at).cast("int")


def keywords(text: Column | str, low: Column | str | None = None) -> Column:
    got = F.regexp_extract(text, T.pattern(V.KEYWORDS), 1)
    if low is not None:
        got = F.when(T.may_hit(low, ["주제어", "핵심어", "key"]), got).otherwise("")
    return F.filter(F.transform(F.split(got, "[,;·]"), lambda k: F.btrim(k, F.lit(" ."))), lambda k: k != "")


def normal_title(line: Column) -> Column:
    """Without stars, blanks and a number at the end; only lines that end so need the pattern."""
    odd = F.rlike(F.right(line, F.lit(1)), F.lit(rf"{T.SPACE}|[*\p{{Nd}}]"))
    return F.btrim(F.when(odd, F.regexp_replace(line, rf"(?:{T.SPACE}|\*)+\p{{Nd}}*{T.SPACE}*\z", "")).otherwise(line), F.lit(" *"))


def guess_title(raw: Column | str, stripped: Column | str) -> Column:
    """Of the first 60 lines the first that may be a title, one that is repeated before others.

    A line's normal form occurs in the line, so others are not brought into theirs to be compared.
    """
    fits = lambda s: F.length(s).between(8, 200) & ~F.endswith(s, F.lit(".")) & ~T.is_heading(s) & ~T.hits(s, V.KOREAN_AUTHORS, "") & ~T.hits(s, V.NO_TITLE)
    again = lambda c: F.size(F.filter(raw, lambda x: F.contains(x, c) & (normal_title(x) == c))) >= 2
    found = F.filter(F.transform(F.slice(stripped, 1, 60), normal_title), fits)
    return T.let(found, lambda f: F.coalesce(T.first(F.filter(f, again)), T.first(f)))


def authors(stripped: Column | str) -> Column:
    line = T.first(F.filter(F.slice(stripped, 1, 40), lambda x: T.hits(x, V.KOREAN_AUTHORS, "")))
    names = F.filter(F.transform(F.split(line, "[,，·ㆍ]"), T.strip), lambda a: a != "")
    return F.coalesce(names, _empty())


def abstract(text: Column | str, stripped: Column | str, lang: Column | str) -> Column:
    ko, en = (find(text, p, 1, "is") for p in (V.KOREAN_ABSTRACT, V.ENGLISH_ABSTRACT))
    lang = F.col(lang) if isinstance(lang, str) else lang
    found = F.when(lang == "ko", F.coalesce(ko, en)).otherwise(F.coalesce(en, ko))
    # the lines above the first Korean keyword line, upwards to a short one or a heading
    at = F.array_position(F.transform(stripped, lambda x: T.hits(x, r"^(주제어|핵심어)\s*[:：]", "")), True).cast("int")
    above = F.reverse(F.slice(stripped, F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40))))
    skip = F.array_position(F.transform(above, lambda x: x != ""), True).cast("int")
    block = F.slice(above, skip, 40)
    stop = F.array_position(F.transform(block, lambda x: (F.length(x) < 12) | T.is_heading(x)), True).cast("int")
    taken = F.when(stop > 0, F.slice(block, F.lit(1), stop - 1)).otherwise(block)
    box = T.let(F.array_join(F.reverse(taken), " "), T.collapse)
    return F.coalesce(T.let(found, T.collapse), F.when((at > 1) & (skip > 0), T.let(box, lambda b: F.when(F.length(b) >= 80, b))))


def sample(sentence_rows: Column | str, low: Column | str | None = None, ko: Column | None = None) -> Column:
    clean = lambda s: ~T.hits(s, T.cue("future_work")) & ~T.hits(s, T.cue("limitations"))
    return T.first(F.filter(T.matches(sentence_rows, "sample", low, ko), clean))


def limitations_and_future(own: Column | str, sentence_rows: Column | str, low: Column | str | None = None, ko: Column | None = None) -> tuple[Column, Column]:
    """From ``own``, the sentences of the section on limitations, where there are any; else by cues over all sentences."""
    future = T.matches(own, "future_work")
    limits = F.filter(own, lambda s: T.hits(s, T.cue("limitations")) | ~T.hits(s, T.cue("future_work")))
    has = F.size(own) > 0
    return (
        F.when(has, F.slice(limits, 1, 6)).otherwise(F.slice(T.matches(sentence_rows, "limitations", low, ko), 1, 5)),
        F.when(has, F.slice(future, 1, 6)).otherwise(F.slice(T.matches(sentence_rows, "future_work", low, ko), 1, 5)),
    )


def mentions(text: Column | str, gazetteer: dict[str, list[str]], low: Column | str | None = None, ko: Column | None = None, emphasis: Column | str | None = None) -> Column:
    """array<struct<n, ord, name, stressed>> of every entity, zeros included: a span counts once for each pattern it fits.

    ``stressed`` tells of those that are met once whether ``emphasis`` has them too.
    """
    low = T.folded(text) if low is None else low
    count = lambda ps: sum((F.when(T.may_hit(low, [p], ko), F.regexp_count(low, F.lit(T.pattern(T.lowered(p), "")))).otherwise(0) for p in ps), F.lit(0))
    also = lambda n, ps: F.lit(False) if emphasis is None else F.coalesce((n == 1) & T.hits(emphasis, "|".join(ps)), F.lit(False))
    entry = lambda i, name, ps: lambda n: F.struct(n.alias("n"), F.lit(i).alias("ord"), F.lit(name).alias("name"), also(n, ps).alias("stressed"))
    return F.array(*[T.let(count(ps), entry(i, name, ps)) for i, (name, ps) in enumerate(gazetteer.items())])


def entities(text: Column | str, emphasis: Column | str, gazetteer: dict[str, list[str]], low: Column | str | None = None, ko: Column | None = None) -> Column:
    """Entities met twice, or once if also in the emphasised texts; most mentioned first, then in gazetteer order."""
    keep = F.filter(mentions(text, gazetteer, low, ko, emphasis), lambda m: (m["n"] >= 2) | m["stressed"])
    return F.transform(F.array_sort(F.transform(keep, lambda m: F.struct((-m["n"]).alias("n"), m["ord"].alias("ord"), m["name"].alias("name")))), lambda m: m["name"])


def canonical(term: Column | str, gazetteer: dict[str, list[str]]) -> Column:
    """The first entity one of whose patterns occurs in the term, or null."""
    return F.coalesce(*[F.when(T.hits(term, "|".join(ps)), F.lit(name)) for name, ps in gazetteer.items()])


def is_known(term: Column) -> Column:
    return T.hits(term, "|".join(p for g in (V.THEORIES, V.METHODS) for ps in g.values() for p in ps))


def phrases_of(abstract_: Column | str, text: Column | str) -> Column:
    """Capitalised phrases of the abstract, or else of the first 2,000 characters."""
    abstract_ = F.col(abstract_) if isinstance(abstract_, str) else abstract_
    return F.regexp_extract_all(F.coalesce(T.nonempty(abstract_), F.substring(text, 1, 2000)), F.lit(T.pattern(V.PHRASE, "")), F.lit(1))


def concepts(keyword_rows: Column, phrases: Column, journal_: Column) -> Column:
    """Keywords, or else ``phrases`` by frequency; without known entities and the journal; twelve at most."""
    counted = F.array_sort(F.transform(F.array_distinct(phrases), lambda p: F.struct((-F.size(F.filter(phrases, lambda x: x == p))).alias("n"), p.alias("p"))))
    fallback = F.filter(F.transform(counted, lambda c: c["p"]), lambda p: ~F.regexp_extract(p, "^[A-Za-z]+", 0).isin(V.PHRASE_STOP))
    found = F.when(F.size(keyword_rows) > 0, keyword_rows).otherwise(fallback)
    keep = lambda c: ~is_known(c) & (F.lower(c) != F.coalesce(F.lower(journal_), F.lit("")))
    return F.slice(F.array_distinct(F.filter(found, keep)), 1, 12)


def attached_concepts(key_concepts: Column | str) -> Column:
    """Up to eight concepts that get pages: the first spelling of each, two characters at least."""
    key = lambda c: T.strip(F.lower(c))
    column = F.col(key_concepts) if isinstance(key_concepts, str) else key_concepts
    new = lambda c, i: (key(c) != "") & (F.length(c) >= 2) & ~F.exists(F.slice(column, F.lit(1), i), lambda e: (key(e) == key(c)) & (F.length(e) >= 2))
    return F.slice(F.filter(column, new), 1, 8)


def extract(sources: DataFrame) -> DataFrame:
    """The default extractor: (source_id, title, author, doi, text, ...) -> rows of ``EXTRACTION``."""
    s = sources.select("source_id", F.col("title").alias("_title"), F.coalesce("author", _empty()).alias("_author"), F.col("doi").alias("_doi"), F.coalesce("text", F.lit("")).alias("_text"))
    text, some, ko = F.col("_text"), F.col("_some"), F.col("_korean")
    s = s.withColumns({"_some": ~T.blank("_text"), "_korean": T.korean("_text"), "_raw": T.raw_lines("_text"), "_low": T.folded("_text")})
    s = s.withColumn("_lines", T.stripped_lines("_raw")).withColumn("_paragraphs", T.paragraphs("_lines"))
    s = s.withColumns({"_sentences": T.sentences("_paragraphs"), "_own": T.sentences(T.limitations_section("_paragraphs"))}).withColumn("_lows", T.folded_rows("_sentences"))
    file_name = F.coalesce(F.col("_title"), F.lit("")).isin("") | (F.instr(F.trim(F.coalesce(F.col("_title"), F.lit(""))), " ") == 0)
    s = s.withColumns({
        "doi": doi(text, F.col("_doi")),
        "language": F.when(some, language(text)),
        "title": F.when(some & file_name, F.coalesce(guess_title("_raw", "_lines"), F.col("_title"))).otherwise(F.col("_title")),
        "authors": F.when(some, F.when(F.size("_author") > 0, F.col("_author")).otherwise(authors("_lines"))).otherwise(_empty()),
        "journal": F.when(some, journal(text)),
        "year": F.when(some, year(text)),
        "keywords": F.when(some, keywords(text, "_low")).otherwise(_empty()),
    })
    s = s.withColumn("abstract", F.when(some, abstract(text, F.col("_lines"), F.col("language"))))
    limits, future = limitations_and_future("_own", "_sentences", "_lows", ko)
    m = lambda name, k: F.slice(T.matches("_sentences", name, "_lows", ko), 1, k)
    s = s.withColumns({
        "purpose": T.first(m("purpose", 1)), "_methodology": T.matches("_sentences", "methodology", "_lows", ko), "research_questions": m("research_questions", 5),
        "sample": sample("_sentences", "_lows", ko), "data": T.first(m("data", 1)), "key_findings": m("findings", 6),
        "theoretical_contributions": m("theoretical_contrib", 4), "practical_contributions": m("practical_contrib", 3),
        "limitations": limits, "future_work": future,
    })
    stressed = F.concat_ws(" ", F.coalesce("abstract", F.lit("")), F.array_join("keywords", " "), F.coalesce("title", F.lit("")), F.col("_methodology"))
    s = s.withColumns({"methodology": T.first(F.col("_methodology")), "_stressed": stressed, "_phrases": F.when(F.size("keywords") == 0, phrases_of("abstract", "_text")).otherwise(_empty())})
    s = s.withColumns({
        "theoretical_background": F.when(some, entities("_text", F.col("_stressed"), V.THEORIES, "_low", ko)).otherwise(_empty()),
        "analysis_methods": F.when(some, entities("_text", F.col("_stressed"), V.METHODS, "_low", ko)).otherwise(_empty()),
        "key_concepts": F.when(some, concepts(F.col("keywords"), F.col("_phrases"), F.col("journal"))).otherwise(_empty()),
    })
    made = set(s.columns)
    out = [F.col(c) if c in made else (F.lit(None).cast("string") if c in STRINGS else _empty()).alias(c) for c in [*STRINGS, *LISTS]]
    return s.select("source_id", "year", *out)


def self_provenance() -> Column:
    """Of an extraction's row: the provenance that points at the paper as a whole."""
    none = lambda: F.lit(None).cast("string")
    own = [F.col(c) for c in ("source_id", "title", "authors", "year", "doi")]
    return F.struct(*own, *[none().alias(c) for c in ("url", "page", "section", "quote")])


def by_row(fn: Callable[[dict, str], dict]) -> Extractor:
    """An extractor from a Python function of (source as a dictionary, text), run on Arrow batches."""

    def run(sources: DataFrame) -> DataFrame:
        def batches(it):
            import pandas as pd

            names = [c.split()[0] for c in EXTRACTION.split(", ")]
            for pdf in it:
                rows = [{"source_id": r["source_id"], **fn({k: v for k, v in r.items() if k != "text"}, r["text"] or "")} for r in pdf.to_dict("records")]
                yield pd.DataFrame([[r.get(c, [] if c in LISTS else None) for c in names] for r in rows], columns=names)

        return sources.mapInPandas(batches, EXTRACTION)

    return run
