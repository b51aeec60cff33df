"""Incremental pages as an ordered log.

A source contributes rows (seq, step, pos, page, section, op, line); pages are a function of the log alone:
an appended line counts once, where it first occurs; a section that is set keeps its last text; a page's name is its
first. So the pages of a batch are those of its sources one by one, and new batches only add to the log.
Every aggregate combines on the map side; no window holds all rows of a popular page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .extract import attached_concepts

PAGE = ["page_type", "slug"]


def order() -> Column:
    """Place of a row in the log."""
    return F.struct("seq", "step", "pos")


def _row(step: int, pos: Column, kind: str, name: Column, slug: Column, section: str | Column, op: str, line: Column) -> Column:
    section = F.lit(section) if isinstance(section, str) else section
    return F.struct(F.lit(step).alias("step"), pos.cast("int").alias("pos"), F.lit(kind).alias("page_type"), name.alias("name"), section.alias("section"), F.lit(op).alias("op"), line.alias("line"), slug.alias("slug"))


def _each(rows: Column, make, n: int | None = None) -> Column:
    """Rows of ``make(value, index)`` for all values, or the first ``n`` where a page takes no more."""
    return F.transform(rows if n is None else F.slice(rows, 1, n), make)


def grouped(groups: dict[str, Column]) -> Column:
    """Bold labels with their bullets; null if all are empty."""
    part = lambda label, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"**{label}:**\n"), F.array_join(F.transform(rows, lambda v: F.concat(F.lit("- "), v)), "\n")))
    kept = {k: F.filter(rows, lambda v: v.isNotNull() & (v != "")) for k, rows in groups.items()}
    return T.nonempty(F.concat_ws("\n", *[part(k, rows) for k, rows in kept.items()]))


#: Kinds of entity pages, with the columns that name their pages.
ENTITIES = {"concepts": "concepts", "theories": "theoretical_background", "methods": "analysis_methods"}
#: The sections of the first row that a source has for each of its pages, by kind of page.
FIRST = {"papers": "Summary", "concepts": "Related Papers", "theories": "Related Papers", "methods": "Related Papers", "overviews": "Key Papers", "questions": "Question"}
#: Parts of the log (``contributions``) that suffice: for ``pages``, for ``touches`` and ``changes``, for ``bullets``.
NAMES = {"sections": {*FIRST.values()}, "lines": ()}
TOUCHES = {"sections": {*FIRST.values(), "Established Findings", "Applications"}, "lines": ("Related Papers", "Applications")}
APPENDED = {"op": "append"}


def contributions(sources: DataFrame, extractions: DataFrame, kinds=None, sections=None, op: str | None = None, lines=None) -> DataFrame:
    """The log rows of sources (seq, source_id, title, author, source_type, evidence_level, ...) and their extractions.

    Only rows of these kinds of pages, these sections and this operation, where given, and null for the lines of sections that
    are not in ``lines``: whatever makes up the others, down to the rules over the text, is then not computed.
    """
    wanted = lambda kind, section, how: (kinds is None or kind in kinds) and (sections is None or section in sections) and op in (None, how)
    said = lambda section, x: x if lines is None or section in lines else F.lit(None).cast("string")
    optional = {"url": "string", "local_file": "string", "publication_date": "date", "evidence_level": "string"}
    s = sources.select("seq", "source_id", F.col("title").alias("s_title"), "author", F.col("doi").alias("s_doi"), "source_type", *[(F.col(c) if c in sources.columns else F.lit(None).cast(k)).alias(c) for c, k in optional.items()])
    e = s.join(extractions, "source_id")
    some = lambda c: T.nonempty(F.col(c))
    e = e.withColumns({
        "p_title": F.coalesce(some("title"), some("s_title")), "p_authors": F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("author", F.array().cast("array<string>"))),
        "p_year": F.coalesce(F.nullif(F.col("year"), F.lit(0)), F.year("publication_date")), "p_doi": F.coalesce(some("doi"), some("s_doi")), "concepts": attached_concepts("key_concepts"),
    }).withColumn("name", F.coalesce("p_title", "source_id")).withColumn("ref", T.short_ref(F.col("p_authors"), F.col("p_title"), F.col("source_id"), F.col("p_year")))
    c = F.col
    cite = lambda x: F.concat(x, F.lit(" "), c("cite"))
    linked = lambda kind: lambda x, slug: T.link(kind, slug, x)
    # every slug and link is made once, and read from a column wherever it occurs
    e = e.withColumns({"slug": T.slug("name"), **{f"{kind}_slugs": F.transform(c(names), T.slug) for kind, names in ENTITIES.items()}})
    e = e.withColumn("own", F.concat(F.lit("[[papers/"), "slug", F.lit("|")))
    e = e.withColumns({
        "cite": F.concat(F.lit("("), "own", "ref", F.lit("]])")), "bullet": F.concat("own", "name", F.lit("]] — "), "ref"),
        **{f"{kind}_links": F.zip_with(c(names), c(f"{kind}_slugs"), linked(kind)) for kind, names in ENTITIES.items()},
    })
    related = F.concat(*[c(f"{kind}_links") for kind in ENTITIES])
    overview = F.transform(F.slice("concepts", 1, 1), lambda t: T.link("overviews", c("concepts_slugs")[0], F.concat(F.lit("Overview: "), t)))
    related = F.array_distinct(F.concat(related, overview))
    one = lambda col: F.array_compact(F.array(some(col)))
    paper = {
        "Summary": F.concat(F.lit(V.SUMMARY_QUOTE), some("abstract")),
        "Research Context": grouped({"Purpose": one("purpose"), "Research Questions": c("research_questions"), "Theoretical Background": c("theories_links"), "Key Concepts": c("concepts_links")}),
        "Research Design": grouped({"Methodology": one("methodology"), "Design": one("research_design"), "Data": one("data"), "Sample": one("sample")}),
        "Variables": grouped({k.title(): c(f"{k}_variables") for k in ("independent", "dependent", "mediating", "moderating", "control")}),
        "Analysis": grouped({"Methods": c("methods_links"), "Models": c("models"), "Algorithms": c("algorithms"), "Metrics": c("evaluation_metrics")}),
        "Results": grouped({"Key Findings": c("key_findings"), "Significant Relationships": c("significant_relationships"), "Non-significant Relationships": c("nonsignificant_relationships")}),
        "Discussion": grouped({"Theoretical Contributions": c("theoretical_contributions"), "Practical Contributions": c("practical_contributions"), "Limitations": c("limitations"), "Future Work": c("future_work")}),
        "Claims": F.array_join(F.transform("claims", lambda x: F.concat(F.lit("- "), x, F.lit("  "), c("cite"))), "\n") if "claims" in e.columns else F.lit(None).cast("string"),
        "Related Pages": T.nonempty(F.array_join(F.transform(related, lambda x: F.concat(F.lit("- "), x)), "\n")),
        "Provenance": F.concat_ws(
            "\n", F.concat(F.lit("- Source ID: `"), c("source_id"), F.lit("`")), F.concat(F.lit("- Local file: "), F.coalesce(F.concat(F.lit("`"), some("local_file"), F.lit("`")), F.lit("(metadata-only)"))),
            F.concat(F.lit("- DOI: "), c("p_doi")), F.concat(F.lit("- URL: "), some("url")), F.concat(F.lit("- Evidence level: "), F.coalesce("evidence_level", F.lit("unknown"))), F.lit(V.EXTRACTOR_LINE),
        ),
    }
    applied = F.concat(F.when(c("language") == "ko", F.lit("적용 분야")).otherwise(F.lit("Applied to")), F.lit(": "), F.coalesce(T.nonempty(F.array_join(F.slice("keywords", 1, 3), ", ")), c("name")))

    def one_row(step: int, pos: Column, kind: str, name: Column, slug: Column, section: str, how: str, line: Column) -> list[Column]:
        return [F.array(_row(step, pos, kind, name, slug, section, how, said(section, line)))] if wanted(kind, section, how) else []

    def some_rows(step: int, pos, kind: str, name: Column, slug: Column, section: str, values: Column, make, n: int | None = None) -> list[Column]:
        """Lines of all values, or of the first ``n``, appended at ``pos`` of their index."""
        if not wanted(kind, section, "append"):
            return []
        return [_each(values, lambda x, j: _row(step, pos(j), kind, name, slug, section, "append", said(section, make(x))), n)]

    rows = [r for i, (k, v) in enumerate(paper.items()) for r in one_row(1, F.lit(i), "papers", c("name"), c("slug"), k, "set", T.strip(v))]

    def entity(step: int, kind: str):
        def page(n: Column, i: Column) -> list[Column]:
            at, own = i * 100, (kind, n, c(f"{kind}_slugs")[i])
            return [
                *one_row(step, at, *own, "Related Papers", "append", c("bullet")),
                *(one_row(step, at + 1, *own, "Applications", "append", cite(applied)) if kind == "methods" else []),
                *some_rows(step, lambda j: at + 10 + j, *own, "Established Findings", c("significant_relationships"), cite, 3),
                *some_rows(step, lambda j: at + 20 + j, *own, "Conflicting Findings", c("nonsignificant_relationships"), lambda f: cite(F.concat(F.lit("(non-significant) "), f)), 3),
            ]

        return page

    for step, (kind, names) in enumerate(ENTITIES.items(), 2):
        page = entity(step, kind)
        if page(F.lit(""), F.lit(0)):
            rows.append(F.flatten(F.transform(names, lambda n, i: F.concat(*page(n, i)))))  # noqa: B023
    topic, topic_slug = (F.try_element_at(c(x), F.lit(1)) for x in ("concepts", "concepts_slugs"))
    over = lambda base, section, source, make, n=None: some_rows(5, lambda j: j + base, "overviews", topic, topic_slug, section, source, make, n)
    overviews = [
        *one_row(5, F.lit(0), "overviews", topic, topic_slug, "Key Papers", "append", c("bullet")),
        *over(100, "Major Theories", c("theories_links"), cite),
        *over(200, "Important Variables", F.filter(c("concepts_links"), lambda x, i: i > 0), cite),
        *over(300, "Recent Developments", c("methods_links"), lambda x: cite(F.concat(F.lit("방법론: "), x))),
        *over(400, "Open Questions", c("future_work"), cite, 3),
    ]
    if overviews:
        rows.append(F.filter(F.concat(*overviews), lambda r: topic.isNotNull()))

    def question(fw: Column, i: Column):
        def page(p: Column) -> list[Column]:
            own = ("questions", p["name"], p["slug"])
            return [
                *one_row(6, i * 100, *own, "Question", "set", fw), *one_row(6, i * 100 + 1, *own, "Why It Is Open", "set", F.concat(F.lit(V.WHY_OPEN), c("cite"))),
                *some_rows(6, lambda j: i * 100 + j + 10, *own, "Related Concepts", c("concepts_links"), lambda x: x, 3),
                *one_row(6, i * 100 + 50, *own, "Related Papers", "append", c("bullet")), *one_row(6, i * 100 + 51, *own, "Status", "set", F.lit("detected")),
            ]

        return page

    if question(F.lit(""), F.lit(0))({"name": F.lit(""), "slug": F.lit("")}):
        named = lambda fw: T.let(T.question_title(fw), lambda n: F.struct(n.alias("name"), T.slug(n).alias("slug")))
        rows.append(F.flatten(_each(c("future_work"), lambda fw, i: T.let(named(fw), lambda p: F.concat(*question(fw, i)(p))), 3)))
    log = e.select("seq", "source_id", (F.size("significant_relationships") > 0).alias("has_sig"), (F.size("nonsignificant_relationships") > 0).alias("has_nonsig"), F.explode_outer(F.concat(*rows)).alias("r")).where("r IS NOT NULL")
    log = log.select("seq", "source_id", "has_sig", "has_nonsig", "r.*")
    return log.withColumn("line", F.when(F.col("op") == "set", F.col("line")).when(F.startswith("line", F.lit("- ")), F.col("line")).otherwise(F.concat(F.lit("- "), F.col("line"))))


def bullets(log: DataFrame) -> DataFrame:
    """Each appended line of a page once: (page_type, slug, section, line, at)."""
    own = log.where("op = 'append' AND line IS NOT NULL").withColumn("_key", T.strip("line")).withColumn("_section", F.lower("section"))
    got = own.groupBy(*PAGE, "_section", "_key").agg(F.min(F.struct(order().alias("at"), "section", "line")).alias("x"))
    return got.select(*PAGE, "x.section", "x.line", "x.at")


def set_sections(log: DataFrame) -> DataFrame:
    """The last text set for each section, whose name counts in any case and keeps its first spelling: (page_type, slug, section, line)."""
    own = log.where("op = 'set' AND line IS NOT NULL AND line <> ''").groupBy(*PAGE, F.lower("section").alias("_key"))
    return own.agg(F.min_by("section", order()).alias("section"), F.max_by("line", order()).alias("line")).drop("_key")


def pages(log: DataFrame) -> DataFrame:
    """(page_type, slug, name, first_seq, n_sources); a page's name is its first."""
    return log.groupBy(*PAGE).agg(F.min_by("name", order()).alias("name"), F.min("seq").alias("first_seq"), F.count_distinct("seq").alias("n_sources"))


def touches(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """A row for each source and page: existed, added, prior (findings established before) and effect on entity pages.

    ``held`` (``held_sections``) is what pages say before the first of these rows: a page that has a file existed, lines
    that stand in it are not added, and findings that stand in it are prior.
    """
    found = F.min(F.when(F.col("section") == "Established Findings", order())).alias("own_found")
    t = log.groupBy("seq", "source_id", *PAGE).agg(F.min(order()).alias("at"), found, F.max("has_sig").alias("has_sig"), F.max("has_nonsig").alias("has_nonsig"), F.max_by("name", order()).alias("name"))
    firsts = t.groupBy(*PAGE).agg(F.min("at").alias("page_at"), F.min("own_found").alias("found_at"))
    listed = log.where(F.lower("section").isin("related papers", "applications"))
    new = bullets(listed).where("section IN ('Related Papers', 'Applications')")
    was, had = F.lit(False), F.lit(False)
    if held is not None:
        new = unwritten(new, held)
        stands = held.groupBy(*PAGE).agg(F.max((F.col("_section") == "established findings") & (T.strip("body") != "")).alias("_had"))
        t = t.join(stands, PAGE, "left")
        was, had = F.col("_had").isNotNull(), F.coalesce("_had", F.lit(False))
    new = new.select(*PAGE, F.col("at.seq").alias("seq")).distinct().withColumn("added", F.lit(True))
    t = t.join(firsts, PAGE).join(new, [*PAGE, "seq"], "left")
    t = t.withColumns({"existed": was | (F.col("page_at") < F.col("at")), "added": F.coalesce("added", F.lit(False)), "prior": had | F.coalesce(F.col("found_at") < F.col("at"), F.lit(False))})
    effect = (
        F.when(F.col("has_nonsig") & F.col("prior"), "contradict")
        .when(F.col("has_sig"), F.when(F.col("prior"), "strengthen").otherwise("extend"))
        .when(~F.col("existed"), "extend")
        .otherwise("unchanged")
    )
    entity = F.col("page_type").isin("concepts", "theories", "methods")
    return t.select("seq", "source_id", *PAGE, "name", "existed", "added", F.when(entity, effect).alias("effect"))


def effects_by_name(log: DataFrame) -> DataFrame:
    """(seq, source_id, name, effect): of entity pages of one name the last written counts, methods after theories after concepts."""
    t = touches(log).where("effect IS NOT NULL")
    last = F.max_by("effect", F.array_position(F.array(*map(F.lit, ENTITIES)), F.col("page_type")))
    return t.groupBy("seq", "source_id", "name").agg(last.alias("effect"))


def changes(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(seq, source_id, page_type, slug, change, effect): what each source created or updated; ``held`` as in ``touches``."""
    t = touches(log, held)
    updated = F.col("page_type").isin("papers", "overviews") | (F.col("effect").isNotNull() & (F.col("added") | (F.col("effect") != "unchanged")))
    change = F.when(~F.col("existed"), "created").when(updated, "updated")
    return t.withColumn("change", change).where("change IS NOT NULL").select("seq", "source_id", *PAGE, "change", "effect")


def section_lines(log: DataFrame, section: str) -> DataFrame:
    """(page_type, slug, section, body): every line or text that a section, named in any case, has; bodies are not built."""
    own = log.where(F.lower("section") == section.lower())
    lines = own.where("op = 'append' AND line IS NOT NULL").select(*PAGE, "section", "line")
    return lines.unionByName(set_sections(own)).withColumnRenamed("line", "body")


def sections(log: DataFrame) -> DataFrame:
    """All sections of all pages with their bodies: (page_type, slug, ord, section, body); skeleton first, others after."""
    skeleton = F.create_map(*[x for k, v in V.SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    generic = F.array(*map(F.lit, V.GENERIC_SECTIONS))
    known = pages(log).select(*PAGE, F.posexplode(F.coalesce(skeleton[F.col("page_type")], generic)).alias("ord", "section"))
    appended = bullets(log).groupBy(*PAGE, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"), F.min("at").alias("at"))
    bodies = appended.unionByName(set_sections(log).select(*PAGE, "section", F.col("line").alias("body"), F.lit(None).cast("struct<seq:bigint,step:int,pos:int>").alias("at")))
    joined = known.join(bodies, [*PAGE, "section"], "full")
    return joined.select(*PAGE, F.coalesce(F.col("ord"), F.lit(1000)).alias("ord"), "at", "section", F.coalesce("body", F.lit("")).alias("body"))


def page_texts(log: DataFrame, frontmatter: DataFrame | None = None) -> DataFrame:
    """(page_type, slug, name, text): Markdown of every page. ``frontmatter`` (page_type, slug, frontmatter) adds its block."""
    part = F.struct("ord", F.coalesce("at", F.struct(F.lit(0).cast("long").alias("seq"), F.lit(0).alias("step"), F.lit(0).alias("pos"))).alias("at"), F.regexp_replace(F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("body")), r"\s+\z", "").alias("text"))
    body = sections(log).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("body"))
    got = pages(log).join(body, PAGE)
    front = F.lit("")
    if frontmatter is not None:
        got = got.join(frontmatter, PAGE, "left")
        front = F.coalesce(F.concat(F.lit("---\n"), "frontmatter", F.lit("\n---\n\n")), F.lit(""))
    return got.select(*PAGE, "name", F.concat(front, F.lit("# "), "name", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))


#: Keys of a paper's front matter between title and date.
_PAPER = ["type", "source_id", "authors", "year", "journal", "doi", "url", "language", "keywords", "source_type", "evidence_level", "tags"]


def paper_record(sources: DataFrame, extractions: DataFrame) -> DataFrame:
    """What a source and its extraction say in a paper's front matter, columns ``_PAPER``."""
    s = sources.select("source_id", "source_type", "evidence_level", "url", F.col("author").alias("s_author"), F.col("doi").alias("s_doi"))
    e = extractions.select("source_id", "authors", "year", "journal", F.col("doi").alias("e_doi"), "language", "keywords")
    return s.join(e, "source_id").withColumns({
        "type": F.lit("paper"), "authors": F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("s_author")), "doi": F.coalesce("e_doi", "s_doi"), "tags": F.array(F.lit("paper"), "source_type"),
    }).select(*_PAPER)


def frontmatter(log: DataFrame, sources: DataFrame, extractions: DataFrame, as_of: str | None = None) -> DataFrame:
    """(page_type, slug, frontmatter) of pages rendered from the log alone."""
    own = own_frontmatter(log, sources, extractions, as_of)
    none = log.sparkSession.createDataFrame([], "page_type string, slug string, text string")
    return merged_frontmatter(own, none).select(*PAGE, "frontmatter")


def held_sections(pages: DataFrame) -> DataFrame:
    """Sections of Markdown pages (page_type, slug, text), in order: (page_type, slug, ord, section, body, _section, first).

    ``_section`` is the heading in lower case; of sections of one name only the ``first`` is read and changed. A page
    without sections has one row without heading.
    """
    parsed = pages.select(*PAGE, parse_page("text")["sections"].alias("s"))
    rows = parsed.select(*PAGE, F.posexplode_outer("s").alias("ord", "x")).select(*PAGE, F.coalesce("ord", F.lit(0)).alias("ord"), F.coalesce("x.heading", F.lit("")).alias("section"), F.coalesce("x.body", F.lit("")).alias("body"))
    rows = rows.withColumn("_section", F.lower("section"))
    return rows.withColumn("first", F.col("section") != "").withColumn("first", F.col("first") & (F.row_number().over(W.partitionBy(*PAGE, "_section").orderBy("ord")) == 1))


def unwritten(lines: DataFrame, held: DataFrame) -> DataFrame:
    """``lines`` (page_type, slug, section, line, ...) that do not stand in their section, blanks at their ends aside."""
    stands = held.where("first").select(*PAGE, "_section", F.explode(T.lines("body")).alias("_key")).distinct()
    return lines.withColumns({"_section": F.lower("section"), "_key": T.strip("line")}).join(stands, [*PAGE, "_section", "_key"], "left_anti").drop("_section", "_key")


def applied(log: DataFrame, held: DataFrame, own: DataFrame) -> DataFrame:
    """Pages with the rows of ``log`` applied to them as they stand: (page_type, slug, text).

    ``held`` (page_type, slug, text): the touched pages that have a file, edited by hand perhaps. Rows are applied as if
    one by one: a line goes to the end of its section unless it stands there, a set section's text is replaced, a section
    that is not there is added at the end; all other text, headings and order stay. A page without file starts as the
    skeleton of its kind. Applying the same rows again changes nothing. ``own`` (page_type, slug, front json) is what the
    rows say in front matter, see ``merged_frontmatter``; it names the pages.
    """
    skeleton = F.create_map(*[x for k, v in V.SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    blank = own.join(held.select(*PAGE), PAGE, "left_anti").select(*PAGE, F.posexplode(F.coalesce(skeleton[F.col("page_type")], F.array(*map(F.lit, V.GENERIC_SECTIONS)))).alias("ord", "section"))
    blank = blank.select(*PAGE, "ord", "section", F.lit("").alias("body"), F.lower("section").alias("_section"), F.lit(True).alias("first"))
    stand = held_sections(held).unionByName(blank)
    fresh = unwritten(bullets(log), stand).groupBy(*PAGE, F.lower("section").alias("_section"))
    fresh = fresh.agg(F.max_by("section", "at").alias("name"), F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("more"))
    fresh = fresh.select(*PAGE, "_section", "name", "at", "more", F.lit(None).cast("string").alias("new"))
    firsts = log.where("op = 'set' AND line IS NOT NULL AND line <> ''").groupBy(*PAGE, F.lower("section").alias("_section")).agg(F.max_by("section", order()).alias("name"), F.min(order()).alias("at"), F.max_by("line", order()).alias("new"))
    status = (F.col("page_type") == "questions") & (F.col("_section") == "status")
    front = merged_frontmatter(own, held)
    firsts = firsts.join(front.select(*PAGE, "status"), PAGE, "left").withColumn("new", F.when(status, F.coalesce("status", "new")).otherwise(F.col("new"))).drop("status")
    ops = fresh.unionByName(firsts.withColumn("more", F.lit(None).cast("string")))
    met = stand.withColumn("_key", F.when(F.col("first"), F.col("_section"))).join(ops.withColumnRenamed("_section", "_key"), [*PAGE, "_key"], "full")
    old = F.coalesce("body", F.lit(""))
    body = F.when(F.col("new").isNotNull(), T.strip("new")).when(F.col("more").isNotNull(), T.strip(F.when(old == "", F.col("more")).otherwise(F.concat(old, F.lit("\n"), "more")))).otherwise(old)
    heading = F.coalesce("name", "section")
    tail = lambda x: F.regexp_replace(x, f"{T.SPACE}+\\z", "")
    part = F.when(heading == "", T.strip(body)).otherwise(tail(F.concat(F.lit("## "), heading, F.lit("\n\n"), body)))
    first_at = F.coalesce("at", F.struct(F.lit(0).cast("long").alias("seq"), F.lit(0).alias("step"), F.lit(0).alias("pos")))
    row = F.struct(F.coalesce("ord", F.lit(2**31 - 1)).alias("ord"), F.when(F.col("ord").isNull(), first_at).alias("at"), part.alias("text"))
    texts = met.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("x")).select(*PAGE, F.filter(F.col("x.text"), lambda t: t != "").alias("parts"))
    titled = F.filter(F.array(F.when(F.col("title") != "", F.concat(F.lit("# "), "title"))), lambda t: t.isNotNull())
    block = F.filter(F.array(F.when(F.col("frontmatter") != "", F.concat(F.lit("---\n"), "frontmatter", F.lit("\n---")))), lambda t: t.isNotNull())
    return texts.join(front, PAGE).select(*PAGE, F.concat(tail(F.array_join(F.concat(block, titled, "parts"), "\n\n")), F.lit("\n")).alias("text"))


def own_frontmatter(log: DataFrame, sources: DataFrame, extractions: DataFrame, as_of: str | None = None) -> DataFrame:
    """(page_type, slug, name, json): what the rows of ``log`` say in front matter; of a paper, its latest source."""
    day = F.lit(as_of) if as_of else F.current_date().cast("string")
    p = log.groupBy(*PAGE).agg(F.min_by("name", order()).alias("name"), F.max_by("name", order()).alias("latest"), F.max_by("source_id", order()).alias("source_id"))
    kind = F.create_map(*[F.lit(x) for kv in {"concepts": "concept", "theories": "theory", "methods": "method", "overviews": "overview", "questions": "question"}.items() for x in kv])[F.col("page_type")]
    as_json = lambda r: F.to_json(r, {"ignoreNullFields": "false"})
    tag = F.when(F.col("page_type") == "questions", "open-question").otherwise(kind)
    other = p.where("page_type <> 'papers'").select(*PAGE, "name", as_json(F.struct(kind.alias("type"), tag.alias("tag"), day.alias("updated"))).alias("json"))
    return other.unionByName(p.where("page_type = 'papers'").join(paper_record(sources, extractions), "source_id").select(*PAGE, "name", as_json(F.struct(F.col("latest").alias("title"), *_PAPER, day.alias("updated"))).alias("json")))


def merged_frontmatter(own: DataFrame, held: DataFrame) -> DataFrame:
    """(page_type, slug, frontmatter, title, status) of the pages of ``own``, by the library for YAML.

    A paper's keys take its latest source's values; on other pages title, type and status stay where they are given and the
    tag is added to the tags, sorted; every other key, and the order of keys, stays. A block that is no YAML mapping
    stays as it is.
    """

    @F.pandas_udf("frontmatter string, title string, status string")
    def run(kind, name, own, page):
        import json

        import pandas as pd
        import yaml as library

        rows = []
        for k, n, o, block, heading, exists in zip(kind, name, own, page["frontmatter"], page["title"], page["exists"]):
            new = json.loads(o)
            try:
                front = library.safe_load(block or "") or {}
            except library.YAMLError:
                front = None
            if not isinstance(front, dict):
                rows.append((block, heading or n, "detected"))
                continue
            title = heading or str(front.get("title") or "") if exists else n
            if not exists:
                front = {"title": n}
            if k == "papers":
                front.update(new)
            else:
                front.setdefault("type", new["type"])
                if k != "questions":
                    front.setdefault("title", n)
                tags = front.get("tags") or []
                front["tags"] = sorted({str(t) for t in (tags if isinstance(tags, list) else [tags])} | {new["tag"]})
                if k == "questions":
                    front["status"] = front.get("status", "detected")
                else:
                    front["updated"] = new["updated"]
            rows.append((library.safe_dump(front, sort_keys=False, allow_unicode=True).strip(), title, str(front.get("status", "detected"))))
        return pd.DataFrame(rows, columns=["frontmatter", "title", "status"])

    page = parse_page("text")
    stands = held.select(*PAGE, F.struct(page["frontmatter"].alias("frontmatter"), page["heading"].alias("title"), F.lit(True).alias("exists")).alias("p"))
    none = F.struct(F.lit(None).cast("string").alias("frontmatter"), F.lit("").alias("title"), F.lit(False).alias("exists"))
    met = own.join(stands, PAGE, "left")
    return met.select(*PAGE, run("page_type", "name", "json", F.coalesce("p", none)).alias("f")).select(*PAGE, "f.*")


def get_section(text: Column | str, heading: str) -> Column:
    """Body of the first section of a Markdown page that is called ``heading``, in any case; null where there is none."""
    named = F.filter(parse_page(text)["sections"], lambda s: F.lower(s["heading"]) == heading.lower())
    return F.try_element_at(named, F.lit(1))["body"]


def parse_page(text: Column | str) -> Column:
    """struct<frontmatter, title, sections array<struct<heading, body>>, heading> of a Markdown page.

    A preamble is a section with heading ""; ``heading`` is the first-level heading, which ``title`` falls back from."""
    block = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
    has = F.rlike(text, F.lit(block))
    front = F.when(has, F.regexp_extract(text, block, 1))
    body = F.when(has, F.regexp_extract(text, block, 2)).otherwise(F.col(text) if isinstance(text, str) else text)
    heading = r"(?Ud)\A\s*#\s+(.+)"
    title = T.nonempty(F.trim(F.regexp_extract(body, heading, 1)))
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(body, heading, "")), r"\n##\s+")
    newline = lambda s: F.btrim(s, F.lit("\n"))
    head = lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("heading"), newline(F.regexp_replace(p, r"\A[^\n]*", "")).alias("body"))
    first = F.struct(F.lit("").alias("heading"), newline(parts[0]).alias("body"))
    rows = F.filter(F.concat(F.array(first), F.transform(F.slice(parts, F.lit(2), F.size(parts)), head)), lambda s: (s["heading"] != "") | (s["body"] != ""))
    own = F.trim(F.regexp_extract(front, r"(?m)^title:\s*(.+)$", 1))
    return F.struct(front.alias("frontmatter"), F.coalesce(title, T.nonempty(own), F.lit("")).alias("title"), rows.alias("sections"), F.coalesce(title, F.lit("")).alias("heading"))
