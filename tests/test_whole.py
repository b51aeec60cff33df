"""Queries on the rows and texts that their SQL leaves out, beside plain Python."""

import hashlib
import random
import re
import unicodedata

import pytest

import compare
from lorebase import queries
from lorebase.functions import values as V


def table(spark, path, texts):
    """A folder with ``documents`` of these texts, as the queries read it."""
    rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
    spark.createDataFrame(list(rows), "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


KNOWN = re.compile("|".join(p for g in (V.THEORIES, V.METHODS) for ps in g.values() for p in ps), re.I)


def plain_phrases(text):
    found = re.findall(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b", (text or "")[:2000])
    ranked = sorted(set(found), key=lambda p: (-found.count(p), p))
    return [p for p in ranked if p.split()[0] not in {"The", "This", "These", "We", "In", "Our"} and not KNOWN.search(p)][:12]


def test_concepts_fallback_takes_texts_of_any_script(spark, data, tmp_path):
    odd = [
        "Café culture – Smart Tourism grew. Smart Tourism, Mobile Banking", "한국어 문서 Remote Work 연구", "Remote Work연구 and Été Mobile Banking", "The\xa0Big Shift and Big Data",
        "Mobile Bankinǵ x", "́Mobile Banking x", "²Mobile Banking, Mobile Banking²", "Mobile\x1cBanking", "_Mobile Banking é", "é" * 1990 + " Mobile Banking", "Technology Acceptance é Online Reviews", "Plain Ascii", None, "",
    ]
    for d in (table(spark, tmp_path, odd), data):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
        want = {i: p for i, t in texts.items() if (p := plain_phrases(t))}
        assert {r["doc_id"]: r["phrases"] for r in queries.concepts_fallback(spark, d).collect()} == want
        assert d == data or {0, 1, 3} <= set(want)


def plain_slug(text):
    """The library's rule: 120 characters, words that do not fit left out, up to a word that ends at 120."""
    s = re.sub("(?i)&(?:amp|lt|gt|quot|apos);", " ", text.split("\n")[0]).lower()
    s = re.sub(r"[\W_]+", "-", re.sub(r"(?<=\d),(?=\d)", "", s)).strip("-")
    if len(s) < 120:
        return s or "untitled"
    if "-" not in s:
        return s[:120]
    out = ""
    for w in s.split("-"):
        if len(out) + len(w) < 120:
            out += w + "-"
        elif len(out) + len(w) == 120:
            out += w
            break
    return (out or s[:120]).strip("-")


def test_slug_takes_the_whole_first_line(spark, data, tmp_path):
    odd = ["a" * 59 + " " + "b" * 60 + " c", "a" * 59 + " " + "b" * 61 + " c", "a" * 119, "a" * 120, "a" * 121, "a" * 130 + " " + "b" * 130, "a" * 130 + " word", "가나 " * 60 + "\nx", "word " * 40, "ab " * 39 + "xyz more", "", "--", "x" * 101 + " tail\nnext"]
    odd += ["w" * 50 + " " + "v" * k + " " + "u" * (67 - k + d) + " z" for k in (10, 30) for d in (0, 1, 2, 3)]
    for d in (table(spark, tmp_path, odd), data):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
        kept = {i: t for i, t in texts.items() if t is not None and unicodedata.is_normalized("NFKC", t.split("\n")[0])}
        got = {r["doc_id"]: r["slug"] for r in queries.slug(spark, d).collect()}
        assert len(got) == len(texts) and {i: got[i] for i in kept} == {i: plain_slug(t) for i, t in kept.items()}


def plain_paper_pages(spark, d):
    """The paper pages that sources make one by one: {slug: page}, and [(seq, slug, change)]."""
    pages, changes = {}, []
    for e in sorted((r.asDict() for r in queries.extractions(spark, d).collect()), key=lambda r: int(r["source_id"][4:])):
        seq, link = int(e["source_id"][4:]), lambda kind, x, alias=None: f"[[{kind}/{plain_slug(x)}|{alias or x}]]"
        name = e["title"] or f"doc-{seq}"
        concepts, seen = [], set()
        for c in e["key_concepts"]:
            if len(c) >= 2 and (k := c.lower().strip()) and k not in seen:
                seen.add(k)
                concepts.append(c)
        concepts, theories, methods = concepts[:8], e["theoretical_background"], e["analysis_methods"]
        p = pages.setdefault(plain_slug(name), {"name": name, "seqs": [], "bodies": {}})
        changes.append((seq, plain_slug(name), "updated" if p["seqs"] else "created"))
        p["seqs"].append(seq)
        if e["abstract"]:
            p["bodies"]["Summary"] = f"> [!quote] 원문 요약 (Source Fact)\n> {e['abstract']}"
        groups = {
            "Research Context": {"Purpose": [e["purpose"]], "Research Questions": e["research_questions"], "Theoretical Background": [link("theories", t) for t in theories], "Key Concepts": [link("concepts", c) for c in concepts]},
            "Research Design": {"Methodology": [e["methodology"]], "Data": [e["data"]], "Sample": [e["sample"]]},
            "Analysis": {"Methods": [link("methods", m) for m in methods]},
            "Results": {"Key Findings": e["key_findings"], "Significant Relationships": e["significant_relationships"], "Non-significant Relationships": e["nonsignificant_relationships"]},
            "Discussion": {"Theoretical Contributions": e["theoretical_contributions"], "Practical Contributions": e["practical_contributions"], "Limitations": e["limitations"], "Future Work": e["future_work"]},
        }
        for section, parts in groups.items():
            body = "\n".join(f"**{label}:**\n" + "\n".join(f"- {v}" for v in kept) for label, rows in parts.items() if (kept := [v for v in rows if v]))
            if body:
                p["bodies"][section] = body.strip()
        related = [link("concepts", c) for c in concepts] + [link("theories", t) for t in theories] + [link("methods", m) for m in methods]
        related += [link("overviews", c, f"Overview: {c}") for c in concepts[:1]]
        if related:
            p["bodies"]["Related Pages"] = "\n".join(f"- {r}" for r in dict.fromkeys(related))
        lines = [f"- Source ID: `{e['source_id']}`", "- Local file: (metadata-only)", f"- DOI: {e['doi']}" if e["doi"] else "", "- Evidence level: unknown", V.EXTRACTOR_LINE]
        p["bodies"]["Provenance"] = "\n".join(x for x in lines if x)
    return pages, changes


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    """Sources 0, 52 and 182 share a page, as do 5 and 187; some lack an abstract, keywords or relations."""
    texts = {i: f"Document {i} speaks. Results show that méthode {i} works – mostly." for i in (0, 1, 2, 3, 5, 52, 182, 187, 364)}
    d = table(spark, tmp_path_factory.mktemp("papers"), texts | {7: None, 546: ""})
    return d, *plain_paper_pages(spark, d)


def section_text(p):
    return "\n\n".join([f"# {p['name']}", *[f"## {s}\n\n{p['bodies'].get(s, '')}".rstrip() for s in V.SECTIONS["papers"]]]) + "\n"


PAGE_QUERIES = {
    "wiki_pages": lambda pages, _: {("papers", s, p["name"], p["seqs"][0], len(p["seqs"])) for s, p in pages.items()},
    "page_changes": lambda _, changes: {(seq, "papers", s, c) for seq, s, c in changes},
    "page_render": lambda pages, _: {("papers", s, p["name"], hashlib.sha256(section_text(p).encode()).hexdigest()) for s, p in pages.items()},
    "page_parse_roundtrip": lambda pages, _: {("papers", s, p["name"], len(V.SECTIONS["papers"])) for s, p in pages.items()},
}


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_pages_hold_the_papers(spark, papers, name):
    d, pages, changes = papers
    df = queries.QUERIES[name](spark, d)
    rows = df.collect()
    mine = [tuple(r) for r in rows if r["page_type"] == "papers"]
    assert len(mine) == len(set(mine)) and set(mine) == PAGE_QUERIES[name](pages, changes) and max(len(p["seqs"]) for p in pages.values()) > 2
    cols, theirs = compare.duck(d, queries.ORACLES[name])
    assert compare.rows_of(df.columns, rows) == compare.rows_of(cols, theirs)


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    d = table(spark, tmp_path, ["one", "twö", None])
    spark.createDataFrame([(9, "three")], "doc_id long, text string").write.mode("append").parquet(f"{d}/documents.parquet")
    df = queries.stream_register(spark, d)
    cols, theirs = compare.duck(d, queries.ORACLES["stream_register"])
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(cols, theirs) and len(theirs) == 4
