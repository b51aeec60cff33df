"""Rules of registration, extraction and merge on made-up papers, and whole ingests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.functions import values as V
from lorebase.operators import extract as X
from lorebase.operators import graph as G
from lorebase.operators import merge as M
from lorebase.operators import register as R
from lorebase.operators import search as S
from lorebase.plans.knowledge_base import KnowledgeBase
from lorebase.sources.durable import cut

PAPER = """Trust and Mobile Payment Use *12
Smith, J.

Abstract
The purpose of this study is to examine technology acceptance for mobile payment by
structural equation modeling.

Keywords: Mobile Payment, trust; TAM.
1. Introduction
We ask whether trust matters. This sentence is long enough too!
Short one. RQ1 concerns the role of privacy.
2. Methods
We conducted a survey with 1,200 respondents in 2019. Data were collected online.
3. Results
Results show that trust matters. https://doi.org/10.1234/AB.2020.7.
4. Limitations and outlook
The first limitation is the sample. Firstly, future research should examine other markets in depth.
References
[1] Nobody (1999).
"""
KOREAN = """제 12 권 제 3 호 2020년
온라인 리뷰 연구의 새로운 방향
홍길동, 김영희·박철수
Test Business Review, 12(3)
요 약
본 연구는 온라인 리뷰를 대상으로 기대 불일치 이론을 검토하는 것을 목적으로 한다. LDA토픽 분석을 활용하여 5,000건의 리뷰를 수집하였다.
주제어: 온라인 리뷰, LDA, 기대 불일치
Ⅰ. 서론
연구 결과 기대 불일치가 만족에 영향을 주는 것으로 나타났다.
Ⅴ. 한계 및 향후 연구
본 연구는 표본이 비교적 적다는 한계가 있다. 향후 연구에서는 다양한 지역을 비교할 필요가 있다.
"""


def one(spark, column, text=PAPER):
    return spark.createDataFrame([(text,)], "text string").select(T.lines("text").alias("ls"), "text").select(column.alias("x")).first()["x"]


def extracted(spark, text, title="paper_file", **more):
    row = {"source_id": "s1", "title": title, "author": None, "doi": None, "text": text} | more
    return X.extract(spark.createDataFrame([row], "source_id string, title string, author array<string>, doi string, text string")).first().asDict()


def test_english_paper(spark):
    e = extracted(spark, PAPER)
    assert e["language"] == "en" and e["title"] == "Trust and Mobile Payment Use" and e["doi"] == "10.1234/AB.2020.7"
    assert e["keywords"] == ["Mobile Payment", "trust", "TAM"] and e["key_concepts"] == ["Mobile Payment", "trust"]
    assert e["abstract"] == "The purpose of this study is to examine technology acceptance for mobile payment by structural equation modeling."
    assert e["year"] == 2019 and e["journal"] is None and e["authors"] == []
    assert e["theoretical_background"] == ["Technology Acceptance Model (TAM)"]
    assert e["analysis_methods"] == ["Structural Equation Modeling (SEM)", "Survey"]
    assert e["sample"] == "We conducted a survey with 1,200 respondents in 2019." and e["data"] == "Data were collected online."
    assert e["research_questions"] == ["We ask whether trust matters.", "RQ1 concerns the role of privacy."]
    assert e["limitations"] == ["The first limitation is the sample."]
    assert e["future_work"] == ["Firstly, future research should examine other markets in depth."]


def test_korean_paper(spark):
    e = extracted(spark, KOREAN)
    assert e["language"] == "ko" and e["authors"] == ["홍길동", "김영희", "박철수"] and e["journal"] == "Test Business Review"
    assert e["year"] == 2020 and e["title"] == "온라인 리뷰 연구의 새로운 방향"
    assert e["abstract"].startswith("본 연구는") and e["keywords"] == ["온라인 리뷰", "LDA", "기대 불일치"]
    assert e["theoretical_background"] == ["Expectancy-Disconfirmation Theory"] and e["key_concepts"] == ["온라인 리뷰"]
    assert e["limitations"] == ["본 연구는 표본이 비교적 적다는 한계가 있다."] and len(e["future_work"]) == 1


def test_empty_and_odd_texts(spark):
    e = extracted(spark, " \n ", title="x", doi="10.1/a.")
    assert e["doi"] == "10.1/a" and e["language"] is None and e["keywords"] == [] and e["title"] == "x"
    assert extracted(spark, None)["key_findings"] == []
    assert one(spark, F.col("ls"), "a\r\nb  c \x1c\n") == ["a", "b", "c", ""]
    rows = one(spark, T.paragraphs("ls"), "one\n two\n\n3 apples\nthree\nKeywords: x\n")
    assert [(r["heading"], r["text"]) for r in rows] == [(False, "one two"), (True, "3 apples"), (False, "three"), (True, "Keywords: x")]


def test_mentions_count_every_pattern(spark):
    got = one(spark, X.mentions("text", V.METHODS), "PLS-SEM and SEM; SEMantics; LDA토픽 LDA")
    assert {r["name"]: r["n"] for r in got if r["n"]} == {"Structural Equation Modeling (SEM)": 3, "Latent Dirichlet Allocation (LDA)": 1}
    theory = one(spark, X.mentions("text", V.THEORIES), "expectancy theory, disconfirmation expectancy theory")
    assert {r["name"]: r["n"] for r in theory if r["n"]} == {"Expectancy Theory": 1}


def test_literals_are_in_every_match():
    assert T.literal(r"goal(-setting)?\s+theory") == "theory" and T.literal(r"planned\s+behaviou?r") == "planned" and T.literal(r"\bTAM\b") == "tam"


def test_names(spark):
    row = spark.range(1).select(
        T.slug(F.lit("  Latent Dirichlet Allocation (LDA) ")).alias("a"), T.slug(F.lit("온라인 리뷰")).alias("b"), T.slug(F.lit("!!")).alias("c"), T.slug(F.lit("word " * 60)).alias("d"),
        T.short_ref(F.array(F.lit("Smith, John")), F.lit("t"), F.lit("s"), F.lit(2021)).alias("e"), T.short_ref(F.array(F.lit("홍길동"), F.lit("x")), F.lit("t"), F.lit("s"), F.lit(2020)).alias("f"),
        T.short_ref(F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit("s"), F.lit(None).cast("int")).alias("g"), T.question_title(F.lit("Secondary data matter.")).alias("h"),
        T.question_title(F.lit("Finally, future research " + "x" * 80)).alias("i"), R.evidence_rank(F.lit("peer_reviewed")).alias("j"), R.evidence_rank(F.lit("unknown")).alias("k"),
        G.one_line(F.lit("a"), F.lit("mixed"), F.lit("b")).alias("l"),
    ).first()
    assert row[:3] == ("latent-dirichlet-allocation-lda", "온라인-리뷰", "untitled") and len(row["d"]) <= 120 and not row["d"].endswith("-")
    assert row[4:7] == ("Smith (2021)", "홍길동 외 (2020)", "s") and row["h"] == "ary data matter." and row["i"] == "x" * 50 + "…"
    assert row[9:] == (9, 0, "a →(±) b")


def _plain_slug(name):
    """The rule one name at a time; shorter than the longest slug."""
    import unicodedata
    from html.entities import name2codepoint

    def numbers(p, base, s):
        try:
            return re.sub(p, lambda m: chr(int(m[1], base)), s)
        except (ValueError, OverflowError):
            return s

    s = unicodedata.normalize("NFKC", name.replace("'", "-"))
    s = re.sub(r"&(\w+);", lambda m: chr(name2codepoint[m[1]]) if m[1] in name2codepoint else m[0], s)
    s = unicodedata.normalize("NFKC", numbers(r"&#x([\da-fA-F]+);", 16, numbers(r"&#(\d+);", 10, s))).lower().replace("'", "")
    return re.sub(r"[\W_]+", "-", re.sub(r"(?<=\d),(?=\d)", "", s)).strip("-") or "untitled"


def test_slugs_of_any_script(spark):
    """Full width, ligatures, letters with loose marks, Hangul by letters, references by name and number, apostrophes of each."""
    given = {
        "Ｔｒｕｓｔ　２.０": "trust-2-0", "eﬃcient ﬁnance": "efficient-finance", "Cafe\u0301 Gefu\u0308hl": "café-gefühl", "\u1112\u1161\u11ab\u1100\u1173\u11af": "한글",
        "R&amp;D": "r-d", "na&iuml;ve &Eacute;tude": "naïve-étude", "x&#178;": "x2", "&#x41;&#66;": "ab", "&amp;#67;": "c", "rock&#39;n": "rockn", "rock'n": "rock-n", "rock＇n": "rockn",
        "&nope; &apos;": "nope-apos", "&#9999999;&#65;": "9999999-65", "1,000 &#44; 2&#44;5": "1000-25", "①②": "12", "": "untitled", "&": "untitled",
    }
    dice = random.Random(5)
    parts = [*given, "a", "B", "é", "ß", " ", "&", ";", "#", "x", "&lt;", "'", "7", ",", "ｱ", "ﾞ", "\u0327", "Ω", "한", "_"]
    names = [*given, *("".join(dice.choices(parts, k=4)) for _ in range(300))]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.slug("n").alias("s"), T.nfkc("n").alias("c")).collect()
    assert {r["n"]: r["s"] for r in got if r["n"] in given} == given
    assert [r["s"] for r in got if len(_plain_slug(r["n"])) < 120] == [s for s in (_plain_slug(r["n"]) for r in got) if len(s) < 120]
    assert spark.sql("SELECT string(null) AS n").select(T.slug("n")).first()[0] == "untitled"


def test_first_match_is_sequential(spark):
    rng = random.Random(1)
    rows = [(i, *(str(rng.randrange(12)) if rng.random() < 0.6 else None for _ in range(3))) for i in range(120)]
    kept, want = [], {}
    for seq, *keys in rows:
        want[seq] = next((k[0] for k in kept if any(a is not None and a == b for a, b in zip(keys, k[1:]))), None)
        if want[seq] is None:
            kept.append((seq, *keys))
    got = R.first_match(spark.createDataFrame(rows, "seq long, a string, b string, c string"), ["a", "b", "c"])
    assert {r["seq"]: r["dup_of"] for r in got.collect()} == want


def chains(rng, n):
    """Rows that share a key with the next, whole or with gaps, and some that share more."""
    return [(i, f"a{i // 2}", f"b{(i + 1) // 2}" if rng.random() < 0.98 else None, str(rng.randrange(n)) if rng.random() < 0.05 else None) for i in range(n)]


@pytest.mark.parametrize("n, most", [(10_000, 100_000), (40, 8)])
def test_first_match_on_long_chains(spark, monkeypatch, n, most):
    """A chain of 10,000 takes a few rounds; components that are too large for a task come apart by rounds."""
    rng, rounds = random.Random(n), []
    rows, kept, want = chains(rng, n) if n < 1000 else [(i, f"a{i // 2}", f"b{(i + 1) // 2}", None) for i in range(n)], {}, {}
    for seq, *keys in rows:
        own = [(k, x) for k, x in enumerate(keys) if x is not None]
        want[seq] = min((kept[x] for x in own if x in kept), default=None)
        if want[seq] is None:
            kept |= dict.fromkeys(own, seq)
    settled = R._settled
    monkeypatch.setattr(R, "_settled", lambda *a: rounds.append(1) or settled(*a))
    got = R.first_match(spark.createDataFrame(rows, "seq long, a string, b string, c string"), ["a", "b", "c"], most=most)
    assert {r["seq"]: r["dup_of"] for r in got.collect()} == want
    assert n < 1000 or len(rounds) <= 5


def test_new_keys_meet_their_buckets_alone(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store")
    keyed = lambda rows, start: cut(R.identity_keys(KnowledgeBase._with_columns(spark.createDataFrame(rows, "source_id string, doi string"))).withColumn("seq", F.monotonically_increasing_id() + start))
    for k in range(2):
        folder = kb._write_keys(kb.manifest.folder(), keyed([(f"{k}-{i}", f"10.1/{k}.{i}") for i in range(200)], 10**12 * k))
        kb.manifest.add({"keys": folder, "sources": folder})
    found = kb._keys(keyed([("x", "10.1/0.7")], 0))
    assert [tuple(r)[:2] for r in found.collect()] == [(0, "10.1/0.7")]
    pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "bucket" in pushed and "key" in pushed and "/sources/" not in " ".join(found.inputFiles())


def test_keys(spark):
    df = spark.createDataFrame([(" 10.1/ABC ", None, "https://X.org/a//", " A  Great Paper", ["Kim"]), ("", "", "", " ", None)], "doi string, file_hash string, url string, title string, author array<string>")
    a, b = R.identity_keys(df).collect()
    assert (a["key_doi"], a["key_hash"], a["key_url"], a["key_title"]) == ("10.1/abc", None, "https://x.org/a", "a great paper\x1fKim")
    assert (b["key_doi"], b["key_url"]) == (None, None) and b["key_title"].startswith("\x1f")


def test_effects_and_idempotent_pages(spark):
    base = extracted(spark, PAPER)
    rows = [base | {"source_id": f"s{i}", "title": f"Paper {i}", "significant_relationships": ["a -> b"] if i in (1, 2) else [], "nonsignificant_relationships": ["c -> d"] if i == 3 else []} for i in range(5)]
    e = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in X.EXTRACTION.split(", ")) for r in rows], X.EXTRACTION)
    s = spark.createDataFrame([(i, f"s{i}", None, [], None, "other") for i in range(5)], "seq long, source_id string, title string, author array<string>, doi string, source_type string")
    log = M.contributions(s, e).cache()
    got = {(r["seq"], r["effect"]) for r in M.touches(log).where("slug = 'mobile-payment' AND page_type = 'concepts'").collect()}
    assert got == {(0, "extend"), (1, "extend"), (2, "strengthen"), (3, "contradict"), (4, "unchanged")}
    twice = log.union(log)
    assert sorted(M.page_texts(twice).collect(), key=str) == sorted(M.page_texts(log).collect(), key=str)
    text = M.page_texts(log).where("slug = 'mobile-payment' AND page_type = 'concepts'").select("text", M.parse_page("text").alias("p")).first()
    sections = {x["heading"]: x["body"] for x in text["p"]["sections"]}
    assert text["p"]["title"] == "Mobile Payment" and list(sections) == V.SECTIONS["concepts"]
    assert sections["Established Findings"].count("\n") == 1 and sections["Conflicting Findings"].startswith("- (non-significant) c -> d")
    d = {(r["metric"], r["key"]): r["value"] for r in S.digest(s, M.pages(log), M.sections(log)).collect()}
    assert d["total_sources", ""] == 5 and d["contradictions", ""] == 2 and d["wiki_pages", "papers"] == 5


def test_page_parsing(spark):
    page = "---\ntitle: T\n---\n\n# Name\n\nintro\n\n## One\n\nbody\nmore\n\n## Two\n"
    p = spark.createDataFrame([(page,), ("no heading",)], "t string").select(M.parse_page("t").alias("p")).collect()
    assert p[0]["p"]["title"] == "Name" and [(x["heading"], x["body"]) for x in p[0]["p"]["sections"]] == [("", "intro"), ("One", "body\nmore"), ("Two", "")]
    assert p[1]["p"]["title"] == "" and p[1]["p"]["frontmatter"] is None


def test_search(spark):
    df = spark.createDataFrame([("wiki/b.md", "# B\nthe Theory of the"), ("wiki/a.md", "the the the"), ("wiki/c.md", "nothing")], "path string, text string")
    hits = S.keyword_search(df, "THE").collect()
    assert [(h["path"], h["title"], h["score"]) for h in hits] == [("wiki/a.md", "a", 3), ("wiki/b.md", "B", 3)]
    assert S.keyword_search(df, " ").count() == 0 and len(S.keyword_search(df, "the", 1).collect()) == 1


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    (root / "in").mkdir()
    (root / "in/a.txt").write_text(PAPER)
    (root / "in/b.md").write_text(PAPER.replace("Trust and Mobile", "Risk and Mobile").replace("other markets", "new regions"))
    (root / "in/c.txt").write_text(PAPER)
    (root / "in/d.html").write_bytes(b"<p>caf\xe9 x</p>")
    (root / "in/e.bin").write_text("skip")
    kb = KnowledgeBase(spark, f"file://{root}/store")
    return root, kb, kb.ingest(f"{root}/in")


def test_ingest(spark, base):
    root, kb, got = base
    assert (got.n_new, got.n_dup) == (3, 1)
    again = kb.ingest(f"{root}/in")
    assert (again.n_new, again.n_dup) == (0, 4) and kb.sources().count() == kb.extractions().count() == 3
    changes = {(r["seq"], r["page_type"], r["slug"]): r["change"] for r in kb.changes().collect()}
    assert changes[1, "concepts", "mobile-payment"] == "created" and changes[2, "concepts", "mobile-payment"] == "updated"
    page = kb.show("papers", "trust-and-mobile-payment-use")
    assert page.startswith("---\ntitle: Trust and Mobile Payment Use\ntype: paper\n") and "## Provenance" in page
    # raw bytes and the touched pages are files as soon as the ingest ends, and the ingest says what it changed
    for r in kb.sources().select("local_file", "file_hash").collect():
        import hashlib

        assert hashlib.sha256((root / "store" / r["local_file"]).read_bytes()).hexdigest() == r["file_hash"]
    assert (root / "store/wiki/papers/trust-and-mobile-payment-use.md").read_text().startswith("---\ntitle: Trust and Mobile Payment Use\n")
    told = {(r["seq"], r["page_type"], r["slug"]): (r["change"], r["effect"]) for r in got.changes.collect()}
    assert {k: c for k, (c, _) in told.items()} == changes and told[1, "concepts", "mobile-payment"] == ("created", "extend")
    assert again.changes is None
    assert kb.show("papers", "none") is None and kb.search("mobile payment").first()["score"] > 0


def test_metadata_and_projects(spark, base):
    _, kb, _ = base
    rows = spark.createDataFrame([("m1", "10.9/x", "One"), ("m2", "10.9/X ", "Two"), ("m3", None, "Three")], "source_id string, doi string, title string")
    got = kb.ingest_metadata(rows)
    assert (got.n_new, got.n_dup) == (2, 1)
    first = kb.add_project("P", keywords="a, b,,")
    kb.add_project("Q")
    kb.add_project("P", keywords="c")
    assert [(r["project_id"] == first, r["keywords"]) for r in kb.projects().collect()] == [(False, []), (True, ["c"])]


def test_export_and_cli(spark, base, capsys):
    from lorebase import cli

    root, kb, _ = base
    kb.export()
    assert (root / "store/wiki/concepts/mobile-payment.md").read_text().startswith("---\ntitle: Mobile Payment\n")
    from lorebase.sources.files import read_pages

    assert read_pages(spark, f"file://{root}/store").count() == kb.wiki().count()
    store = ["--store", f"file://{root}/store"]
    assert cli.main([*store, "digest"], spark) == 0 and "**Total sources:**" in capsys.readouterr().out
    assert cli.main([*store, "show", "papers", "none"], spark) == 1


def test_watch(spark, base, tmp_path):
    from lorebase.streaming.watch import watch

    root, kb, _ = base
    live = KnowledgeBase(spark, f"file://{tmp_path}/store")
    watch(spark, f"{root}/in", live, f"file://{tmp_path}/state").awaitTermination(120)
    batch = {(r["page_type"], r["slug"]) for r in KnowledgeBase(spark, kb.root).wiki().collect()}
    assert {(r["page_type"], r["slug"]) for r in live.wiki().collect()} <= batch and live.sources().count() == 3


def test_row_extractor(spark):
    fn = X.by_row(lambda source, text: {"title": source["title"].upper(), "keywords": text.split()})
    df = spark.createDataFrame([("s", "t", "a b")], "source_id string, title string, text string")
    r = fn(df).first()
    assert (r["title"], list(r["keywords"]), list(r["models"])) == ("T", ["a", "b"], [])


def test_graph_and_ranges(spark):
    nodes = spark.createDataFrame([("n1", "concept", "A  b", ["x"], ["s1"]), ("n2", "concept", "a B", [], ["s2", "s1"])], "node_id string, node_type string, label string, aliases array<string>, source_ids array<string>")
    m = G.merge_nodes(nodes).collect()
    assert len(m) == 1 and (m[0]["key"], m[0]["node_id"], m[0]["source_ids"], m[0]["n"]) == ("concept:a b", "n1", ["s1", "s2"], 2)
    ok, bad = G.valid(spark.createDataFrame([(0.5,), (1.5,), (None,)], "confidence double"))
    assert (ok.count(), bad.count()) == (1, 2)


def test_hand_edited_front_matter_stays(spark, tmp_path):
    (tmp_path / "a.txt").write_text(PAPER)
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store")
    kb.ingest(f"{tmp_path}/a.txt")
    page = tmp_path / "store/wiki/concepts/mobile-payment.md"
    page.write_text(page.read_text().replace("tags:\n- concept", "tags:\n- zeta\n- mine").replace("title: Mobile Payment", "title: Paying"))
    question = next((tmp_path / "store/wiki/questions").iterdir())
    question.write_text(question.read_text().replace("status: detected", "status: reviewing"))
    (tmp_path / "b.txt").write_text(PAPER.replace("Trust and Mobile", "Risk and Mobile"))
    kb.ingest(f"{tmp_path}/b.txt")
    text = page.read_text()
    assert text.startswith("---\ntitle: Paying\ntype: concept\ntags:\n- concept\n- mine\n- zeta\n") and text.count("- [[papers/") == 2
    assert "status: reviewing" in question.read_text()


def test_graph_round_trip_and_provenance(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store")
    assert [x.count() for x in kb.graph()] == [0, 0]
    nodes = spark.createDataFrame([("n1", "concept", "A", ["x"], ["s1"], None), ("n2", "paper", "B\n\"q\"", [], ["s1"], "p.md")], G.NODE)
    edges = spark.createDataFrame([("e1", "n1", "n2", "uses", 0.5, [])], G.EDGE)
    for _ in range(2):
        kb.save_graph(nodes, edges)
        assert [sorted(map(tuple, x.collect())) for x in kb.graph()] == [sorted(map(tuple, x.collect())) for x in (nodes, edges)]
    e = X.extract(spark.createDataFrame([("s1", "t", None, None, PAPER)], "source_id string, title string, author array<string>, doi string, text string"))
    got = e.select(X.self_provenance().alias("p")).first()["p"].asDict()
    assert got == {"source_id": "s1", "title": "Trust and Mobile Payment Use", "authors": [], "year": 2019, "doi": "10.1234/AB.2020.7", "url": None, "page": None, "section": None, "quote": None}
    assert e.select(X.self_provenance().cast(G.PROVENANCE)).count() == 1


def test_sections_and_effects_by_name(spark):
    rows = [(1, "s", True, False, 6, 0, "questions", "Q", "Status", "set", "a", "q"), (2, "s", True, False, 6, 0, "questions", "Q", "STATUS", "set", "b", "q")]
    rows += [(1, "s", True, False, k, 0, kind, "Trust", "Related Papers", "append", "- x", "trust") for k, kind in ((2, "concepts"), (4, "methods"))]
    rows += [(0, "r", True, False, 4, 0, "methods", "Trust", "Established Findings", "append", "- y", "trust")]
    log = spark.createDataFrame(rows, "seq long, source_id string, has_sig boolean, has_nonsig boolean, step int, pos int, page_type string, name string, section string, op string, line string, slug string")
    assert [(r["section"], r["line"]) for r in M.set_sections(log).collect()] == [("Status", "b")]
    assert {(r["seq"], r["name"], r["effect"]) for r in M.effects_by_name(log).collect()} == {(0, "Trust", "extend"), (1, "Trust", "strengthen")}


def test_new_sources_against_kept_ones(spark):
    rng = random.Random(3)
    rows = [(i, *(str(rng.randrange(25)) if rng.random() < 0.6 else None for _ in range(3))) for i in range(100)]
    kinds = "seq long, a string, b string, c string"
    whole = {r["seq"]: r["dup_of"] for r in R.first_match(spark.createDataFrame(rows, kinds), ["a", "b", "c"]).collect()}
    kept = [r for r in rows[:40] if whole[r[0]] is None]
    names = ["a", "b", "c"]
    got = R.first_match_against(R.key_rows(spark.createDataFrame(kept, kinds), names), spark.createDataFrame(rows[40:], kinds), names)
    assert {r["seq"]: r["dup_of"] for r in got.collect()} == {k: v for k, v in whole.items() if k >= 40}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lorebase.sources import durable

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_dir(far)
