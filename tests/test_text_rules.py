"""Rules over whole texts are planned once and give what the rules by line and paragraph give."""


def test_text_rules_are_planned_once(spark, data):
    """A pattern that is planned several times runs several times over every text; slugs are made by name, not by row of the log."""
    from lorebase import queries as Q
    from lorebase.functions import values as V
    from lorebase.operators import extract as X
    from lorebase.operators import merge as M
    from lorebase.plans import papers as P

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        sources = P.papers(spark, data)
        text = plan(X.extract(sources))
        # one of the two runs, by language
        assert text.count(V.ENGLISH_ABSTRACT) == 2 and text.count("translate(") == 0
        log = plan(M.contributions(sources.drop("text"), Q.extractions(spark, data)))
        assert log.split("Join Inner")[0].count("lorebase_plain_") == 5  # papers, three kinds of entities, questions
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_blanks_titles_and_lines_at_once(spark):
    """Cases where the rules that run over the whole text at once could differ from those by paragraph and line."""
    from lorebase.functions import text as T

    text = "A B. C　 D end. \r\n\r\n Next one here is long.  Then another sentence!\x0bTail without an end \n1. Head\nLast  \t paragraph, of  its own\r\n"
    row = spark.createDataFrame([(text,)], "text string").select(T.lines("text").alias("ls"), T.sentences(T.paragraphs(T.lines("text"))).alias("ss")).first()
    assert row["ls"] == [x.strip() for x in text.splitlines()]
    assert row["ss"] == ["Next one here is long.", "Then another sentence!", "Tail without an end", "Last paragraph, of its own"]


def test_parts_of_the_log_suffice(spark, data):
    """A query that reads a part of the log gets what the whole log gives it, and rules over the text that only other parts need are not planned."""
    from lorebase import queries as Q
    from lorebase.functions import text as T
    from lorebase.functions import values as V
    from lorebase.operators import merge as M

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        whole = Q.log(spark, data)
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(M.touches(Q.contributed(spark, data, **M.TOUCHES))) == rows(M.touches(whole))
        concepts = {"kinds": {"concepts"}, "sections": {"Conflicting Findings"}}
        plan = lambda **part: Q.contributed(spark, data, **part)._jdf.queryExecution().optimizedPlan().toString()
        counted = T.lowered(r"\bsurvey\b")
        cue = lambda text, name: T.lowered(V.CUES[name][0]) in text
        text = plan(**concepts)
        assert not any(cue(text, name) for name in V.CUES) and counted not in text
        text = plan(kinds={"questions"}, op="set")
        assert cue(text, "future_work") and not cue(text, "purpose") and counted not in text
        text = plan(**M.NAMES)
        assert counted in text and not cue(text, "purpose") and not cue(text, "data")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_patterns_on_folded_text(spark):
    """Patterns that regard case on folded text find what those that ignore it find on the text itself; so does a literal from its rarest letter on."""
    from lorebase.functions import text as T
    from lorebase.functions import values as V
    from lorebase.operators import extract as X
    from pyspark.sql import functions as F

    assert T.lowered(r"\bMETHODS?\b\D\p{L}") == r"method(?<=\bmethod)s?\b\D\p{L}" and T.lowered(r"\bUTAUT2?\b") == r"utaut(?<=\butaut)2?\b"
    assert T.sought("expectan") == "xpectan" and T.sought("sem") == "sem"
    texts = ["PLS-SEM and SEM; SEMantics LDA토픽 lda_ UTAUT2 stam TAM", "ınterviewſ Interviewİ ınterKview SURVEY", "N = 5, RQ1: RQ; future WORK, METHODOLOGY", "ΟΔΟΣ tam", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", T.folded("text"))
    patterns = [p for g in (V.THEORIES, V.METHODS, V.CUES) for ps in (g.values()) for p in ps]
    pairs = [(F.regexp_count("text", F.lit(T.pattern(p))), F.regexp_count("low", F.lit(T.pattern(T.lowered(p), "")))) for p in patterns]
    assert all(a == b for r in rows.select(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs]).collect() for a, b in r)
    years = [r[0] for r in spark.createDataFrame([(t,) for t in ["x1999 20201 1850 2100 (2019)", "1899", "a 1990.", ""]], "text string").select(X.year("text")).collect()]
    assert years == [2019, None, 1990, None]


def test_white_space_of_every_script(spark):
    from lorebase.functions import text as T

    texts = ["", " ", "a b", " a", "a ", "a  b", "a\tb", "é b", "a b", "a 　 b", " a b ", "😀 \x1f😀", "a​b", "\x00 a"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").orderBy("i").select(T.collapse("s")).collect()]
    assert got == [" ".join(t.split()) for t in texts]
    tidy = spark.createDataFrame([("a b",)], "s string").select(T.collapse("s").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "++" in tidy
