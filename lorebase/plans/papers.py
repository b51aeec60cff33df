"""A corpus of papers composed from the documents table, alike in Spark and DuckDB.

Every document becomes a paper: headings, an abstract, keywords and a section on limitations around its whole text.
The same SQL text runs on both engines, which lets the SQL of each query start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_THEORIES = ["technology acceptance", "planned behavior", "diffusion of innovations", "goal-setting theory", "expectancy theory"]
_METHODS = ["structural equation modeling", "topic modeling", "sentiment analysis", "regression analysis", "latent profile analysis", "an interview study"]
_TOPICS = ["Mobile Banking", "Online Reviews", "Smart Tourism", "mobile banking", "E-Learning", "Remote Work", "Service Robots"]


def _case(n: str, values: list[str]) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


_NL = "chr(10)"
_THEORY, _METHOD, _TOPIC = _case("doc_id", _THEORIES), _case("doc_id", _METHODS), _case("doc_id", _TOPICS)
_TEXT = " || ".join([
    f"'Adoption of ' || {_TOPIC} || ' in Region ' || chr(65 + (doc_id % 26)::INT) || ' Services'", _NL,
    "CASE doc_id % 5 WHEN 0 THEN '김철수, 이영희' ELSE 'A. Smith and B. Jones' END", _NL,
    f"'Journal of Service Studies, ' || (doc_id % 20 + 1) || '(' || (doc_id % 4 + 1) || ')' || CASE doc_id % 3 WHEN 0 THEN ', ' || (1990 + doc_id % 35) ELSE '' END", _NL,
    f"CASE doc_id % 3 WHEN 1 THEN 'https://doi.org/10.1234/svc.' || doc_id || '.' || {_NL} ELSE '' END", _NL,
    "'Abstract'", _NL,
    f"'The purpose of this study is to examine {{0}} by means of {{1}}. It covers wave ' || (2000 + doc_id % 20) || ' of the panel.'".replace("{0}", f"' || {_THEORY} || '").replace("{1}", f"' || {_METHOD} || '"), _NL, _NL,
    f"CASE doc_id % 4 WHEN 3 THEN '' ELSE 'Keywords: ' || {_TOPIC} || ', ' || {_THEORY} || '; Trust ' || (doc_id % 3) || '.' || {_NL} END",
    "'1. Introduction'", _NL,
    "coalesce(text, '')", _NL, _NL,
    "'2. Methods'", _NL,
    f"'We conducted a survey among ' || (100 + doc_id % 400) || ' respondents in two rounds. Data were collected online in spring.'", _NL,
    f"'We used ' || {_METHOD} || ' to test the model of ' || {_THEORY} || '.'", _NL,
    "'3. Results'", _NL,
    f"'The results show that quality improves adoption in group ' || (doc_id % 6) || '. Managerial advice follows from this result.'", _NL,
    "CASE doc_id % 6 WHEN 5 THEN '4. Discussion' ELSE '4. Limitations and Future Research' END", _NL,
    "'The small size of panel ' || (doc_id % 7) || ' is a limitation of this work.' ", "' Future research should examine topic ' || (doc_id % 11) || ' in further markets and over longer periods of time.'", _NL,
    "'References'", _NL,
])

SQL = f"""
SELECT 'src-' || doc_id AS source_id, doc_id AS seq, 'doc-' || doc_id AS title,
       CASE doc_id % 4 WHEN 0 THEN 'journal_article' WHEN 1 THEN 'presentation' WHEN 2 THEN 'webpage' ELSE 'personal_note' END AS source_type,
       {_TEXT} AS text
FROM documents WHERE doc_id IS NOT NULL
"""


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are: text rules are heavy on few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, seq, title, source_type, text, author, doi)."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    got = spark.sql(SQL.replace("FROM documents", "FROM {documents}").replace("::INT", "").replace("chr(65 + (doc_id % 26))", "chr(65 + doc_id % 26)"), documents=docs)
    return got.selectExpr("*", "cast(array() as array<string>) AS author", "cast(null as string) AS doi")
