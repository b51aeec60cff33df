"""The catalogue: each query beside DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import extract as X
from .operators import graph as G
from .operators import merge as M
from .operators import register as R
from .operators import search as S
from .plans import papers as P
from .sources.durable import cut, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- DuckDB's side of the text rules: RE2 has no look-around and counts letters by ASCII in \b

_W = r"[^\p{L}\p{N}_]"


def _re(p: str) -> str:
    """A pattern for RE2: borders spelled out, look-around dropped, quotes doubled."""
    p = p.replace(r"\b", "")
    return p.replace("(?<!disconfirmation )", "").replace("(?<!불일치 )", "").replace("(?![가-힣]*\\s*이상)", "").replace("'", "''")


def _hit(s: str, patterns: list[str]) -> str:
    whole = [rf"(?:^|{_W}){_re(p)}(?:$|{_W})" if p.startswith(r"\b") and p.endswith(r"\b") else rf"(?:^|{_W}){_re(p)}" if p.startswith(r"\b") else _re(p) for p in patterns]
    return f"regexp_matches({s}, '{'|'.join(f'(?:{p})' for p in whole)}', 'i')"


def _count(s: str, p: str) -> str:
    own = rf"(?:^|{_W}){_re(p)}(?:$|{_W})" if p.startswith(r"\b") else _re(p)
    n = f"len(regexp_extract_all({s}, '(?i){own}'))"
    return f"({n} - len(regexp_extract_all({s}, '(?i)disconfirmation {_re(p)}')))" if p.startswith("(?<!disc") else n


_PAPERS = f"papers AS ({P.SQL})"
_HEAD = _re(V.HEADING).replace("keywords|abstract|references", rf"keywords(?:$|{_W})|abstract(?:$|{_W})|references(?:$|{_W})").replace(r"key\s*words?|", rf"key\s*words?(?:$|{_W})|")
_LINES = _PAPERS + r""", lined AS (SELECT *, list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM papers)"""
_PARAGRAPHS = _LINES + f""", marked AS (
  SELECT *, list_filter(list_transform(string_split(array_to_string(list_transform(ls, lambda x:
    CASE WHEN x = '' THEN chr(1) WHEN regexp_matches(x, '{_HEAD}', 'i') THEN chr(1) || chr(2) || x || chr(1) ELSE x END), chr(10)), chr(1)),
    lambda p: trim(p, chr(10))), lambda p: p <> '') AS ps FROM lined)"""
_SPLIT = r"""list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(replace({p}, chr(10), ' '), '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(3), 'g'), chr(3)), lambda s: trim(s)), lambda s: length(s) > 15)"""
_SENTENCES = _PARAGRAPHS + f""", split AS (
  SELECT *, flatten(list_transform(list_filter(ps, lambda p: NOT starts_with(p, chr(2))), lambda p: {_SPLIT.replace("{p}", "p")})) AS ss,
    list_position(list_transform(ps, lambda p: starts_with(p, chr(2)) AND regexp_matches(p, '{V.LIMITATION_HEADING}', 'i')), true) AS lim FROM marked),
sectioned AS (SELECT *, CASE WHEN lim > 0 THEN list_position(list_transform(ps[lim + 1:], lambda p: starts_with(p, chr(2))), true) END AS stop FROM split),
sentences AS (SELECT *, CASE WHEN lim > 0 THEN flatten(list_transform(CASE WHEN stop > 0 THEN ps[lim + 1:lim + stop - 1] ELSE ps[lim + 1:] END, lambda p: {_SPLIT.replace("{p}", "p")})) ELSE [] END AS own FROM sectioned)"""
_CUE = {k: _hit("s", v) for k, v in V.CUES.items()}


def _cue(name: str, k: int | None = None, rows: str = "ss") -> str:
    got = f"list_filter({rows}, lambda s: {_CUE[name]})"
    return f"{got}[1:{k}]" if k else got


_LIMITS = f"CASE WHEN len(own) > 0 THEN list_filter(own, lambda s: {_CUE['limitations']} OR NOT {_CUE['future_work']})[1:6] ELSE {_cue('limitations', 5)} END"
_FUTURE = f"CASE WHEN len(own) > 0 THEN {_cue('future_work', 6, 'own')} ELSE {_cue('future_work', 5)} END"
_DOI = r"nullif(rtrim(regexp_extract(text, '(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+'), '.,;'), '')"
_LANG = "CASE WHEN len(regexp_extract_all(text, '[가-힣]')) > len(regexp_extract_all(text, '[A-Za-z]')) * 0.3 THEN 'ko' ELSE 'en' END"
_JOURNAL = r"nullif(trim(regexp_extract(text, '(?m)^\s*([A-Z][A-Za-z&\- ]{3,80}?),\s*\d+\s*\(\d+\)', 1)), '')"
_JOURNAL_LINE = r"regexp_extract(text, '(?m)^\s*([A-Z][A-Za-z&\- ]{3,80}?),\s*\d+\s*\(\d+\).*')"
_YEAR_IN = r"nullif(regexp_extract({s}, '(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})(?:$|[^\p{L}\p{N}_])', 1), '')"
_YEAR = f"coalesce({_YEAR_IN.replace('{s}', _JOURNAL_LINE)}, {_YEAR_IN.replace('{s}', 'text')})::INT"
_KEYWORDS = r"list_filter(list_transform(string_split_regex(regexp_extract(text, '(?i)(?:주제어|핵심어|key\s*words?)\s*[:：]\s*(.+)', 1), '[,;·]'), lambda k: trim(k, ' .')), lambda k: k <> '')"
_ABSTRACT = r"trim(regexp_replace(substr(text, strpos(text, chr(10) || 'Abstract' || chr(10)) + 10, strpos(substr(text, strpos(text, chr(10) || 'Abstract' || chr(10)) + 10), chr(10) || chr(10)) - 1), '\s+', ' ', 'g'))"
_AUTHORS = r"coalesce(list_transform(string_split_regex(list_filter(ls[1:40], lambda x: regexp_matches(x, '^[가-힣]{2,4}(?:\s*[,，·ㆍ]\s*[가-힣]{2,4})+$'))[1], '[,，·ㆍ]'), lambda a: trim(a)), [])"
_NORMAL = r"trim(regexp_replace(x, '[\s*]+\d*\s*$', ''), ' *')"
_TITLE = f"""list_filter(list_transform(ls[1:60], lambda x: {_NORMAL}), lambda x: length(x) BETWEEN 8 AND 200 AND NOT regexp_matches(x, 'https?://|doi|제\\s*\\d+\\s*권|vol\\.|©|@|^[^\\p{{L}}\\p{{N}}_]', 'i')
  AND NOT regexp_matches(x, '^[가-힣]{{2,4}}(?:\\s*[,，·ㆍ]\\s*[가-힣]{{2,4}})+$') AND NOT regexp_matches(x, '{_HEAD}', 'i') AND NOT ends_with(x, '.'))"""
_GUESS = f"coalesce(list_filter({_TITLE}, lambda c: len(list_filter(list_transform(ls, lambda x: {_NORMAL}), lambda y: y = c)) >= 2)[1], ({_TITLE})[1], title)"


def _entities(gazetteer: dict) -> str:
    rows = [f"{{'n': -({' + '.join(_count('text', p) for p in ps)}), 'o': {i}, 'e': {_hit('stressed', ps)}, 'name': '{name}'}}" for i, (name, ps) in enumerate(gazetteer.items())]
    return f"list_transform(list_sort(list_filter([{', '.join(rows)}], lambda m: m.n <= -2 OR (m.n = -1 AND m.e))), lambda m: m.name)"


_TOP = {"research_questions": 5, "findings": 6, "theoretical_contrib": 4, "practical_contrib": 3}
_KNOWN = _hit("c", [p for g in (V.THEORIES, V.METHODS) for ps in g.values() for p in ps])
_FIELDS = _SENTENCES + f""", fields AS (
  SELECT source_id, seq, title AS s_title, source_type, text, ls, {_GUESS} AS title, {_DOI} AS doi, {_LANG} AS language, {_JOURNAL} AS journal, {_YEAR} AS year, {_KEYWORDS} AS keywords, {_ABSTRACT} AS abstract,
    {_AUTHORS} AS authors, {_FUTURE} AS future_work, {_LIMITS} AS limitations, {_cue("methodology")} AS meth, {_cue("purpose")}[1] AS purpose, {_cue("data")}[1] AS data,
    list_filter(ss, lambda s: {_CUE['sample']} AND NOT {_CUE['future_work']} AND NOT {_CUE['limitations']})[1] AS sample,
    {", ".join(f"{_cue(k, n)} AS {k}" for k, n in _TOP.items())} FROM sentences),
stress AS (SELECT *, coalesce(abstract, '') || ' ' || array_to_string(keywords, ' ') || ' ' || coalesce(title, '') || ' ' || array_to_string(meth, ' ') AS stressed FROM fields),
ents AS (SELECT *, {_entities(V.THEORIES)} AS theories, {_entities(V.METHODS)} AS methods,
    list_filter(keywords, lambda c: NOT {_KNOWN} AND lower(c) <> coalesce(lower(journal), '')) AS found FROM stress),
uniq AS (SELECT *, list_filter(found, lambda c, i: list_position(found, c) = i)[1:12] AS kc FROM ents),
ex AS (SELECT *, list_filter(kc, lambda c, i: length(c) >= 2 AND list_position(list_transform(kc, lambda z: lower(z)), lower(c)) = i)[1:8] AS concepts,
    CASE WHEN len(authors) > 0 THEN trim(string_split(authors[1], ',')[1]) || CASE WHEN len(authors) > 1 THEN CASE WHEN regexp_matches(authors[1], '[가-힣]') THEN ' 외' ELSE ' et al.' END ELSE '' END ELSE coalesce(title, source_id) END
      || CASE WHEN year IS NOT NULL THEN ' (' || year || ')' ELSE '' END AS ref FROM uniq)"""


def _slug(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-')"


def _link(kind: str, x: str, alias: str | None = None) -> str:
    return f"('[[{kind}/' || {_slug(x)} || '|' || {alias or x} || ']]')"


def _grouped(groups: dict[str, str]) -> str:
    """Bold labels with their bullets, of lists; null if all are empty."""
    parts = ", ".join(f"CASE WHEN len({rows}) > 0 THEN '**{label}:**' || chr(10) || array_to_string(list_transform({rows}, lambda v: '- ' || v), chr(10)) END" for label, rows in groups.items())
    return f"nullif(array_to_string(list_filter([{parts}], lambda g: g IS NOT NULL), chr(10)), '')"


def _links(kind: str, rows: str) -> str:
    return f"list_transform({rows}, lambda v: {_link(kind, 'v')})"


def _one(x: str) -> str:
    return f"list_filter([{x}], lambda v: v IS NOT NULL AND v <> '')"


_OVER = f"CASE WHEN len(concepts) > 0 THEN [{_link('overviews', 'concepts[1]', chr(39) + 'Overview: ' + chr(39) + ' || concepts[1]')}] ELSE [] END"
_RELATED = f"list_concat({_links('concepts', 'concepts')}, {_links('theories', 'theories')}, {_links('methods', 'methods')}, {_OVER})"
#: Sections of a paper's page; those that no default extractor fills are null.
_PAPER = {
    "Summary": "'> [!quote] 원문 요약 (Source Fact)' || chr(10) || '> ' || nullif(abstract, '')",
    "Research Context": _grouped({"Purpose": _one("purpose"), "Research Questions": "research_questions", "Theoretical Background": _links("theories", "theories"), "Key Concepts": _links("concepts", "concepts")}),
    "Research Design": _grouped({"Methodology": _one("meth[1]"), "Data": _one("data"), "Sample": _one("sample")}),
    "Variables": "NULL",
    "Analysis": _grouped({"Methods": _links("methods", "methods")}),
    "Results": _grouped({"Key Findings": "findings", "Significant Relationships": "sig", "Non-significant Relationships": "non"}),
    "Discussion": _grouped({"Theoretical Contributions": "theoretical_contrib", "Practical Contributions": "practical_contrib", "Limitations": "limitations", "Future Work": "future_work"}),
    "Claims": "NULL",
    "Related Pages": "array_to_string(list_transform(list_filter(related, lambda v, i: list_position(related, v) = i), lambda v: '- ' || v), chr(10))",
    "Provenance": "'- Source ID: `' || source_id || '`' || chr(10) || '- Local file: (metadata-only)' || coalesce(chr(10) || '- DOI: ' || doi, '') || chr(10) || '- Evidence level: unknown' || chr(10) || '" + V.EXTRACTOR_LINE + "'",
}
_QTITLE = r"regexp_replace(regexp_replace(trim(f), '^(?:first(?:ly)?|second(?:ly)?|third(?:ly)?|also|finally|moreover)\s*,?\s*', '', 'i'), '^(?:future research)\s*', '', 'i')"
_QNAME = f"CASE WHEN length({_QTITLE}) <= 50 THEN {_QTITLE} ELSE rtrim({_QTITLE}[1:50]) || '…' END"
#: Relations that no default extractor finds, given to every third paper so that effects occur.
_SIG, _NON = "CASE WHEN seq % 3 = 0 THEN ['quality -> adoption ' || seq % 4] ELSE [] END", "CASE WHEN seq % 7 = 0 THEN ['price -> adoption'] ELSE [] END"
_LOG = _FIELDS + f""", base AS MATERIALIZED (
  SELECT *, {_SIG} AS sig, {_NON} AS non, '(' || {_link("papers", "title", "ref")} || ')' AS cite, {_link("papers", "title")} || ' — ' || ref AS bullet, {_RELATED} AS related FROM ex),
ent AS (SELECT seq, 2 AS step, 'concepts' AS page_type, unnest(concepts) AS name, generate_subscripts(concepts, 1) - 1 AS i, sig, non, cite, bullet, keywords, title, language FROM base
  UNION ALL SELECT seq, 3, 'theories', unnest(theories), generate_subscripts(theories, 1) - 1, sig, non, cite, bullet, keywords, title, language FROM base
  UNION ALL SELECT seq, 4, 'methods', unnest(methods), generate_subscripts(methods, 1) - 1, sig, non, cite, bullet, keywords, title, language FROM base),
ques AS (SELECT seq, unnest(future_work[1:3]) AS f, generate_subscripts(future_work[1:3], 1) - 1 AS i, concepts, cite, bullet FROM base),
log AS (
  SELECT seq, step, i * 100 AS pos, page_type, name, 'Related Papers' AS section, 'append' AS op, bullet AS line FROM ent
  {" ".join(f"UNION ALL SELECT seq, 1, {i}, 'papers', title, '{k}', 'set', {x} FROM base" for i, (k, x) in enumerate(_PAPER.items()))}
  UNION ALL SELECT seq, step, i * 100 + 1, page_type, name, 'Applications', 'append', 'Applied to: ' || coalesce(nullif(array_to_string(keywords[1:3], ', '), ''), title) || ' ' || cite FROM ent WHERE page_type = 'methods'
  UNION ALL SELECT seq, step, i * 100 + 10, page_type, name, 'Established Findings', 'append', sig[1] || ' ' || cite FROM ent WHERE len(sig) > 0
  UNION ALL SELECT seq, step, i * 100 + 20, page_type, name, 'Conflicting Findings', 'append', '(non-significant) ' || non[1] || ' ' || cite FROM ent WHERE len(non) > 0
  UNION ALL SELECT seq, 5, 0, 'overviews', concepts[1], 'Key Papers', 'append', bullet FROM base WHERE len(concepts) > 0
  UNION ALL SELECT seq, 5, 100 + g - 1, 'overviews', concepts[1], 'Major Theories', 'append', {_link("theories", "t")} || ' ' || cite FROM (SELECT *, unnest(theories) AS t, generate_subscripts(theories, 1) AS g FROM base WHERE len(concepts) > 0)
  UNION ALL SELECT seq, 5, 200 + g - 1, 'overviews', concepts[1], 'Important Variables', 'append', {_link("concepts", "t")} || ' ' || cite FROM (SELECT *, unnest(concepts[2:]) AS t, generate_subscripts(concepts[2:], 1) AS g FROM base WHERE len(concepts) > 1)
  UNION ALL SELECT seq, 5, 300 + g - 1, 'overviews', concepts[1], 'Recent Developments', 'append', '방법론: ' || {_link("methods", "t")} || ' ' || cite FROM (SELECT *, unnest(methods) AS t, generate_subscripts(methods, 1) AS g FROM base WHERE len(concepts) > 0)
  UNION ALL SELECT seq, 5, 400 + g - 1, 'overviews', concepts[1], 'Open Questions', 'append', t || ' ' || cite FROM (SELECT *, unnest(future_work[1:3]) AS t, generate_subscripts(future_work[1:3], 1) AS g FROM base WHERE len(concepts) > 0)
  UNION ALL SELECT seq, 6, i * 100, 'questions', {_QNAME}, 'Question', 'set', f FROM ques
  UNION ALL SELECT seq, 6, i * 100 + 1, 'questions', {_QNAME}, 'Why It Is Open', 'set', '{V.WHY_OPEN}' || cite FROM ques
  UNION ALL SELECT seq, 6, i * 100 + 10 + g - 1, 'questions', {_QNAME}, 'Related Concepts', 'append', {_link("concepts", "t")} FROM (SELECT *, unnest(concepts[1:3]) AS t, generate_subscripts(concepts[1:3], 1) AS g FROM ques WHERE len(concepts) > 0)
  UNION ALL SELECT seq, 6, i * 100 + 50, 'questions', {_QNAME}, 'Related Papers', 'append', bullet FROM ques
  UNION ALL SELECT seq, 6, i * 100 + 51, 'questions', {_QNAME}, 'Status', 'set', 'detected' FROM ques),
slugged AS MATERIALIZED (SELECT *, {_slug("name")} AS slug FROM log),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_type, slug, section, line ORDER BY seq, step, pos) AS k FROM slugged WHERE op = 'append')"""


def _fields(spark: SparkSession, d: str, **columns) -> DataFrame:
    s = P.papers(spark, d).withColumn("ls", T.lines("text"))
    return s.select("source_id", *[c.alias(k) for k, c in columns.items()])


def _rows(df: DataFrame, rows: Column, *names: str) -> DataFrame:
    """``df`` with a row for each element of ``rows``: (place, element) or (element) by the number of ``names``.

    The outer form: for the plain one Spark asks whether an array is empty before it reads on, by evaluating it twice.
    """
    made = (F.posexplode_outer if len(names) == 2 else F.explode_outer)(rows)
    return df.select("source_id", made.alias(*names)).where(F.col(names[-1]).isNotNull())


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    s = P.papers(spark, d).withColumn("ps", T.paragraphs(T.lines("text")))
    return s.select("source_id", "ps", T.sentences("ps").alias("ss")).withColumn("low", T.folded_rows("ss"))


def extractions(spark: SparkSession, d: str) -> DataFrame:
    """Extractions of the composed papers, with relations given to some."""
    seq = F.substring_index("source_id", "-", -1).cast("long")
    sig = F.when(seq % 3 == 0, F.array(F.concat(F.lit("quality -> adoption "), (seq % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    non = F.when(seq % 7 == 0, F.array(F.lit("price -> adoption"))).otherwise(F.array().cast("array<string>"))
    return X.extract(P.papers(spark, d)).withColumns({"significant_relationships": sig, "nonsignificant_relationships": non})


def contributed(spark: SparkSession, d: str, **part) -> DataFrame:
    """The contribution log of the composed papers, or the part (``merge.contributions``) that a query reads, once."""
    return M.contributions(P.papers(spark, d).drop("text"), extractions(spark, d), **part)


def log(spark: SparkSession, d: str, **part) -> DataFrame:
    """The same, written once, where it is read several times."""
    return cut(contributed(spark, d, **part))


# ---- registration and deduplication

_SUFFIX = "CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'pptx' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'HTML' WHEN 5 THEN 'md' WHEN 6 THEN 'txt' ELSE 'bin' END"
_TYPE = "CASE " + " ".join(f"WHEN lower({_SUFFIX}) = '{k}' THEN '{v}'" for k, v in V.SOURCE_TYPE_BY_SUFFIX.items()) + " ELSE 'other' END"
_LEVEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.EVIDENCE_BY_TYPE.items()) + " END"
_RANK = "CASE level " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(V.EVIDENCE_BY_RANK)) + " END"
_REGISTER = f"""reg AS (SELECT doc_id, {_TYPE} AS kind, sha256(coalesce(text, '')) AS file_hash FROM documents),
typed AS (SELECT *, {_LEVEL} AS level FROM reg), ranked AS (SELECT *, {_RANK} AS rank FROM typed)"""


def _registered(spark, d) -> DataFrame:
    t = _table(spark, d, "documents").select("doc_id", "text", F.expr(_SUFFIX).alias("suffix"))
    t = t.select("doc_id", R.source_type(F.col("suffix")).alias("source_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"))
    return t.withColumn("evidence_level", R.evidence_level(F.col("source_type"))).withColumn("rank", R.evidence_rank(F.col("evidence_level")))


@query(f"""WITH {_REGISTER} SELECT doc_id, 'src-' || substr(sha256(doc_id || '|' || file_hash), 1, 12) AS source_id, kind AS source_type, level AS evidence_level, rank, file_hash,
  CASE WHEN kind = 'journal_article' THEN true END AS peer_reviewed FROM ranked""")
def sources_register(spark, d):
    return _registered(spark, d).withColumns({"source_id": R.source_id(F.col("doc_id").cast("string"), F.col("file_hash")), "peer_reviewed": R.peer_reviewed(F.col("source_type"))})


@query(f"WITH {_REGISTER} SELECT kind AS source_type, level AS evidence_level, rank, count(*) AS n FROM ranked GROUP BY ALL")
def evidence_rank_summary(spark, d):
    return _registered(spark, d).groupBy("source_type", "evidence_level", "rank").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, lower(rtrim(trim('  ' || upper(url) || '// '), '/')) AS url_key, trim(regexp_replace(lower('A  Page ' || chr(10) || page_id), '\s+', ' ', 'g')) AS title_key FROM pages""")
def fingerprint_normalize(spark, d):
    messy = F.concat(F.lit("  "), F.upper("url"), F.lit("// "))
    return _table(spark, d, "pages").select("page_id", T.url_key(messy).alias("url_key"), T.title_key(F.concat(F.lit("A  Page \n"), F.col("page_id").cast("string"))).alias("title_key"))


def _matched(spark, d) -> DataFrame:
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    rows = _table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("key_hash"), T.title_key(line).alias("key_title"))
    return R.first_match(rows, ["key_hash", "key_title"])


_MATCH = r"""rows_ AS MATERIALIZED (SELECT doc_id AS seq, sha256(text) AS h, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\s+', ' ', 'g')) AS t, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE doc_id IS NOT NULL),
walk(k, hs, ts, seqs, dup, seq) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT k, CASE WHEN d IS NULL THEN list_append(hs, h) ELSE hs END, CASE WHEN d IS NULL THEN list_append(ts, t) ELSE ts END, CASE WHEN d IS NULL THEN list_append(seqs, seq) ELSE seqs END, d, seq
  FROM (SELECT r.k, hs, ts, seqs, h, t, r.seq, seqs[least(coalesce(nullif(list_position(hs, h), 0), 1000000000), coalesce(nullif(list_position(ts, t), 0), 1000000000))] AS d
        FROM walk JOIN rows_ r ON r.k = walk.k + 1)),
matched AS (SELECT seq, dup AS dup_of FROM walk WHERE k > 0)"""


@query(f"WITH RECURSIVE {_MATCH} SELECT * FROM matched")
def dedup_first_match(spark, d):
    return _matched(spark, d).select("seq", "dup_of")


@query(f"WITH RECURSIVE {_MATCH} SELECT count(*) FILTER (dup_of IS NULL) AS n_new, count(*) FILTER (dup_of IS NOT NULL) AS n_dup FROM matched")
def dedup_counts(spark, d):
    return _matched(spark, d).agg(F.count_if(F.col("dup_of").isNull()).alias("n_new"), F.count_if(F.col("dup_of").isNotNull()).alias("n_dup"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dedup_exact(spark, d):
    return _table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("text")


# ---- fields of papers


@query(f"WITH {_PAPERS} SELECT source_id, {_LANG} AS language FROM papers")
def language_detect(spark, d):
    return _fields(spark, d, language=X.language("text"))


@query(f"WITH {_PAPERS} SELECT source_id, {_DOI} AS doi FROM papers")
def doi_extract(spark, d):
    return _fields(spark, d, doi=X.doi(F.col("text"), F.col("doi")))


@query(f"WITH {_PAPERS} SELECT source_id, {_YEAR} AS year FROM papers")
def year_extract(spark, d):
    return _fields(spark, d, year=X.year("text"))


@query(f"WITH {_PAPERS} SELECT source_id, {_JOURNAL} AS journal FROM papers")
def journal_extract(spark, d):
    return _fields(spark, d, journal=X.journal("text"))


@query(f"WITH {_PAPERS} SELECT source_id, {_KEYWORDS} AS keywords FROM papers")
def keywords_split(spark, d):
    return _fields(spark, d, keywords=X.keywords("text"))


@query(f"WITH {_LINES} SELECT source_id, {_ABSTRACT} AS abstract FROM lined")
def abstract_extract(spark, d):
    return _fields(spark, d, abstract=X.abstract("text", "ls", X.language("text")))


@query(f"WITH {_LINES} SELECT source_id, {_AUTHORS} AS authors FROM lined")
def authors_ko(spark, d):
    return _fields(spark, d, authors=X.authors("ls"))


@query(f"WITH {_LINES} SELECT source_id, {_GUESS} AS title FROM lined")
def title_guess(spark, d):
    s = P.papers(spark, d).select("source_id", "title", T.raw_lines("text").alias("raw")).withColumn("ls", T.stripped_lines("raw"))
    return s.select("source_id", F.coalesce(X.guess_title("raw", "ls"), "title").alias("title"))


@query(f"WITH {_LINES} SELECT source_id, len(ls) AS n_lines, sha256(array_to_string(ls, chr(10))) AS lines_sha256 FROM lined")
def text_lines(spark, d):
    return _fields(spark, d, n_lines=F.size("ls").cast("long"), lines_sha256=F.sha2(F.array_join("ls", "\n"), 256))


@query(f"WITH {_LINES} SELECT source_id, unnest(list_filter(ls, lambda x: regexp_matches(x, '{_HEAD}', 'i'))) AS heading FROM lined")
def text_headings(spark, d):
    s = P.papers(spark, d).select("source_id", T.lines("text").alias("ls"))
    return _rows(s, F.filter("ls", T.is_heading), "heading")


@query(f"WITH {_PARAGRAPHS} SELECT source_id, i - 1 AS pos, starts_with(p, chr(2)) AS heading, replace(trim(p, chr(2)), chr(10), ' ') AS text FROM (SELECT source_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM marked)")
def text_paragraphs(spark, d):
    s = _rows(_sentences(spark, d), F.col("ps"), "pos", "p")
    return s.select("source_id", F.col("pos").cast("long"), "p.heading", "p.text")


@query(f"WITH {_SENTENCES} SELECT source_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM sentences")
def text_sentences(spark, d):
    return _rows(_sentences(spark, d), F.col("ss"), "pos", "sentence").withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_SENTENCES} SELECT source_id, " + ", ".join(f"len({_cue(k)}) AS n_{k}" for k in V.CUES) + " FROM sentences")
def cue_hits(spark, d):
    return _sentences(spark, d).select("source_id", *[F.size(T.matches("ss", k, "low")).cast("long").alias(f"n_{k}") for k in V.CUES])


@query(f"WITH {_SENTENCES} SELECT source_id, " + ", ".join(f"({_cue(k)})[1] AS {k}" for k in ("purpose", "methodology", "data")) + " FROM sentences")
def cue_first(spark, d):
    return _sentences(spark, d).select("source_id", *[T.first(T.matches("ss", k, "low")).alias(k) for k in ("purpose", "methodology", "data")])


@query(f"WITH {_SENTENCES} SELECT source_id, " + ", ".join(f"{_cue(k, n)} AS {k}" for k, n in _TOP.items()) + " FROM sentences")
def cue_topn(spark, d):
    return _sentences(spark, d).select("source_id", *[F.slice(T.matches("ss", k, "low"), 1, n).alias(k) for k, n in _TOP.items()])


@query(f"WITH {_SENTENCES} SELECT source_id, list_filter(ss, lambda s: {_CUE['sample']} AND NOT {_CUE['future_work']} AND NOT {_CUE['limitations']})[1] AS sample FROM sentences")
def sample_antipredicate(spark, d):
    return _sentences(spark, d).select("source_id", X.sample("ss", "low").alias("sample"))


@query(f"WITH {_SENTENCES} SELECT source_id, {_LIMITS} AS limitations, {_FUTURE} AS future_work FROM sentences")
def limitations_section(spark, d):
    s = _sentences(spark, d).withColumn("own", T.sentences(T.limitations_section("ps")))
    a, b = X.limitations_and_future("own", "ss", "low")
    return s.select("source_id", a.alias("limitations"), b.alias("future_work"))


_ALL = {"theory": V.THEORIES, "method": V.METHODS}


@query(f"WITH {_PAPERS}, counted AS (" + " UNION ALL ".join(f"SELECT source_id, '{k}' AS kind, '{n}' AS name, {' + '.join(_count('text', p) for p in ps)} AS n FROM papers" for k, g in _ALL.items() for n, ps in g.items()) + ") SELECT * FROM counted WHERE n > 0")
def entity_counts(spark, d):
    s = P.papers(spark, d).withColumn("low", T.folded("text"))
    named = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["name"].alias("name"), m["n"].cast("long").alias("n"))
    found = F.concat(*[F.transform(X.mentions("text", g, "low"), named(k)) for k, g in _ALL.items()])
    return _rows(s, F.filter(found, lambda m: m["n"] > 0), "m").select("source_id", "m.*")


@query(f"WITH {_FIELDS} SELECT source_id, theories, methods FROM ex")
def entities_ranked(spark, d):
    return extractions(spark, d).select("source_id", F.col("theoretical_background").alias("theories"), F.col("analysis_methods").alias("methods"))


@query(f"WITH {_FIELDS} SELECT source_id, kc AS key_concepts, concepts FROM ex")
def concepts(spark, d):
    return extractions(spark, d).select("source_id", "key_concepts", X.attached_concepts("key_concepts").alias("concepts"))


#: RE2's borders know ASCII alone, so letters and digits beyond it stand as underscores, which are word characters too.
_SHOWN = r"array_to_string(list_transform(string_split(substr(text, 1, 2000), ''), lambda c: CASE WHEN ord(c) > 127 AND regexp_matches(c, '[\p{L}\p{N}]') THEN '_' ELSE c END), '')"
_PHRASE = r"\b([A-Z][a-z]+(?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+[A-Z][a-z]+){1,3})\b"


@query(f"""WITH phrases AS (SELECT doc_id, unnest(regexp_extract_all({_SHOWN}, '{_PHRASE}', 1)) AS p FROM documents WHERE doc_id IS NOT NULL),
counted AS (SELECT doc_id, p, count(*) AS n FROM phrases GROUP BY ALL)
SELECT doc_id, list(p ORDER BY n DESC, p)[1:12] AS phrases FROM counted
WHERE regexp_extract(p, '^[A-Za-z]+') NOT IN ('The', 'This', 'These', 'We', 'In', 'Our') AND NOT {_KNOWN.replace("regexp_matches(c,", "regexp_matches(p,")} GROUP BY doc_id""")
def concepts_fallback(spark, d):
    s = _table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", X.phrases_of(F.lit(None).cast("string"), "text").alias("_p"))
    return s.select("doc_id", X.concepts(F.array().cast("array<string>"), F.col("_p"), F.lit(None).cast("string")).alias("phrases")).where(F.size("phrases") > 0)


# ---- names


@query(f"WITH {_FIELDS} SELECT source_id, ref FROM ex")
def short_ref(spark, d):
    e = extractions(spark, d)
    return e.select("source_id", T.short_ref(F.col("authors"), F.col("title"), F.col("source_id"), F.col("year")).alias("ref"))


_DASHED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(name, '(?i)&(?:amp|lt|gt|quot|apos);', ' ', 'g')), '(\p{N}),(\p{N})', '\1\2', 'g'), '(\p{N}),(\p{N})', '\1\2', 'g'), '[^\p{L}\p{N}]+', '-', 'g'), '-')"
#: Whole words up to 120 characters: one that does not fit is left out, one that ends there is the last.
_FITS = """trim(list_reduce(string_split(s, '-'), lambda acc, w: CASE WHEN acc <> '' AND NOT ends_with(acc, '-') THEN acc WHEN length(acc) + length(w) < 120 THEN acc || w || '-'
  WHEN length(acc) + length(w) = 120 THEN acc || w ELSE acc END, ''), '-')"""


@query(f"""SELECT doc_id, coalesce(nullif(CASE WHEN length(s) < 120 THEN s ELSE coalesce(nullif({_FITS}, ''), s[1:120]) END, ''), 'untitled') AS slug
FROM (SELECT doc_id, {_DASHED} AS s FROM (SELECT doc_id, split_part(text, chr(10), 1) AS name FROM documents))""")
def slug(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query(f"WITH {_FIELDS} SELECT source_id, {_link('papers', 'title', 'ref')} AS cite, list_transform(concepts, lambda c: {_link('concepts', 'c')}) AS links FROM ex")
def wikilinks(spark, d):
    e = extractions(spark, d)
    ref = T.short_ref(F.col("authors"), F.col("title"), F.col("source_id"), F.col("year"))
    return e.select("source_id", T.wikilink("papers", F.col("title"), ref).alias("cite"), F.transform(X.attached_concepts("key_concepts"), lambda c: T.wikilink("concepts", c)).alias("links"))


# ---- pages


@query(f"WITH {_LOG} SELECT page_type, slug, section, '- ' || line AS line, seq, step, pos FROM firsts WHERE k = 1")
def wiki_bullets(spark, d):
    got = M.bullets(contributed(spark, d, **M.APPENDED)).select("page_type", "slug", "section", "line", "at.*")
    return got.withColumns({"step": F.col("step").cast("int"), "pos": F.col("pos").cast("long")})


@query(f"WITH {_LOG} SELECT page_type, slug, arg_min(name, (seq, step, pos)) AS name, min(seq) AS first_seq, count(DISTINCT seq) AS n_sources FROM slugged GROUP BY ALL")
def wiki_pages(spark, d):
    return M.pages(contributed(spark, d, **M.NAMES))


_TOUCH = _LOG + """, touch AS (SELECT s.seq, s.page_type, s.slug, min((s.seq, s.step, s.pos)) AS own_at FROM slugged s GROUP BY ALL),
state AS (SELECT page_type, slug, min((seq, step, pos)) AS page_at, min(CASE WHEN section = 'Established Findings' THEN (seq, step, pos) END) AS found_at FROM slugged GROUP BY ALL),
fresh AS (SELECT DISTINCT page_type, slug, seq FROM firsts WHERE k = 1 AND section IN ('Related Papers', 'Applications')),
judged AS (SELECT t.*, page_at < own_at AS existed, coalesce(found_at < own_at, false) AS prior, f.seq IS NOT NULL AS added, len(sig) > 0 AS has_sig, len(non) > 0 AS has_non
  FROM touch t JOIN state USING (page_type, slug) LEFT JOIN fresh f USING (page_type, slug, seq) JOIN base USING (seq)),
effects AS (SELECT *, CASE WHEN page_type IN ('concepts', 'theories', 'methods') THEN CASE WHEN has_non AND prior THEN 'contradict' WHEN has_sig THEN CASE WHEN prior THEN 'strengthen' ELSE 'extend' END
  WHEN NOT existed THEN 'extend' ELSE 'unchanged' END END AS effect FROM judged)"""


@query(f"WITH {_TOUCH} SELECT seq, page_type, slug, effect FROM effects WHERE effect IS NOT NULL")
def effects(spark, d):
    return M.touches(log(spark, d, **M.TOUCHES)).where("effect IS NOT NULL").select("seq", "page_type", "slug", "effect")


@query(f"""WITH {_TOUCH} SELECT seq, page_type, slug, CASE WHEN NOT existed THEN 'created' ELSE 'updated' END AS change FROM effects
WHERE NOT existed OR page_type IN ('overviews', 'papers') OR (effect IS NOT NULL AND (added OR effect <> 'unchanged'))""")
def page_changes(spark, d):
    return M.changes(log(spark, d, **M.TOUCHES)).drop("source_id", "effect")


@query(f"WITH {_LOG} SELECT slug, section, count(*) AS n, sha256(string_agg('- ' || line, chr(10) ORDER BY seq, step, pos)) AS body_sha256 FROM firsts WHERE k = 1 AND page_type = 'overviews' GROUP BY ALL")
def overview_sections(spark, d):
    got = M.bullets(contributed(spark, d, kinds={"overviews"})).groupBy("slug", "section").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return got.select("slug", "section", "n", F.sha2(F.array_join(F.col("x.line"), "\n"), 256).alias("body_sha256"))


@query(f"WITH {_LOG} SELECT slug, section, arg_max(line, (seq, step, pos)) AS body FROM slugged WHERE op = 'set' AND page_type = 'questions' GROUP BY ALL")
def open_questions(spark, d):
    return M.set_sections(contributed(spark, d, kinds={"questions"}, op="set")).select("slug", "section", F.col("line").alias("body"))


@query(f"""WITH {_LOG} SELECT slug, section, arg_max(line, (seq, step, pos)) AS body FROM slugged WHERE page_type = 'papers' AND line <> '' GROUP BY ALL""")
def paper_sections_lww(spark, d):
    return M.set_sections(contributed(spark, d, kinds={"papers"}, op="set")).select("slug", "section", F.col("line").alias("body"))


_RENDER = _LOG + ", skeleton AS (" + " UNION ALL ".join(f"SELECT '{t}' AS page_type, '{s}' AS section, {i} AS ord" for t, ss in V.SECTIONS.items() for i, s in enumerate(ss)) + """),
bodies AS (SELECT page_type, slug, section, string_agg('- ' || line, chr(10) ORDER BY seq, step, pos) AS body, min((seq, step, pos)) AS first_at FROM firsts WHERE k = 1 GROUP BY ALL
  UNION ALL SELECT page_type, slug, section, arg_max(line, (seq, step, pos)), NULL FROM slugged WHERE op = 'set' AND line <> '' GROUP BY ALL),
paged AS (SELECT page_type, slug, arg_min(name, (seq, step, pos)) AS name FROM slugged GROUP BY ALL),
parts AS (SELECT coalesce(p.page_type, b.page_type) AS page_type, coalesce(p.slug, b.slug) AS slug, coalesce(p.section, b.section) AS section, coalesce(ord, 1000) AS ord, b.first_at, coalesce(body, '') AS body
  FROM (SELECT page_type, slug, section, ord FROM paged JOIN skeleton USING (page_type)) p FULL JOIN bodies b ON p.page_type = b.page_type AND p.slug = b.slug AND p.section = b.section),
texts AS (SELECT page_type, slug, name, '# ' || name || chr(10) || chr(10) || string_agg(rtrim('## ' || section || chr(10) || chr(10) || body, ' ' || chr(10)), chr(10) || chr(10) ORDER BY ord, first_at) || chr(10) AS text
  FROM parts JOIN paged USING (page_type, slug) GROUP BY page_type, slug, name)"""


@query(f"WITH {_RENDER} SELECT page_type, slug, name, sha256(text) AS text_sha256 FROM texts")
def page_render(spark, d):
    got = M.page_texts(log(spark, d))
    return got.select("page_type", "slug", "name", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {_RENDER} SELECT page_type, slug, name AS title, len(string_split(text, chr(10) || '## ')) - 1 AS n_sections FROM texts")
def page_parse_roundtrip(spark, d):
    got = M.page_texts(log(spark, d)).select("page_type", "slug", M.parse_page("text").alias("p"))
    return got.select("page_type", "slug", "p.title", F.size("p.sections").cast("long").alias("n_sections"))


_SEARCHED = "SELECT 'wiki/papers/doc-' || doc_id || '.md' AS path, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"
_TERMS = ["the", "tion", "worthless", "the"]
_SCORE = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in _TERMS)


def _searched(spark, d) -> DataFrame:
    return _table(spark, d, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.concat(F.lit("wiki/papers/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


@query(f"SELECT path, ({_SCORE})::INT AS score FROM ({_SEARCHED}) WHERE {_SCORE} > 0 ORDER BY score DESC, path LIMIT 20")
def search_topk(spark, d):
    return S.keyword_search(_searched(spark, d), " ".join(_TERMS)).select("path", "score")


@query(ORACLES["search_topk"])
def search_indexed(spark, d):
    pages = _searched(spark, d)
    own = cut(S.postings(pages))
    texts = lambda paths: pages.join(paths, "path", "left_semi")
    return S.indexed_search(own, cut(S.gram_counts(own)), texts, " ".join(_TERMS)).select("path", "score")


_AT = "coalesce(" + ", ".join(f"nullif(strpos(lower(text), '{t}'), 0)" for t in _TERMS) + ")"


@query(rf"SELECT path, coalesce(trim(regexp_replace(substr(text, greatest({_AT} - 61, 0) + 1, 120), '\s+', ' ', 'g')), '') AS snippet FROM ({_SEARCHED})")
def search_snippets(spark, d):
    return _searched(spark, d).select("path", S.snippet("text", _TERMS).alias("snippet"))


@query(f"""WITH {_LOG} SELECT 'total_sources' AS metric, '' AS key, count(*) AS value FROM base UNION ALL SELECT 'sources_by_type', source_type, count(*) FROM base GROUP BY source_type
UNION ALL SELECT 'wiki_pages', page_type, count(DISTINCT slug) FROM slugged GROUP BY page_type
UNION ALL SELECT 'open_questions', '', count(DISTINCT slug) FROM slugged WHERE page_type = 'questions'
UNION ALL SELECT 'contradictions', '', count(DISTINCT slug) FROM slugged WHERE page_type = 'concepts' AND section = 'Conflicting Findings'""")
def digest(spark, d):
    own = log(spark, d, sections=M.NAMES["sections"] | {"Conflicting Findings"}, lines={"Conflicting Findings"})
    return S.digest(P.papers(spark, d), M.pages(own), M.section_lines(own, "Conflicting Findings"))


@query(f"""WITH {_LOG} SELECT 1 AS one, count(DISTINCT slug) AS n FROM slugged WHERE page_type = 'concepts' AND section = 'Conflicting Findings'""")
def digest_contradictions(spark, d):
    s = M.bullets(contributed(spark, d, kinds={"concepts"}, sections={"Conflicting Findings"}))
    return s.agg(F.count_distinct("slug").alias("n")).select(F.lit(1).alias("one"), "n")


# ---- graph, claims, projects, upserts


_NODES = _FIELDS + r""", nodes AS (SELECT source_id, 'paper' AS node_type, title AS label FROM ex UNION ALL SELECT source_id, 'concept', unnest(kc) FROM ex
  UNION ALL SELECT source_id, 'theory', unnest(theories) FROM ex UNION ALL SELECT source_id, 'method', unnest(methods) FROM ex)"""


@query(f"WITH {_NODES} SELECT node_type || ':' || trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS key, count(*) AS n, list_sort(list(DISTINCT source_id)) AS source_ids FROM nodes GROUP BY 1")
def graph_node_merge(spark, d):
    return G.merge_nodes(G.nodes_of(extractions(spark, d))).select("key", "n", "source_ids")


@query("""SELECT 'conv-' || conv_id % 50 || '-cites-' || role AS key, max(turn * 0.5)::DOUBLE AS weight, count(*) AS n, min('edge-' || conv_id || '-' || turn) AS edge_id FROM conversations GROUP BY 1""")
def graph_edge_merge(spark, d):
    c = _table(spark, d, "conversations").selectExpr("concat('edge-', conv_id, '-', turn) AS edge_id", "concat('conv-', conv_id % 50) AS source", "role AS target", "'cites' AS edge_type", "cast(turn * 0.5D AS double) AS weight")
    return G.merge_edges(c)


_CLAIMS = "SELECT doc_id, 'Perceived  Quality ' || doc_id % 9 AS subject, ' Adoption of ' || lang AS object, CASE doc_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'none' WHEN 3 THEN 'mixed' ELSE 'unspecified' END AS direction FROM documents"
_SIGNATURE = r"trim(regexp_replace(lower(subject), '\s+', ' ', 'g')) || '=>' || trim(regexp_replace(lower(object), '\s+', ' ', 'g'))"


def _claims(spark, d) -> DataFrame:
    return spark.sql(_CLAIMS.replace("FROM documents", "FROM {documents}"), documents=_table(spark, d, "documents"))


@query(f"SELECT doc_id, {_SIGNATURE} AS signature, subject || ' ' || CASE direction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CLAIM_ARROWS.items()) + f" END || ' ' || object AS line FROM ({_CLAIMS})")
def claim_signatures(spark, d):
    return _claims(spark, d).select("doc_id", G.signature("subject", "object").alias("signature"), G.one_line(F.col("subject"), F.col("direction"), F.col("object")).alias("line"))


@query(f"SELECT * FROM (SELECT {_SIGNATURE} AS signature, count(*) FILTER (direction = 'positive') AS n_positive, count(*) FILTER (direction = 'negative') AS n_negative FROM ({_CLAIMS}) GROUP BY 1) WHERE n_positive > 0 AND n_negative > 0")
def claim_contradictions(spark, d):
    return G.contradictions(_claims(spark, d))


@query("SELECT doc_id, list_filter(list_transform(string_split(source || ' , ' || lang || ',,', ','), lambda k: trim(k)), lambda k: k <> '') AS keywords FROM documents")
def project_keywords(spark, d):
    return _table(spark, d, "documents").select("doc_id", G.split_keywords(F.concat("source", F.lit(" , "), "lang", F.lit(",,"))).alias("keywords"))


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def upsert_latest(spark, d):
    return G.upsert(_table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


#: A phrase for each entity, in the gazetteers' order, and one for none.
_SAID = [
    "Expectancy-Disconfirmation", "Technology  Acceptance", "the UTAUT2 model", "planned behaviour", "Diffusion of innovation", "expectancy theory", "goal-setting theory", "uses and gratification",
    "self determination theory", "Herzberg", "Joint sentiment", "an LDA run", "BERTopic", "topicmodel", "Text mining", "sentiment  analysis", "semantic network", "morphological analysis", "PLS-SEM",
    "Regression Analysis", "latent profile", "a survey", "Interviews", "other",
]
_SPOKEN = f"doc_id || CASE doc_id % {len(_SAID)} " + " ".join(f"WHEN {i} THEN ' {x}'" for i, x in enumerate(_SAID)) + " END"


def _canonical(gazetteer: dict) -> str:
    return "CASE " + " ".join(f"WHEN {_hit('term', ps)} THEN '{name}'" for name, ps in gazetteer.items()) + " END"


@query(f"SELECT term, {_canonical(V.THEORIES)} AS theory, {_canonical(V.METHODS)} AS method FROM (SELECT {_SPOKEN} AS term FROM documents)")
def canonical_entities(spark, d):
    s = spark.sql(f"SELECT {_SPOKEN} AS term FROM {{documents}}", documents=_table(spark, d, "documents"))
    return s.select("term", X.canonical("term", V.THEORIES).alias("theory"), X.canonical("term", V.METHODS).alias("method"))


@query(f"WITH {_REGISTER} SELECT doc_id, kind AS source_type, file_hash FROM reg")
def stream_register(spark, d):
    """Documents registered by a stream over the table's files, each micro-batch written as a folder of its own."""
    root = f"{shared_dir(spark)}/lorebase/stream-{uuid.uuid4().hex}"
    reader, path = spark.readStream.schema("doc_id long, text string"), spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # a stream reads folders: a table that is one file is picked from the folder it lies in
    rows = reader.parquet(f"{d}/documents.parquet") if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(d)

    def take(batch: DataFrame, batch_id: int) -> None:
        kind = R.source_type(F.expr(_SUFFIX))
        batch.select("doc_id", kind.alias("source_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash")).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("doc_id", "source_type", "file_hash")


_NAMED = {
    "key_concepts": "kc", "theoretical_background": "theories", "analysis_methods": "methods", "key_findings": "findings", "significant_relationships": "sig", "nonsignificant_relationships": "non",
    "theoretical_contributions": "theoretical_contrib", "practical_contributions": "practical_contrib", "methodology": "meth[1]",
}
_HELD = {"title", "journal", "doi", "language", "purpose", "data", "sample", "abstract", "authors", "keywords", "research_questions", "limitations", "future_work"}
_COLUMNS = [f"{_NAMED[c] if c in _NAMED else c if c in _HELD else 'NULL::VARCHAR' if c in X.STRINGS else '[]::VARCHAR[]'} AS {c}" for c in [*X.STRINGS, *X.LISTS]]


@query(f"WITH {_FIELDS}, given AS (SELECT *, {_SIG} AS sig, {_NON} AS non FROM ex) SELECT source_id, year, {', '.join(_COLUMNS)} FROM given")
def paper_extraction(spark, d):
    """The whole record of every paper."""
    return extractions(spark, d)
