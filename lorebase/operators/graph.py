"""Graph records, claims, ideas, projects and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

PROVENANCE = "struct<source_id:string,title:string,authors:array<string>,year:int,doi:string,url:string,page:string,section:string,quote:string>"
CLAIM = f"claim_id string, subject string, predicate string, object string, direction string, significance string, effect_size string, context string, population string, method string, confidence double, provenance {PROVENANCE}"
NODE = "node_id string, node_type string, label string, aliases array<string>, source_ids array<string>, wiki_page string"
EDGE = f"edge_id string, source string, target string, edge_type string, weight double, provenance array<{PROVENANCE}>"
IDEA = (
    "idea_id string, kind string, status string, created timestamp_ntz, updated timestamp_ntz, title string, observed_connection string, why_it_matters string, existing_evidence string, research_gap string, "
    f"research_question string, hypothesis string, method string, data string, expected_contribution string, risks string, interpretation string, speculation string, supporting_sources array<{PROVENANCE}>, confidence double, related_project_id string"
)
PROJECT = "project_id string, title string, research_question string, keywords array<string>, theory array<string>, method array<string>, dataset array<string>, current_stage string, important_references array<string>, research_interests array<string>"


def signature(subject: Column | str, object_: Column | str) -> Column:
    return F.concat(T.title_key(subject), F.lit("=>"), T.title_key(object_))


def one_line(subject: Column, direction: Column, object_: Column) -> Column:
    arrow = F.create_map(*[F.lit(x) for kv in V.CLAIM_ARROWS.items() for x in kv])[F.coalesce(direction, F.lit("unspecified"))]
    return F.concat_ws(" ", subject, arrow, object_)


def contradictions(claims: DataFrame) -> DataFrame:
    """Signatures that sources assert in opposite directions: (signature, n_positive, n_negative)."""
    of = lambda d: F.count_if(F.col("direction") == d)
    got = claims.groupBy(signature("subject", "object").alias("signature")).agg(of("positive").alias("n_positive"), of("negative").alias("n_negative"))
    return got.where("n_positive > 0 AND n_negative > 0")


def valid(rows: DataFrame, low: float = 0.0, high: float | None = 1.0, column: str = "confidence") -> tuple[DataFrame, DataFrame]:
    """Rows whose number is in range, and the others."""
    ok = F.coalesce((F.col(column) >= low) & (F.col(column) <= high if high is not None else F.lit(True)), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def node_key(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit(":"), T.title_key(label))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row a key: first label by node_id, union of aliases and source ids, the number merged."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return nodes.groupBy(node_key(F.col("node_type"), F.col("label")).alias("key")).agg(F.min("node_id").alias("node_id"), F.min_by("label", "node_id").alias("label"), union("aliases"), union("source_ids"), F.count(F.lit(1)).alias("n"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row a (source, type, target): greatest weight, the number merged."""
    key = F.concat_ws("-", "source", "edge_type", "target").alias("key")
    return edges.groupBy(key).agg(F.min("edge_id").alias("edge_id"), F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def upsert(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key; a row's place is that of its last version."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("_r")).select("_r.*")


def split_keywords(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(text, ","), T.strip), lambda k: k != "")


def nodes_of(extractions: DataFrame) -> DataFrame:
    """Nodes that extractions imply: a paper each, its concepts, theories and methods."""
    kinds = {"concept": "key_concepts", "theory": "theoretical_background", "method": "analysis_methods"}
    pairs = [F.arrays_zip(F.array_repeat(F.lit(k), F.size(c)).alias("node_type"), F.col(c).alias("label")).cast("array<struct<node_type:string,label:string>>") for k, c in kinds.items()]
    paper = F.array(F.struct(F.lit("paper").alias("node_type"), F.coalesce("title", "source_id").alias("label")))
    rows = extractions.select("source_id", F.explode(F.concat(paper, *pairs)).alias("x")).select("source_id", "x.*")
    ident = F.concat(F.lit("node-"), F.substring(F.sha2(F.concat_ws("|", "source_id", "node_type", "label"), 256), 1, 12))
    return rows.select(ident.alias("node_id"), "node_type", "label", F.array().cast("array<string>").alias("aliases"), F.array("source_id").alias("source_ids"), F.lit(None).cast("string").alias("wiki_page"))
