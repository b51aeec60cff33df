"""The corpus pipeline: documents to token counts, in five stages.

Each stage takes all its predecessor kept, and its decisions take effect: toxic documents go, one document of each
near-duplicate group stays, personal data is replaced in the texts, sources are replicated towards target weights (a
document may then occur several times, under its own id), and every remaining text is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import bpe, mixing, pii, simhash, toxicity
from lorebase.llm.common import cut, forget, recording, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the toxicity model rejects, columns ``COLUMNS`` (others go).

    Learns from ``labels`` of the training folds among ``docs``. Null and empty texts stay; repeated rows are judged
    alike; without labels of both classes the seed lexicon decides; an empty table gives an empty result.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within three bits, that of the smallest id; columns ``COLUMNS``.

    Words, shingles and radius are those of ``op9_simhash``. Null, empty and blank texts are one group. Rows without id
    stay; of rows that repeat the kept id one stays; an empty table gives an empty result.
    """
    return simhash.drop_near_duplicates(docs).select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in ``text`` replaced by its kind in brackets and ``n_chars`` adjusted; columns ``COLUMNS``.

    Null texts stay null, empty ones empty; repeated rows change alike; an empty table gives an empty result.
    """
    return pii.redact_documents(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated towards the target weights of their sources, in shuffled order; columns ``COLUMNS``.

    A document occurs as often as its hashed Poisson count says, maybe never. A null source is the source "", a null id
    hashes as "null", repeated rows get equal counts, null texts have no characters; an empty table gives an empty result.
    """
    return mixing.mix(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null texts count as empty, repeated rows are rows each."""
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("personal data", redact), ("mixing", mix_sources), ("tokens", encode)]

#: The stages learn models and cut texts by rules that SQL does not express: a test holds ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again; what a stage has read or made on the way goes then."""
    docs, own = table(spark, sf_dir, "documents"), set()
    for _, stage in STAGES[:-1]:
        with recording() as paths:
            docs = cut(stage(spark, docs, sf_dir))
        forget((own | paths) - {docs._lorebase_path})
        own = {docs._lorebase_path}
    return STAGES[-1][1](spark, docs, sf_dir)
