"""Registration of sources: typing, evidence, identity keys and greedy first-match deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.durable import cut, release
from .components import connected_components

#: Rounds of ``first_match`` before components are looked for; rows of a component that one task replays.
ROUNDS, REPLAYED = 3, 100_000
KEYS = ["key_doi", "key_hash", "key_url", "key_title"]


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def source_type(suffix: Column, given: Column | None = None) -> Column:
    by_suffix = F.coalesce(lookup(F.lower(suffix), V.SOURCE_TYPE_BY_SUFFIX), F.lit("other"))
    return by_suffix if given is None else F.coalesce(given, by_suffix)


def evidence_level(kind: Column) -> Column:
    return F.coalesce(lookup(kind, V.EVIDENCE_BY_TYPE), F.lit("unknown"))


def evidence_rank(level: Column) -> Column:
    """0 for unknown up to 9 for peer-reviewed."""
    return F.array_position(F.array(*map(F.lit, V.EVIDENCE_BY_RANK)), level).cast("int") - 1


def peer_reviewed(kind: Column) -> Column:
    """True for journal articles, else null, never false."""
    return F.when(kind == "journal_article", F.lit(True))


def source_id(*parts: Column) -> Column:
    """Deterministic, so that a retried task makes the same id."""
    return F.concat(F.lit("src-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def identity_keys(sources: DataFrame) -> DataFrame:
    """Adds the four keys. A field that is null or empty gives no key; a title of blanks gives the empty one.

    The title's key holds the first author; two sources without authors agree on that.
    """
    given = lambda c: T.nonempty(F.col(c)).isNotNull()
    title = F.concat(T.title_key("title"), F.lit("\x1f"), F.coalesce(F.try_element_at("author", F.lit(1)), F.lit("\x1e")))
    return sources.withColumns({
        "key_doi": F.when(given("doi"), T.strip(F.lower("doi"))), "key_hash": F.when(given("file_hash"), F.col("file_hash")),
        "key_url": F.when(given("url"), T.url_key("url")), "key_title": F.when(given("title"), title),
    })


def key_rows(rows: DataFrame, keys: list[str] = KEYS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kind, key, seq, ...): a row for each key that a source has."""
    pairs = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(keys)])
    return rows.select("seq", *keep, F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("p")).select("p.kind", "p.key", "seq", *keep)


def key_bucket(buckets: int) -> Column:
    """The bucket of a key, by which tables of keys are laid out."""
    return F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")


def _replayed(batches):
    """Kept rows of whole components, one row at a time: (seq) of rows (component, seq, kinds, keys) in order."""
    import pyarrow as pa

    component, taken, kept = None, set(), []
    for b in batches:
        for c, seq, pairs in zip(b.column("component").to_pylist(), b.column("seq").to_pylist(), b.column("pairs").to_pylist()):
            if c != component:
                component, taken = c, set()
            own = {(p["kind"], p["key"]) for p in pairs}
            if not own & taken:
                taken |= own
                kept.append(seq)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["seq"])
        kept = []


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys of kept rows, undecided keys) after one round over undecided (seq, kind, key)."""
    heads = left.groupBy("kind", "key").agg(F.min("seq").alias("head"))
    kept = left.join(heads, ["kind", "key"]).groupBy("seq").agg(F.max(F.col("seq") != F.col("head")).alias("later")).where("NOT later").select("seq")
    return _settled(left, kept)


def _settled(left: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = cut(left.join(kept, "seq", "left_semi").select("kind", "key", F.col("seq").alias("kept")))
    gone = left.join(own.select("kind", "key"), ["kind", "key"], "left_semi").select("seq").distinct()
    return own, cut(left.join(gone, "seq", "left_anti"))


def first_match(rows: DataFrame, keys: list[str] = KEYS, rounds: int = ROUNDS, most: int = REPLAYED) -> DataFrame:
    """``rows`` (seq, keys...) with ``dup_of``: the ``seq`` of the source a row duplicates, null for kept ones.

    The meaning is sequential: in order of ``seq`` a row duplicates the first kept row that shares a key, and a
    duplicate's own keys match nothing later. Three mechanisms, each on what the one before left undecided:

    * ``rounds`` rounds: a row that is the first of each of its keys is kept, rows that share a key with it are
      duplicates. Most tables end here; a chain (each row shares a key with the next) loses two rows a round;
    * connected components of the rows that share keys, found in rounds that grow with the logarithm of a chain's length;
      each component of up to ``most`` rows is replayed in order in one task, which holds the keys of one component;
    * larger components go on by rounds, and are replayed as soon as they have come apart.

    All steps are equi-joins and aggregations on (kind, key) or seq, so a key shared by a third of the rows is combined
    before the shuffle.
    """
    every = cut(key_rows(rows, keys))
    left, kept_keys, n = every, [], 0
    while not left.isEmpty():
        n += 1
        if n % (rounds + 1):
            own, rest = _round(left)
        else:
            heads = left.groupBy("kind", "key").agg(F.min("seq").alias("head"))
            found = connected_components(left.join(heads, ["kind", "key"]).select(F.col("head").alias("a"), F.col("seq").alias("b"))).withColumnRenamed("id", "seq")
            whole = left.groupBy("seq").agg(F.collect_list(F.struct("kind", "key")).alias("pairs")).join(found, "seq", "left").withColumn("component", F.coalesce("component", "seq"))  # a row has as many pairs as keys
            whole = cut(whole)
            small = whole.groupBy("component").count().where(F.col("count") <= most).select("component")
            dealt = whole.join(cut(small), "component", "left_semi").select("component", "seq", "pairs").repartition("component").sortWithinPartitions("component", "seq")
            own, rest = _settled(left, cut(dealt.mapInArrow(_replayed, "seq long")))
            release(whole)
        if left is not every:
            release(left)
        left = rest
        kept_keys.append(own)
    release(left)
    if not kept_keys:
        return rows.withColumn("dup_of", F.lit(None).cast("long"))
    shared = every.join(reduce(DataFrame.union, kept_keys), ["kind", "key"]).where("kept < seq").groupBy("seq").agg(F.min("kept").alias("dup_of"))
    out = rows.join(cut(shared), "seq", "left")
    release(every, *kept_keys)
    return out


def first_match_against(kept: DataFrame, rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``first_match`` of new ``rows`` after sources that are kept already, all of smaller ``seq``.

    ``kept``: their keys (kind, key, seq), at least those that new rows share. They are looked up by key once; rounds run
    on the new rows that match none of them.
    """
    old = kept.groupBy("kind", "key").agg(F.min("seq").alias("kept"))
    known = cut(key_rows(rows, keys).join(old, ["kind", "key"]).groupBy("seq").agg(F.min("kept").alias("dup_of")))
    fresh = first_match(rows.join(known, "seq", "left_anti"), keys)
    return fresh.unionByName(rows.join(known, "seq"))
