"""Operator 5: mixing sources to target weights by Poisson replication.

A source's repetition rate is weight * total size / source size, so the mixture keeps the corpus's total size. Each
document's count inverts the Poisson distribution of that mean at a uniform number hashed from seed and id: the
number of k with P(X <= k) <= u. Documents are exploded by their count and dealt out by a hash of (id, copy), then
sorted by it within each partition: a global shuffle that any rerun repeats exactly.

The distribution of a source is a running sum over rows (source, k), from twelve deviations below the mean, or 0, to
twelve above: what is left out on either side is below 1e-30. So a rate of millions takes some ten thousand rows.

Statistics combine on the map side to a row a source, written as a small table. While that is below Spark's broadcast
threshold the documents meet it without a shuffle; beyond, a sort-merge join with one row a source on its side lets
adaptive execution split a source with a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, others, private, table

SEED, TEMPERATURE = "lorebase-mix", 0.5


def uniform(*parts: Column | str) -> Column:
    """A hashed number in [0, 1) with 52 bits."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_cdfs(rated: DataFrame) -> DataFrame:
    """(_source, _low, _cdf) of rows (_source, _rate): P(X <= _low), P(X <= _low + 1), ... as an array.

    Rates of 0 and null give the distribution of 0. Starts above 0 take the probability of ``_low`` from Stirling's
    series, which is exact to double precision there.
    """
    rate, k, low = F.col("_rate"), F.col("k").cast("double"), F.col("_low")  # powers of k pass 64 bits
    reach = F.sqrt(rate) * 12 + 20
    rows = rated.withColumn("_rate", F.coalesce(rate, F.lit(0.0))).withColumn("_low", F.when(rate > 2000, F.floor(rate - reach)).otherwise(0).cast("long"))
    rows = rows.withColumn("k", F.explode(F.sequence(low, F.when(rate > 0, F.ceil(rate + reach)).otherwise(0).cast("long"))))
    off = (k - rate) / rate  # log P(X = k) without the difference of large logarithms
    first = -F.log(2 * F.pi() * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k) - (k * F.log1p(off) - (k - rate))
    log = F.when(k == 0, -rate).when(k == low, first).otherwise(F.log(rate / k))
    upto = W.partitionBy("_source").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("log", F.sum(log).over(upto)).withColumn("sum", F.sum(F.exp("log")).over(upto))
    made = rows.groupBy("_source", "_low").agg(F.array_sort(F.collect_list(F.struct("k", "sum"))).alias("x"))
    return made.select("_source", "_low", F.col("x.sum").alias("_cdf"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(_source, _rate): by given weights (a source that has none gets 0), else in proportion to size ** temperature.

    A source's size is its number of characters plus one for each document, so that empty texts count too.
    """
    size = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).cast("double").alias("_size")
    )
    if weights is None:
        weight = F.pow("_size", F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    size = size.withColumn("_weight", weight)
    total = size.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    rate = F.when(F.col("_weights") > 0, F.col("_weight") / F.col("_weights") * F.col("_all") / F.col("_size")).otherwise(0.0)
    return size.join(F.broadcast(total)).select("_source", rate.alias("_rate"))  # total is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The mixture: the columns of ``docs``, then ``mix_copy`` (from 1) and ``mix_key`` (the shuffle's sort key).

    Columns of ``docs`` by these two names, in any case, are replaced. A null source is the source ``""``; a null id hashes as
    ``null``; repeated rows get equal counts; an empty table gives an empty mixture. Any rate below 2 ** 31 is taken; a
    rate's distribution takes 24 * sqrt(rate) + 40 rows.
    """
    keep = others(docs, "mix_copy", "mix_key")
    docs = docs.select(*keep)
    from_, low, cdf, number, count = private(docs.columns, "source", "low", "cdf", "u", "n")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # written first: its size is then known, and only a table below the broadcast threshold is broadcast
    table_ = cut(poisson_cdfs(rates(docs, weights, temperature)).coalesce(1)).toDF(from_, low, cdf)
    counted = docs.withColumn(from_, F.coalesce(F.col("source").cast("string"), F.lit(""))).join(table_, from_)
    counted = counted.withColumn(number, uniform(seed, "count", doc))
    counted = counted.withColumn(count, (F.col(low) + F.size(F.filter(cdf, lambda c: c <= F.col(number)))).cast("int"))
    copies = counted.where(F.col(count) > 0).select(*keep, F.explode(F.sequence(F.lit(1), F.col(count))).alias("mix_copy"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), doc, F.col("mix_copy"))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH sized AS (
  SELECT coalesce(source, '') AS s, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY 1),
rated AS (
  SELECT s, pow(size, {TEMPERATURE}) / (SELECT sum(pow(size, {TEMPERATURE})) FROM sized) * (SELECT sum(size) FROM sized) / size AS rate FROM sized),
terms AS (
  SELECT s, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / greatest(k, 1)) END) OVER (PARTITION BY s ORDER BY k)) AS p
  FROM rated, LATERAL (SELECT unnest(range(0, ceil(rate + sqrt(rate) * 12 + 21)::BIGINT)) AS k)),
cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
cdfs AS (SELECT s, list(c) AS cs FROM cdf GROUP BY s),
counted AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{SEED}:count:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(2**52)})) AS n
  FROM documents d JOIN cdfs ON s = coalesce(d.source, ''))
SELECT doc_id, text, lang, source, n_chars, mix_copy::INT AS mix_copy,
       md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mix_copy) AS mix_key
FROM counted, LATERAL (SELECT unnest(range(1, n + 1)) AS mix_copy)
"""
