"""Operator 11: phrase collocations from weighted n-gram counts.

Texts are cut at punctuation into pieces; identical pieces of a language collapse to one row with a multiplicity, so a
passage that many documents share is read once. Phrases of 1, 2, ... words are counted in turn, each occurrence with its
piece's multiplicity:

* a task takes pieces as Arrow batches and sums the n-grams of some million words by columns, which combines a very
  common phrase before the shuffle;
* the shuffle deals (language, n-gram) to hash buckets, and in each bucket duckdb sums the parts out-of-core, under a
  memory limit, spilling to a folder that ends with the task, and keeps the phrases that reach ``least``;
* a phrase can be that frequent only if both phrases of one word less within it are. The frequent ones set bits in a
  bitmap, whose size is bounded (``MOST_BITS``) and which is broadcast. A bit that another phrase has set makes a task
  emit an n-gram that duckdb then drops; so results are exact whatever the size of the bitmap.

A candidate's cuts ask for the counts of their parts: requests are shuffled to where the counts of those phrases are, by
a join whose other side has a row a phrase, so that adaptive execution splits a part that a third of all phrases share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import lengths_of, slices
from .common import cut, release, table

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Words that a task sums at once; bits of the bitmap per frequent phrase, and at most (32 MB).
FLUSH, BITS_EACH, LEAST_BITS, MOST_BITS = 1 << 20, 16, 1 << 20, 1 << 28
MEMORY = "256MB"
BUCKET = 32768
#: Marks that end a piece, and blanks between words.
MARKS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"


def _pieces(batches):
    """(lang, piece, m): pieces of words joined by one space, summed within some million characters."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def summed(parts):
        return pa.Table.from_batches(parts).group_by(["lang", "piece"]).aggregate([("m", "sum")]).rename_columns(["lang", "piece", "m"]).combine_chunks().to_batches()

    held, size = [], 0
    for b in batches:
        for s, e in slices(lengths_of(b.column("text"))):
            text = pc.ascii_lower(pc.fill_null(b.column("text").slice(s, e - s), ""))
            rows = pc.split_pattern_regex(text.cast(pa.large_string()), MARKS)
            piece = pc.replace_substring_regex(pc.utf8_trim(rows.flatten(), " \t"), BLANKS, " ")
            lang = pc.fill_null(b.column("lang").slice(s, e - s), "und").take(pc.list_parent_indices(rows))
            keep = pc.not_equal(piece, "")
            piece = piece.filter(keep)
            held.append(pa.RecordBatch.from_arrays([lang.filter(keep), piece, pa.repeat(pa.scalar(1, pa.int64()), len(piece))], ["lang", "piece", "m"]))
            size += piece.nbytes
            if size > 1 << 24:
                yield from _strings(summed(held))
                held, size = [], 0
    if held:
        yield from _strings(summed(held))


def _strings(batches):
    """Batches with large strings as plain ones, which Spark reads."""
    import pyarrow as pa

    for b in batches:
        for k in range(0, b.num_rows, 1 << 16):
            part = b.slice(k, 1 << 16)
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in part.columns], names=part.schema.names)


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces of each language with their multiplicity. Null texts are empty, null languages ``und``."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _hash_words(words):
    """A 64-bit hash a word, numpy."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


_FACTOR, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(h):
    """Spread the bits of rolling hashes."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _rolling(h, lang, n: int):
    """Hashes of the n-grams that begin at each word but the last n - 1."""
    import numpy as np

    size = max(len(h) - n + 1, 0)
    out = lang[:size].copy()
    for j in range(n):
        out = out * np.uint64(_FACTOR) + h[j : j + size]
    return _mixed(out)


def _grams(n: int, known):
    """Arrow function: pieces to (lang, gram, c), partial sums of n-grams whose two shorter ones may be frequent.

    ``known``: broadcast of (number of bits, bitmap), or None for single words.
    """

    def sums(parts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(parts).combine_chunks()
        lists = pc.split_pattern(t.column("piece").combine_chunks().cast(pa.large_string()), " ")
        parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        words, lang = lists.flatten().dictionary_encode(), t.column("lang").combine_chunks().dictionary_encode()
        codes, of, m = words.indices.to_numpy(), lang.indices.to_numpy()[parent], t.column("m").to_numpy()[parent]
        start = np.arange(max(len(codes) - n + 1, 0))
        if known:
            bits, data = known.value
            h, seed = (_hash_words(d.dictionary.to_pylist())[k] for d, k in ((words, codes), (lang, of)))
            at = _rolling(h, seed, n - 1) % np.uint64(bits)
            hit = (np.frombuffer(data, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            start = np.flatnonzero(hit[: len(start)] & hit[1 : len(start) + 1] & (parent[: len(start)] == parent[n - 1 :]))
        key = of[start].astype(np.int64)  # the code of an n-gram's first words and that of the next make a code
        for j in range(n):
            distinct, key = np.unique(key * len(words.dictionary) + codes[start + j], return_inverse=True)
        total, first = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        np.add.at(total, key, m[start])
        first[key] = start
        gram = pc.binary_join_element_wise(*[words.dictionary.take(pa.array(codes[first + j])) for j in range(n)], pa.scalar(" ", pa.large_string()))
        return pa.table({"lang": lang.dictionary.take(pa.array(of[first])), "gram": gram, "c": total}).to_batches()

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("piece").nbytes
            if size > FLUSH * 6:
                yield from _strings(sums(held))
                held, size = [], 0
        if size:
            yield from _strings(sums(held))

    return run


def _counted(least: int):
    """Arrow function on the rows of some hash buckets: (lang, gram, f, h) of n-grams that reach ``least``, by duckdb."""

    def run(batches):
        import tempfile

        import duckdb
        import numpy as np
        import pyarrow as pa

        first = next(batches, None)
        if first is None:
            return

        def each():
            yield first
            yield from batches

        with tempfile.TemporaryDirectory(prefix="duckdb-") as spill, duckdb.connect() as con:  # the task's own spill, gone with it
            con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = '{spill}'; SET preserve_insertion_order = false")
            con.register("rows", pa.RecordBatchReader.from_batches(first.schema, each()))
            found = con.execute(f"SELECT lang, gram, sum(c)::BIGINT AS f FROM rows GROUP BY ALL HAVING sum(c) >= {least}").to_arrow_reader(1 << 16)
            for b in found:
                h = _hash_words(b.column("lang").to_pylist())
                for words in zip(*[g.split(" ") for g in b.column("gram").to_pylist()]):  # all have as many words
                    h = h * np.uint64(_FACTOR) + _hash_words(words)
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("gram"), b.column("f"), pa.array(_mixed(h).view(np.int64))], ["lang", "gram", "f", "h"])

    return run


def counts(parts: DataFrame, n: int, least: int, known=None) -> DataFrame:
    """(lang, gram, f, h): n-grams of the pieces that occur ``least`` times or more; ``h`` is the hash that bitmaps use."""
    found = parts.mapInArrow(_grams(n, known), "lang string, gram string, c long")
    return found.repartition("lang", "gram").mapInArrow(_counted(least), "lang string, gram string, f long, h long")


def bitmap(found: DataFrame):
    """(bits, bytes) of the frequent n-grams' hashes: 16 bits each, ``MOST_BITS`` in all at most, whatever their number."""
    bits = LEAST_BITS
    n = found.count()
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    # the hash is unsigned: pmod of a power of two takes its low bits
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = found.select(F.floor(at / BUCKET).cast("int").alias("bucket"), (at % BUCKET).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    data = bytearray(bits // 8)
    for r in rows.toLocalIterator():  # at most ``MOST_BITS / 8`` bytes
        data[r["bucket"] * (BUCKET // 8) : (r["bucket"] + 1) * (BUCKET // 8)] = r["map"]
    return bits, bytes(data)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, f, k) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, (lang, n))."""
    spark = docs.sparkSession
    parts = cut(pieces(docs))
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = cut(parts.groupBy("lang").agg(F.sum(words.cast("long") * F.col("m")).alias("n")))
    found, known = None, None
    for n in range(1, longest + 1):
        level = cut(counts(parts, n, least, known))
        if known is not None:
            known.unpersist()
        rows = level.select("lang", "gram", "f", F.lit(n).alias("k"))
        found = rows if found is None else found.unionByName(rows)
        if n < longest:
            known = spark.sparkContext.broadcast(bitmap(level))
    release(parts)
    return found, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, or all where that is None.

    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is a candidate. A cut after its first k words has
    l and r, the counts of both parts, and floor(1000 * a * n / (l * r)), n being the language's words; the lowest score
    counts, ties to the smallest k. Candidates within a longer one that has ``share`` per cent of their count or more
    are dropped. Order: score and a descending, phrase ascending by bytes.

    Null and empty texts have no phrases, null languages are ``und``; repeated rows count again; other columns are
    ignored; an empty table gives an empty result; texts and pieces may be of any length. Arithmetic is in 38 digits.
    """
    every, totals = frequent(docs, least, longest)
    cand = every.where("k > 1").withColumnsRenamed({"gram": "phrase", "f": "a"})
    words = F.split("phrase", " ")
    side = lambda s: F.array_join(s, " ")
    # within a longer candidate: if one of two words more is as frequent, so is the one between
    inner = cand.where("k > 2").select("lang", F.explode(F.array(side(F.slice(words, F.lit(1), F.col("k") - 1)), side(F.slice(words, F.lit(2), F.col("k") - 1)))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = cut(cand.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True))).drop("longer"))
    cuts = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    asked = free.select("lang", "phrase", "a", cuts.alias("cut"), words.alias("w"), "k")
    asked = asked.select("lang", "phrase", "a", "cut", side(F.slice("w", F.lit(1), F.col("cut"))).alias("left"), side(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"))
    for part, name in (("left", "l"), ("right", "r")):
        asked = asked.withColumnRenamed(part, "gram").join(every.select("lang", "gram", F.col("f").alias(name)), ["lang", "gram"]).drop("gram")
    asked = asked.join(totals, "lang").withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * 1000 * CAST(n AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    best = asked.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    got = best.withColumn("rank", rank)
    if top is not None:
        got = got.where(F.col("rank") <= top)
    return got.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = rf"""
WITH cuts AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{MARKS}')) AS piece
  FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '{BLANKS}'), lambda w: w <> '') AS w, count(*) AS m FROM cuts GROUP BY ALL),
totals AS (SELECT lang, sum(len(w) * m)::HUGEINT AS n FROM pieces GROUP BY 1),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS gram, m
  FROM pieces, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, gram, sum(m)::HUGEINT AS f FROM grams GROUP BY ALL HAVING sum(m) >= {LEAST}),
cand AS (SELECT lang, k, gram AS phrase, string_split(gram, ' ') AS w, f AS a FROM f WHERE k > 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM (
    SELECT lang, a, unnest(list_transform(range(1, k), lambda len_: len_)) AS size, k, w FROM cand) l,
    LATERAL (SELECT unnest(range(1, l.k - l.size + 2)) AS i) p
    JOIN cand s ON s.lang = l.lang AND s.phrase = array_to_string(l.w[p.i : p.i + l.size - 1], ' ') AND {SHARE} * l.a >= 100 * s.a
  WHERE l.size > 1),
asked AS (
  SELECT c.lang, c.phrase, c.a, x AS cut, array_to_string(w[1 : x], ' ') AS lp, array_to_string(w[x + 1 : k], ' ') AS rp
  FROM cand c, LATERAL (SELECT unnest(range(1, c.k)) AS x) WHERE (c.lang, c.phrase) NOT IN (SELECT (lang, phrase) FROM inside)),
scored AS (
  SELECT q.lang, phrase, a, cut, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
  FROM asked q JOIN f l ON l.lang = q.lang AND l.gram = lp JOIN f r ON r.lang = q.lang AND r.gram = rp JOIN totals t ON t.lang = q.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}
"""
