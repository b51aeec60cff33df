"""Operator 3: token ids in files of an adaptive context-mixing range coder.

A block holds consecutive ids of whole documents, ``BLOCK`` of them or a little more, and is coded by itself: models
start empty, and a checksum of its ids closes it. Documents that would take it beyond ``LIMIT`` ids are cut there. The coder (``TokenCoder.java``) predicts ids from orders 2, 1 and 0, mixes how far it trusts each and drives a
range coder. It runs in the JVM, as functions of one block: Spark's own compiler makes the classes on the driver, and
executors get them as any jar of the session. No Python code touches coded ids.

Layout of a file table: Parquet rows (part, block, n_ids, payload, pieces), uncompressed. ``part`` follows the order of
doc_id. ``pieces`` lists what the block holds, in order: where the document starts in the part, its doc_id, its length,
where in the document the piece begins, and how many ids it has. So every block is decoded by itself, wherever it is
read, and only documents longer than a block are put together by a shuffle. Spark's writers commit the files, so a lost
executor leaves no half-written one.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from array import array
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_letters, lengths_of, slices, vocabulary
from .common import cached, cut, scratch, shared_dir, table

VOCABULARY, END, BLOCK, LIMIT, PIECES, AT_ONCE = "word_bpe_49k.json", 2, 1 << 15, 1 << 16, 1 << 19, 1 << 23
FUNCTIONS = {"Encode": "binary", "EncodeShorts": "binary", "Decode": "array<binary>", "Join": "binary"}
_PIECES = "array<struct<start:bigint,doc_id:bigint,length:bigint,at:bigint,n:int>>"


def coder(spark: SparkSession) -> dict[str, str]:
    """SQL names of the coder's functions, made known to the session: ids -> payload, ids of two bytes -> payload, (payload, numbers) -> pieces, pieces -> ids."""
    source = Path(__file__).with_name("TokenCoder.java").read_text()
    mark = hashlib.sha256(source.encode()).hexdigest()[:12]
    names = {k: f"lorebase_{k.lower()}_{mark}" for k in FUNCTIONS}
    if all(spark.catalog.functionExists(n) for n in names.values()):
        return names
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    path = f"{shared_dir(spark)}/lorebase/coder-{mark}.jar"
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    out.write(packed.getvalue())
    out.close()
    spark.sql(f"ADD JAR '{path}'")
    for k, kind in FUNCTIONS.items():
        made = compiler.getClassLoader().loadClass(f"lorebase.TokenCoder${k}").newInstance()
        spark._jsparkSession.udf().register(names[k], made, jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
    return names


_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
_PLAIN = re.compile(r"[a-z0-9ß-öø-ÿ!-&(-/:;=-@\[-`{-~]+")
_ODD_SPACE = "[\x1c-\x1f]"


class ChunkEncoder:
    """The tokenizers library's encoding, each distinct stretch between white space once.

    White space is dropped by this kind of vocabulary and nothing is joined across it. A stretch of plain letters, digits
    and marks is cut as the library's splitter cuts it, and its pieces go to the library's model directly, as its
    normaliser (composed form, lower case) would hand them over. A worker keeps ``PIECES`` of them, and those of one slice
    of texts more. Ids take two bytes each, as the coder knows no larger ones.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        kinds = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"].get("pretokenizers", [{}])[0].get("behavior") == "Removed"
        self.by_chunk &= all(t["content"].startswith("<") for t in spec["added_tokens"])  # no piece below holds that mark
        self.letters = {b: c for c, b in byte_letters().items()}
        self.pieces: dict[str, bytes] = {}

    def piece(self, s: str) -> bytes:
        written = s if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
        got = self.pieces[s] = array("H", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
        return got

    def distinct(self, words):
        """Ids of each stretch of an Arrow array as 16-bit integers, in an Arrow array."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.pieces) >= PIECES:
            self.pieces.clear()
        pieces, piece, kind = self.pieces, self.piece, pa.large_binary()

        def known(some):
            """Ids of plain pieces, each distinct one looked up once."""
            some = some.dictionary_encode()
            texts = some.dictionary.to_numpy(zero_copy_only=False).tolist()
            got = [piece(t) if g is None else g for g, t in zip(map(pieces.get, texts), texts)]
            return pa.array(got, kind).take(some.indices)

        words = words.to_numpy(zero_copy_only=False).tolist()
        lows = " ".join(words).lower().split(" ")  # no stretch holds a space, and none changes what another becomes
        low = pa.array(lows, pa.large_string())
        a, b = pc.utf8_rtrim(low, _MARKS), pc.utf8_ltrim(low, _LETTERS)  # letters, then marks, if nothing is in both
        odd = np.flatnonzero(pc.not_equal(pc.add(pc.binary_length(a), pc.binary_length(b)), pc.binary_length(low)))
        if len(odd):
            fits = np.ones(len(lows), bool)
            fits[odd] = False
            a, b = (pc.if_else(pa.array(fits), x, pa.scalar("", pa.large_string())) for x in (a, b))
        out = pc.binary_join_element_wise(known(a), known(b), pa.scalar(b"", kind))
        if not len(odd):
            return out
        ids, rest = [b""] * len(odd), []
        for k, i in enumerate(odd.tolist()):
            if _PLAIN.fullmatch(lows[i]):
                ids[k] = b"".join([pieces.get(p) or piece(p) for p in _PARTS.findall(lows[i])])
            else:
                rest.append(k)
        for s in range(0, len(rest), 4096):
            some = rest[s : s + 4096]
            for k, e in zip(some, self.tokenizer.encode_batch([words[odd[k]] for k in some], add_special_tokens=False)):
                ids[k] = array("H", e.ids).tobytes()
        return pc.replace_with_mask(out, pa.array(~fits), pa.array(ids, kind))

    def encode(self, texts, end: int):
        """(ids of all ``texts``, an Arrow array of strings, with ``end`` after each, and the number of ids of each)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = np.ones(len(texts), bool) if not self.by_chunk else pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.replace_with_mask(texts, pa.array(odd), pa.scalar("", pa.large_string())) if odd.any() else texts)
        words, ends = split.flatten().dictionary_encode(), np.diff(split.offsets.to_numpy()).cumsum()
        known = pa.concat_arrays([self.distinct(words.dictionary), pa.array([array("H", [end]).tobytes()], pa.large_binary())])
        joined = known.take(pa.array(np.insert(words.indices.to_numpy(), ends, len(known) - 1)))  # the end is one more stretch
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] // 2
        ids = np.frombuffer(joined.buffers()[2], np.uint16)[: at[-1]]
        counts = np.diff(np.r_[0, at[ends + np.arange(1, len(ends) + 1)]])
        if odd.any():  # by the library itself, put in where they belong
            rows = np.flatnonzero(odd)
            more = [np.array([*e.ids, end], np.uint16) for e in self.tokenizer.encode_batch(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)]
            kept = np.split(ids, counts.cumsum()[:-1])
            for i, m in zip(rows, more):
                kept[i], counts[i] = m, len(m)
            ids = np.concatenate(kept)
        return ids, counts


def _blocks(path: str, end: int):
    """Rows (part, block, n_ids, ids, pieces) of a partition of (doc_id, text), ids of two bytes each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, part = cached(("chunks", path), lambda: ChunkEncoder(path)), TaskContext.get().partitionId()
        left, pieces, held, block, start = np.zeros(0, np.uint16), [], 0, 0, 0  # of the block that is not yet closed
        fields = [("start", pa.int64()), ("doc_id", pa.int64()), ("length", pa.int64()), ("at", pa.int64()), ("n", pa.int32())]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct(fields))]

        def rows(ready):
            nonlocal block
            for s in range(0, len(ready), 16):
                some = ready[s : s + 16]
                lists = [[dict(zip((f for f, _ in fields), p)) for p in ps] for _, ps in some]
                columns = [[part] * len(some), list(range(block, block + len(some))), [len(i) for i, _ in some], [i.tobytes() for i, _ in some], lists]
                block += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "block", "n_ids", "ids", "pieces"])

        for b in batches:
            texts, docs = b.column("text"), b.column("doc_id").to_pylist()
            for s, e in slices(lengths_of(texts), AT_ONCE):
                ids, counts = own.encode(texts.slice(s, e - s), end)
                flat = np.r_[left, ids]
                ready, begin = [], 0
                for i, n in zip(docs[s:e], counts.tolist()):
                    at = 0
                    while at < n:
                        take = min(n - at, LIMIT - held)
                        pieces.append((start, i, n, at, take))
                        at, held = at + take, held + take
                        if held == LIMIT or at == n and held >= BLOCK:
                            ready.append((flat[begin : begin + held], pieces))
                            begin, pieces, held = begin + held, [], 0
                    start += n
                left = flat[begin:].copy()
                yield from rows(ready)
        if pieces:
            yield from rows([(left, pieces)])

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write the ids of ``docs`` (doc_id, text), ``end`` after each document, in ascending order of doc_id.

    Null ids come first, rows of one id in the order of a hash of their texts and then of the texts; null and empty
    texts are ``end`` alone. Rows of one id are spread over tasks like any others. A text of any length is cut into
    blocks. Other columns are ignored. An empty table writes a file table without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("p", F.spark_partition_id())
    rows = rows.repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h", "text")
    made = rows.select("doc_id", "text").mapInArrow(_blocks(tokenizer or vocabulary(VOCABULARY), end), f"part long, block long, n_ids long, ids binary, pieces {_PIECES}")
    coded = made.select("part", "block", "n_ids", F.call_function(coder(spark)["EncodeShorts"], "ids").alias("payload"), "pieces")
    coded.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ids of each document as little-endian unsigned 32-bit integers, its end id included, and
    the number of ids of all documents before it. A payload that is cut or changed is an error."""
    own, blocks = coder(spark), spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = cut(before)  # a row a part; written, its known size lets Spark broadcast it

    def pieces(some: DataFrame) -> DataFrame:
        # the outer form keeps Spark from testing the decoded array for emptiness first, which would decode it twice
        rows = F.explode_outer(F.arrays_zip(F.col("pieces"), F.call_function(own["Decode"], "payload", "pieces.n").alias("ids"))).alias("x")
        return some.select("part", rows).select("part", "x.pieces.*", "x.ids")

    whole = pieces(blocks.where("exists(pieces, p -> p.n = p.length)")).where("n = length").select("part", "start", "doc_id", "ids")
    long = pieces(blocks.where("exists(pieces, p -> p.n < p.length)")).where("n < length").groupBy("part", "start", "doc_id")
    long = long.agg(F.call_function(own["Join"], F.sort_array(F.collect_list(F.struct("at", "ids")))["ids"]).alias("ids"))
    found = whole.unionByName(long)  # the pieces of one document: as many as its length takes
    return found.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
