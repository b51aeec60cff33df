"""A knowledge base: registered sources, extractions, and pages, as tables of batches.

Every step writes new batch folders, which readers see once a manifest names them (``sources/manifest.py``). An ingest is
three steps: (1) sources are registered, and wait in the manifest's ``pending``; (2) they are extracted and what they say
about pages is logged, which waits in ``unwritten``; (3) the pages that it touches are changed as they stand in their
files. What breaks off is finished by ``mend``, which every ingest calls first: no step loses or repeats anything.

Page files belong to their readers too. A step reads the touched ones as they stand, and the table ``pages`` keeps every
page as last seen; files changed later, told by their time, overlay it for searches.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import extract as X
from ..operators import graph as G
from ..operators import merge as M
from ..operators import register as R
from ..operators import search as S
from ..sources import files
from ..sources.durable import cut, exists, filesystem
from ..sources.manifest import Manifest

SOURCE = (
    "source_id string, source_type string, title string, author array<string>, organization string, publication string, publication_date date, ingestion_date timestamp_ntz, doi string, url string, "
    "local_file string, language string, keywords array<string>, access_status string, peer_reviewed boolean, evidence_level string, file_hash string, seq long"
)
LOG = "seq long, source_id string, has_sig boolean, has_nonsig boolean, step int, pos int, page_type string, name string, section string, op string, line string, slug string"
PAGES = "page_type string, slug string, path string, text string, modified long"
CHANGES = "seq long, source_id string, page_type string, slug string, change string, effect string"
STORE_VARIABLE = "LOREBASE_STORE"
#: Identity keys of sources; a record that replaces another has a row of kind -1.
KEY = "kind int, key string, seq long, source_id string, bucket int"
#: Buckets that keys are laid out by, so that an ingest reads the row groups of its own keys' buckets alone; and how many
#: keys of its own an ingest hands to the scan, which then skips row groups by their Bloom filters.
BUCKETS, ASKED = 1024, 1000


def resolve_store(explicit: str | None = None) -> str:
    """The store's root: an argument, else the environment, else ./store."""
    return explicit or os.environ.get(STORE_VARIABLE) or f"file://{os.getcwd()}/store"


@dataclass
class Ingested:
    """What an ingest did: (seq, path, source_id, dup_of, duplicate) a file, counts, and what it did to pages.

    ``changes``: (seq, source_id, page_type, slug, change, effect), created and updated pages; null without new sources.
    """

    rows: DataFrame
    n_new: int = 0
    n_dup: int = 0
    changes: DataFrame | None = field(default=None)


def _numbered(rows: DataFrame, start: int) -> DataFrame:
    """(row, seq): places from ``start`` in the order of path and id, by ranges and the number of rows before each."""
    ranged = cut(rows.repartitionByRange("path", "source_id", "row").withColumn("p", F.spark_partition_id()))
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = sizes.select("p", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("p").orderBy("path", "source_id", "row"))
    return ranged.withColumn("k", place).join(before, "p").select("row", (F.col("k") + F.col("before") + (start - 1)).cast("long").alias("seq"))


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str | None = None, extractor: X.Extractor = X.extract, shared: bool = False):
        """``shared`` says that a ``file:`` root on a cluster is mounted by every machine."""
        self.spark, self.root, self.extractor = spark, files.resolved(spark, resolve_store(root), shared), extractor
        self.manifest = Manifest(spark, self.root)

    def ensure(self) -> None:
        """Make the folders of a store."""
        for d in ["raw", "structured", "kg", "index", *[f"wiki/{t}" for t in V.PAGE_TYPES], *[f"ideas/{k}" for k in V.IDEA_KINDS]]:
            fs, where = filesystem(self.spark, f"{self.root}/{d}")
            fs.mkdirs(where)

    # tables
    def _table(self, name: str, schema: str, key: str | None = None, only: list[str] | None = None, where: F.Column | None = None) -> DataFrame:
        """The live rows of a table, or those of the folders ``only``; of each folder those ``where`` says, but of replacing
        ones all are looked at for their keys. Of rows of one ``key`` that were replaced, those of
        the last folder count; only the keys of replacing folders are looked up, so plain batches are read without a shuffle."""
        live = self.manifest.read()["tables"].get(name, [])
        live = [e for e in live if only is None or e["folder"] in only]
        if not live:
            return self.spark.createDataFrame([], schema)
        path = lambda e: f"{self.root}/tables/{name}/{e['folder']}"
        read = lambda es: self.spark.read.schema(schema).parquet(*map(path, es))
        again = [e for e in live if e["replaces"]]
        every = read(live) if where is None else read(live).where(where)
        if key is None or not again:
            return every
        number = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"/batch-(\d{12})-", 1), F.lit("")), F.lit("0"))
        newest = read(again).select(F.col(key).alias("_key"), number.alias("_n")).groupBy("_key").agg(F.max("_n").alias("_newest"))
        rows = every.withColumn("_n", number)
        return rows.join(newest, F.col(key) == F.col("_key"), "left").where("_newest IS NULL OR _n >= _newest").drop("_key", "_n", "_newest")

    def _write(self, name: str, folder: str, df: DataFrame) -> str:
        df.write.mode("overwrite").parquet(f"{self.root}/tables/{name}/{folder}")
        return folder

    def sources(self) -> DataFrame:
        return self._table("sources", SOURCE, "source_id")

    def source(self, source_id: str) -> DataFrame:
        return self.sources().where(F.col("source_id") == source_id).limit(1)

    def extraction(self, source_id: str) -> DataFrame:
        return self.extractions().where(F.col("source_id") == source_id).limit(1)

    def extractions(self) -> DataFrame:
        return self._table("extractions", X.EXTRACTION, "source_id")

    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def save_sources(self, rows: DataFrame) -> None:
        """Put records in by ``source_id``, in place of those that have it; columns of ``SOURCE``, missing ones are null.

        Saved records come last in order, in that of their ids. Of rows of one id one is kept; pages stay as they are.
        """
        rows = self._with_columns(rows).dropDuplicates(["source_id"])
        start = (self.sources().agg(F.max("seq")).first()[0] or 0) + 1
        rows = cut(rows.drop("seq").withColumn("row", F.monotonically_increasing_id()))
        places = _numbered(rows.select("row", F.col("source_id").alias("path"), "source_id"), start)
        kinds = dict(x.rsplit(" ", 1) for x in SOURCE.split(", "))
        new = cut(rows.join(places, "row").select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]))
        folder = self._write("sources", self.manifest.folder(), new)
        self.manifest.add({"sources": folder, "keys": self._write_keys(folder, R.identity_keys(new), replaces=True)}, replaces=True)

    def save_extractions(self, rows: DataFrame) -> None:
        """Put extractions in by ``source_id``, in place of those that have it; columns of ``X.EXTRACTION``."""
        names = [x.rsplit(" ", 1) for x in X.EXTRACTION.split(", ")]
        rows = rows.dropDuplicates(["source_id"]).select(*[F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in names])
        self.manifest.add({"extractions": self._write("extractions", self.manifest.folder(), rows)}, replaces=True)

    def compact(self) -> None:
        """Write the live rows of each table of many folders as one; readers of the old folders are not disturbed."""
        keyed = {"sources": (SOURCE, "source_id"), "extractions": (X.EXTRACTION, "source_id"), "log": (LOG, None), "texts": ("source_id string, text string", None)}
        for name, (schema, key) in keyed.items():
            old = [e["folder"] for e in self.manifest.read()["tables"].get(name, [])]
            waits = {*self.manifest.read()["pending"], *self.manifest.read()["unwritten"]}
            if len(old) > 1 and not waits & set(old):
                new = self._write(name, self.manifest.folder(), self._table(name, schema, key, old))

                def swap(m: dict, name=name, old=old, new=new) -> None:
                    rest = [e for e in m["tables"][name] if e["folder"] not in old]
                    m["tables"][name] = [{"folder": new, "replaces": False}, *rest]

                self.manifest.commit(swap)

    def vacuum(self) -> int:
        """Delete folders that no manifest names, left by what broke off or by ``compact``. Call it while nothing else runs."""
        live = {f"{t}/{e['folder']}" for t, es in self.manifest.read()["tables"].items() for e in es}
        gone = [f"{t}/{n}" for t in self.manifest._names(f"{self.root}/tables") if not t.startswith("_") for n in self.manifest._names(f"{self.root}/tables/{t}") if n.startswith("batch") and f"{t}/{n}" not in live]
        for x in gone:
            fs, where = filesystem(self.spark, f"{self.root}/tables/{x}")
            fs.delete(where, True)
        return len(gone)

    # ingest
    def ingest(self, path: str | list[str], source_type: str | None = None, title: str | None = None, pdf: bool = False) -> Ingested:
        """Register a file, or all files of known kinds below a folder in path order, and merge what they say.

        What an earlier ingest left undone is done first; its changes are not among those returned, see ``changes``.
        """
        self.mend()
        found = files.scan(self.spark, path, pdf)
        kind = R.source_type(F.col("suffix"), F.lit(source_type) if source_type else None)
        rows = found.select(
            "path", "suffix", "text", "content", "file_hash", R.source_id(F.col("path"), F.col("file_hash")).alias("source_id"), kind.alias("source_type"),
            (F.lit(title) if title else F.col("stem")).alias("title"), F.lit("full_text").alias("access_status"),
        )
        return self._register(rows)

    ingest_dir = ingest

    def ingest_metadata(self, sources: DataFrame) -> Ingested:
        """Register sources without full text: columns of ``SOURCE``, those missing are null; order by ``path``.

        A row without ``source_id`` gets one, rows without any identity key are each a source of their own.
        """
        self.mend()
        given = [c for c in sources.columns if c != "seq"]
        own = R.source_id(F.to_json(F.struct(*given)), F.monotonically_increasing_id().cast("string"))
        rows = sources.select(*given).withColumns({c: F.lit(None).cast("string") for c in ("path", "text", "source_id") if c not in given}).withColumn("access_status", F.lit("metadata_only"))
        return self._register(rows.withColumn("source_id", F.coalesce(T.nonempty(F.col("source_id")), own)))

    @staticmethod
    def _with_columns(rows: DataFrame) -> DataFrame:
        kinds = dict(x.rsplit(" ", 1) for x in SOURCE.split(", "))
        for c in kinds:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kinds[c]))
        level = F.when(F.coalesce("evidence_level", F.lit("unknown")) != "unknown", F.col("evidence_level")).otherwise(R.evidence_level(F.col("source_type")))
        return rows.withColumns({
            "author": F.coalesce("author", F.array().cast("array<string>")), "keywords": F.coalesce("keywords", F.array().cast("array<string>")), "source_type": F.coalesce("source_type", F.lit("other")),
            "peer_reviewed": F.coalesce("peer_reviewed", R.peer_reviewed(F.col("source_type"))), "evidence_level": level,
        })

    def _register(self, rows: DataFrame) -> Ingested:
        kinds = dict(x.rsplit(" ", 1) for x in SOURCE.split(", "))
        old = self.sources()
        start = (old.agg(F.max("seq")).first()[0] or 0) + 1
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        rows = self._with_columns(rows).drop("seq").join(_numbered(rows.select("row", "path", "source_id"), start), "row").drop("row")
        local = F.when(F.col("access_status") == "full_text", F.concat(F.lit("raw/"), "source_id", F.lit("."), F.col("suffix") if "suffix" in rows.columns else F.lit("")))
        rows = cut(R.identity_keys(rows.withColumn("local_file", F.coalesce("local_file", local))))
        found = R.first_match_against(self._keys(rows), rows.select("seq", *R.KEYS))
        firsts = rows.groupBy("source_id").agg(F.min("seq").alias("_first"))  # of rows of one id the first is registered
        known = rows.select("source_id").join(old.select("source_id"), "source_id", "left_semi").distinct().withColumn("_known", F.lit(True))
        matched = cut(found.join(rows.select("seq", "source_id", "path"), "seq").join(firsts, "source_id").join(known, "source_id", "left").withColumn("_known", F.coalesce("_known", F.col("seq") > F.col("_first"))))
        fresh = matched.where("dup_of IS NULL AND NOT _known").select("seq")
        new = cut(rows.join(fresh, "seq", "left_semi"))
        n_new, n, changes = new.count(), matched.count(), None
        if n_new:
            folder = self.manifest.folder()
            made = {"texts": self._write("texts", folder, new.select("source_id", "text")), "sources": folder, "keys": folder}
            if "content" in new.columns:  # raw bytes, never changed afterwards
                made["raw"] = self._write("raw", folder, new.select("source_id", "suffix", "content"))
                files.write_files(new.where("content IS NOT NULL").select(F.col("local_file").alias("name"), "content"), self.root)
            self._write_keys(folder, new)
            self._write("sources", folder, new.select(*kinds))
            self.manifest.add(made, pending=([folder], []))
            changes = self.mend()
        shown = matched.select("seq", "path", "source_id", "dup_of", (F.col("dup_of").isNotNull() | F.col("_known")).alias("duplicate"))
        return Ingested(shown, n_new, n - n_new, changes)

    def _write_keys(self, folder: str, rows: DataFrame, replaces: bool = False) -> str:
        """The identity keys of registered ``rows`` as a batch, in order of buckets, with Bloom filters of keys."""
        keys = R.key_rows(rows, keep=("source_id",))
        if replaces:
            keys = keys.unionByName(rows.select(F.lit(-1).alias("kind"), F.col("source_id").alias("key"), "seq", "source_id"))
        keys = keys.withColumn("bucket", R.key_bucket(BUCKETS)).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
        keys.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.root}/tables/keys/{folder}")
        return folder

    def _keys(self, rows: DataFrame) -> DataFrame:
        """Registered keys that ``rows`` may share: (kind, key, seq). The scan skips what holds none of their buckets."""
        live = self.manifest.read()["tables"]
        mine = cut(R.key_rows(rows).select("kind", "key", R.key_bucket(BUCKETS).alias("bucket")).distinct())
        buckets = [r[0] for r in mine.select("bucket").distinct().collect()]  # ``BUCKETS`` at most
        keyed = {e["folder"] for e in live.get("keys", [])}
        got = self._table("keys", KEY, "source_id", where=F.col("bucket").isin(buckets))
        few = mine.select("key").limit(ASKED + 1).collect()
        got = got.where((F.col("kind") >= 0) & F.col("key").isin([r[0] for r in few])) if len(few) <= ASKED else got.where("kind >= 0")
        older = [e["folder"] for e in live.get("sources", []) if e["folder"] not in keyed]  # from before there was a table of keys
        if older:
            got = got.select("kind", "key", "seq").unionByName(R.key_rows(R.identity_keys(self._table("sources", SOURCE, only=older))))
        return got.select("kind", "key", "seq")

    def mend(self) -> DataFrame | None:
        """Do what an ingest, or one that broke off, has left to do: extract, log, change pages. The changes of the sources
        extracted now, or null."""
        changes = self._extract()
        self._write_pages()
        return changes

    complete = mend

    def _extract(self) -> DataFrame | None:
        """Step 2, for the batches that wait."""
        waits = self.manifest.read()["pending"]
        if not waits:
            return None
        todo = self._table("sources", SOURCE, only=waits).join(self._table("texts", "source_id string, text string", only=waits), "source_id", "left")
        todo, folder = cut(todo), self.manifest.folder()
        found = cut(self.extractor(todo))
        added = cut(M.contributions(todo.drop("text", "language", "keywords"), found))
        held = M.held_sections(cut(self._touched(added)))
        self._write("log", folder, added)
        self._write("extractions", folder, found)
        self._write("changes", folder, M.changes(added, held).select("seq", "source_id", *M.PAGE, "change", "effect"))
        self.manifest.add({"log": folder, "extractions": folder, "changes": folder}, pending=([], waits), unwritten=([folder], []))
        return self._table("changes", CHANGES, only=[folder])

    def _write_pages(self) -> None:
        """Step 3, for the logged batches that wait: page files are changed as they stand, and ``pages`` takes in what they
        say now, and what was edited in others since."""
        was = self.manifest.read()
        if not was["unwritten"]:
            return
        since = self._mark()
        log = self._table("log", LOG, only=was["unwritten"])
        held = cut(self._touched(log))
        texts = cut(M.applied(log, held, M.own_frontmatter(log, self.sources(), self.extractions())))
        times = files.write_pages(texts, self.root)
        seen = texts.withColumn("path", F.concat(F.lit("wiki/"), "page_type", F.lit("/"), "slug", F.lit(".md"))).join(times, "path", "left")
        if was["pages_since"]:
            edited = files.read_pages(self.spark, self.root, was["pages_since"]).join(texts.select(*M.PAGE), M.PAGE, "left_anti")
            seen = seen.unionByName(edited)
        folder = self._write("pages", self.manifest.folder(), seen.select(*[c.split()[0] for c in PAGES.split(", ")]))
        self._write("postings", folder, S.postings(self.spark.read.schema(PAGES).parquet(f"{self.root}/tables/pages/{folder}")))
        self._write("grams", folder, S.gram_counts(self.spark.read.schema(S.POSTINGS).parquet(f"{self.root}/tables/postings/{folder}")).repartitionByRange("gram").sortWithinPartitions("gram"))

        def done(m: dict) -> None:
            for name in ("pages", "postings", "grams"):
                m["tables"].setdefault(name, []).append({"folder": folder, "replaces": False})
            m["unwritten"] = [x for x in m["unwritten"] if x not in was["unwritten"]]
            m["pages_since"] = since

        self.manifest.commit(done)

    def _mark(self) -> int:
        """The store's time, in milliseconds: that of a file written now."""
        fs, where = filesystem(self.spark, f"{self.root}/tables/_mark")
        fs.create(where, True).close()
        return fs.getFileStatus(where).getModificationTime()

    # pages
    def _touched(self, log: DataFrame) -> DataFrame:
        """(page_type, slug, text) of the pages of ``log`` that have a file, read by path: no other file is looked at."""
        path = F.concat(F.lit(f"{self.root}/wiki/"), "page_type", F.lit("/"), "slug", F.lit(".md"))
        pages = log.select(*M.PAGE).distinct().select(*M.PAGE, files.content(self.spark, path).alias("content"))
        return pages.where("content IS NOT NULL").select(*M.PAGE, files.decode("content").alias("text"))

    def pages(self) -> DataFrame:
        """(page_type, slug, path, text): all pages as they stand, edits by hand included.

        The table holds them as last seen; files changed since are read, and pages whose file is gone are left out.
        """
        m = self.manifest.read()
        live = [f"{self.root}/tables/pages/{e['folder']}" for e in m["tables"].get("pages", [])]
        if not exists(self.spark, f"{self.root}/wiki"):
            return self.spark.createDataFrame([], PAGES)
        if not live or not m["pages_since"]:
            return files.read_pages(self.spark, self.root).select("page_type", "slug", "path", "text")
        number = F.regexp_extract("_metadata.file_path", r"/(batch-[^/]*)/", 1)
        last = self.spark.read.schema(PAGES).option("recursiveFileLookup", "true").parquet(*live).select("page_type", "slug", "path", "text", number.alias("n"))
        now = files.read_pages(self.spark, self.root, m["pages_since"]).select("page_type", "slug", "path", "text", F.lit("now").alias("n"))
        got = last.unionByName(now).groupBy(*M.PAGE, "path").agg(F.max_by("text", "n").alias("text"))
        return got.join(files.list_pages(self.spark, self.root).select("path"), "path", "left_semi").select("page_type", "slug", "path", "text")

    def page_texts(self, as_of: str | None = None, log: DataFrame | None = None) -> DataFrame:
        """Pages rendered from the log alone, or from ``log``, with front matter dated ``as_of`` (default: today)."""
        log = self.log() if log is None else log
        front = M.frontmatter(log, self.sources(), self.extractions(), as_of)
        return M.page_texts(log, front).withColumn("path", F.concat(F.lit("wiki/"), "page_type", F.lit("/"), "slug", F.lit(".md")))

    def wiki(self) -> DataFrame:
        return M.pages(self.log()).select("page_type", "slug", "name").orderBy("page_type", "slug")

    def show(self, page_type: str, slug: str) -> str | None:
        """A page as its file stands."""
        path = f"{self.root}/wiki/{page_type}/{slug}.md"
        got = self.spark.range(1).select(files.decode(files.content(self.spark, F.lit(path))).alias("text")).first()
        return got["text"]

    def section(self, page_type: str, slug: str, heading: str) -> str | None:
        """One section of a page as its file stands, by its heading in any case."""
        text = self.show(page_type, slug)
        return None if text is None else self.spark.createDataFrame([(text,)], "text string").select(M.get_section("text", heading)).first()[0]

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Over the pages as they stand. Posting lists say which to read, and those edited since are read too: their files'
        times are not those that the index was made at. Stores from before the index are scanned until their next ingest."""
        m = self.manifest.read()
        seen = {e["folder"] for e in m["tables"].get("pages", [])}
        if not seen or not m["pages_since"] or seen - {e["folder"] for e in m["tables"].get("postings", [])}:
            return S.keyword_search(self.pages().select("path", "text"), query, limit)
        since = F.timestamp_millis(F.lit(m["pages_since"]))
        now = files.list_pages(self.spark, self.root).where(F.col("modificationTime") >= since).select("path", F.unix_millis("modificationTime").alias("modified"))
        known = self._table("pages", PAGES).where(F.col("modified") >= m["pages_since"]).select("path", "modified")
        edited = now.join(known, ["path", "modified"], "left_anti").select("path")
        return S.indexed_search(self._table("postings", S.POSTINGS), self._table("grams", S.GRAMS), self._standing, query, limit, edited)

    def _standing(self, paths: DataFrame) -> DataFrame:
        """(path, text) of the pages (path) that have a file, read by path."""
        got = paths.select("path", files.content(self.spark, F.concat(F.lit(f"{self.root}/"), "path")).alias("content"))
        return got.where("content IS NOT NULL").select("path", files.decode("content").alias("text"))

    def digest(self) -> DataFrame:
        log = self.log()
        return S.digest(self.sources(), M.pages(log), M.section_lines(log, "Conflicting Findings"))

    def changes(self) -> DataFrame:
        """(seq, source_id, page_type, slug, change, effect): what every ingest did to pages as they stood then."""
        return self._table("changes", CHANGES)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as last saved; where none were, those of a file ``kg/graph.json`` of two arrays."""
        if "kg_nodes" in (live := self.manifest.read()["tables"]):
            last = lambda t: [live[t][-1]["folder"]]
            return tuple(self._table(t, kind, only=last(t)) for t, kind in (("kg_nodes", G.NODE), ("kg_edges", G.EDGE)))
        return files.read_graph(self.spark, f"{self.root}/kg/graph.json", G.NODE, G.EDGE)

    def save_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Replace both, columns of ``G.NODE`` and ``G.EDGE``: tasks write them, one commit makes them the graph."""
        folder = self.manifest.folder()
        put = lambda df, kind: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], kind).schema])
        self.manifest.add({"kg_nodes": self._write("kg_nodes", folder, put(nodes, G.NODE)), "kg_edges": self._write("kg_edges", folder, put(edges, G.EDGE))})

    # projects
    def projects(self) -> DataFrame:
        got = self._table("projects", G.PROJECT + ", version long")
        return G.upsert(got, "project_id", "version").orderBy("version").drop("version")

    def add_project(self, title: str, research_question: str | None = None, keywords: str = "") -> str:
        n = self._table("projects", G.PROJECT + ", version long").count()
        row = self.spark.range(1).select(
            F.concat(F.lit("proj-"), F.substring(F.sha2(F.lit(title), 256), 1, 8)).alias("project_id"), F.lit(title).alias("title"), F.lit(research_question).cast("string").alias("research_question"),
            G.split_keywords(F.lit(keywords)).alias("keywords"), *[F.array().cast("array<string>").alias(c) for c in ("theory", "method", "dataset")], F.lit(None).cast("string").alias("current_stage"),
            *[F.array().cast("array<string>").alias(c) for c in ("important_references", "research_interests")], F.lit(n).cast("long").alias("version"),
        )
        self.manifest.add({"projects": self._write("projects", self.manifest.folder(), row)})
        return row.first()["project_id"]

    def export(self) -> None:
        """Finish what is left to do, write the pages whose file is gone, as the log has them, and the tables as JSON."""
        self.ensure()
        self.mend()
        missing = M.pages(self.log()).select(*M.PAGE).join(files.list_pages(self.spark, self.root).select(*M.PAGE), M.PAGE, "left_anti")
        log = cut(self.log().join(cut(missing), M.PAGE, "left_semi"))
        files.write_pages(self.page_texts(log=log), self.root)
        files.write_json(self.sources().orderBy("seq"), f"{self.root}/index/sources")
        files.write_json(self.extractions(), f"{self.root}/structured/extractions")
