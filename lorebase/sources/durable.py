"""Tables that survive lost executors: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables of this process lie in a folder of their own, deleted when it ends.
RUN = uuid.uuid4().hex
_made: dict[str, SparkSession] = {}
_recorder: contextvars.ContextVar[tuple[set[str], ...]] = contextvars.ContextVar("recorder", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder on a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lorebase-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder; what is written there goes when this process ends, or by ``forget``."""
    path = f"{shared_dir(spark)}/lorebase/{RUN}/{kind}-{uuid.uuid4().hex}"
    _made[path] = spark
    for paths in _recorder.get():
        paths.add(path)
    return path


@contextlib.contextmanager
def recording():
    """Paths of the tables that this thread makes meanwhile; those of other threads are theirs."""
    paths: set[str] = set()
    token = _recorder.set((*_recorder.get(), paths))
    try:
        yield paths
    finally:
        _recorder.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lorebase_path = path
    return out


def made() -> set[str]:
    """Paths of the tables that are still there."""
    return set(_made)


def forget(paths: set[str]) -> None:
    """Delete these tables, which no later plan may read."""
    for path in paths & set(_made):
        fs, where = filesystem(_made.pop(path), path)
        fs.delete(where, True)


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    forget({df._lorebase_path for df in frames if hasattr(df, "_lorebase_path")})


@atexit.register
def _end() -> None:
    try:
        forget(made())
    except Exception:  # the JVM may be gone before this process
        pass


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)
