"""Tables between stages, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("open_scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Everything that is written to the shared folder within is deleted at the end.

    Results of operators are lazy over tables that they write; a caller who writes a result within a scope leaves nothing but what they wrote.
    Scopes may be nested: what is written in an inner one ends with it.
    """
    own: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), own))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for path in own:
            at, fs = _place(spark, path)
            fs.delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, as in tests, may it be unset: there the driver is the executor, and a folder of its own
    does.  On a cluster that is an error, as no local folder is seen by all.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    """A new place in the shared folder, which is cleared when the session ends."""
    path = f"{shared_dir(spark)}/tessera-{kind}-{uuid.uuid4().hex}"
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    if scopes := _open_scopes.get():
        scopes[-1].append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before.  The table goes with :func:`drop`, or when the session ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def state_of(df: DataFrame) -> tuple:
    """Name, length and time of each file that ``df`` reads: another state is another table."""
    out = []
    for name in sorted(df.inputFiles()):
        at, fs = _place(df.sparkSession, name)
        s = fs.getFileStatus(at)
        out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote; nothing may read them any more."""
    for df in tables:
        at, fs = _place(df.sparkSession, df._written_at)
        fs.delete(at, True)


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
