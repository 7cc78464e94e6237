"""Tables that steps write for later steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made here for local sessions without ``spark.checkpoint.dir``, by application.
_LOCAL: dict[str, str] = {}
#: Paths that ``materialize`` wrote inside the open ``scratch`` blocks, the innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where that is unset, a folder is made here; on a cluster it must be set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _LOCAL.setdefault(sc.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lodestack-")
        _LOCAL[sc.applicationId] = found
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lodestack-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there."""
    path = shared_path(df.sparkSession, tag)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path."""
    store, p = hadoop_path(spark, path)
    store.delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what ``materialize`` wrote inside, but for tables that the given function was called with.

    Those go to the block around it, if there is one; otherwise they stay in the shared folder for
    whoever reads the result.
    """
    paths: list[str] = []
    kept: list[str] = []
    _OPEN.append(paths)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.written_to)
        return table

    try:
        yield keep
    finally:
        _OPEN.remove(paths)
        for path in paths:
            if path not in kept:
                remove(spark, path)
        if _OPEN:
            _OPEN[-1].extend(kept)
