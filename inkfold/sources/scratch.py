"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a local session sets a temporary folder; on a cluster, whose
    machines don't share such a folder, ValueError is raised."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The paths of the tables that open scopes will drop, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are dropped at the end, so what is made of them must be written by then; those stored
    with `keep` belong to the scope around, or stay. Without a scope tables stay until the shared folder is cleared."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written once as a table in the shared folder and read again: what is dear to compute is computed once, and
    survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/inkfold/{name}-{uuid.uuid4().hex}"
    around = _scopes.get()[: -1 if keep else None]
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
