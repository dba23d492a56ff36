"""What the operators of this package share: scratch tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


#: By application, where a local session names no folder.
_OWN: dict[str, str] = {}
#: Folders of the tables written, newest last, for ``cleared``.
_ROOTS: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in a local session that names none.

    On a cluster a folder of one machine would hide its tables from all others, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="folioscope-")
        root = _OWN[app]
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the tables that operators write inside; what they return must be written by then."""
    before = len(_ROOTS)
    try:
        yield
    finally:
        for root in _ROOTS[before:]:
            remove(spark, root)
        del _ROOTS[before:]


class Stash:
    """Tables written to the shared folder, so that lineage ends there and lost executors cost no rerun.

    A table is dropped with ``drop`` once later tables replace it; the rest stay for
    the result that reads them, and go at the end of a ``cleared`` block around both.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._stash_path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(name: str) -> str:
    """A column's name as it is, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))
