"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. `lower` is exact (and much faster) where the text is pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


_made: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this process under spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process (tests).

    It is deleted when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = _made.setdefault("", tempfile.mkdtemp(prefix="pagelens-"))
    if root not in _made:
        _made[root] = f"{root.rstrip('/')}/pagelens-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _made[root])
    return _made[root]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the cluster's own cleaning of the folder does it
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go when it has ended, since nothing reads them again. `discard` removes the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "lz4").parquet(path)  # a new plan, which takes the setting
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stored` has written, once what was made of them is stored too."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(batch: pa.RecordBatch, limit: int = 4 << 20, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text each (one row at least)."""
    lengths = pc.binary_length(batch.column(col)).fill_null(0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
