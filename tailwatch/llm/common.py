"""What the operators of this package share: the scratch folder, table reading and word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space. On UTF-8 bytes,
#: ``bytes.split()`` finds exactly these words and ``bytes.lower()`` lower-cases exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"

_owned: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a folder of our own only where none is configured and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = tempfile.mkdtemp(prefix="tailwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tailwatch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends, if not dropped before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _owned:
        atexit.register(_drop_all)
    _owned.append((spark, path))
    return path


def save(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        _remove(t.sparkSession, t._scratch)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _owned[:] = [x for x in _owned if x[1] != path]


def _drop_all() -> None:
    for spark, path in list(_owned):
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended already
            return


def small_batches(spark: SparkSession, rows: int = 64) -> None:
    """Arrow batches of whole texts: so few rows that a batch of very long texts still fits a worker. A bound by bytes
    as well makes Spark size every row, which takes half as much of the JVM's time again and several times its garbage
    collection. A session setting, which every operator here sets for its own plans."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
