"""The folder that driver and executors share, and tables written there: cuts of the lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_made: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Rows go to workers in Arrow batches of about BATCH_BYTES: texts and documents are long, and both sides hold a batch or two. A session that has set the limit keeps its own."""
    if spark.conf.get(_LIMIT, None) in (None, _DEFAULT):
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI inside spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent, as in a local test, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quire-")
    if "://" not in base:
        base = "file://" + base if base.startswith("/") else base
    _made.append(f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession) -> int:
    """Deletes the folders that this driver has made so far, once their results have been read; how many there were."""
    jvm = spark.sparkContext._jvm
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, written as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds the rows to a folder of runs. Each call writes a folder of its own, whose files show when all are there, so calls at the same time neither mix nor lose rows."""
    df.write.parquet(f"{path.rstrip('/')}/run-{uuid.uuid4().hex}")


def appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that have been added to a folder of runs so far; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
