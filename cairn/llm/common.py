"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
#: The column with a row's own number.
ROW = "_cairn_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str):
    """The column's text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Where the setting is absent (tests, a local shell) a temporary folder is
    set, but only if the master is local.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
    return sc.getCheckpointDir().rstrip("/")


#: Paths of the tables that this driver has written and not yet removed.
_written: list[str] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path for a written table in the shared folder."""
    _written.append(path := f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return path


def written() -> list[str]:
    return list(_written)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes written tables that nothing reads any more, through the file system that Spark knows for them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows written and read again with a number of their own (column ROW).

    Rows are told apart by it whatever their doc_id: ids may be null or repeat.
    Rows that have a number already keep it and are not written again.
    """
    if ROW in docs.columns:
        return docs
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
