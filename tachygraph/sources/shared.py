"""Tables in the folder that the driver and all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; for a local master without that setting, a folder of our own."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tachygraph-")
    return f"file://{_own}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; what reads it does not run it again, and a lost executor loses nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, first: int = 0) -> int:
    """Deletes what ``stored`` has written in this process, from table number ``first`` on, once the results that read it are kept elsewhere; gives the number of tables."""
    gone = _written[first:]
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _written[first:]
    return len(gone)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``stored`` has written within, so results that read it must be kept by then."""
    first = len(_written)
    try:
        yield
    finally:
        drop_stored(spark, first)
