"""Tables that cut lineage, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as they are stored, up to which a written table may be broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one of our own only for a local master without the setting."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tachygraph-")
    return f"file://{_own}"


_own: str | None = None


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def drop_tables(spark: SparkSession, first: int = 0) -> int:
    """Deletes the tables that this process has written so, from number ``first`` on, once the results that read them are stored; gives their number."""
    jvm, gone = spark.sparkContext._jvm, _written[first:]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _written[first:]
    return len(gone)


def stored(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a written table, without the tables that were written on the way to it."""
    first = len(_written)
    out = table(frame := make(), name)
    path = _written.pop()
    drop_tables(frame.sparkSession, first)
    _written.append(path)
    return out


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """``df`` (a written table) has at most ``rows`` rows (BROADCAST_ROWS) and BROADCAST_BYTES."""
    rows = BROADCAST_ROWS if rows is None else min(rows, BROADCAST_ROWS)
    stored_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return stored_bytes <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it is small; larger ones join by shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df
