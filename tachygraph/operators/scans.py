"""Running values over long keys: each key is cut into chunks by its position, so that no task holds a whole key.

A scan has three steps: within a chunk, a window over its rows; over the chunks, a window over one summary row each; and the value
carried into a chunk joined back to its rows. A key of a million rows has some fifteen chunks of CHUNK positions. As the rows are needed
twice, they are written once to the shared folder (``sources.shared``) and not made twice; give a scan the columns that it needs.

Positions are numbers; a null position is a chunk of its own, before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.sources.shared import stored

#: Positions in a chunk.
CHUNK = 65_536

#: What a scan can carry: the value of a frame of rows, and of what came before together with it.
_KINDS = {
    "sum": (F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
}


def chunk_of(at: str | Column, width: float | None = None) -> Column:
    """The chunk of a position."""
    return F.floor((F.col(at) if isinstance(at, str) else at) / (CHUNK if width is None else width))


def scanned(rows: DataFrame, by: list[str], at: str, values: dict[str, tuple[str, Column]], width: float | None = None, order: list[str | Column] | None = None, upto: int = 0) -> DataFrame:
    """``rows`` with running values, by name: (kind, value), the sum or max of the key's rows so far.

    ``at`` cuts a key into chunks of ``width`` positions; rows are in the order of ``at`` and then ``order``. With ``upto`` -1 a row's
    own value is left out. Where a key's rows are many in one position, they are one chunk.
    """
    keys = [F.col(at), *(F.col(c) if isinstance(c, str) else c for c in order or [])]
    own = Window.partitionBy(*by, "chunk_").orderBy(*keys)
    held = stored(rows.withColumns({"chunk_": chunk_of(at, width)} | {f"{k}_in_": v for k, (_, v) in values.items()}), "scan")
    chunks = held.groupBy(*by, "chunk_").agg(*[_KINDS[kind][0](f"{k}_in_").alias(f"{k}_all_") for k, (kind, _) in values.items()])
    over = Window.partitionBy(*by).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*by, "chunk_", *[_KINDS[kind][0](f"{k}_all_").over(over).alias(f"{k}_before_") for k, (kind, _) in values.items()])
    same = [F.col(f"r_.{c}").eqNullSafe(F.col(f"c_.{c}")) for c in (*by, "chunk_")]
    met = held.alias("r_").join(carried.alias("c_"), same, "left").select("r_.*", *[f"c_.{k}_before_" for k in values])
    frame = own.rowsBetween(Window.unboundedPreceding, upto)
    out = {k: _KINDS[kind][1](F.col(f"{k}_before_"), _KINDS[kind][0](f"{k}_in_").over(frame)) for k, (kind, _) in values.items()}
    return met.withColumns(out).drop("chunk_", *[f"{k}{s}" for k in values for s in ("_in_", "_before_")])


def numbered(rows: DataFrame, by: list[str], at: str, name: str, width: float | None = None, order: list[str] | None = None) -> DataFrame:
    """``rows`` with their number in their key, from 0."""
    return scanned(rows, by, at, {name: ("sum", F.lit(1))}, width, order, -1).withColumn(name, F.col(name).cast("long"))


def overlapping(rows: DataFrame, at: str, behind: float = 0, ahead: float = 0, width: float | None = None) -> DataFrame:
    """``rows`` in chunks (column chunk_), each with ``behind`` positions before it and ``ahead`` after; ``own_`` marks a chunk's own rows.

    For windows of a few rows over (key, chunk_): filter on ``own_`` after them. Both must be less than a chunk.
    """
    width, own = CHUNK if width is None else width, chunk_of(at, width)
    near = F.array(own, *([chunk_of(F.col(at) + behind, width)] if behind else []), *([chunk_of(F.col(at) - ahead, width)] if ahead else []))
    return rows.withColumn("home_", own).withColumn("chunk_", F.explode(F.array_distinct(near))).withColumn("own_", F.col("home_").eqNullSafe(F.col("chunk_"))).drop("home_")


def owned(rows: DataFrame) -> DataFrame:
    """The chunks' own rows of ``overlapping``, without its columns."""
    return rows.filter("own_").drop("own_", "chunk_")
