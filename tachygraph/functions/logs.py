"""Messages to the log, with a flag, with the time, and short views of tables."""

from __future__ import annotations

import logging
import random

import numpy as np
from pyspark.sql import DataFrame

from tachygraph.functions.scalars import now_seconds

log = logging.getLogger("tachygraph")


def say(verbose: bool, message: str) -> None:
    if verbose:
        log.info(message)


def timed(message: str) -> None:
    log.info("%s %s", now_seconds(), message)


def said_if(flag: bool, verbose: bool, message: str) -> bool:
    """Says ``message`` if ``flag`` and ``verbose``; gives ``flag`` back, for use in conditions."""
    say(flag and verbose, message)
    return flag


def preview(df: DataFrame, rows: int = 10) -> str:
    """The first rows as text."""
    return df.limit(rows).toPandas().to_string()


def set_seed(seed: int = 42) -> None:
    """Seeds Python's and numpy's generators on the driver; Spark operators take their seeds as parameters."""
    random.seed(seed)
    np.random.seed(seed)
