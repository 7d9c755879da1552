"""What the jobs share: configuration, a session for the command line, and logging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configured(kind: type, spark: SparkSession, path: str | None) -> Any:
    """``kind`` (a dataclass) with the values of the JSON file at ``path``, read by Spark as it may be remote; unknown names are refused."""
    if path is None:
        return kind()
    given = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
    return kind(**given)


def main(name: str, about: str, paths: tuple[str, ...], run: Callable[..., dict]) -> None:
    """Command line: one option for each of ``paths``, and --config."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file; what it leaves out has its default")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[args[p] for p in paths], config_path=args["config"])
    finally:
        spark.stop()
