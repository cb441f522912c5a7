"""What the jobs share: config files, the command line, and their log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that a partitioned write puts in one folder together in few tasks: Spark splits what is too large for one and joins what is small."""
    return df.hint("rebalance", *columns)


def main(job: Callable[..., dict], config: str, argv: list[str] | None = None) -> int:
    """Run `job` with the settings of the config file, of which each can be given as --name value; prints its summary as JSON."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=str(Path(__file__).with_name(config)))
    known, rest = first.parse_known_args(argv)
    settings = json.loads(Path(known.config).read_text())
    parser = argparse.ArgumentParser(description=(job.__doc__ or "").split("\n")[0], parents=[first])
    for name, value in settings.items():
        parser.add_argument(f"--{name}", type=json.loads if isinstance(value, (dict, list)) else type(value), default=value)
    settings = {k: v for k, v in vars(parser.parse_args(rest)).items() if k != "config"}
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__name__).getOrCreate()
    try:
        print(json.dumps(job(spark, **settings), default=str))
    finally:
        spark.stop()
    return 0
