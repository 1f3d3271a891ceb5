"""What the jobs share: configuration, logging, and the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("lodestone.jobs")


def configured(name: str, path: str | None = None) -> dict:
    """The job's configuration: of the file given, else of the one beside this module; unknown names are an error."""
    default = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    if path is None:
        return default
    given = json.loads(Path(path).read_text())
    if unknown := sorted(given.keys() - default.keys()):
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return default | given


def main(name: str, doc: str, arguments: dict[str, str], run: Callable[..., object]) -> None:
    """Runs a job from a shell: arguments are paths, each with its description."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    for argument, what in arguments.items():
        parser.add_argument(f"--{argument}", required=True, help=what)
    parser.add_argument("--config", help=f"a JSON file with settings that differ from jobs/{name}.json")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    config = configured(name, given.pop("config"))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **given, config=config)
    finally:
        spark.stop()
