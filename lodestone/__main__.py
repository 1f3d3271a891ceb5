"""The engine from a shell: ``python -m lodestone COMMAND ...`` (or by spark-submit). Paths are any that Spark reads."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .engine import Engine
from .sources import writers


def _callable(name: str):
    """package.module:function"""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    top.add_argument("--config", type=json.loads, default={}, help="fields of EngineConfig as JSON")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, says: str, *options: tuple) -> None:
        sub = commands.add_parser(name, help=says)
        for flag, more in options:
            sub.add_argument(flag, **more)

    need = {"required": True}
    command("ingest-pool", "raw lines to a pool sorted by mass", ("--input", need), ("--out", need), ("--parser", need | {"type": _callable}), ("--limit", {"type": int}), ("--shards", {"type": int, "default": 64}))
    command("reshard", "a pool in files of bounded size", ("--src", need), ("--out", need), ("--rows", {"type": int, "default": 4_000_000}), ("--shards", {"type": int, "default": 64}))
    command("library", "labelled spectra to a library", ("--spectra", need), ("--out", need))
    command("search", "anchors of spectra in a library", ("--spectra", need), ("--library", need), ("--out", need))
    command("predict", "ranked structures of molecules", ("--version", {"type": int, "default": 4}), ("--spectra", need), ("--library", need), ("--pool", {}), ("--large", {}), ("--probs", {}), ("--canonical", {}), ("--out", need))
    command("submit", "predictions as joined lists", ("--predictions", need), ("--expected", need), ("--fallback", {"default": ""}), ("--out", need))
    command("decoys", "candidates of windows by a seeded hash", ("--truths", need), ("--pool", need), ("--n-structures", {"type": int, "default": 30_000}), ("--decoys", {"type": int}), ("--seed", {"type": int, "default": 0}), ("--out", need))
    command("mine-decoys", "the hardest wrong candidates", ("--window", need), ("--truth", need), ("--decoys", {"type": int}), ("--out", need))
    command("evaluate", "reciprocal ranks of predictions", ("--predictions", need), ("--answers", need))
    command("tier-sweep", "caps on the first tier", ("--first", need), ("--second", need), ("--answers", need), ("--caps", {"default": "3,5,8,12,18,25"}), ("--reachable-weight", {"type": float, "default": 0.49}))
    return top


def run(spark: SparkSession, argv: list[str]) -> list[dict]:
    """Rows for the caller to print: of what has a result of its own, else where it was written."""
    a = arguments().parse_args(argv)
    engine = Engine(spark, EngineConfig(**a.config))
    read = lambda path: spark.read.parquet(path) if path else None
    if a.command == "ingest-pool":
        engine.ingest_pool(a.input, a.out, a.parser, a.limit, a.shards)
    elif a.command == "reshard":
        engine.reshard(a.src, a.out, a.rows, shards=a.shards)
    elif a.command == "library":
        engine.build_library(read(a.spectra)).write.mode("overwrite").parquet(a.out)
    elif a.command == "search":
        engine.search(read(a.spectra), read(a.library)).write.mode("overwrite").parquet(a.out)
    elif a.command == "predict":
        made = engine.predict(a.version, read(a.spectra), read(a.library), read(a.pool), read(a.large), read(a.probs), read(a.canonical))
        made.write.mode("overwrite").parquet(a.out)
    elif a.command == "submit":
        writers.csv(engine.submission(read(a.predictions), read(a.expected), a.fallback.split(";") if a.fallback else []), a.out)
    elif a.command == "decoys":
        engine.decoys(read(a.truths), read(a.pool), a.n_structures, a.decoys, a.seed).write.mode("overwrite").parquet(a.out)
    elif a.command == "mine-decoys":
        engine.mine_decoys(read(a.window), read(a.truth), a.decoys).write.mode("overwrite").parquet(a.out)
    elif a.command == "evaluate":
        return [r.asDict() for r in engine.evaluate(read(a.predictions), read(a.answers)).collect()]
    elif a.command == "tier-sweep":
        swept = engine.tier_sweep(read(a.first), read(a.second), read(a.answers), [int(c) for c in a.caps.split(",")], a.reachable_weight)
        return [r.asDict() for r in swept.orderBy(F.desc("weighted"), "cap").collect()]
    return [{"written": a.out}]


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("lodestone").getOrCreate()
    for row in run(session, sys.argv[1:]):
        print(json.dumps(row))
    session.stop()
