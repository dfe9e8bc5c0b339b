"""Command line: ingestion over a configuration, its plan, storage statistics, and registered queries.

    python -m tessera.cli plan config.yaml --data DIR --root DIR
    python -m tessera.cli ingest config.yaml --data DIR --root DIR [--num-prompts N] [--shard 0/4] [--dataset NAME ...] [--force]
    python -m tessera.cli statistics --root DIR
    python -m tessera.cli query NAME --data DIR

A dataset's raw rows are the Parquet table DIR/NAME.parquet. Without a model of one's own the toy model runs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import ingest as I
from .plans import orchestrate as O
from .sources import converters as K
from .sources import files, storage


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("plan", "ingest"):
        one = commands.add_parser(name)
        one.add_argument("config")
        one.add_argument("--data", required=True)
        one.add_argument("--root", required=True)
        one.add_argument("--num-prompts", type=int)
        one.add_argument("--shard", default="0/1", type=lambda text: O.Shard(*map(int, text.split("/"))))
        one.add_argument("--dataset", action="append")
        one.add_argument("--force", action="store_true")
    commands.add_parser("statistics").add_argument("--root", required=True)
    one = commands.add_parser("query")
    one.add_argument("name")
    one.add_argument("--data", required=True)
    return out


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """The table that a command prints."""
    args = parser().parse_args(arguments)
    if args.command == "statistics":
        return storage.storage_statistics(spark, args.root)
    if args.command == "query":
        from .plans import catalog

        return catalog.load()[0][args.name](spark, args.data)
    config = files.read_config(spark.read.text(args.config, wholetext=True).first()[0])
    load = lambda name: _numbered(spark.read.parquet(f"{args.data}/{name}.parquet"))
    rows = O.prompts(config, load, args.num_prompts, args.shard, args.dataset)
    model = config.get("model") or {}
    settings = I.Settings(model.get("name", "toy"), max_tokens=int(model.get("max_tokens", 16384)), seed=int(model.get("seed", 42)))
    pipeline = O.FullIngestionPipeline(spark, args.root, I.toy_model(), settings)
    return pipeline.plan(rows, args.force) if args.command == "plan" else pipeline.run(rows, args.force)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with idx, their own or one by their contents."""
    return rows if "idx" in rows.columns else K.numbered(rows.withColumn("_row", F.xxhash64(*rows.columns)), "_row").drop("_row")


def main() -> None:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    run(spark, sys.argv[1:]).show(1000, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
