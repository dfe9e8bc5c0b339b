"""File sources and sinks: JSON arrays, configurations, graphs, and a lazy accessor of a store's runs."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import registry as R
from . import converters, storage
from .storage import exists


def read_cases(spark: SparkSession, root: str, kinds: list[str], setting: str) -> DataFrame | None:
    """Test cases of JSON arrays test_cases_{kind}_{setting}.json with their kind as attack_type; missing files are passed over."""
    found = [(kind, f"{root}/test_cases_{kind}_{setting}.json") for kind in kinds]
    tables = [spark.read.option("multiLine", True).json(path).withColumn("attack_type", F.lit(kind)) for kind, path in found if exists(spark, path)]
    return converters.union_all(tables) if tables else None


def read_config(text: str) -> dict:
    """A YAML configuration with its datasets checked: known converters, positive limits, no limit being -1."""
    import yaml

    config = yaml.safe_load(text) or {}
    for name, own in (config.get("datasets") or {}).items():
        own = own or {}
        if (kind := own.get("converter", name)) not in converters.BY_NAME and ":" not in kind:
            raise ValueError(f"no such converter: {kind}")
        if (limit := own.get("num_prompts", -1)) != -1 and limit < 1:
            raise ValueError(f"{name}: num_prompts is -1 or positive")
    return config


def config_snapshot(*columns: str) -> Column:
    """The given settings as one JSON object, in that order."""
    return F.to_json(F.struct(*columns))


def prompt_limit(command_line: int | None, dataset: int | None, everywhere: int | None) -> int:
    """The first limit given, by precedence; -1 is none."""
    return next((n for n in (command_line, dataset, everywhere) if n is not None), -1)


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def snake_cased(name: Column) -> Column:
    """snake_case() of a column."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def construct(name: str, known: dict[str, Callable], suffix: str = "", **settings: object):
    """What a configuration names: one of the known, in snake or camel case, with or without the suffix, or a class or
    function of another module as "module:name"."""
    if ":" in name:
        module, _, own = name.partition(":")
        return getattr(importlib.import_module(module), own)(**settings)
    found = snake_case(name)
    found = found if found in known else found.removesuffix(suffix)
    if found not in known:
        raise ValueError(f"no such name: {name}")
    return known[found](**settings)


def converter(name: str, **settings: object) -> converters.Converter:
    """A converter by its configured name, with or without Dataset behind, or of another module."""
    return construct(name, converters.BY_NAME, "_dataset", **settings)


def benign_class(names: dict[int, str]) -> int:
    """The number of the class that is called benign, safe or normal; 0 if none is."""
    return next((k for k, name in sorted(names.items()) if name.upper() in ("BENIGN", "SAFE", "NORMAL")), 0)


def benign_classes(classes: DataFrame, *by: str) -> DataFrame:
    """(by, benign): benign_class() of the (class, name) of each key."""
    hit = F.upper("name").isin("BENIGN", "SAFE", "NORMAL")
    return classes.groupBy(*by).agg(F.coalesce(F.min(F.when(hit, F.col("class"))), F.lit(0)).alias("benign"))


def write_graphs(graphs: DataFrame, path: str) -> None:
    graphs.write.mode("append").parquet(path)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.GRAPHS).parquet(path)


def as_map(row: str, fields: list[str]):
    """A struct column's fields as a map of texts, and back by from_map()."""
    return F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"{row}.{f}").cast("string") for f in fields]))


def from_map(column: str, kinds: dict[str, str]):
    return F.struct(*[F.col(column)[f].cast(kind).alias(f) for f, kind in kinds.items()])


def graphs_to_json(graphs: DataFrame) -> DataFrame:
    """(run_id, graph): each graph as one JSON object."""
    return graphs.select("run_id", F.to_json(F.struct(*graphs.columns)).alias("graph"))


def graphs_from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("graph", S.GRAPHS).alias("g")).select("g.*")


class RunData:
    """One run of a store: its row at once, artifacts and arrays when asked for."""

    def __init__(self, store: "Store", run_id: str):
        self.store, self.run_id = store, run_id

    @cached_property
    def row(self) -> dict:
        found = self.store.runs.where(F.col("run_id") == self.run_id).first()
        if found is None:
            raise LookupError(f"no run {self.run_id}")
        return found.asDict()

    @cached_property
    def labels(self) -> dict:
        return json.loads(self.row.get("prompt_labels") or "{}")

    def path(self, kind: str) -> str:
        return self.store.artifact(self.run_id, kind)

    def vectors(self, layer: int, kind: str = "vectors") -> DataFrame:
        """(position, vec) of a layer, from the table that the artifact names."""
        spark = self.store.events.sparkSession
        return storage.read_vectors(spark, self.path(kind), layer).where(F.col("run_id") == self.run_id).drop("run_id")

    def graph(self, kind: str = "graph") -> dict:
        spark = self.store.events.sparkSession
        found = read_graphs(spark, self.path(kind)).where(F.col("run_id") == self.run_id).first()
        if found is None:
            raise LookupError(f"run {self.run_id} has no {kind}")
        return found.asDict(recursive=True)


class Store:
    """A store's tables of events and artifacts; its current runs are resolved once."""

    def __init__(self, events: DataFrame, artifacts: DataFrame, **filters: object):
        self.events, self.artifacts, self.filters = events, artifacts, filters

    @cached_property
    def runs(self) -> DataFrame:
        return R.get_runs(R.current(self.events), **self.filters).cache()

    def run(self, run_id: str) -> RunData:
        return RunData(self, run_id)

    def run_data(self) -> list[RunData]:
        """An accessor for each of the store's runs; their ids come to the driver, no more."""
        return [RunData(self, row["run_id"]) for row in self.runs.select("run_id").orderBy("run_id").toLocalIterator()]

    def artifact(self, run_id: str, kind: str) -> str:
        """The path of a run's artifact; LookupError where it has none."""
        row = R.latest_artifacts(self.artifacts.where((F.col("run_id") == run_id) & (F.col("kind") == kind))).first()
        if row is None:
            raise LookupError(f"run {run_id} has no {kind}")
        return row["path"]
