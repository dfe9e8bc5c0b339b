"""Tables of a hub, mirrored below a folder: default names, scans with an index, iteration."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .converters import numbered

#: Where a mirror keeps a table; name is the last part of the repository's id.
LAYOUT = "{root}/{repo_id}/{revision}/{subset}/{split}"


def default_name(repo_id: Column, subset: Column | None = None) -> Column:
    """The last part of the id, with _ for -, and the subset behind it."""
    name = F.regexp_replace(F.element_at(F.split(repo_id, "/"), -1), "-", "_")
    return name if subset is None else F.concat_ws("_", name, subset)


class HubTable:
    """One split of a table; a source whose rows are numbered in an order of its own."""

    def __init__(self, spark: SparkSession, root: str, repo_id: str, split: str = "train", subset: str | None = None, revision: str | None = None, layout: str = LAYOUT):
        self.spark, self.repo_id, self.subset = spark, repo_id, subset
        self.path = layout.format(root=root.rstrip("/"), repo_id=repo_id, revision=revision or "main", subset=subset or "default", split=split, name=repo_id.rsplit("/", 1)[-1])

    @property
    def name(self) -> str:
        return "_".join(filter(None, (self.repo_id.rsplit("/", 1)[-1].replace("-", "_"), self.subset)))

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def rows(self, *order: str) -> DataFrame:
        """The rows with idx, from 0 in the given order of columns, or of all columns."""
        table = self.table()
        return numbered(table, *(order or table.columns))

    def __iter__(self) -> Iterator[Row]:
        return self.table().toLocalIterator()

    def __len__(self) -> int:
        return self.table().count()
