"""Tables that are appended to in batches, which count from the moment when all of a batch is written.

Every row carries its batch, and is in a folder of the batch's own; a row for the batch in the table of batches, written last
by one task, makes it count. Readers take rows of such batches only. So a call that ends between two of its tables leaves
rows that nobody sees, and the call that repeats it writes all of them again, in a batch of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

BATCHES = "batches"


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def new_batch() -> str:
        """A name that is no number, so that a folder's name reads as text."""
        return f"b{uuid.uuid4().hex}"

    def append(self, batch: str, **tables: DataFrame) -> None:
        """Writes the rows of a batch, table after table, and then makes it count. A batch that counts already stays as it is."""
        if self._counts(batch):
            return
        for name, rows in tables.items():
            # what an earlier try of this very batch has left goes
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch}")
        self.spark.createDataFrame([(batch, sorted(tables))], "batch_id string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{self.root}/{BATCHES}")

    def _counts(self, batch: str) -> bool:
        done = self.batches()
        return done is not None and not done.where(F.col("batch_id") == batch).isEmpty()

    def batches(self) -> DataFrame | None:
        path = f"{self.root}/{BATCHES}"
        return self.spark.read.parquet(path) if storage.exists(self.spark, path) else None

    def read(self, name: str) -> DataFrame | None:
        """The table's rows in batches that count, with batch_id; None before the first of them."""
        done, path = self.batches(), f"{self.root}/{name}"
        if done is None or not storage.exists(self.spark, path):
            return None
        kept = done.where(F.array_contains("tables", name)).select("batch_id").distinct()
        return self.spark.read.option("basePath", path).parquet(path).join(kept, "batch_id", "left_semi")

    def purge(self) -> list[str]:
        """Removes the folders of batches that don't count, and names them; not while another call is writing."""
        done = self.batches()
        known = {row["batch_id"] for row in done.select("batch_id").collect()} if done is not None else set()
        gone = []
        for table in storage.children(self.spark, self.root):
            for folder in storage.children(self.spark, f"{self.root}/{table}") if table != BATCHES else []:
                if folder.startswith("batch_id=") and folder.removeprefix("batch_id=") not in known:
                    storage.delete(self.spark, f"{self.root}/{table}/{folder}")
                    gone.append(f"{table}/{folder}")
        return sorted(gone)
