"""Tables on storage: partitioned sinks, matrix caches and shared scratch space."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session, as in tests, gets a temporary folder; a cluster raises ValueError.
    """
    key = "spark.checkpoint.dir"
    base = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(key, base)
    return base.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it wants it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def stored(df: DataFrame) -> DataFrame:
    """df written to shared scratch space and read back, which cuts its lineage; the folder goes at the session's end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    fs, folder = _at(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(*frames: DataFrame) -> None:
    """Removes the folders of stored() tables that nothing reads any more."""
    for df in frames:
        fs, folder = _at(df.sparkSession, df._stored_at)
        fs.delete(folder, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, wherever Spark's file systems reach; one that is there is replaced."""
    fs, file = _at(spark, path)
    out = fs.create(file, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def write_npy(spark: SparkSession, path: str, array: np.ndarray) -> None:
    """A small array in NumPy's file format."""
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    write_bytes(spark, path, out.getvalue())


def read_npy(spark: SparkSession, path: str) -> np.ndarray:
    return np.load(io.BytesIO(read_bytes(spark, path)), allow_pickle=False)


def exists(spark: SparkSession, path: str) -> bool:
    fs, file = _at(spark, path)
    return fs.exists(file)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none where there is no such folder."""
    fs, folder = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, file = _at(spark, path)
    fs.delete(file, True)


def makedirs(spark: SparkSession, path: str) -> None:
    fs, folder = _at(spark, path)
    fs.mkdirs(folder)


def write_incidence(rows: DataFrame, path: str) -> None:
    """Feature incidence by date of the run, clustered by run for scans of single runs."""
    from ..operators.registry import date_of

    dated = rows.withColumn("day", F.coalesce(date_of(F.col("run_id")), F.lit("undated")))
    dated.repartition("day", "run_id").sortWithinPartitions("run_id").write.mode("append").partitionBy("day").parquet(path)


def write_activations(rows: DataFrame, path: str) -> None:
    """One table of sparse activations, partitioned by layer, for any number of runs."""
    rows.repartition("layer", "run_id").sortWithinPartitions("run_id", "position").write.mode("append").partitionBy("layer").parquet(path)


#: Components of a vector that one stored row holds.
CHUNK = 1024


def write_vectors(rows: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Dense vectors (run_id, layer, position, vec) by layer, zstd-compressed, in rows of at most `chunk` components, so
    that a range of features is read without the rest."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("vec") - 1, F.lit(0)), F.lit(chunk))
    parts = rows.select("run_id", "layer", "position", "vec", F.explode(starts).alias("start")).withColumn("vec", F.slice("vec", F.col("start") + 1, chunk))
    parts.repartition("layer", "run_id").sortWithinPartitions("run_id", "position", "start").write.mode("append").partitionBy("layer").option("compression", "zstd").parquet(path)


def read_vectors(spark: SparkSession, path: str, layer: int) -> DataFrame:
    """(run_id, position, vec) of a layer, chunks put together."""
    parts = read_layer(spark, path, layer).groupBy("run_id", "position").agg(F.sort_array(F.collect_list(F.struct("start", "vec"))).alias("parts"))
    return parts.select("run_id", "position", F.flatten(F.col("parts.vec")).alias("vec"))


def read_layer(spark: SparkSession, path: str, layer: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("layer") == layer)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


class MatrixCache:
    """Matrices as Parquet, by what they were made from: the filters of the runs are part of the key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, **settings: object) -> str:
        return hashlib.sha1(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def load_or_make(self, make, **settings: object) -> DataFrame:
        fs, _ = self._fs()
        path = f"{self.root}/{self.key(**settings)}"
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def entries(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def clear(self, **settings: object) -> None:
        """Removes the matrix made from these settings; without any, all."""
        fs, path = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.key(**settings)}") if settings else path, True)


def storage_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(n_files, bytes, n_runs) below a folder, from file listings without reading contents; runs are folders named by a
    run id, a date and at least eight hexadecimal digits, or run_id=..."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    run = F.regexp_extract("path", r"/(?:run_id=([^/]+)|([0-9]{4}-?[0-9]{2}-?[0-9]{2}[_-][0-9a-f]{8,40}))/", 0)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.countDistinct(F.when(run != "", run)).alias("n_runs"))
