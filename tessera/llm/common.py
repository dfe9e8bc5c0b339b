"""What the operators of this subpackage share: shared scratch folders and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an operator handles, and returns, at once; that Spark hands to Python at once; after which memory is trimmed.
SLICE_ROWS = 256
BATCH_ROWS = 1024
TRIM_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; Spark's file system removes it at the session's end.

    Where the setting is missing, a local session, as in tests, gets a temporary folder; a cluster raises ValueError, as
    its executors would write to folders of their own.
    """
    key = "spark.checkpoint.dir"
    base = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(key, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder as Parquet and read back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(f"{path}/data")
    out = spark.read.schema(df.schema).parquet(f"{path}/data")
    out._stored_at = path
    return out


def removed(*frames: DataFrame) -> None:
    """Removes the folders of stored() frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_held: list = ["", None]


def worker_cache(owner: str, make: Callable):
    """What make() returns, kept in this worker process until another owner asks: workers outlive tasks and stages, so
    that otherwise the caches of every operator they have run would add up."""
    if _held[0] != owner:
        _held[:] = ["", None]
        _held[:] = [owner, make()]
    return _held[1]


def unused(name: str, *frames: DataFrame) -> str:
    """name, or the first of name1, name2, ... that is no column of frames, in any case of letters."""
    taken = {column.lower() for df in frames for column in df.columns}
    return next(each for each in itertools.chain([name], (f"{name}{n}" for n in itertools.count(1))) if each.lower() not in taken)


def text_of(column: str):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session is set to hand BATCH_ROWS rows at once to Python, as rows may hold long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that gives freed memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def give_back() -> None:
    """Gives freed memory back to the system: workers outlive tasks, and what they once needed would stay theirs."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in slices; what was freed goes back to the system now and then, as workers outlive tasks."""
    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        seen += batch.num_rows
        if seen >= TRIM_ROWS:
            del batch
            pa.default_memory_pool().release_unused()
            _trim()(0)
            seen = 0
    pa.default_memory_pool().release_unused()
    _trim()(0)


def map_rows(df: DataFrame, schema: str, kernel: Callable[[pa.RecordBatch], dict], rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow by slices: kernel takes a slice and returns its columns by name, in the order of schema."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            out = kernel(part)
            yield pa.RecordBatch.from_arrays([column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column, f.type) for column, f in zip(out.values(), arrow, strict=True)], schema=arrow)

    return small_batches(df).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow form of a flat DDL schema of long, int, double, boolean, string, binary columns or arrays of these."""
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else plain[name]

    return pa.schema([(name, kind(of)) for name, of in (part.split() for part in ddl.split(","))])
