"""Helpers shared by the training-data operators: scratch tables, sizes, keys."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every contract here: space and 0x09-0x0D.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


#: What frees the tables that a Python worker keeps between tasks, by the kind of work that they serve.
KEPT: dict[str, Callable[[], None]] = {}


def worker(kind: str):
    """Marks the body of a Python task.  Workers are reused: at its start a task frees what
    work of another kind has kept in its process, and at its end memory goes back to the system."""

    def mark(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        @functools.wraps(run)
        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for other, free in KEPT.items():
                if other != kind:
                    free()
            give_back()
            try:
                yield from run(batches)
            finally:
                give_back()

        return marked

    return mark


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Scratch tables of this process, in the order in which they were made.
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Only a local-mode session without that setting gets a temporary folder of
    its own, which is then set; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_brindle_scratch", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-scratch-")
        spark.sparkContext._brindle_scratch = folder
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Delete the scratch tables made since ``tables_made()`` was ``since``, but for ``keep``; nothing may read them afterwards."""
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    if keep is not None and not kept:  # a table without files cannot be told apart: delete nothing
        return
    for path in _made[since:]:
        if path.rsplit("/", 1)[-1] not in kept:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _made[since:] = [p for p in _made[since:] if p.rsplit("/", 1)[-1] in kept]


def tables_made() -> int:
    return len(_made)


def dealt_anew(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its long ``column`` as an expression, so that a join on it shuffles ``df`` by itself.

    An aggregate that a join takes as it lies keeps adaptive execution from splitting
    the join's hot partitions; after a shuffle of its own it can.
    """
    return df.withColumn(column, F.col(column).bitwiseXOR(F.lit(0).cast("long")))


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of 2,000 rows, since texts are long.

    Only Spark's default of 10,000 is replaced; another setting of the session stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_ROWS) == "10000":
        conf.set(_BATCH_ROWS, "2000")
    return df.mapInArrow(run, schema)


def shards(spark: SparkSession, at_least: int = 1) -> int:
    """Number of hash shards for a Python-side operator: the session's shuffle partitions."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_bucket(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus`` (fold assignment)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
