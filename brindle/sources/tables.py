"""Table scans.  A scan names the columns it wants, so the Parquet reader reads no others."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@dataclass(frozen=True)
class TableId:
    """Full identity of a table: equal bare names in two schemas or catalogs stay apart."""

    catalog: str
    schema: str
    table: str

    @classmethod
    def parse(cls, name: str, spark: SparkSession) -> TableId:
        parts = [p.strip("`\"") for p in name.split(".")]
        if not 1 <= len(parts) <= 3 or not all(parts):
            raise ValueError(f"not a table name: {name!r}")
        catalog, schema = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
        return cls(*([catalog, schema][: 3 - len(parts)] + parts))

    def __str__(self) -> str:
        return f"{self.catalog}.{self.schema}.{self.table}"


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


def scan(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table, in the order asked for; all of them if none is named."""
    return read_parquet(spark, f"{sf_dir}/{table}.parquet", columns or None)


def batches(df: DataFrame, rows: int = 65_536) -> Iterator[list[Row]]:
    """A result in batches of ``rows`` (one at least), fetched a partition at a time as they are asked for."""
    it = df.toLocalIterator(prefetchPartitions=True)
    while batch := list(islice(it, max(1, rows))):
        yield batch


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV with a declared schema: inferring one would read the files twice."""
    return spark.read.schema(schema).csv(path, header=header)


def load(spark: SparkSession, sf_dir: str, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    return {t: scan(spark, sf_dir, t) for t in tables}


def register(spark: SparkSession, sf_dir: str, tables: Sequence[str] = TABLES) -> None:
    """Temporary views of the tables, for SQL."""
    for name, df in load(spark, sf_dir, tables).items():
        df.createOrReplaceTempView(name)
