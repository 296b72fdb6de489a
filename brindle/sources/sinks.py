"""Results for people and programs: JSON rows, strings, text, files and tables."""

from __future__ import annotations

import datetime
import decimal
import json
import math
from typing import Any

from pyspark.sql import DataFrame, Row


def _bare(value: Any) -> Any:
    """Numbers and booleans as they are; null as null; anything else as a string."""
    if value is None or isinstance(value, bool | int):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() and value.as_tuple().exponent >= 0 else float(value)
    return _text(value)


def _text(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    if isinstance(value, bytes | bytearray):
        return value.hex()
    if isinstance(value, Row):
        return json.dumps(value.asDict(recursive=True), default=str)
    if isinstance(value, list | dict):
        return json.dumps(value, default=str)
    return str(value)


def json_rows(rows: list[Row], columns: list[str]) -> str:
    """One array of row objects.  Of columns with one name the later get a suffix, so that none is lost."""
    names: list[str] = []
    for c in columns:
        n, k = c, 1
        while n in names:
            n, k = f"{c}_{k}", k + 1
        names.append(n)
    return json.dumps([dict(zip(names, map(_bare, r), strict=True)) for r in rows])


def string_rows(df: DataFrame, max_rows: int = 10_000) -> tuple[list[list[str]], bool]:
    """(rows as strings, truncated).  One row more than asked for is fetched, to know."""
    return limited_rows(df, max_rows)[1:]


def limited_rows(df: DataFrame, max_rows: int, streamed: bool = False) -> tuple[DataFrame, list[list[str]], bool]:
    """The frame that was run, its rows as strings, and whether there are more; ``streamed`` fetches a partition at a time."""
    if max_rows < 0:
        raise ValueError("max_rows is negative")
    few = df.limit(max_rows + 1)
    rows = [[_text(v) for v in r] for r in (few.toLocalIterator() if streamed else few.collect())]
    return few, rows[:max_rows], len(rows) > max_rows


def text_table(rows: list[list[str]], columns: list[str]) -> str:
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in widths), *map(line, rows)])


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write a result; rows with one partition value go to one file each task, so few small files arise."""
    writer = df.write.mode(mode).format(form)
    if form == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
