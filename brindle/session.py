"""SQL sessions: isolated, measured, with a column cache and advice."""

from __future__ import annotations

import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import statements
from .activity import ActivityLog
from .functions import relaxed
from .functions.registry import FUNCTIONS, names
from .plans import Advice, ColumnCache, advise
from .plans.advisor import summarize
from .sources import TableId
from .sources.sinks import limited_rows


@dataclass
class Settings:
    """Options of a session.

    ``min_rows`` is the advice's least size of a plan; ``stream_pipeline`` fetches results a
    partition at a time; ``cache_tables`` keeps tables that are queried again; with
    ``relaxed_precision`` the functions of ``Session.function`` take single precision, with
    ``strict_fp`` it refuses those that are not exact.  ``fast_math`` is accepted and
    noted; the JVM has no such mode.
    """

    min_rows: int = 100_000
    memory_fraction: float = 0.85
    stream_pipeline: bool = True
    cache_tables: bool = True
    fast_math: bool = False
    relaxed_precision: bool = False
    strict_fp: bool = False
    cache_bytes: int = 1 << 30
    memory_bytes: int = 4 << 30

    def set(self, name: str, value: Any) -> None:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if name not in kinds:
            raise KeyError(f"no setting {name!r}; there are {', '.join(kinds)}")
        kind = kinds[name]
        if kind is bool and isinstance(value, str):
            if value.lower() not in {"true", "false", "on", "off", "1", "0"}:
                raise ValueError(f"{name} is true or false")
            value = value.lower() in {"true", "on", "1"}
        value = kind(value)
        if name == "memory_fraction" and not 0 < value <= 1:
            raise ValueError("memory_fraction lies in (0, 1]")
        if kind is int and value < 0:
            raise ValueError(f"{name} is negative")
        setattr(self, name, value)


@dataclass
class QueryStats:
    """Of one query: microseconds by phase, rows of its scans, and whether advice was favourable."""

    worthwhile_plans: int = 0
    scan_us: int = 0
    execute_us: int = 0
    optimize_us: int = 0
    input_rows: int = 0
    wall_us: int = 0


@dataclass
class QueryResult:
    columns: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    truncated: bool = False
    error: str | None = None
    stats: QueryStats = field(default_factory=QueryStats)

    @property
    def ok(self) -> bool:
        return self.error is None


def spark_session(app: str = "brindle", **conf: Any) -> SparkSession:
    """A session with the engine's defaults; what the cluster or the caller sets stays."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scan_micros(df: DataFrame) -> int:
    """Time that the tasks of ``df``'s last run spent in reading files, by Spark's own metric."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        metric = plan.metrics().get("scanTime")
        if metric.isDefined():
            total += int(metric.get().value()) * 1000
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


class Session:
    """An isolated database on a shared Spark application.

    Temporary views and settings belong to the session; its tables live in a schema of
    its own, which ``close`` drops.  ``accelerated=False`` leaves out advice and cache.
    """

    def __init__(self, spark: SparkSession | None = None, schema: str | None = None, accelerated: bool = True, settings: Settings | None = None, log: ActivityLog | None = None):
        self.spark = (spark or spark_session()).newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.settings, self.log, self.accelerated = settings or Settings(), log or ActivityLog(), accelerated
        self._owned = schema is None
        self.schema = schema or f"brindle_{uuid.uuid4().hex[:12]}"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.schema}")
        self.spark.catalog.setCurrentDatabase(self.schema)
        self.cache = ColumnCache(self.settings.cache_bytes)
        self.notes: list[str] = []
        self._reads: Counter[TableId] = Counter()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.cache.invalidate()
        if self._owned:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.schema} CASCADE")

    def register(self, sf_dir: str) -> None:
        from .sources import register

        register(self.spark, sf_dir)

    def warmup(self) -> None:
        """Start executors and compile a plan, so that the first query does not pay for it."""
        self.spark.range(1000).select(F.sum("id")).collect()

    def sql(self, text: str) -> DataFrame:
        """One statement as a DataFrame; writes run at once and drop what they make stale."""
        write = statements.classify(text)
        change = statements.row_change(text) if write and write.verb in {"delete", "update"} else None
        if m := re.fullmatch(r"set\s+engine\.(\w+)\s*=\s*(\S+)", statements.bare(text), re.I):
            self.settings.set(m[1].lower(), m[2])
            if m[1].lower() == "fast_math" and self.settings.fast_math:
                self.notes.append("fast_math has no effect on the JVM")
            if m[1].lower() == "cache_bytes":
                self.cache.budget = self.settings.cache_bytes
            return self.spark.createDataFrame([], "key string, value string")
        if write:  # before it runs: a failed write may have changed rows
            self._forget(write)
        df = self._change(change) if change else self.spark.sql(text)
        if write:
            self._forget(write)
        return df

    def _forget(self, write: statements.Write) -> None:
        table = TableId.parse(write.table, self.spark) if write.table else None
        dropped = self.cache.invalidate(table)
        self._reads.clear() if table is None else self._reads.pop(table, None)
        if write.table:
            self.spark.sql(f"REFRESH TABLE {write.table}")
        self.log.write("debug", "invalidate", verb=write.verb, table=str(table or "*"), dropped=dropped)

    def _change(self, change: statements.RowChange) -> DataFrame:
        """DELETE and UPDATE of file tables: the new rows are written beside the old ones, then swapped."""
        old = self.spark.table(change.table)
        hit = F.coalesce(F.expr(change.condition), F.lit(False)) if change.condition else F.lit(True)
        if change.verb == "delete":
            new = old.where(~hit)
        else:
            unknown = set(map(str.lower, change.assignments)) - {c.lower() for c in old.columns}
            if unknown:
                raise ValueError(f"no column {', '.join(sorted(unknown))} in {change.table}")
            values = {k.lower(): v for k, v in change.assignments.items()}
            new = old.select(*[F.when(hit, F.expr(values[c.lower()]).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c.lower() in values else F.col(c) for c in old.columns])
        count = old.where(hit).count()
        name = TableId.parse(change.table, self.spark)
        mark = uuid.uuid4().hex[:8]
        at, fresh, former = f"{name.schema}.{name.table}", f"{name.schema}.{name.table}__new_{mark}", f"{name.schema}.{name.table}__old_{mark}"
        new.write.saveAsTable(fresh)
        # The old rows keep a name until the new ones have theirs; `recover` puts back what a crash left between.
        self.spark.sql(f"ALTER TABLE {at} RENAME TO {former}")
        try:
            self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {at}")
        except Exception:
            self.spark.sql(f"ALTER TABLE {former} RENAME TO {at}")
            raise
        self.spark.sql(f"DROP TABLE {former}")
        return self.spark.createDataFrame([(count,)], "count long")

    def recover(self) -> None:
        """End or undo changes that a crash cut short: a table without its name gets its old rows back.

        To be called while no other session changes tables of the schema.
        """
        there = {t.name for t in self.spark.catalog.listTables(self.schema) if not t.isTemporary}
        for left in sorted(there):
            if m := re.fullmatch(r"(.+)__(old|new)_[0-9a-f]{8}", left):
                if m[2] == "old" and m[1] not in there:
                    self.spark.sql(f"ALTER TABLE {self.schema}.{left} RENAME TO {self.schema}.{m[1]}")
                    there.add(m[1])
                else:
                    self.spark.sql(f"DROP TABLE {self.schema}.{left}")

    def _hold_tables(self, df: DataFrame) -> None:
        """Keep the tables that ``df`` reads, from their second query on; Catalyst then reads the kept columns in any plan."""
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.getClass().getSimpleName() != "LogicalRelation" or not leaf.catalogTable().isDefined():
                continue
            name = TableId.parse(leaf.catalogTable().get().identifier().unquotedString(), self.spark)
            self._reads[name] += 1
            if not self.cache.touch(name) and self._reads[name] > 1:
                self.cache.hold(name, self.spark.table(str(name)), int(str(leaf.stats().sizeInBytes())))

    def function(self, name: str, *args: Any) -> Column:
        """A registered scalar function under this session's settings of precision."""
        f = FUNCTIONS[name]
        if self.settings.strict_fp and not f.exact:
            raise ValueError(f"strict floating point allows only {', '.join(names(exact_only=True))}")
        return relaxed(f.build, *args) if self.settings.relaxed_precision and not f.exact else f.build(*args)

    def register_function(self, name: str, body: Callable[..., Any], returns: str) -> None:
        """A scalar function of pandas series for SQL; it gets Arrow batches, never single rows."""
        self.spark.udf.register(name, F.pandas_udf(body, returns))

    def table(self, name: str, *columns: str, populate: bool = True) -> DataFrame:
        """Columns of a table through the column cache."""
        names = list(columns) or self.spark.table(name).columns
        if not self.accelerated:
            return self.spark.table(name).select(*names)
        return self.cache.serve(TableId.parse(name, self.spark), lambda: self.spark.table(name), names, populate)

    def advise(self, df: DataFrame) -> Advice:
        s = self.settings
        out = advise(df, int(s.memory_bytes * s.memory_fraction), exact_only=s.strict_fp, min_rows=s.min_rows)
        self.log.write("info", "advice", **out.as_dict())
        return out

    def query(self, text: str, max_rows: int = 10_000) -> QueryResult:
        """Run one statement; rows come as strings, and errors as text."""
        out, began = QueryResult(), time.perf_counter()
        try:
            df = self.sql(text)
            if self.accelerated and self.settings.cache_tables and df.columns and not statements.classify(text):
                self._hold_tables(df)
                df = self.spark.sql(text) if self.cache.entries else df
            start = time.perf_counter()
            df._jdf.queryExecution().executedPlan()
            out.stats.optimize_us = int((time.perf_counter() - start) * 1e6)
            out.columns, out.types = df.columns, [t for _, t in df.dtypes]
            if self.accelerated and df.columns:
                plan = summarize(df)
                out.stats.input_rows = sum(n.rows for n in plan.walk() if n.kind == "scan")
                out.stats.worthwhile_plans = int(self.advise(df).worthwhile)
            start = time.perf_counter()
            limited, out.rows, out.truncated = limited_rows(df, max_rows, self.settings.stream_pipeline)
            out.stats.execute_us = int((time.perf_counter() - start) * 1e6)
            out.stats.scan_us = scan_micros(limited)
        except Exception as e:
            out.error = str(e).split("\n\nJVM stacktrace")[0].strip()
            self.log.write("error", "query", sql=text, error=out.error)
        out.stats.wall_us = int((time.perf_counter() - began) * 1e6)
        self.log.write("info", "query", sql=text, ok=out.ok, **vars(out.stats))
        return out

    def script(self, text: str) -> Iterator[tuple[str, DataFrame]]:
        """Each statement with its result; those without columns make no rows."""
        for s in statements.split(text):
            yield s, self.sql(s)

    def rows(self, df: DataFrame, max_rows: int | None = None) -> list[Row]:
        return (df.limit(max_rows) if max_rows is not None else df).collect()
