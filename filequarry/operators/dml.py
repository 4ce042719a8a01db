"""Changes of file tables: each is a DataFrame of the whole new table, written beside the old one and put in its place."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TableConfig
from ..plans.lexer import DialectError
from ..plans.statements import Change
from ..storage import Storage, beside

if TYPE_CHECKING:
    from ..engine import Engine

WRITABLE = ("csv", "tsv", "jsonl", "parquet", "json", "yaml")


@contextlib.contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold a lock file beside a table, so that two processes do not change it at once.

    On a local disk the system keeps the lock, and the file stays, as another process may wait for it. Elsewhere the file
    itself is the lock.
    """
    lock = beside(path, "lock")
    if "://" in path and not path.startswith("file:"):
        with Storage(spark, path).locked(lock):
            yield
        return
    import fcntl

    with open(lock.removeprefix("file://"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def update(df: DataFrame, where: str, sets: dict[str, str]) -> DataFrame:
    """All SET expressions see the old row; rows for which the condition is null stay as they are."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    own = {k.lower(): v for k, v in sets.items()}
    if unknown := set(own) - {c.lower() for c in df.columns}:
        raise DialectError(f"no column {', '.join(sorted(unknown))}")
    return df.select(*[F.when(hit, F.expr(own[f.name.lower()]).try_cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in own else F.col(f"`{f.name}`") for f in df.schema])


def delete(df: DataFrame, where: str) -> DataFrame:
    return df.where(~F.coalesce(F.expr(where), F.lit(False)))


def upsert(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new go in the place of rows with the same keys; columns that new lacks keep their old values."""
    old = df.alias("o").join(new.alias("n"), [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`").try_cast(df.schema[k].dataType)) for k in keys], "left")
    hit = F.col("n.__new").isNotNull()
    own = {c.lower(): c for c in new.columns}
    kept = old.select(*[F.when(hit, F.col(f"n.`{own[f.name.lower()]}`").try_cast(f.dataType)).otherwise(F.col(f"o.`{f.name}`")).alias(f.name) if f.name.lower() in own else F.col(f"o.`{f.name}`") for f in df.schema])
    added = new.alias("n").join(df.alias("o"), [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`").try_cast(df.schema[k].dataType)) for k in keys], "left_anti")
    return insert(kept, added.drop("__new"))


def apply(engine: Engine, df: DataFrame, change: Change) -> tuple[DataFrame, int]:
    """The new table, and how many rows the change touches."""
    sql = lambda e: engine.explain(f"SELECT {e} FROM {change.table}")[len("SELECT ") :].rpartition(" FROM ")[0]
    if change.kind in ("insert", "upsert"):
        known = {c.lower(): c for c in df.columns}
        if unknown := [c for c in change.columns if c.lower() not in known]:
            raise DialectError(f"no column {', '.join(unknown)}")
        cols = [known[c.lower()] for c in change.columns]
        rows = ", ".join(f"({', '.join(r)})" for r in change.rows)
        new = engine.spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(f'`{c}`' for c in cols)})")
        if change.kind == "insert":
            return insert(df, new), len(change.rows)
        keys = [known[k.lower()] for k in change.keys]
        return upsert(df, new.withColumn("__new", F.lit(True)), keys), len(change.rows)
    where = sql(change.where)
    n = df.where(F.expr(where)).count()
    if change.kind == "delete":
        return delete(df, where), n
    return update(df, where, {c: sql(e) for c, e in change.sets.items()}), n


def replace(df: DataFrame, config: TableConfig) -> None:
    """Write the table beside its path and move it there; a table of one file stays one file.

    The old table is deleted only when the new one is in its place, and comes back if that fails.
    """
    from ..sinks import write_rows

    if config.format not in WRITABLE:
        raise DialectError(f"{config.format} tables cannot be changed")
    path, mark = config.file_path.rstrip("/"), uuid.uuid4().hex[:8]
    new, old = beside(path, mark, ".new"), beside(path, mark, ".old")
    files = Storage(df.sparkSession, path)
    try:
        if files.is_dir(path) or config.format in ("json", "yaml"):
            write_rows(df, new, config)
            files.put_in_place(new, path, old)
        else:
            write_rows(df.coalesce(1), new, config, compressed=path.endswith(".gz"))
            (part,) = files.matching(f"{new}/part-*")
            files.put_in_place(part, path, old)
    finally:
        files.delete(new)
