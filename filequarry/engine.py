"""The engine: named tables over files, queried in the dialect or as DataFrames."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from . import catalog, sources
from .operators import dml
from .plans import dialect, statements
from .plans.lexer import DialectError


class Engine:
    """Tables by name over one Spark session. Each table is a temporary view; files are read when a query runs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, catalog.TableConfig] = {}
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, path: str, **options) -> DataFrame:
        """Name a file or folder; options are those of a TableConfig."""
        return self.register_config(catalog.TableConfig(name=name, file_path=path, **options))

    def register_config(self, config: catalog.TableConfig, **given) -> DataFrame:
        """Name the table of a configuration; what is given here goes before what the configuration says."""
        config = dataclasses.replace(config, **given) if given else config
        df = sources.read(self.spark, config)
        self.tables[config.name.lower()] = config
        return self.register_frame(config.name, df)

    def register_frame(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self.frames[name.lower()] = df
        return df

    def table(self, name: str) -> DataFrame:
        if name.lower() not in self.frames:
            raise DialectError(f"there is no table {name}")
        return self.frames[name.lower()]

    def explain(self, sql: str) -> str:
        """The Spark SQL that a SELECT of the dialect becomes."""
        used = {t: self.frames[t].schema for t in dialect.tables_of(sql) if t in self.frames}
        return dialect.to_spark(sql, used)

    def sql(self, sql: str) -> DataFrame:
        """Run a statement. A SELECT is planned, not run; INSERT, UPDATE, DELETE and UPSERT give a row of rows_affected."""
        if change := statements.parse(sql):
            return self._change(change)
        return self._plan(self.explain(sql))

    def _plan(self, spark_sql: str) -> DataFrame:
        """Analysed without ANSI errors: what can't be computed is null, as the dialect has it."""
        conf, key = self.spark.conf, "spark.sql.ansi.enabled"
        before = conf.get(key)
        conf.set(key, "false")
        try:
            return self.spark.sql(spark_sql)
        finally:
            conf.set(key, before)

    def _change(self, change: statements.Change) -> DataFrame:
        name = change.table.lower()
        config, df = self.tables.get(name), self.table(change.table)
        if config is None:
            raise DialectError(f"{change.table} is no file")
        with dml.locked(self.spark, config.file_path):
            df = sources.read(self.spark, config, df.schema)
            df.createOrReplaceTempView(config.name)
            after, affected = dml.apply(self, df, change)
            if affected:
                dml.replace(after, config)
        self.register_frame(config.name, sources.read(self.spark, config, df.schema))
        return self.spark.createDataFrame([(affected,)], "rows_affected long")
