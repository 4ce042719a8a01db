"""Readers: a table configuration becomes a DataFrame scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TableConfig
from .textual import read_ini, read_yaml

__all__ = ["read"]


def read(spark: SparkSession, config: TableConfig, schema: T.StructType | None = None) -> DataFrame:
    """The table of a configuration. Compressed files are told by their extension; paths may be any that Spark reads.

    ``schema`` goes before what would be inferred from JSON and YAML.
    """
    kind, schema = config.format, config.schema() or schema
    if kind == "parquet":
        return spark.read.parquet(config.file_path)
    if kind in ("json", "jsonl"):
        reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", kind == "json")
        reader = reader.schema(schema) if schema else reader.option("samplingRatio", config.infer_share)
        return reader.json(config.file_path)
    if kind == "yaml":
        return read_yaml(spark, config.file_path, schema)
    if kind == "ini":
        return read_ini(spark, config.file_path)
    return read_delimited(spark, config)


def read_delimited(spark: SparkSession, config: TableConfig) -> DataFrame:
    """CSV and TSV. Quotes are doubled inside quoted values unless another escape is set.

    Without declared columns the types are inferred, which reads the rows once more, or the share of them that
    ``infer_share`` tells; all columns are strings with ``all_strings``.
    """
    if config.max_columns or config.strict_quotes or not config.skip_empty_lines:
        df = _split_lines(spark, config)
    else:
        reader = spark.read.options(
            header=config.has_header, sep=config.delimiter, mode="PERMISSIVE", multiLine=config.multi_line,
            quote=config.quote if config.allow_quoted else "", escape=config.escape or config.quote,
            ignoreLeadingWhiteSpace=config.trim_spaces, ignoreTrailingWhiteSpace=config.trim_spaces,
        )
        if schema := config.schema():
            reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType() if config.trim_spaces else f.dataType) for f in schema]))
        elif not config.all_strings:
            reader = reader.option("inferSchema", True).option("preferDate", True).option("samplingRatio", config.infer_share)
        df = reader.csv(config.file_path)
        if not config.has_header and not config.columns:
            df = df.toDF(*[f"col_{i}" for i in range(len(df.columns))])
    if config.trim_spaces:
        df = df.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])
    return _typed(df, config)


def _typed(df: DataFrame, config: TableConfig) -> DataFrame:
    """Declared types, by try_cast: what can't be converted is null. Rows without a required value go."""
    if not (schema := config.schema()):
        return df
    out = df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    for f in schema:
        if not f.nullable:
            out = out.where(F.col(f"`{f.name}`").isNotNull())
    return out


def _split_lines(spark: SparkSession, config: TableConfig) -> DataFrame:
    """Lines cut at the delimiter into ``max_columns`` values at most, the last of which keeps all that follows.

    Values in quotes are taken whole, delimiters and all. With ``strict_quotes`` lines with an odd number of quotes go.
    Of each file the first line is the header. Empty lines are rows of empty values unless ``skip_empty_lines``.
    """
    lines = spark.read.text(config.file_path)
    if config.skip_empty_lines:
        lines = lines.where(F.trim("value") != "")
    q, sep = re.escape(config.quote), re.escape(config.delimiter)
    n = config.max_columns or -1
    names = [c.name for c in config.columns]
    if config.has_header and not names:
        first = lines.select("value").first()
        names = [x.strip().strip(config.quote) for x in (first[0].split(config.delimiter, n - 1 if n > 0 else -1) if first else [])]
    if config.has_header and config.skip_empty_lines:
        # Spark's CSV reader knows where files begin; whole lines are its one value, as no text has the delimiter
        lines = spark.read.schema("value string").csv(config.file_path, sep="\uffff", quote="", header=True).where(F.trim("value") != "")
    elif config.has_header:
        numbered = spark.read.text(config.file_path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
        starts = numbered.where("file_block_start = 0").groupBy("file_path").agg(F.min("row").alias("row"))
        lines = numbered.join(starts.select("row"), "row", "left_anti").select("value")
    if config.strict_quotes:
        lines = lines.where((F.length("value") - F.length(F.replace("value", F.lit(config.quote)))) % 2 == 0)
    if not names:
        names = [f"col_{i}" for i in range(n if n > 0 else 1)]
    if not config.allow_quoted:
        parts = F.split("value", sep, n)
        return lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(names)])
    one = rf"{q}(?:[^{q}]|{q}{q})*{q}|[^{sep}]*"
    last = rf"(?:{sep}(.*))?" if n > 0 else rf"(?:{sep}.*)?"
    middle = len(names) - 1 if n > 0 else len(names)
    whole = "^" + rf"(?:{sep}|$)?".join([rf"\s*({one})\s*"] * middle) + (last if n > 0 else ".*") + "$"

    def value(i: int) -> Column:
        raw = F.trim(F.regexp_extract("value", whole, i))
        quoted = raw.startswith(config.quote) & raw.endswith(config.quote) & (F.length(raw) > 1)
        return F.when(quoted, F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit(config.quote * 2), F.lit(config.quote))).otherwise(raw)

    return lines.select(*[value(i).alias(c) for i, c in enumerate(names, 1)])
