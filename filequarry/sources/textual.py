"""YAML lists of maps and INI files. Spark reads the files, wherever they are.

YAML lists are cut where an item begins at the start of a line, so that one file is read by many tasks, a few items at a
time. A file for which that can't be right (aliases across items, texts or flow lists in which lines begin with a dash,
documents that are no list) is told by its pieces, and is parsed whole in one task, as INI files are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "string": T.StringType()}
INI = "section string, key string, value string, line long"
#: Items of a list that are parsed at once.
ITEMS = 500
_DOCUMENT = re.compile(r"^(?:---|\.\.\.)(?:\s|$)", re.M)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value) of each file; compressed ones are told by their extension."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("start"), "value")


def _items(spark: SparkSession, path: str, mark: str = "- ") -> DataFrame:
    """(file, start, value): what stands between the marks that begin lines of each file, and where the part begins that Spark read it in."""
    lines = spark.read.option("lineSep", f"\n{mark}").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def load(text: str) -> object:
    """A YAML document. The C parser is tried first."""
    import yaml

    try:
        return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return yaml.safe_load(text)


def _maps(told: object) -> list[dict]:
    return [{str(k): v for k, v in r.items()} for r in told if isinstance(r, dict)] if isinstance(told, list) else []


def _texts(rows: Iterator[tuple[str, int, str]], cut: bool) -> Iterator[tuple[str, int, str, int]]:
    """(file, start, text, length of what goes before the first mark) of ITEMS items each, or of whole files."""
    at, items, head = None, [], 0
    for file, start, value in rows:
        if not cut:
            yield file, start, value, len(value)
            continue
        begins = (file, start) != at
        if begins or len(items) == ITEMS:
            if items:
                yield *at, "\n".join(items), head
            at, items, head = (file, start), [], 0
        if begins and start == 0:
            items, head = [value], len(value)
        else:
            items.append(f"- {value}")
    if items:
        yield *at, "\n".join(items), head


def _rows(text: str, head: int, cut: bool) -> list[dict] | None:
    """The maps of a text; None for a piece that doesn't stand by itself."""
    import yaml

    if not cut:
        return _maps(load(text))
    if _DOCUMENT.search(text, head):
        return None
    try:
        told = load(text)
    except yaml.YAMLError:
        return None
    # a comment alone may go before the first item
    return _maps(told) if isinstance(told, list) or told is None else None


def _kind(v: object) -> str | None:
    import datetime

    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "long" if isinstance(v, int) else "double"
    return "date" if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) else "string"


_SEEN = "file string, start long, n long, key string, kind string"


def _columns(cut: bool):
    """Keys with the kinds of their values, in order of appearance; a null key tells a file that can't be cut."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = {}, 0
        for file, start, text, head in _texts((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)), cut):
            rows = _rows(text, head, cut)
            for k, v in [(None, None)] if rows is None else (x for r in rows for x in r.items()):
                if (at := (file, start, k, _kind(v))) not in seen:
                    seen[at], n = n, n + 1
            if len(seen) > 10000:
                yield batch_of(seen)
                seen = {}
        yield batch_of(seen)

    def batch_of(seen: dict[tuple, int]) -> pa.RecordBatch:
        cols = list(zip(*[(file, start, n, k, kind) for (file, start, k, kind), n in seen.items()], strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "start", "n", "key", "kind"])

    return told


def yaml_schema(spark: SparkSession, path: str) -> tuple[T.StructType, list[str]]:
    """Keys of any row, in order of appearance, with the kind that all their values have; and the files that can't be cut."""

    def keys(found: DataFrame) -> list:
        at, file = F.struct("file", "start", "n"), F.when(F.col("key").isNull(), F.col("file"))
        return found.groupBy("key").agg(F.min(at).alias("at"), F.collect_set("kind").alias("kinds"), F.collect_set(file).alias("files")).collect()

    seen = keys(_items(spark, path).mapInArrow(_columns(True), _SEEN))
    whole = sorted(f for r in seen for f in r.files)
    if whole:
        parts = [frame.mapInArrow(_columns(cut), _SEEN) for frame, cut in _parts(spark, path, whole)]
        seen = keys(parts[0].union(parts[1]))

    def met(kinds: set[str]) -> T.DataType:
        return _KINDS["double" if kinds == {"long", "double"} else next(iter(kinds)) if len(kinds) == 1 else "string"]

    return T.StructType([T.StructField(r.key, met(set(r.kinds))) for r in sorted(seen, key=lambda r: tuple(r["at"]))]), whole


def _parts(spark: SparkSession, path: str, whole: list[str]) -> list[tuple[DataFrame, bool]]:
    """What is to be parsed, and whether it is cut into items."""
    if not whole:
        return [(_items(spark, path), True)]
    return [(_items(spark, path).where(~F.col("file").isin(whole)), True), (_whole(spark, path).where(F.col("file").isin(whole)), False)]


def _value(v: object, kind: T.DataType) -> object:
    if v is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(v)
        if isinstance(kind, T.IntegralType):
            return int(v)
    except (TypeError, ValueError):
        return None
    return v


def read_yaml(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Files that each hold a list of maps; others give no rows. They are read once before, for the columns and to see which can't be cut."""
    told, whole = yaml_schema(spark, path)
    schema = schema or told
    if not schema.fields:
        return spark.createDataFrame([], schema)
    parts = [_parsed(frame, schema, cut) for frame, cut in _parts(spark, path, whole)]
    return parts[0].union(parts[1]) if whole else parts[0]


def _parsed(texts: DataFrame, schema: T.StructType, cut: bool) -> DataFrame:
    fields = [(f.name, f.dataType) for f in schema]

    def parsed(batches: Iterator) -> Iterator:
        import pandas as pd

        for _, _, text, head in _texts((r for b in batches for r in zip(b["file"], b["start"], b["value"], strict=True)), cut):
            rows = [[_value(r.get(n), t) for n, t in fields] for r in _rows(text, head, cut)]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, (n, _) in enumerate(fields)})

    return texts.mapInPandas(parsed, schema)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a YAML document of columns, data and count, as ``sinks.save`` writes it, by many tasks."""
    fields = [(f.name, f.dataType) for f in schema]
    # items of data are two spaces in; what goes before the first one is no item, and after the last one the count stands
    items = _items(spark, path, "  - ").where(~F.col("value").startswith("columns:"))

    def parsed(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for at in range(0, len(b), ITEMS):
                values = [re.sub(r"\ncount: \d+\n\Z", "", v) for v in b["value"][at : at + ITEMS]]
                rows = [[_value(r.get(n), t) for n, t in fields] for r in _maps(load("".join(f"  - {v}\n" for v in values)))]
                yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, (n, _) in enumerate(fields)})

    return items.mapInPandas(parsed, schema)


def _entries(text: str) -> Iterator[tuple[str, str, str, int]]:
    section = ""
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and line[-1] == "]":
            section = line[1:-1].strip()
            continue
        key, eq, value = line.partition("=")
        if eq:
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            yield section, key.strip(), value, n


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """INI files as rows of section, key, value and line number. ``;`` and ``#`` start comments."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                cols = list(zip(*_entries(text), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()], strict=True)], ["section", "key", "value", "line"])

    return _whole(spark, path).select("value").mapInArrow(parsed, INI)
