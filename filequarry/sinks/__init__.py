"""Writers of results: Spark's own for row formats, and small writers for formats that are one document."""

from __future__ import annotations

import datetime
import decimal
import gzip
import io
import itertools
import json
import os
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import IO, Any

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..catalog import TableConfig
from ..storage import Storage, beside as hidden, shared_beside
from .xlsx import pack, row_lines, write_xlsx

ALIASES = {"text": "table", "json-lines": "jsonl", "ndjson": "jsonl", "yml": "yaml", "xlsx": "excel"}
FORMATS = ("table", "csv", "tsv", "json", "jsonl", "yaml", "excel", "parquet")
CODECS = ("snappy", "gzip", "lz4", "zstd", "none")
#: Cells of the table format are cut to this many characters.
CELL = 50
#: Rows that become text at once, and rows of one file of such texts.
BATCH, PART = 500, 1 << 15


def canonical(fmt: str) -> str:
    fmt = ALIASES.get(fmt.lower(), fmt.lower())
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known are {', '.join(FORMATS)}")
    return fmt


def plain(v: Any) -> Any:
    """A value as JSON and YAML have it."""
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat(" ") if isinstance(v, datetime.datetime) else v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(df: DataFrame) -> Iterator[dict[str, Any]]:
    """Rows one after the other, a partition at a time, so that the driver never holds them all."""
    for r in df.toLocalIterator():
        yield {c: plain(v) for c, v in zip(df.columns, r, strict=True)}


def _yaml(data: list[dict[str, Any]], pad: str) -> str:
    """Rows as items of a YAML list."""
    import yaml

    text = yaml.dump(data, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), sort_keys=False, allow_unicode=True)
    return "".join(f"{pad}{line}\n" for line in text.removesuffix("\n").split("\n"))


def _json(r: dict[str, Any], pad: str) -> str:
    text = json.dumps(r, ensure_ascii=False, indent=2).replace("\n", f"\n{pad}  ")
    return f"{pad}  {text}"


def _list(data: Iterator[dict[str, Any]], kind: str, out: IO[str], indent: int = 0) -> int:
    """A JSON or YAML list, row by row, and how many there were."""
    n, pad = 0, " " * indent
    if kind == "json":
        for r in data:
            out.write(f"{',' if n else '['}\n{_json(r, pad)}")
            n += 1
        out.write(f"\n{pad}]" if n else "[]")
        return n
    while some := list(itertools.islice(data, BATCH)):
        out.write(_yaml(some, pad))
        n += len(some)
    if not n:
        out.write(f"{pad}[]\n")
    return n


def _around(columns: list[str], kind: str) -> tuple[str, str]:
    """What goes before and after the list in a document of columns, data and count; the latter wants the number of rows."""
    if kind == "json":
        return '{\n  "columns": ' + json.dumps(columns, ensure_ascii=False, indent=2).replace("\n", "\n  ") + ',\n  "data": ', ',\n  "count": %d\n}'
    import yaml

    return yaml.safe_dump({"columns": columns}, sort_keys=False, allow_unicode=True) + "data:\n", "count: %d\n"


def _envelope(df: DataFrame, kind: str, out: IO[str]) -> None:
    """columns, data and count, as one document; rows are written as they come."""
    head, tail = _around(df.columns, kind)
    out.write(head)
    out.write(tail % _list(rows(df), kind, out, 2))


def parts(df: DataFrame, text: Callable[[list[list[Any]]], tuple[str, list[int]]], folder: str, *more: Column) -> Row:
    """Text files of the rows in a folder, made by many tasks. Returns n, the number of rows, and what ``more`` says of ``told``.

    ``text`` makes the text of some rows without the last line feed, and numbers, ``told``. However few tasks give the
    rows, stretches of PART rows each are dealt out, and each has a file.
    """
    at = "at"
    while at in df.columns:
        at += "_"
    spark = df.sparkSession
    dealt = df.withColumn(at, F.monotonically_increasing_id())
    part = F.expr(f"`{at}` div {PART}")
    dealt = dealt.repartition(3 * spark.sparkContext.defaultParallelism, part).sortWithinPartitions(at)

    def told(data: Iterator[Row]) -> Iterator[tuple]:
        for part, some in itertools.groupby(data, lambda r: r[-1] // PART):
            while batch := [[plain(v) for v in r[:-1]] for r in itertools.islice(some, BATCH)]:
                yield (*text(batch), len(batch), part)

    seen = Observation()
    made = spark.createDataFrame(dealt.rdd.mapPartitions(told), "value string, told array<long>, n long, part long", verifySchema=False)
    made.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *more).select("value", "part").write.partitionBy("part").text(folder)
    return seen.get


def part_files(files: Storage, folder: str) -> list[str]:
    return sorted(files.matching(f"{folder}/part=*/part-*"), key=lambda p: [int(x or 0) for x in re.findall(r"/part=(\d+)/part-\d+.*?(?:-c(\d+))?\.txt", p)[0]])


def _document(df: DataFrame, kind: str, path: str, indent: int = 0, around: tuple[str, str] = ("", ""), packed: bool = False) -> None:
    """A JSON or YAML list, with what goes around it: rows become text where they are, and the driver joins files."""
    spark, pad = df.sparkSession, " " * indent
    local = "://" not in path or path.startswith("file:")
    # of a plain path the folder is that of this program, which Spark's may not be
    path = f"file://{os.path.abspath(path.removeprefix('file://'))}" if local and not path.startswith("file:/") else path
    files, folder = Storage(spark, path), shared_beside(spark, path)
    if folder is None:  # no folder is shared with the tasks: rows come to the driver
        with _open(path.removeprefix("file://"), "gzip" if packed else None) as f:
            f.write(around[0])
            n = _list(rows(df), kind, f, indent)
            f.write(around[1] % n if around[1] else "")
        return
    made = Storage(spark, folder)
    columns = df.columns

    def text(some: list[list[Any]]) -> tuple[str, list[int]]:
        maps = [dict(zip(columns, r, strict=True)) for r in some]
        return (",\n".join(_json(r, pad) for r in maps) + "," if kind == "json" else _yaml(maps, pad).removesuffix("\n")), []

    try:
        n = parts(df, text, folder)["n"]
        head, tail = around[0], around[1] % n if around[1] else ""
        if kind == "json":
            head, tail = head + ("[\n" if n else "[]"), (f"\n{pad}]" if n else "") + tail
        elif not n:
            head += f"{pad}[]\n"
        files.join(part_files(made, folder), path, head, tail, 2 if kind == "json" else 0, packed, made)
    finally:
        made.delete(folder)


def _workbook(df: DataFrame, path: str) -> None:
    """Cells are made by the tasks and packed by the driver, row by row."""
    spark, columns = df.sparkSession, df.columns
    folder = shared_beside(spark, path)
    if folder is None:
        write_xlsx(path, columns, (list(r.values()) for r in rows(df)))
        return
    made = Storage(spark, folder)
    try:
        wide = [F.max(F.get("told", F.lit(i))).alias(f"w{i}") for i in range(len(columns))]
        told = parts(df, row_lines, folder, *wide)

        def lines() -> Iterator[bytes]:
            for part in part_files(made, folder):
                with made.on_disk(part) as name, open(name, "rb") as f:
                    yield from f

        pack(path, columns, [max(told[f"w{i}"] or 0, len(c)) for i, c in enumerate(columns)], lines(), told["n"])
    finally:
        made.delete(folder)


def show(df: DataFrame, out: IO[str]) -> int:
    """A boxed table and its number of rows. Rows come one by one, twice, as all cells set a column's width."""
    df = df.persist()
    try:
        return _boxed(df, out)
    finally:
        df.unpersist()


def _boxed(df: DataFrame, out: IO[str]) -> int:
    cut = lambda s: s if len(s) <= CELL else s[: CELL - 3] + "..."
    cells = lambda: ([cut(("" if v is None else str(v)).replace("\n", " ")) for v in r.values()] for r in rows(df))
    head = [cut(c.replace("\n", " ")) for c in df.columns]
    wide, n = [len(c) for c in head], 0
    for r in cells():
        wide = [max(w, len(c)) for w, c in zip(wide, r, strict=True)]
        n += 1
    if not n:
        out.write("No results found.\n")
        return 0
    bar = "+" + "+".join("-" * (w + 2) for w in wide) + "+\n"
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)) + " |\n"
    out.write(bar + line(head) + bar)
    n = 0
    for r in cells():
        out.write(line(r))
        n += 1
    out.write(bar + f"({n} rows)\n")
    return n


def write_rows(df: DataFrame, path: str, config: TableConfig, compressed: bool = False) -> None:
    """A table in its own format, as its configuration says: a folder, or one file for JSON arrays and YAML lists."""
    kind = config.format
    if kind in ("json", "yaml"):
        _document(df, kind, path)
        return
    writer = df.write.option("compression", "gzip") if compressed else df.write
    if kind in ("csv", "tsv"):
        _delimited(writer, config.delimiter, config.has_header, config.quote).csv(path)
    elif kind == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    else:
        df.write.parquet(path)


def _delimited(writer, sep: str, header: bool = True, quote: str = '"'):
    return writer.option("header", header).option("sep", sep).option("quote", quote).option("escape", quote).option("emptyValue", "").option("nullValue", "")


def save(df: DataFrame, path: str | None, fmt: str = "table", *, single: bool = True, compression: str | None = None, delimiter: str = ",") -> None:
    """Write a result to a path, or to standard output.

    CSV, TSV, JSONL and Parquet are written by Spark: to one file, or with ``single=False`` to a folder with a file for
    each partition, which is the way for large results. The other formats are one document each: of JSON, YAML and Excel
    the tasks make the text of the rows, in a folder that they share, and the driver joins the files.
    """
    fmt = canonical(fmt)
    if fmt == "parquet" and compression and compression not in CODECS:
        raise ValueError(f"unknown codec {compression}; known are {', '.join(CODECS)}")
    if path is None:
        if fmt in ("excel", "parquet"):
            raise ValueError(f"{fmt} needs a path")
        _print(df, sys.stdout, fmt, delimiter)
        return
    if fmt == "excel":
        _workbook(df, path)
    elif fmt in ("json", "yaml"):
        head, tail = _around(df.columns, fmt)
        _document(df, fmt, path, 2, (head, tail + "\n" if fmt == "json" else tail), _packed(path, compression))
    elif fmt == "table":
        if "://" in path and not path.startswith("file:"):
            text = io.StringIO()
            _print(df, text, fmt, delimiter)
            raw = text.getvalue().encode()
            Storage(df.sparkSession, path).write(path, gzip.compress(raw) if _packed(path, compression) else raw)
            return
        with _open(path.removeprefix("file://"), compression) as f:
            _print(df, f, fmt, delimiter)
    else:
        _save_rows(df, path, fmt, single, compression, "\t" if fmt == "tsv" else delimiter)


def _packed(path: str, compression: str | None) -> bool:
    return compression == "gzip" or path.endswith(".gz")


def _open(path: str, compression: str | None) -> IO[str]:
    if _packed(path, compression):
        return gzip.open(path, "wt", encoding="utf-8")
    return open(path, "w", encoding="utf-8")


def _print(df: DataFrame, out: IO[str], fmt: str, delimiter: str) -> None:
    if fmt == "table":
        show(df, out)
    elif fmt == "json":
        _envelope(df, fmt, out)
        out.write("\n")
    elif fmt == "jsonl":
        for r in rows(df):
            out.write(json.dumps(r, ensure_ascii=False) + "\n")
    elif fmt == "yaml":
        _envelope(df, fmt, out)
    else:
        import csv

        w = csv.writer(out, delimiter="\t" if fmt == "tsv" else delimiter, lineterminator="\n")
        w.writerow(df.columns)
        w.writerows(["" if v is None else v for v in r.values()] for r in rows(df))


def _save_rows(df: DataFrame, path: str, fmt: str, single: bool, compression: str | None, sep: str) -> None:
    mark = uuid.uuid4().hex[:8]
    beside = hidden(path, mark, ".new") if single else path
    out = df.coalesce(1) if single else df
    if not out.isStreaming and fmt in ("csv", "tsv"):
        out = out.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct", "binary") else F.col(f"`{f.name}`") for f in out.schema])
    writer = out.write.mode("overwrite")
    packed = compression or ("gzip" if path.endswith(".gz") else None)
    if packed:
        writer = writer.option("compression", packed)
    if fmt in ("csv", "tsv"):
        _delimited(writer, sep).csv(beside)
    elif fmt == "jsonl":
        writer.option("ignoreNullFields", False).json(beside)
    else:
        writer.parquet(beside)
    if single:
        files = Storage(df.sparkSession, path)
        (part,) = files.matching(f"{beside}/part-*")
        files.put_in_place(part, path, hidden(path, mark, ".old"))
        files.delete(beside)
