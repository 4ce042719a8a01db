"""Table configurations: what a file holds and how it is read, kept as YAML or JSON files."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

#: Column types by name, and by the numbers that older configurations use.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "decimal": T.DoubleType(), "bool": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(),
}
NUMBERED = ("string", "int", "float", "decimal", "bool")
FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".yaml": "yaml", ".yml": "yaml",
    ".parquet": "parquet", ".ini": "ini", ".txt": "csv",
}
#: Names that other versions of a setting went by.
OLD_NAMES = {"quote_char": "quote", "escape_char": "escape", "allow_quoted_newlines": "multi_line", "skip_empty": "skip_empty_lines"}


class ConfigError(ValueError):
    """A table configuration that cannot be used."""


@dataclass
class Column:
    name: str
    type: str = "string"
    index: int = 0
    required: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.type, int) and not isinstance(self.type, bool):
            if not 0 <= self.type < len(NUMBERED):
                raise ConfigError(f"column {self.name}: no type has the number {self.type}")
            self.type = NUMBERED[self.type]
        self.type = str(self.type).lower()
        if self.type not in TYPES:
            raise ConfigError(f"column {self.name}: unknown type {self.type}")


@dataclass
class TableConfig:
    name: str
    file_path: str
    format: str = ""
    delimiter: str = ""
    has_header: bool = True
    columns: list[Column] = field(default_factory=list)
    quote: str = '"'
    escape: str = ""
    max_columns: int = 0
    trim_spaces: bool = False
    allow_quoted: bool = True
    strict_quotes: bool = False
    skip_empty_lines: bool = True
    multi_line: bool = False
    all_strings: bool = False
    infer_share: float = 1.0
    parallel_reading: bool = True
    worker_threads: int = 0
    chunk_size: int = 0
    buffer_size: int = 0

    def __post_init__(self) -> None:
        self.columns = [c if isinstance(c, Column) else Column(**c) for c in self.columns or ()]
        self.columns.sort(key=lambda c: c.index)
        self.format = (self.format or format_of(self.file_path)).lower()
        if self.format not in {*FORMATS.values()}:
            raise ConfigError(f"{self.name}: unknown format {self.format}")
        if not self.delimiter:
            self.delimiter = "\t" if self.format == "tsv" else ","

    def schema(self) -> T.StructType | None:
        """The declared columns, if there are any."""
        return T.StructType([T.StructField(c.name, TYPES[c.type], not c.required) for c in self.columns]) or None if self.columns else None


def format_of(path: str) -> str:
    """The format that a path's extension tells; that of the inner one if it ends in .gz; CSV if it tells none."""
    inner = path[:-3] if path.lower().endswith(".gz") else path
    return FORMATS.get(os.path.splitext(inner.rstrip("/"))[1].lower(), "csv")


def from_dict(told: dict[str, Any]) -> TableConfig:
    if not isinstance(told, dict) or not told.get("name") or not told.get("file_path"):
        raise ConfigError("a table configuration needs a name and a file_path")
    told = {OLD_NAMES.get(k, k): v for k, v in told.items()}
    known = {f.name for f in dataclasses.fields(TableConfig)}
    if unknown := sorted(set(told) - known):
        raise ConfigError(f"{told['name']}: unknown settings {', '.join(unknown)}")
    return TableConfig(**told)


def load(path: str) -> TableConfig:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        told = json.loads(text)
    else:
        import yaml

        told = yaml.safe_load(text)
    return from_dict(told)


def save(config: TableConfig, path: str) -> None:
    told = {k: v for k, v in dataclasses.asdict(config).items() if v not in ("", 0, [], None)}
    if path.endswith(".json"):
        text = json.dumps(told, indent=2) + "\n"
    else:
        import yaml

        text = yaml.safe_dump(told, sort_keys=False, allow_unicode=True)
    Path(path).write_text(text, encoding="utf-8")


def load_dir(folder: str) -> tuple[dict[str, TableConfig], dict[str, str]]:
    """All configurations below a folder by table name, and what is wrong with files that can't be used."""
    found: dict[str, TableConfig] = {}
    wrong: dict[str, str] = {}
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml", ".json")):
        try:
            config = load(str(path))
            found[config.name] = config
        except Exception as e:  # each file is told about by itself
            wrong[str(path)] = f"{type(e).__name__}: {e}"
    return found, wrong


def validate(config: TableConfig) -> list[str]:
    """What is wrong with a configuration; nothing if it can be used."""
    faults = []
    if "://" not in config.file_path and not os.path.exists(config.file_path):
        faults.append(f"{config.file_path} does not exist")
    if len(config.delimiter) != 1:
        faults.append("the delimiter must be one character")
    if len({c.name.lower() for c in config.columns}) < len(config.columns):
        faults.append("column names repeat")
    if not 0 < config.infer_share <= 1:
        faults.append("infer_share is no share of the rows")
    if config.max_columns < 0:
        faults.append("max_columns is negative")
    return faults
