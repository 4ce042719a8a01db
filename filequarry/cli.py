"""The command line: ``query``, ``config`` and ``version``."""

from __future__ import annotations

import argparse
import sys
import threading

from . import __version__, catalog, sinks
from .catalog import ConfigError, TableConfig
from .engine import Engine
from .plans.lexer import DialectError
from .session import session

#: Exit codes: wrong usage or configuration, a query that can't be read, a missing file, a failed run, a run out of time.
USAGE, QUERY, MISSING, FAILED, LATE = 2, 3, 4, 5, 124


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="filequarry", description="SQL over data files, on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a statement")
    q.add_argument("sql")
    q.add_argument("-f", "--file", action="append", default=[], metavar="NAME:PATH", help="a table and its file")
    q.add_argument("-c", "--config-dir", help="a folder of table configurations")
    q.add_argument("-o", "--output", default="table", help="format: " + ", ".join(sinks.FORMATS))
    q.add_argument("-e", "--export", metavar="PATH", help="write there rather than to standard output")
    q.add_argument("-t", "--timeout", type=float, default=300.0, help="seconds")
    q.add_argument("-v", "--verbose", action="store_true", help="tell the Spark SQL and the plan")
    q.add_argument("--folder", action="store_true", help="export a folder with a file for each partition")
    q.add_argument("--compression")
    # None means not given: a table's configuration goes before defaults, and what is given before both
    for name in ("delimiter", "quote", "escape"):
        q.add_argument(f"--{name}")
    q.add_argument("--max-columns", type=int)
    q.add_argument("--workers", type=int, help="local worker threads")
    for name in ("trim-spaces", "allow-quoted", "strict-quotes", "skip-empty", "multi-line", "all-strings", "parallel"):
        q.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    c = sub.add_parser("config", help="make, list and check table configurations")
    cs = c.add_subparsers(dest="action", required=True)
    make = cs.add_parser("create")
    make.add_argument("name")
    make.add_argument("path")
    make.add_argument("--to", help="the configuration's file; its extension tells its format")
    make.add_argument("--format", default="", help="the data's format, if the extension doesn't tell it")
    make.add_argument("--delimiter", default="")
    for action in ("list", "validate"):
        cs.add_parser(action).add_argument("folder")
    sub.add_parser("version")
    return p


def options(a: argparse.Namespace) -> dict:
    given = {k: getattr(a, k) for k in ("delimiter", "quote", "escape", "max_columns", "trim_spaces", "allow_quoted", "strict_quotes", "multi_line", "all_strings")}
    given |= {"skip_empty_lines": a.skip_empty, "parallel_reading": a.parallel, "worker_threads": a.workers}
    if given["delimiter"]:
        given["delimiter"] = given["delimiter"].replace("\\t", "\t")[0]
    return {k: v for k, v in given.items() if v is not None}


def inline(spec: str) -> TableConfig:
    name, colon, path = spec.partition(":")
    if not colon or not name or not path:
        raise ConfigError(f"--file takes NAME:PATH, not {spec}")
    return TableConfig(name=name, file_path=path)


def run_query(a: argparse.Namespace) -> int:
    import os

    fmt, given = sinks.canonical(a.output), options(a)
    configs: dict[str, TableConfig] = {}
    if a.config_dir:
        configs, wrong = catalog.load_dir(a.config_dir)
        for path, why in wrong.items():
            print(f"{path}: {why}", file=sys.stderr)
    configs |= {c.name: c for c in map(inline, a.file)}
    if not configs:
        raise ConfigError("no table: give --file or --config-dir")
    for c in configs.values():
        if "://" not in c.file_path and not os.path.exists(c.file_path):
            raise FileNotFoundError(c.file_path)
    spark = session(master=f"local[{a.workers}]" if a.workers else None, spark__ui__enabled="false", spark__ui__showConsoleProgress=str(bool(a.verbose or (a.export and sys.stderr.isatty()))).lower())
    spark.sparkContext.setLogLevel("OFF" if not a.verbose else "WARN")
    engine = Engine(spark)
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag("filequarry")

    clock = threading.Timer(a.timeout, stop)
    clock.daemon = True
    spark.addTag("filequarry")
    clock.start()
    try:
        for c in configs.values():
            engine.register_config(c, **given)
        df = engine.sql(a.sql)
        if a.verbose:
            print(df._jdf.queryExecution().toString(), file=sys.stderr)
        sinks.save(df, a.export, fmt, single=not a.folder, compression=a.compression)
    except Exception:
        if late.is_set():
            print(f"stopped after {a.timeout:g} seconds", file=sys.stderr)
            return LATE
        raise
    finally:
        clock.cancel()
    return 0


def run_config(a: argparse.Namespace) -> int:
    if a.action == "create":
        config = TableConfig(name=a.name, file_path=a.path, format=a.format, delimiter=a.delimiter)
        if faults := catalog.validate(config):
            raise ConfigError("; ".join(faults))
        engine = Engine(session(spark__ui__enabled="false"))
        names = {"bigint": "int", "int": "int", "double": "float", "boolean": "bool", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamp"}
        found = engine.register_config(config).dtypes
        config.columns = [catalog.Column(n, names.get(t, "string"), i) for i, (n, t) in enumerate(found)]
        to = a.to or f"{a.name}.yaml"
        catalog.save(config, to)
        print(f"Configuration: {to}\nFormat: {config.format}\nColumns: {', '.join(f'{c.name} {c.type}' for c in config.columns)}")
        return 0
    found, wrong = catalog.load_dir(a.folder)
    faults = {n: catalog.validate(c) for n, c in found.items()}
    for n, c in sorted(found.items()):
        if a.action == "list":
            print(f"{n}\t{c.format}\t{c.file_path}")
        else:
            print(f"{n}: {'; '.join(faults[n]) or 'valid'}")
    for path, why in wrong.items():
        print(f"{path}: {why}", file=sys.stderr)
    return USAGE if wrong or (a.action == "validate" and any(faults.values())) else 0


def main(argv: list[str] | None = None) -> int:
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    a = parser().parse_args(argv)
    try:
        if a.command == "version":
            print(f"filequarry {__version__}")
            return 0
        return run_query(a) if a.command == "query" else run_config(a)
    except FileNotFoundError as e:
        print(f"no such file: {e}", file=sys.stderr)
        return MISSING
    except ConfigError as e:
        print(e, file=sys.stderr)
        return USAGE
    except (DialectError, ParseException, AnalysisException) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return QUERY
    except ValueError as e:
        print(e, file=sys.stderr)
        return USAGE
    except PySparkException as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
