"""Lexer and dialect, changes of tables, configurations, sinks, command line and entry."""

import io
import json
import os
import subprocess
import sys

import pytest
import yaml
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from filequarry import Engine, TableConfig, catalog, cli, sinks
from filequarry.plans import dialect, lexer, statements
from filequarry.sinks.xlsx import read_xlsx
from filequarry.storage import Storage

SCHEMAS = {"t": T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType())])}


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT a FROM t LIMIT 2,3", "SELECT a FROM t LIMIT 3 OFFSET 2"),
        ("SELECT 'LIMIT 2,3' FROM t", "SELECT 'LIMIT 2,3' FROM t"),
        ("SELECT a FROM t WHERE s IS NULL", "SELECT a FROM t WHERE (s IS NULL OR s = '')"),
        ("SELECT a FROM t WHERE x.s IS NOT NULL", "SELECT a FROM t WHERE (x.s IS NOT NULL AND x.s != '')"),
        ("SELECT a FROM t WHERE n IS NULL", "SELECT a FROM t WHERE n IS NULL"),
        ("SELECT a FROM t WHERE s > 5", "SELECT a FROM t WHERE try_cast (s AS DOUBLE) > 5"),
        ("SELECT a FROM t WHERE -5 < n", "SELECT a FROM t WHERE - 5 < n"),
        ("SELECT n / 2 * 3 FROM t", "SELECT try_divide (n, 2) * 3 FROM t"),
        ("SELECT a FROM x OUTER JOIN y ON x.a = y.a", "SELECT a FROM x FULL OUTER JOIN y ON x.a = y.a"),
        ("SELECT a FROM x LEFT OUTER JOIN y ON x.a = y.a", "SELECT a FROM x LEFT OUTER JOIN y ON x.a = y.a"),
        ("SELECT n, s FROM t GROUP BY n", "SELECT n, first(s) AS s FROM t GROUP BY n"),
        ("SELECT a /* LIKE */ FROM t WHERE s LIKE 'x' -- LIKE", "SELECT a FROM t WHERE s ILIKE 'x'"),
    ],
)
def test_rewrites(sql, want):
    squeeze = lambda s: s.replace(" (", "(")
    assert squeeze(dialect.to_spark(sql, SCHEMAS)) == squeeze(want)


@given(st.lists(st.sampled_from(["a", "'b c'", '"d"', "`e f`", "1.5", "(", ")", ",", "<=", "--x\n", "''", "é", "LIKE"]), max_size=30))
def test_lexing_again_changes_nothing(parts):
    tokens = lexer.lex(" ".join(parts))
    assert [t.text for t in lexer.lex(lexer.text(tokens))] == [t.text for t in tokens]


@pytest.mark.parametrize("sql", ["SELECT 'a", "SELECT (a FROM t", "SELECT MOD(1) FROM t", "SELECT a /"])
def test_what_cannot_be_read(sql):
    with pytest.raises(lexer.DialectError):
        dialect.to_spark(sql, {})


@pytest.mark.parametrize("sql", ["UPDATE t SET a = 1", "DELETE FROM t", "INSERT INTO t VALUES (1)", "INSERT INTO t (a, b) VALUES (1)", "UPDATE t a = 1 WHERE b", "INSERT INTO t (a) VALUES (1) x"])
def test_changes_that_are_refused(sql):
    with pytest.raises(lexer.DialectError):
        statements.parse(sql)


# ---- changes


@pytest.fixture(params=["csv", "jsonl", "parquet", "json", "tsv"])
def table(request, spark, tmp_path):
    path = str(tmp_path / f"t.{request.param}")
    df = spark.createDataFrame([(1, "a, b", None), (2, 'q"x', 2.5), (3, "", 3.5)], "id long, name string, v double")
    if request.param == "json":
        sinks.write_rows(df, path, TableConfig(name="t", file_path=path))
    else:
        sinks.save(df, path, request.param)
    e = Engine(spark)
    e.register("t", path)
    return e, path


def content(e):
    return sorted((r.id, r.name or "", r.v) for r in e.sql("SELECT id, name, v FROM t").collect())


def test_changes(table):
    e, path = table
    n = lambda sql: e.sql(sql).collect()[0].rows_affected
    assert n("INSERT INTO t (id, name) VALUES (4, 'it''s'), (5, NULL)") == 2
    assert n("UPDATE t SET v = id * 2, name = CONCAT(name, '!') WHERE id > 1 AND id < 4") == 2
    assert content(e) == [(1, "a, b", None), (2, 'q"x!', 4.0), (3, "!", 6.0), (4, "it's", None), (5, "", None)]
    assert n("UPDATE t SET id = v, v = id WHERE id = 2") == 1  # both see the old row
    assert (4, 'q"x!', 2.0) in content(e)
    assert n("DELETE FROM t WHERE v IS NULL AND id = 1") == 1
    assert n("DELETE FROM t WHERE v > 100") == 0
    assert n("UPSERT INTO t (id, name) VALUES (3, 'three'), (9, 'nine')") == 2
    assert [r[:2] for r in content(e)] == [(3, "three"), (4, "it's"), (4, 'q"x!'), (5, ""), (9, "nine")]
    assert (3, "three", 6.0) in content(e)
    assert n("DELETE FROM t WHERE 1 = 1") == 5 and content(e) == []
    name = os.path.basename(path)
    assert sorted(os.listdir(os.path.dirname(path))) == [f".{name}.lock", name]


def test_a_change_that_fails_leaves_the_old_table(table, monkeypatch):
    e, path = table
    real = Storage.rename

    def broken(self, old, new):
        if new == path and not old.endswith(".old"):
            raise OSError("no")
        real(self, old, new)

    before = content(e)
    monkeypatch.setattr(Storage, "rename", broken)
    with pytest.raises(OSError):
        e.sql("DELETE FROM t WHERE id = 1").collect()
    monkeypatch.undo()
    e.register("t", path)
    assert content(e) == before
    name = os.path.basename(path)
    assert sorted(os.listdir(os.path.dirname(path))) == [f".{name}.lock", name]


def test_the_lock_file_elsewhere_has_one_holder(spark, tmp_path):
    files, lock = Storage(spark, str(tmp_path)), f"{tmp_path}/.t.lock"
    with files.locked(lock):
        with pytest.raises(TimeoutError), files.locked(lock, 0.2):
            pass
        assert files.exists(lock)
    assert not files.exists(lock)


def test_lines_that_equal_the_header_are_rows(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.csv").write_text("a:b\n1:x:y\na:b\n\n2:'z'\n")
    e = Engine(spark)
    e.register("t", str(tmp_path), format="csv", delimiter=":", quote="'", max_columns=2)
    rows = sorted(tuple(r) for r in e.sql("SELECT a, b FROM t").collect())
    assert rows == sorted([("1", "x:y"), ("a", "b"), ("2", "z")] * 2)
    e.register("u", str(tmp_path), format="csv", delimiter=":", quote="'", max_columns=2, skip_empty_lines=False)
    rows = sorted(tuple(x or "" for x in r) for r in e.sql("SELECT a, b FROM u").collect())
    assert rows == sorted([("1", "x:y"), ("a", "b"), ("2", "z"), ("", "")] * 2)


def test_yaml_and_ini_folders(spark, tmp_path):
    import gzip

    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "1.yaml").write_text("- {a: 1, b: x}\n- {b: y, c: 2020-01-02}\n")
    with gzip.open(tmp_path / "y" / "2.yaml.gz", "wt") as f:
        f.write("- {a: 2.5, d: true}\n")
    e = Engine(spark)
    df = e.register("y", str(tmp_path / "y"), format="yaml")
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "date"), ("d", "boolean")]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(["(1.0, 'x', None, None)", "(None, 'y', datetime.date(2020, 1, 2), None)", "(2.5, None, None, True)"])
    (tmp_path / "i.ini").write_text("[s]\nk = 'v'\n; no\nx=1\n")
    assert [tuple(r) for r in e.register("i", f"file://{tmp_path}/i.ini", format="ini").collect()] == [("s", "k", "v", 2), ("s", "x", "1", 4)]


def test_insert_without_a_last_newline(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n1,a")
    e = Engine(spark)
    e.register("t", str(tmp_path / "t.csv"))
    e.sql("INSERT INTO t (id, name) VALUES (2, NULL)")
    assert (tmp_path / "t.csv").read_text().splitlines() == ["id,name", "1,a", "2,"]
    with pytest.raises(lexer.DialectError):
        e.sql("INSERT INTO t (nope) VALUES (1)")


# ---- configurations


def test_configurations(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "data.csv").write_text("a\n1\n")
    c = TableConfig(name="x", file_path=str(tmp_path / "data.csv"), columns=[{"name": "b", "type": "float", "index": 1}, {"name": "a", "type": 1, "index": 0}])
    assert [(x.name, x.type) for x in c.columns] == [("a", "int"), ("b", "float")]
    for path in (tmp_path / "x.yaml", tmp_path / "d" / "x.json"):
        catalog.save(c, str(path))
        assert catalog.load(str(path)) == c
    (tmp_path / "bad.yaml").write_text("name: y\nfile_path: z\ncolour: red\n")
    found, wrong = catalog.load_dir(str(tmp_path))
    assert list(found) == ["x"] and len(wrong) == 1
    assert catalog.from_dict({"name": "n", "file_path": "f.csv", "quote_char": "'"}).quote == "'"
    assert catalog.validate(c) == [] and catalog.validate(TableConfig(name="n", file_path="/none.csv", delimiter="ab"))
    with pytest.raises(catalog.ConfigError):
        catalog.Column("a", "colour")


@pytest.mark.parametrize("path, want", [("a.csv", "csv"), ("a.TSV", "tsv"), ("a.json.gz", "json"), ("a.jsonl", "jsonl"), ("a.yml", "yaml"), ("a.parquet", "parquet"), ("a.ini", "ini"), ("a", "csv")])
def test_formats_by_extension(path, want):
    assert catalog.format_of(path) == want


# ---- sinks


@pytest.fixture(scope="module")
def result(spark):
    return spark.sql("SELECT * FROM VALUES (1, 'a,b', 1.5D, DATE'2024-01-02', true), (2, NULL, NULL, NULL, NULL), (3, 'x\"y', -2D, NULL, false) AS t(id, s, d, day, ok)").coalesce(1)


def test_documents(result, tmp_path):
    for fmt, read in (("json", json.loads), ("yaml", yaml.safe_load)):
        sinks.save(result, str(tmp_path / fmt), fmt)
        told = read((tmp_path / fmt).read_text())
        assert told["columns"] == ["id", "s", "d", "day", "ok"] and told["count"] == 3
        assert told["data"][0] == {"id": 1, "s": "a,b", "d": 1.5, "day": "2024-01-02", "ok": True} and told["data"][1]["s"] is None


def test_row_formats(result, spark, tmp_path):
    sinks.save(result, str(tmp_path / "r.csv"), "csv")
    assert (tmp_path / "r.csv").read_text().splitlines() == ["id,s,d,day,ok", '1,"a,b",1.5,2024-01-02,true', "2,,,,", '3,"x""y",-2.0,,false']
    sinks.save(result, str(tmp_path / "r.jsonl"), "ndjson")
    assert json.loads((tmp_path / "r.jsonl").read_text().splitlines()[1]) == {"id": 2, "s": None, "d": None, "day": None, "ok": None}
    for codec in sinks.CODECS:
        sinks.save(result, str(tmp_path / f"{codec}.parquet"), "parquet", compression=codec)
        assert spark.read.parquet(str(tmp_path / f"{codec}.parquet")).collect() == result.collect()
    sinks.save(result, str(tmp_path / "many"), "csv", single=False)
    assert os.path.isdir(tmp_path / "many")
    sinks.save(result, str(tmp_path / "r.csv.gz"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv.gz")).count() == 3
    with pytest.raises(ValueError):
        sinks.save(result, str(tmp_path / "x"), "parquet", compression="zip")
    with pytest.raises(ValueError):
        sinks.save(result, None, "word")


def test_workbook(result, tmp_path):
    sinks.save(result, str(tmp_path / "r.xlsx"), "xlsx")
    assert read_xlsx(str(tmp_path / "r.xlsx")) == [["id", "s", "d", "day", "ok"], [1.0, "a,b", 1.5, "2024-01-02", True], [2.0, None, None, None, None], [3.0, 'x"y', -2.0, None, False]]


def test_boxes(result, spark):
    out = io.StringIO()
    assert sinks.show(result.select("id", "s"), out) == 3
    assert out.getvalue().splitlines()[0] == "+----+-----+" and out.getvalue().endswith("(3 rows)\n")
    out = io.StringIO()
    sinks.show(spark.sql("SELECT repeat('x', 80) AS s"), out)
    assert "x" * 47 + "..." in out.getvalue() and "x" * 48 not in out.getvalue()
    out = io.StringIO()
    sinks.show(result.limit(0), out)
    assert out.getvalue() == "No results found.\n"


# ---- command line


@pytest.fixture
def files(tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n1,a\n2,b\n")
    return tmp_path


def test_query_command(spark, files, capsys):
    run = lambda *a: cli.main(["query", *a])
    t = f"t:{files}/t.csv"
    assert run("SELECT name FROM t WHERE id > 1", "-f", t) == 0
    assert "| b    |" in capsys.readouterr().out
    assert run("SELECT name FROM t", "-f", t, "-o", "jsonl", "-e", f"{files}/o.jsonl") == 0
    assert len((files / "o.jsonl").read_text().splitlines()) == 2
    assert run("SELECT name FROM t ORDER BY id", "-f", t, "-o", "csv") == 0
    assert capsys.readouterr().out == "name\na\nb\n"
    assert run("SELECT nope FROM t", "-f", t) == cli.QUERY
    assert run("SELEC name FROM t", "-f", t) == cli.QUERY
    assert run("SELECT name FROM t", "-f", "t:/none.csv") == cli.MISSING
    assert run("SELECT name FROM t") == cli.USAGE
    assert run("SELECT name FROM t", "-f", t, "-o", "word") == cli.USAGE
    assert run("SELECT id FROM t", "-f", t, "-t", "0.000001") in (cli.LATE, 0)


def test_given_options_go_first(spark, files, capsys):
    (files / "c").mkdir()
    (files / "p.csv").write_text("a|b\n1|2\n")
    (files / "c" / "p.yaml").write_text(f"name: p\nfile_path: {files}/p.csv\ndelimiter: '|'\n")
    assert cli.main(["query", "SELECT b FROM p", "-c", f"{files}/c", "-o", "csv"]) == 0
    assert capsys.readouterr().out == "b\n2\n"
    assert cli.main(["query", "SELECT * FROM p", "-c", f"{files}/c", "-o", "csv", "--delimiter", ","]) == 0
    assert capsys.readouterr().out == "a|b\n1|2\n"


def test_config_command(spark, files, capsys):
    assert cli.main(["config", "create", "t", f"{files}/t.csv", "--to", f"{files}/t.yaml"]) == 0
    assert "Format: csv" in capsys.readouterr().out
    assert [(c.name, c.type) for c in catalog.load(f"{files}/t.yaml").columns] == [("id", "int"), ("name", "string")]
    assert cli.main(["config", "list", str(files)]) == 0 and cli.main(["config", "validate", str(files)]) == 0
    (files / "bad.json").write_text("{}")
    assert cli.main(["config", "validate", str(files)]) == cli.USAGE
    assert cli.main(["version"]) == 0


def test_entry_without_the_llm_folders(tmp_path):
    """The entry imports, and lists the other queries, where that subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys\nsys.modules['filequarry.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\nassert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_follow(spark, tmp_path):
    from filequarry import Column
    from filequarry.streaming import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,name\n1,a\n")
    config = TableConfig(name="s", file_path=str(tmp_path / "in"), format="csv", columns=[Column("id", "int", 0), Column("name", "string", 1)])
    q = follow(spark, config).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("followed").collect()] == [(1, "a")]
    with pytest.raises(ValueError):
        follow(spark, TableConfig(name="s", file_path="x.yaml"), config.schema())
