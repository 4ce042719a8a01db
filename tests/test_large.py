"""Documents and workbooks of many rows: rows become text in tasks, files are cut for many tasks, the driver only joins."""

import gzip
import json
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from filequarry import Engine, TableConfig, sinks
from filequarry.sinks import xlsx


def yaml_rows(spark, path):
    return [r.asDict() for r in Engine(spark).register("y", str(path), format="yaml").collect()]


def test_yaml_list_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "y.yaml").write_text("".join(f"- k: {i}\n  name: 'x{i}: \"y\"'\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = Engine(spark).register("y", str(tmp_path / "y.yaml"))
        assert df.dtypes == [("k", "bigint"), ("name", "string")]
        assert df.groupBy(F.spark_partition_id()).count().count() > 3
        assert [tuple(r) for r in df.orderBy("k").collect()] == [(i, f'x{i}: "y"') for i in range(20000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


ODD = {
    "begun": "# told\n---\n- a: 1\n- a: 2\n...\n",
    "alias": "- &x {a: 1}\n" + "- {a: 2}\n" * 600 + "- *x\n",
    "merged": "- &x {a: 1}\n" + "- {b: 2}\n" * 600 + "- {<<: *x, b: 3}\n",
    "quoted": '- {a: "p\n- q"}\n- {a: r}\n',
    "flow": "[{a: 1},\n {a: 2}]\n",
    "map": "data:\n- a: 1\n- a: 2\n",
    "dashes": "-\n  a: 1\n-   a: 2\n- a: 3\n-\ta: 4\n",
    "block": "- a: |\n    x\n\n    - y\n- a: >-\n   - z\n",
    "mixed": "- 1\n- [a]\n- a: x\n-\n- null\n",
    "breaks": "- a: 1\r\n- a: 2\r\n",
    "blank": "\n\n- a: 1\n\n# no\n- a: 2",
    "nothing": "",
    "remarks": "# no\n",
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_odd_yaml_is_read_as_a_whole_parse_does(spark, tmp_path, name):
    path = tmp_path / "y.yaml"
    path.write_bytes(ODD[name].encode())
    try:
        told = yaml.safe_load(ODD[name])
    except yaml.YAMLError:
        with pytest.raises(Exception, match="(?i)yaml|scanner|parser"):
            yaml_rows(spark, path)
        return
    want = [r for r in told if isinstance(r, dict)] if isinstance(told, list) else []
    keys = list(dict.fromkeys(k for r in want for k in r))
    got = yaml_rows(spark, path)
    assert sorted(map(str, got)) == sorted(str({k: r.get(k) for k in keys}) for r in want)


def test_two_yaml_documents_fail(spark, tmp_path):
    for i, text in enumerate(("- a: 1\n---\n- a: 2\n", "- a: 1\n" * 600 + "...\n- a: 2\n")):
        (tmp_path / f"{i}.yaml").write_text(text)
        with pytest.raises(Exception):
            yaml_rows(spark, tmp_path / f"{i}.yaml")


def test_a_file_that_cannot_be_cut_beside_others(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "1.yaml").write_text(ODD["alias"])
    (tmp_path / "y" / "2.yaml").write_text("- {a: 7, c: z}\n")
    rows = yaml_rows(spark, tmp_path / "y")
    assert len(rows) == 603 and sum(r["a"] for r in rows) == 1 + 1200 + 1 + 7 and [r["c"] for r in rows if r["c"]] == ["z"]


@pytest.fixture
def no_rows_at_the_driver(monkeypatch):
    def never(df):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(sinks, "rows", never)


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(70000).select("id", F.expr("if(id % 7 = 0, null, concat('a: \"', id, '\"\n- b'))").alias("s"), (F.col("id") / 4).alias("d")).orderBy(F.desc("id"))


def want_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("fmt, read", [("json", json.loads), ("yaml", lambda t: yaml.load(t, Loader=yaml.CSafeLoader))])
def test_documents_keep_their_order(spark, many, tmp_path, no_rows_at_the_driver, fmt, read):
    sinks.save(many, str(tmp_path / "d"), fmt)
    want = want_of(many)
    assert read((tmp_path / "d").read_text()) == {"columns": ["id", "s", "d"], "data": want, "count": 70000}
    sinks.write_rows(many.limit(10), str(tmp_path / "l"), TableConfig(name="l", file_path=str(tmp_path / f"l.{fmt}")))
    assert read((tmp_path / "l").read_text()) == want[:10]
    sinks.save(many.limit(0), f"file://{tmp_path}/e.gz", fmt)
    assert read(gzip.open(tmp_path / "e.gz", "rt").read()) == {"columns": ["id", "s", "d"], "data": [], "count": 0}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d", "e.gz", "l"]


def test_document_read_back_by_many_tasks(spark, many, tmp_path, no_rows_at_the_driver):
    from filequarry.sources.textual import read_document

    for name, df in (("d", many), ("e", many.limit(0)), ("o", many.limit(1))):
        sinks.save(df, str(tmp_path / name), "yaml")
        assert sorted(read_document(spark, str(tmp_path / name), df.schema).collect()) == sorted(df.collect())


def test_workbook_of_many_rows_and_sheets(spark, many, tmp_path, monkeypatch, no_rows_at_the_driver):
    want = [["id", "s", "d"]] + [[float(r.id), r.s, r.d] for r in many.collect()]
    sinks.save(many, str(tmp_path / "r.xlsx"), "excel")
    assert xlsx.read_xlsx(str(tmp_path / "r.xlsx")) == want
    monkeypatch.setattr(xlsx, "MOST_ROWS", 30000)
    sinks.save(many, str(tmp_path / "s.xlsx"), "excel")
    assert xlsx.read_xlsx(str(tmp_path / "s.xlsx")) == want
    with zipfile.ZipFile(tmp_path / "s.xlsx") as z:
        assert [n for n in z.namelist() if "sheet" in n and "work" in n.split("/")[1]] == [f"xl/worksheets/sheet{i}.xml" for i in (1, 2, 3)]
        assert z.read("xl/workbook.xml").count(b"<sheet ") == 3
    sinks.save(many.limit(0), str(tmp_path / "e.xlsx"), "excel")
    assert xlsx.read_xlsx(str(tmp_path / "e.xlsx")) == want[:1]


def test_stream_windows_sort_no_table_in_one_task(spark, monkeypatch):
    from filequarry.operators import reference_queries

    def never(*columns):
        raise AssertionError("a window without partitions")

    monkeypatch.setattr(reference_queries.Window, "orderBy", never)
    assert reference_queries.stream_windows(spark, "/root/testdata/sf0.001").count() > 0
