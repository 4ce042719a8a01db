"""The capability floor: statements over small files in every format, with the values that standard SQL gives."""

import datetime
import gzip
import json

import pytest

from filequarry import Column, Engine

STAFF = [
    (1, "John", "Doe", 1, 75000, 5), (2, "Jane", "Smith", 2, 85000, 6), (3, "Bob", "Johnson", 1, 65000, 5), (4, "Alice", "Brown", 3, 95000, 7), (5, "Charlie", "Wilson", 1, 110000, None),
    (6, "Diana", "Garcia", 2, 120000, None), (7, "Eva", "Martinez", 3, 105000, None), (8, "Frank", "Lee", 1, 72000, 5), (9, "Grace", "Taylor", 2, 78000, 6), (10, "Henry", "Davis", 3, 88000, 7),
]
UNITS = [(1, "Engineering"), (2, "Marketing"), (3, "Sales"), (4, "HR")]
TASKS = [("Website Redesign", 1, "Completed"), ("Mobile App", 2, "In Progress  "), ("Marketing Campaign", 2, "Completed"), ("API Development", 1, "Planning"), ("Security Audit", 8, "Completed")]
GOODS = [("Laptop Pro", 1299.99), ("Wireless Mouse", 29.99), ("Office Chair", 299.99), ("Standing Desk", 599.99), ("Monitor 4K", 449.99)]
SALES = [(1, 2599.98), (2, 299.90), (3, 299.99), (4, 1349.97), (5, 599.99), (6, 1299.99)]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    csv = lambda head, rows, sep=",": "\n".join(sep.join("" if v is None else str(v) for v in r) for r in [head, *rows])
    (d / "employees.csv").write_text(csv(("employee_id", "first_name", "last_name", "department_id", "salary", "manager_id"), STAFF))
    (d / "departments.csv").write_text("department_id,department_name\n" + "\n".join(f'{a},"{b}"' for a, b in UNITS) + "\n")
    (d / "projects.tsv").write_text(csv(("project_name", "employee_id", "status"), TASKS, "\t"))
    (d / "products.json").write_text(json.dumps([{"name": a, "price": b} for a, b in GOODS], indent=1))
    (d / "sales.jsonl").write_text("\n".join(json.dumps({"sale_id": a, "amount": b}) for a, b in SALES) + "\nnot json\n")
    (d / "sites.csv").write_text('id:name:note:site\n1:Ann:"likes a: b":"https://ann.dev:8080"\n2:Bo:plain:http://bo.com:3000/x \n')
    (d / "logs.csv").write_text("a:b:c:d:e\nf:g\n")
    (d / "quotes.csv").write_text('id,name,note\n1,"Jane ""Q"" S","with, comma"\n\n2,Al,"two\nlines"\n')
    (d / "prices.yaml").write_text("- {name: a, price: 1.5, n: 1}\n- {name: b, price: 2, ok: true}\n- not a map\n")
    (d / "app.ini").write_text("; c\n[main]\nkey = \"v\"\n# c\n[other]\nk2=v=2\n")
    with gzip.open(d / "units.csv.gz", "wt") as f:
        f.write("department_id,department_name\n1,Engineering\n")
    e = Engine(spark)
    for name in ("employees.csv", "departments.csv", "projects.tsv", "products.json", "sales.jsonl", "prices.yaml", "app.ini", "units.csv.gz"):
        e.register(name.split(".")[0], str(d / name))
    e.register("sites", str(d / "sites.csv"), delimiter=":", max_columns=4)
    e.register("quotes", str(d / "quotes.csv"), multi_line=True)
    e.dir = d
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def ids(engine, where):
    return [r[0] for r in rows(engine, f"SELECT employee_id FROM employees WHERE {where} ORDER BY employee_id")]


@pytest.mark.parametrize(
    "where, want",
    [
        ("salary > 80000", [2, 4, 5, 6, 7, 10]), ("department_id = 1", [1, 3, 5, 8]), ("department_id = 1 AND salary > 70000", [1, 5, 8]),
        ("salary > 100000 OR department_id = 3", [4, 5, 6, 7, 10]), ("UPPER(first_name) = \"JOHN\"", [1]), ("first_name LIKE 'j%'", [1, 2]), ("first_name LIKE \"%e\"", [2, 4, 5, 9]),
        ("first_name LIKE '%an%'", [2, 6, 8]), ("first_name LIKE 'J_n%'", [2]), ("manager_id IS NULL", [5, 6, 7]), ("manager_id IS NOT NULL", [1, 2, 3, 4, 8, 9, 10]),
        ("department_id IN (1, 3)", [1, 3, 4, 5, 7, 8, 10]), ("department_id NOT IN (1,3)", [2, 6, 9]), ("LENGTH(first_name) > 4", [4, 5, 6, 8, 9, 10]), ("salary BETWEEN 70000 AND 80000", [1, 8, 9]),
        ("NOT (salary > 70000)", [3]), ("first_name != 'John' && salary<73000", [3, 8]), ("salary / (department_id - 1) > 80000", [2, 6]), ("last_name NOT LIKE '%o%' AND department_id = 2", [2, 6]),
    ],
)
def test_where(engine, where, want):
    assert ids(engine, where) == want


def test_projection(engine):
    assert engine.sql("SELECT * FROM employees").columns == ["employee_id", "first_name", "last_name", "department_id", "salary", "manager_id"]
    df = engine.sql("SELECT salary pay, first_name AS name, salary / 1000 AS k FROM employees WHERE salary > 100000 ORDER BY salary")
    assert df.columns == ["pay", "name", "k"] and [tuple(r) for r in df.collect()][0] == (105000, "Eva", 105.0)
    assert rows(engine, "SELECT e.*, 1 one FROM employees e WHERE e.employee_id = 1")[0][-1] == 1


def test_order_is_by_value(engine):
    assert [r[0] for r in rows(engine, "SELECT salary FROM employees ORDER BY salary")][::9] == [65000, 120000]
    assert rows(engine, "SELECT first_name FROM employees ORDER BY salary DESC LIMIT 3") == [("Diana",), ("Charlie",), ("Eva",)]
    assert rows(engine, "SELECT name FROM products ORDER BY price DESC LIMIT 1") == [("Laptop Pro",)]


@pytest.mark.parametrize("limit, want", [("2,3", [3, 4, 5]), ("3 OFFSET 2", [3, 4, 5]), ("8, 5", [9, 10]), ("7,3", [8, 9, 10]), ("20,3", []), ("50", list(range(1, 11)))])
def test_limits(engine, limit, want):
    assert [r[0] for r in rows(engine, f"SELECT employee_id FROM employees ORDER BY employee_id LIMIT {limit};")] == want


def test_joins(engine):
    base = "FROM employees e JOIN departments d ON e.department_id = d.department_id"
    assert len(engine.sql(f"SELECT e.*, d.department_name {base}").collect()) == 10
    assert rows(engine, f"SELECT UPPER(e.first_name) AS name, d.department_name {base} WHERE e.salary > 90000 AND d.department_name = 'Engineering' -- who\n") == [("CHARLIE", "Engineering")]
    assert rows(engine, f"SELECT e.first_name {base} ORDER BY e.salary DESC LIMIT 2") == [("Diana",), ("Charlie",)]
    lost = "SELECT d.department_name FROM departments d LEFT JOIN employees e ON d.department_id = e.department_id WHERE e.employee_id IS NULL"
    assert rows(engine, lost) == [("HR",)]
    assert len(rows(engine, "SELECT d.department_id FROM employees e OUTER JOIN departments d ON e.department_id = d.department_id")) == 11
    assert sorted(rows(engine, "SELECT e.first_name, p.project_name FROM employees e JOIN projects p ON e.employee_id = p.employee_id WHERE p.status = 'Completed'")) == [("Frank", "Security Audit"), ("Jane", "Marketing Campaign"), ("John", "Website Redesign")]
    pairs = "SELECT a.first_name, b.first_name AS boss FROM employees a JOIN employees b ON a.manager_id = b.employee_id WHERE b.first_name = 'Eva' ORDER BY 1"
    assert rows(engine, pairs) == [("Alice", "Eva"), ("Henry", "Eva")]


def test_groups(engine):
    assert sorted(rows(engine, "SELECT department_id FROM employees GROUP BY department_id")) == [(1,), (2,), (3,)]
    sql = "SELECT d.department_name, COUNT(*) AS n, ROUND(AVG(e.salary)) AS a, UPPER(MAX(e.first_name)) AS m FROM employees e JOIN departments d ON e.department_id = d.department_id GROUP BY d.department_name HAVING COUNT(*) > 2 ORDER BY n DESC, a"
    assert rows(engine, sql) == [("Engineering", 4, 80500.0, "JOHN"), ("Marketing", 3, 94333.0, "JANE"), ("Sales", 3, 96000.0, "HENRY")]
    assert rows(engine, "SELECT COUNT(*) AS n, SUM(salary) AS s, MIN(salary) AS low FROM employees") == [(10, 893000, 65000)]
    first = rows(engine, "SELECT department_id, first_name, COUNT(*) AS n FROM employees GROUP BY department_id")
    assert {(d, n) for d, _, n in first} == {(1, 4), (2, 3), (3, 3)} and all(any(s[1] == f and s[3] == d for s in STAFF) for d, f, _ in first)


def test_functions(engine):
    one = lambda e: rows(engine, f"SELECT {e} AS x FROM employees WHERE employee_id = 1")[0][0]
    want = {
        "UPPER(first_name)": "JOHN", "lower(last_name)": "doe", "LEN('日本é')": 3, "SUBSTR(first_name, 1, 3)": "Joh", "SUBSTRING('日本é', 2)": "本é", "SUBSTR('abc', 0, 2)": "", "SUBSTR('abc', 2, -1)": "",
        "TRIM('\\t a ')": "a", "LTRIM('  a ')": "a ", "RTRIM(' a  ')": " a", "CONCAT(first_name, ' ', last_name)": "John Doe", "CONCAT('a', NULL, 1)": "a1", "CONCAT()": "", "REPLACE('aXbX', 'X', '-')": "a-b-",
        "LEFT(first_name, 2)": "Jo", "RIGHT(first_name,2)": "hn", "LEFT('abc', -1)": "", "REVERSE('aé日')": "日éa", "REPEAT('ab', 3)": "ababab", "REPEAT('ab', -1)": "", "ABS(-100)": 100, "ROUND(-2.5)": -3, "ROUND(1234.567, 1)": 1234.6,
        "FLOOR(-1.5)": -2.0, "CEIL(85.1)": 86.0, "CEILING(-1.5)": -1.0, "MOD(-7, 3)": -1, "MOD(5, 0)": None, "MODULO(7, 4)": 3, "POWER(2, -1)": 0.5, "POW(9, 0.5)": 3.0, "SQRT(1000000)": 1000.0, "SQRT(-1)": None, "SIGN(-3.5)": -1,
        "DATE('2024-02-03 10:11:12')": "2024-02-03", "DATE('02/03/2024')": "2024-02-03", "DATE('soon')": "soon", "YEAR('2024-02-03')": 2024, "MONTH('2024-02-03')": 2, "DAY('2024-02-03T01:02:03Z')": 3, "YEAR('x')": None,
        "COALESCE(NULL, '', 'z')": "z", "COALESCE(manager_id, 'none')": "5", "IFNULL('', 'd')": "d", "ISNULL(NULL, 7)": 7, "1 / 0": None, "7 / 2": 3.5, "2 + 3 * 4": 14, "'it''s, (fine)'": "it's, (fine)", '"x y"': "x y", "UPPER(LEFT(REVERSE('abc'), 1))": "C",
    }
    for e, v in want.items():
        got = one(e)
        assert (float(got) if isinstance(v, (int, float)) and got is not None else got) == v, e
    now, today = rows(engine, "SELECT NOW() AS a, DATE() AS b FROM departments LIMIT 1")[0]
    assert datetime.datetime.strptime(now, "%Y-%m-%d %H:%M:%S") and datetime.date.fromisoformat(today)


def test_formats(engine, spark):
    assert rows(engine, "SELECT sale_id FROM sales WHERE amount > 1000 ORDER BY sale_id") == [(1,), (4,), (6,)]
    assert rows(engine, "SELECT id, site, note FROM sites ORDER BY id") == [("1", "https://ann.dev:8080", "likes a: b"), ("2", "http://bo.com:3000/x", "plain")]
    assert rows(engine, "SELECT name, note FROM quotes ORDER BY id") == [('Jane "Q" S', "with, comma"), ("Al", "two\nlines")]
    assert rows(engine, "SELECT name, price, n, ok FROM prices ORDER BY name") == [("a", 1.5, 1, None), ("b", 2.0, None, True)]
    assert rows(engine, "SELECT section, key, value, line FROM app ORDER BY line") == [("main", "key", "v", 3), ("other", "k2", "v=2", 6)]
    assert rows(engine, "SELECT department_name FROM units") == [("Engineering",)]
    assert rows(engine, "SELECT COUNT(*) AS n FROM projects WHERE TRIM(status) = 'In Progress'") == [(1,)]
    plain = Engine(spark).register("l", str(engine.dir / "logs.csv"), delimiter=":", max_columns=3, has_header=False, allow_quoted=False)
    assert sorted(map(tuple, plain.collect())) == [("a", "b", "c:d:e"), ("f", "g", None)]


def test_declared_types(engine, spark):
    columns = [Column("employee_id", "int", 0), Column("first_name", "string", 1), Column("last_name", "int", 2)]
    df = Engine(spark).register("e", str(engine.dir / "employees.csv"), columns=columns)
    assert df.dtypes == [("employee_id", "bigint"), ("first_name", "string"), ("last_name", "bigint")]
    assert {r.last_name for r in df.collect()} == {None}
    required = Engine(spark).register("e", str(engine.dir / "employees.csv"), columns=[Column("employee_id", "int", 0), Column("first_name", "int", 1, required=True)])
    assert required.count() == 0


def test_strings_that_are_numbers(engine, spark):
    e = Engine(spark)
    e.register("t", str(engine.dir / "employees.csv"), all_strings=True)
    assert {t for _, t in e.table("t").dtypes} == {"string"}
    assert len(rows(e, "SELECT first_name FROM t WHERE salary > 80000 AND manager_id IS NOT NULL")) == 3
    assert len(rows(e, "SELECT first_name FROM t WHERE manager_id IS NULL OR 100000 < salary")) == 3
    assert len(rows(e, "SELECT first_name FROM t WHERE salary BETWEEN 70000 AND 80000 OR department_id IN (3)")) == 6


def test_types_from_a_share_of_rows(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\n" + "\n".join(f"{i},{i / 2}" for i in range(2000)))
    df = Engine(spark).register("n", str(tmp_path / "n.csv"), infer_share=0.05)
    assert df.dtypes == [("a", "int"), ("b", "double")] and df.count() == 2000


def test_parquet_nulls(engine, spark, tmp_path):
    spark.createDataFrame([(1, None, 1.5), (None, "b", None), (3, "c", 2.5)], "a int, b string, c double").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    e = Engine(spark)
    e.register("p", str(tmp_path / "p.parquet"))
    assert sorted(map(str, rows(e, "SELECT a, b, c FROM p"))) == ["(1, None, 1.5)", "(3, 'c', 2.5)", "(None, 'b', None)"]


def test_pushdown(engine, spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id AS b", "id AS c").write.parquet(str(tmp_path / "p.parquet"))
    e = Engine(spark)
    e.register("p", str(tmp_path / "p.parquet"))
    plan = e.sql("SELECT a FROM p WHERE b > 5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,5)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan


def test_expressions_in_clauses(engine):
    got = rows(engine, "SELECT LENGTH(first_name) AS n, COUNT(*) AS c FROM employees GROUP BY LENGTH(first_name) ORDER BY LENGTH(first_name) DESC")
    assert got == [(7, 1), (5, 5), (4, 2), (3, 2)]
    assert rows(engine, "SELECT *, salary / 2 AS half FROM employees WHERE employee_id = 1")[0][-1] == 37500.0
    assert rows(engine, "SELECT first_name FROM employees ORDER BY salary / department_id DESC, LENGTH(last_name) LIMIT 1") == [("Charlie",)]
    assert rows(engine, "SELECT CASE WHEN salary > 100000 THEN 'high' ELSE 'low' END AS band, COUNT(*) AS n FROM employees GROUP BY 1 ORDER BY 1") == [("high", 3), ("low", 7)]
    assert rows(engine, "SELECT department_name FROM departments WHERE department_id IN (SELECT department_id FROM employees WHERE salary > 100000) ORDER BY 1") == [("Engineering",), ("Marketing",), ("Sales",)]


def test_group_keys_do_not_run_together(engine, spark):
    e = Engine(spark)
    e.register_frame("g", spark.createDataFrame([("x|", "y"), ("x", "|y"), ("x", "|y"), (None, "y")], "a string, b string"))
    assert sorted(map(str, rows(e, "SELECT a, b, COUNT(*) AS n FROM g GROUP BY a, b"))) == ["('x', '|y', 2)", "('x|', 'y', 1)", "(None, 'y', 1)"]


def test_long_lines_and_patterns(spark, tmp_path):
    long = "ab" * 100_000
    (tmp_path / "l.jsonl").write_text(json.dumps({"i": 1, "t": long}) + "\n" + json.dumps({"i": 2, "t": "b"}) + "\n")
    e = Engine(spark)
    e.register("l", str(tmp_path / "l.jsonl"))
    assert rows(e, "SELECT i, LENGTH(t) AS n FROM l ORDER BY i") == [(1, 200_000), (2, 1)]
    assert rows(e, "SELECT i FROM l WHERE LEFT(t, 60) LIKE '" + "%a" * 12 + "%c'") == []


def test_quotes_and_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id:name\n1:"a:b"\n2:"open\n3:c\n\n   \n4:"d ""e"""\n')
    strict = Engine(spark).register("q", str(tmp_path / "q.csv"), delimiter=":", strict_quotes=True)
    assert sorted(map(tuple, strict.collect())) == [("1", "a:b"), ("3", "c"), ("4", 'd "e"')]
    (tmp_path / "t.csv").write_text("id , name \n 1 , a b \n")
    assert [tuple(r) for r in Engine(spark).register("t", str(tmp_path / "t.csv"), trim_spaces=True).collect()] == [(1, "a b")]
    bare = Engine(spark).register("b", str(tmp_path / "q.csv"), delimiter=":", allow_quoted=False)
    assert bare.where("id = 3").first().name == "c" and bare.where("id = 2").first().name == '"open'


def test_formats_meet_in_one_query(engine):
    sql = """SELECT p.name, s.amount FROM sales s JOIN products p ON ROUND(s.amount, 2) = ROUND(p.price * 2, 2) OR s.amount = p.price
      JOIN prices y ON y.n = 1 ORDER BY s.sale_id"""
    assert rows(engine, sql) == [("Laptop Pro", 2599.98), ("Office Chair", 299.99), ("Standing Desk", 599.99), ("Laptop Pro", 1299.99)]
