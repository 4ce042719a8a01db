"""The registered queries: dialect text or DataFrames over the driver's tables, and the SQL that checks each.

Where the two texts are equal only one is given. Sums and averages of doubles are rounded on both sides, since their last
bits depend on order. File queries write a table in a format and read it back, so the table's plain SELECT checks them.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import sinks
from ..catalog import Column, TableConfig
from ..engine import Engine
from ..plans import dialect
from ..sinks.xlsx import row_texts, rows_of
from ..sources.textual import read_document

FLAGSHIP = """SELECT r.r_name AS region, o.o_orderpriority AS priority, COUNT(*) AS n_items,
  ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE l.l_quantity > 10 AND r.r_name LIKE 'a%' GROUP BY r.r_name, o.o_orderpriority ORDER BY revenue DESC, region, priority LIMIT 10"""

#: name -> the dialect's text, or that and the oracle's.
TEXTS: dict[str, str | tuple[str, str]] = {
    "flagship": (FLAGSHIP, FLAGSHIP.replace("LIKE 'a%'", "ILIKE 'a%'")),
    # projection and expressions
    "select_star": "SELECT * FROM nation",
    "project_columns": "SELECT o_totalprice, o_orderkey, o_orderstatus FROM orders",
    "project_aliases": "SELECT o_orderkey AS id, o_totalprice price FROM orders",
    "project_expressions": "SELECT o_orderkey, o_totalprice * 2 AS twice, 'x y' AS word, 7 AS seven FROM orders",
    "arithmetic": ("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_quantity - 1.0 AS less, l_linenumber + 1 AS next, l_quantity / (l_linenumber - 1) AS per FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_quantity - 1.0 AS less, l_linenumber + 1 AS next, l_quantity / NULLIF(l_linenumber - 1, 0) AS per FROM lineitem"),
    # filters
    "filter_comparison": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderkey <> 7",
    "filter_and_or": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderpriority = '1-URGENT'",
    "filter_not": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0) AND c_mktsegment NOT IN ('BUILDING') AND c_nationkey NOT BETWEEN 3 AND 9",
    "filter_like": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment LIKE 'b%' OR c_name LIKE '%_7'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE 'b%' OR c_name ILIKE '%_7'"),
    "filter_not_like": ("SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE '%ing'", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE '%ing'"),
    "filter_in": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 23)",
    "filter_not_in": "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 7, 23)",
    "filter_between": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 2500.5",
    "filter_is_null": ("SELECT c_custkey, seg FROM blanks WHERE seg IS NULL", "SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL END AS seg FROM customer WHERE c_nationkey % 3 < 2"),
    "filter_is_not_null": ("SELECT c_custkey, seg FROM blanks WHERE seg IS NOT NULL", "SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_nationkey % 3 = 2"),
    "filter_function": "SELECT c_custkey FROM customer WHERE LENGTH(c_mktsegment) > 8 AND UPPER(c_name) <> 'X'",
    "filter_string_number": ("SELECT key FROM texts WHERE amount > 150000", "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 150000"),
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "join_right": "SELECT o.o_orderkey, s.s_name FROM supplier s RIGHT JOIN orders o ON s.s_suppkey = o.o_custkey",
    "join_full": "SELECT s.s_suppkey, n.n_name FROM supplier s FULL OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey < 3",
    "join_bare_outer": ("SELECT s.s_suppkey, c.c_custkey FROM supplier s OUTER JOIN customer c ON s.s_suppkey = c.c_custkey", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey"),
    "join_theta": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey",
    "join_expression": "SELECT c.c_custkey, r.r_name FROM customer c JOIN region r ON LEFT(c.c_mktsegment, 1) = LEFT(r.r_name, 1)",
    "join_multi": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_self": "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_semi": ("SELECT c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey)"),
    "join_anti": ("SELECT c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 400000)"),
    "join_anti_is_null": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL",
    "join_then_filter": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000 AND o.o_orderstatus = 'O'",
    "join_group_by": "SELECT n.n_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "join_order_limit": "SELECT o.o_orderkey, UPPER(c.c_name) AS who, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20",
    # groups and aggregates
    "group_by_keys": "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_first_row": ("SELECT r_regionkey, r_name FROM region GROUP BY r_regionkey", "SELECT r_regionkey, r_name FROM region"),
    "agg_count": "SELECT l_returnflag, COUNT(*) AS n, COUNT(l_tax) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_sum": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS s, SUM(l_linenumber) AS k FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS s, CAST(SUM(l_linenumber) AS BIGINT) AS k FROM lineitem GROUP BY l_returnflag"),
    "agg_avg": "SELECT l_linestatus, ROUND(AVG(l_quantity), 6) AS a FROM lineitem GROUP BY l_linestatus",
    "agg_min_max": "SELECT o_orderpriority, MIN(o_totalprice) AS low, MAX(o_orderdate) AS late FROM orders GROUP BY o_orderpriority",
    "agg_nested_functions": "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS a, UPPER(MAX(c_name)) AS top, LENGTH(MIN(c_name)) + 0.0 AS n FROM customer GROUP BY c_mktsegment",
    "agg_order_by_alias": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey",
    "agg_global": "SELECT COUNT(*) AS n, MIN(l_shipdate) AS first, ROUND(AVG(l_discount), 8) AS d FROM lineitem",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "select_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "agg_cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    # order and limit
    "order_by_asc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey",
    "order_by_desc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC",
    "order_by_multi": "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment ASC, c_nationkey DESC, c_custkey",
    "limit_n": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 17",
    "limit_offset": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 40, 25", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 40"),
    "limit_offset_words": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 1490",
    "top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    # functions
    "func_upper_lower": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l FROM customer",
    "func_length": ("SELECT c_custkey, LENGTH(c_name) AS n, LEN(c_mktsegment) AS m FROM customer", "SELECT c_custkey, CAST(LENGTH(c_name) AS INT) AS n, CAST(LENGTH(c_mktsegment) AS INT) AS m FROM customer"),
    "func_substr": "SELECT c_custkey, SUBSTR(c_name, 3, 4) AS a, SUBSTRING(c_mktsegment, 2) AS b FROM customer",
    "func_trim": ("SELECT c_custkey, TRIM(CONCAT('  ', c_name, '\\t ')) AS a, LTRIM(CONCAT('  ', c_name)) AS b, RTRIM(CONCAT(c_name, '  ')) AS c FROM customer", "SELECT c_custkey, c_name AS a, c_name AS b, c_name AS c FROM customer"),
    "func_concat": ("SELECT c_custkey, CONCAT(c_name, '-', c_custkey, NULL) AS a FROM customer", "SELECT c_custkey, CONCAT(c_name, '-', CAST(c_custkey AS VARCHAR), NULL) AS a FROM customer"),
    "func_replace": "SELECT p_partkey, REPLACE(p_type, 'A', '_') AS a FROM part",
    "func_left_right": "SELECT c_custkey, LEFT(c_name, 3) AS a, RIGHT(c_name, 5) AS b FROM customer",
    "func_reverse": "SELECT c_custkey, REVERSE(c_name) AS a FROM customer",
    "func_repeat": "SELECT n_nationkey, REPEAT(n_name, 2) AS a FROM nation",
    "func_abs": "SELECT c_custkey, ABS(c_acctbal) AS a, ABS(-100) AS b FROM customer",
    "func_round": "SELECT c_custkey, ROUND(c_acctbal) AS a, ROUND(c_acctbal, 1) AS b FROM customer",
    "func_floor_ceil": ("SELECT c_custkey, FLOOR(c_acctbal) AS a, CEIL(c_acctbal) AS b, CEILING(c_acctbal) AS c FROM customer", "SELECT c_custkey, CAST(FLOOR(c_acctbal) AS DOUBLE) AS a, CAST(CEIL(c_acctbal) AS DOUBLE) AS b, CAST(CEIL(c_acctbal) AS DOUBLE) AS c FROM customer"),
    "func_mod": ("SELECT o_orderkey, MOD(o_orderkey, 7) AS a, MODULO(o_custkey, o_orderkey % 3) AS b FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS a, o_custkey % NULLIF(o_orderkey % 3, 0) AS b FROM orders"),
    "func_power": "SELECT p_partkey, POWER(p_size, 2) AS a, POW(2.0, -1) AS b FROM part",
    "func_sqrt": ("SELECT c_custkey, SQRT(c_acctbal) AS a FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN SQRT(c_acctbal) END AS a FROM customer"),
    "func_sign": ("SELECT c_custkey, SIGN(c_acctbal) AS a FROM customer", "SELECT c_custkey, CAST(SIGN(c_acctbal) AS INT) AS a FROM customer"),
    "func_date": ("SELECT o_orderkey, DATE(o_orderdate) AS a, DATE('no date') AS b FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS a, 'no date' AS b FROM orders"),
    "func_year_month_day": ("SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d FROM orders", "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, CAST(DAY(o_orderdate) AS INT) AS d FROM orders"),
    "func_coalesce": ("SELECT c_custkey, COALESCE(seg, 'none') AS a, COALESCE(c_custkey, 'x') AS b FROM blanks", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 2 THEN c_mktsegment ELSE 'none' END AS a, CAST(c_custkey AS VARCHAR) AS b FROM customer"),
    "func_ifnull": ("SELECT c_custkey, IFNULL(seg, 'none') AS a, ISNULL(seg, c_name) AS b FROM blanks", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 2 THEN c_mktsegment ELSE 'none' END AS a, CASE WHEN c_nationkey % 3 = 2 THEN c_mktsegment ELSE c_name END AS b FROM customer"),
    "func_nested": "SELECT c_custkey, UPPER(LEFT(REVERSE(c_name), 2)) AS a, ROUND(ABS(c_acctbal), 1) AS b FROM customer",
    # beyond the reference: plain Spark SQL
    "subquery_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)",
    "case_cast": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, CAST(o_custkey AS VARCHAR(20)) AS c FROM orders",
    "common_table": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM big GROUP BY n",
    "window_row_number": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) + 0 AS rn FROM orders",
    "window_rank": ("SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer", "SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INT) AS d FROM customer"),
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000",
}

NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
#: Query -> oracle, for those in FRAMES.
FRAME_ORACLES: dict[str, str] = {
    "window_lag_lead": "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "join_cross_format": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_broadcast": "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "scan_parquet": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'",
    "scan_csv_max_columns": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'https://x.org:80/' || n_nationkey AS url FROM nation",
    "scan_ini": "SELECT 'region' || n_regionkey AS section, 'nation' || n_nationkey AS key, n_name AS value, CAST(1 + 2 * ROW_NUMBER() OVER (ORDER BY n_regionkey, n_nationkey) AS BIGINT) AS line FROM nation",
    "stream_windows": """SELECT "start", "start" + INTERVAL 1 HOUR AS "end", event_type, COUNT(*) AS n FROM (SELECT date_trunc('hour', ts) AS "start", event_type FROM events) e
  WHERE "start" + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY "start", event_type""",
    "dml_insert": f"{NATION} UNION ALL SELECT 100, 'NOWHERE', NULL UNION ALL SELECT 101, 'ELSE', 3",
    "dml_update": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN UPPER(n_name) || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation",
    "dml_delete": f"{NATION} WHERE NOT (n_regionkey IN (1, 2) OR n_name = 'CHINA')",
    "dml_upsert": f"{NATION} WHERE n_nationkey NOT IN (1, 2) UNION ALL SELECT 1, 'ONE', 0 UNION ALL SELECT 2, 'TWO', 0 UNION ALL SELECT 200, 'NEW', 4",
}
SCANS = ("csv", "csv_delimited", "csv_gz", "tsv", "json", "jsonl", "yaml")
SINKS = ("csv", "json", "jsonl", "yaml", "parquet", "excel")
#: What files are written from and read back as: nulls, quotes and delimiters in values, dates, decimals and booleans.
ACCOUNTS = """SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_custkey % 7 <> 0 THEN c_name || ': "' || c_mktsegment || '", x' END AS name,
  CASE WHEN c_nationkey % 5 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 11 <> 0 THEN {day} END AS day,
  CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS {amount}) AS amount, c_acctbal > 0 AS flag FROM customer"""
for _k in (*(f"scan_{s}" for s in SCANS), *(f"sink_{s}" for s in SINKS)):
    FRAME_ORACLES[_k] = ACCOUNTS.format(day="CAST(CAST(DATE '2020-02-28' + CAST(c_custkey % 1000 AS INTEGER) AS DATE) AS VARCHAR)", amount="DOUBLE")

FRAME_ORACLES |= {
    "scan_csv_multi_line": f"SELECT k, replace(name, ': ', chr(10)) AS name, balance, day, amount, flag FROM ({FRAME_ORACLES['scan_csv']}) a",
    "scan_csv_strict_quotes": "SELECT CAST(c_custkey AS BIGINT) AS id, c_name || ', ' || c_mktsegment AS name FROM customer WHERE c_custkey % 3 <> 0",
    "scan_csv_quotes_kept": "SELECT CAST(c_custkey AS BIGINT) AS id, '\"' || c_name || '\"' AS name FROM customer",
    "scan_csv_empty_lines": "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name FROM customer UNION ALL SELECT NULL, '' FROM customer WHERE c_custkey % 5 = 0",
    "sink_csv_gz": FRAME_ORACLES["sink_csv"],
    "sink_parquet_zstd": FRAME_ORACLES["sink_csv"],
    "sink_table": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CASE WHEN n_regionkey = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation",
}

_KEPT: list[str] = []


def _folder(spark: SparkSession) -> str:
    """A folder for small files, until the program ends: in the cluster's shared folder if that is a plain path."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not _KEPT:
        _KEPT.append(tempfile.mkdtemp(prefix="filequarry-", dir=shared if shared and os.path.isdir(shared) else None))
        atexit.register(shutil.rmtree, _KEPT[0], True)
    return tempfile.mkdtemp(dir=_KEPT[0])


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    out = Engine(spark)
    for n in names:
        if n == "blanks":  # a string column with nulls and empty values
            c = spark.read.parquet(f"{sf_dir}/customer.parquet")
            third = F.col("c_nationkey") % 3
            out.register_frame(n, c.select("c_custkey", "c_name", F.when(third == 0, "").when(third == 2, F.col("c_mktsegment")).alias("seg")))
        elif n == "texts":  # numbers as text, some of them blank
            o = spark.read.parquet(f"{sf_dir}/orders.parquet")
            out.register_frame(n, o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_totalprice").cast("string")).alias("amount")))
        else:
            out.register(n, f"{sf_dir}/{n}.parquet", format="parquet")
    return out


def run_text(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "blanks", "texts"}
    return lambda spark, sf_dir: engine(spark, sf_dir, *sorted(dialect.tables_of(sql) & tables)).sql(sql)


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "customer").spark.sql(ACCOUNTS.format(day="date_add(DATE '2020-02-28', CAST(c_custkey % 1000 AS INT))", amount="DECIMAL(12, 2)"))


def _read_back(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("k").cast("long").alias("k"), F.col("name").cast("string").alias("name"), F.col("balance").cast("double").alias("balance"),
        F.col("day").cast("date").cast("string").alias("day"), F.col("amount").cast("decimal(12, 2)").cast("double").alias("amount"), F.col("flag").cast("boolean").alias("flag"),
    )


def scan(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fmt, options = {"csv_delimited": ("csv", {"delimiter": ":"}), "csv_gz": ("csv", {})}.get(kind, (kind, {}))
        path = f"{_folder(spark)}/accounts.{fmt}{'.gz' if kind == 'csv_gz' else ''}"
        df = _accounts(spark, sf_dir)
        if kind in ("json", "yaml"):
            sinks.write_rows(df, path, TableConfig(name="n", file_path=path))
        else:
            sinks.save(df, path, fmt, **options)
        return _read_back(Engine(spark).register("n", path, **options))

    return run


def _sheet(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's rows as strings. One task unpacks it, as it is one stream, and many read the cells."""
    head = rows_of(next(row_texts(path)))[0]
    text = lambda v: None if v in (None, "") else str(v).lower() if isinstance(v, bool) else str(int(v) if isinstance(v, float) and v.is_integer() else v)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                for n, x in enumerate(row_texts(path)):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([x])], ["n", "x"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, x in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                rows = rows_of(x)[0 if n else 1 :]
                yield pa.RecordBatch.from_arrays([pa.array([text(r[i]) for r in rows], pa.string()) for i in range(len(head))], head)

    texts = spark.range(1, numPartitions=1).mapInArrow(unpacked, "n long, x string").repartition(3 * spark.sparkContext.defaultParallelism, "n")
    return texts.mapInArrow(cells, ", ".join(f"`{c}` string" for c in head))


def sink(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_folder(spark)}/out.{kind}"
        sinks.save(_accounts(spark, sf_dir), path, kind)
        if kind == "excel":
            return _read_back(_sheet(spark, path))
        if kind == "yaml":
            return _read_back(read_document(spark, path, T.StructType.fromDDL("k long, name string, balance double, day string, amount double, flag boolean")))
        if kind == "json":
            return _read_back(spark.read.option("multiLine", True).json(path).select(F.explode("data").alias("r")).select("r.*"))
        return _read_back(Engine(spark).register("n", path, format=kind))

    return run


def scan_csv_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/lines.csv"
    sinks.save(_accounts(spark, sf_dir).withColumn("name", F.replace("name", F.lit(": "), F.lit("\n"))), path, "csv")
    return _read_back(Engine(spark).register("n", path, multi_line=True))


def lines_of(line: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """A table of id and name whose lines are written as they are told, after a header."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_folder(spark)}/told"
        told = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr(line).alias("value"))
        told.select(F.explode(F.split("value", "~")).alias("value")).coalesce(1).write.option("header", False).text(path)
        head = spark.createDataFrame([("id,name",)], "value string")
        whole = head.coalesce(1).union(spark.read.text(path)).coalesce(1)
        whole.write.text(f"{path}.csv")
        df = Engine(spark).register("told", f"{path}.csv", format="csv", **options)
        return df.select(F.col("id").try_cast("long").alias("id"), F.coalesce("name", F.lit("")).alias("name"))

    return run


def sink_packed(fmt: str, ending: str, codec: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_folder(spark)}/out.{ending}"
        sinks.save(_accounts(spark, sf_dir), path, fmt, compression=codec)
        return _read_back(Engine(spark).register("n", path, format=fmt))

    return run


def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxed table, cell by cell."""
    path = f"{_folder(spark)}/out.txt"
    n = _nation(spark, sf_dir)
    sinks.save(n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.nullif("n_regionkey", F.lit(0)).alias("region")), path, "table")
    with open(path, encoding="utf-8") as f:
        cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in f if line.startswith("|")]
    return spark.createDataFrame(cells[1:], ", ".join(f"{c} string" for c in cells[0]))


def dml(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_folder(spark)}/nation.csv"
        sinks.save(_nation(spark, sf_dir), path, "csv")
        e = Engine(spark)
        e.register("nation", path)
        for s in statements:
            e.sql(s).collect()
        return e.table("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))

    return run


def window_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))


def join_cross_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.save(_nation(spark, sf_dir), f"{folder}/n.csv", "csv")
    sinks.save(spark.read.parquet(f"{sf_dir}/region.parquet"), f"{folder}/r.jsonl", "jsonl")
    e = Engine(spark)
    e.register("n", f"{folder}/n.csv")
    e.register("r", f"{folder}/r.jsonl")
    return e.sql("SELECT n.n_name, r.r_name FROM n JOIN r ON n.n_regionkey = r.r_regionkey")


def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalyst broadcasts the small side where its size is below the threshold, and shuffles both where it is not."""
    item, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier"))
    return item.join(supplier, item.l_suppkey == supplier.s_suppkey).select("l_orderkey", "l_linenumber", "s_name")


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = Engine(spark).register("l", f"{sf_dir}/lineitem.parquet", format="parquet")
    return item.where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_shipdate")


def scan_csv_max_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/urls"
    n = _nation(spark, sf_dir)
    n.select(F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("https://x.org:80/"), F.col("n_nationkey").cast("string")))).write.text(path)
    columns = [Column("id", "int", 0), Column("name", "string", 1), Column("url", "string", 2)]
    return Engine(spark).register("u", path, format="csv", delimiter=":", max_columns=3, has_header=False, columns=columns)


def scan_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/nations.ini"
    with open(path, "w", encoding="utf-8") as f:
        f.write("; nations\n")
        for r in _nation(spark, sf_dir).orderBy("n_regionkey", "n_nationkey").collect():
            f.write(f"[region{r.n_regionkey}]\nnation{r.n_nationkey} = \"{r.n_name}\"\n")
    return Engine(spark).register("ini", path)


def func_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "region").sql("SELECT r_regionkey, NOW() AS now, DATE() AS today FROM region")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hourly windows of a followed folder. Its files come one by one; the last has rows of the first once more.

    Those are later than the watermark of two files before allows, so no window counts them, and windows that the
    watermark has not passed are still open and not given.
    """
    from ..streaming import follow, windowed_counts

    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # quarters by time from a summary of bounded size, as a window over all rows would sort them in one task
    ends = events.agg(F.percentile_approx(F.col("ts").cast("timestamp"), [0.25, 0.5, 0.75], 10000)).first()[0] or []
    e = events.withColumn("quarter", sum((F.coalesce((F.col("ts") > F.lit(t)).cast("int"), F.lit(0)) for t in ends), F.lit(1)))
    for n in (1, 2, 3, 4):
        rows = e.where((F.col("quarter") == n) | ((F.col("quarter") == 1) & F.lit(n == 4))).drop("quarter")
        rows.repartition(1).write.mode("append").parquet(f"{folder}/events")
    stream = follow(spark, TableConfig(name="events", file_path=f"{folder}/events", format="parquet"), e.drop("quarter").schema, files_per_trigger=1)
    counts = windowed_counts(stream, "ts", ["event_type"])
    query = counts.writeStream.format("parquet").option("path", f"{folder}/counts").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    return told.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"scan_{k}": scan(k) for k in SCANS},
    **{f"sink_{k}": sink(k) for k in SINKS},
    "scan_csv_multi_line": scan_csv_multi_line,
    "scan_csv_strict_quotes": lines_of("""concat(c_custkey, if(c_custkey % 3 = 0, ',', ',"'), c_name, ', ', c_mktsegment, '"')""", strict_quotes=True),
    "scan_csv_quotes_kept": lines_of("""concat(c_custkey, ',"', c_name, '"')""", allow_quoted=False),
    "scan_csv_empty_lines": lines_of("""concat(c_custkey, ',', c_name, if(c_custkey % 5 = 0, '~', ''))""", skip_empty_lines=False),
    "sink_csv_gz": sink_packed("csv", "csv.gz", "gzip"),
    "sink_parquet_zstd": sink_packed("parquet", "parquet", "zstd"),
    "sink_table": sink_table,
    "scan_parquet": scan_parquet,
    "scan_csv_max_columns": scan_csv_max_columns,
    "scan_ini": scan_ini,
    "join_cross_format": join_cross_format,
    "join_broadcast": join_broadcast,
    "window_lag_lead": window_lag_lead,
    "func_now": func_now,
    "stream_windows": stream_windows,
    "dml_insert": dml("INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (100, 'NOWHERE', NULL), (101, 'ELSE', 3)"),
    "dml_update": dml("UPDATE nation SET n_name = CONCAT(UPPER(n_name), '!'), n_regionkey = n_nationkey WHERE n_regionkey = 1"),
    "dml_delete": dml("DELETE FROM nation WHERE n_regionkey IN (1, 2) OR n_name = 'CHINA'"),
    "dml_upsert": dml("UPSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (1, 'ONE', 0), (2, 'TWO', 0), (200, 'NEW', 4)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run_text(v if isinstance(v, str) else v[0]) for k, v in TEXTS.items()} | FRAMES


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v[1] for k, v in TEXTS.items()} | FRAME_ORACLES
