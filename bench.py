"""Warm times of headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS tell the tables and the threads."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: The operations whose times the reference publishes, over lineitem (about 600,000 rows at scale 0.1), and the flagship.
TEXTS = {
    "select_star": "SELECT * FROM lineitem",
    "where_filter": "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N'",
    "join": "SELECT l.l_orderkey, o.o_totalprice, l.l_quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    "group_by": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "order_by": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber",
    "top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
}


def main() -> None:
    from filequarry import Engine, session
    from filequarry.operators.reference_queries import FLAGSHIP

    spark = session(
        "bench", f"local[{CPUS}]", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=CPUS,
    )
    spark.sparkContext.setLogLevel("OFF")
    engine = Engine(spark)
    for t in ("lineitem", "orders", "customer", "nation", "region"):
        engine.register(t, f"{SF_DIR}/{t}.parquet", format="parquet")
    took = {}
    for name, sql in {**TEXTS, "flagship": FLAGSHIP}.items():
        times = []
        for _ in range(4):  # the first also compiles
            began = time.perf_counter()
            engine.sql(sql).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times[1:]), 4)
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
