"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up and then three times, the last three into Spark's no-op sink; its time is the median. `duckdb` holds
DuckDB's median for the same SQL on as many threads, for comparison.
"""

import json
import os
import statistics
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from graphloom import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "bgp_star", "bgp_join_3", "bgp_join_5", "filter_date", "optional", "optional_filter", "exists", "not_exists", "minus", "union", "agg_sum_avg", "agg_distinct", "having", "distinct", "topk", "path_seq", "path_plus",
    "bsbm_like_q2", "bsbm_like_q4", "bsbm_like_q7", "bsbm_like_q10", "bi_like_q1", "bi_like_q3", "bi_like_q4", "bi_like_q5", "bi_like_q6", "bi_like_q8", "wind_like_2", "wind_like_3", "wind_like_4",
]


def timed(run, times: int = 3) -> float:
    run()
    taken = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        taken.append(time.perf_counter() - began)
    return statistics.median(taken)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "16m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    db.execute(f"SET threads = {int(CPUS)}")
    db.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    queries, sql = catalog.queries(), catalog.oracle_sql()
    took, other = {}, {}
    for name in HEADLINE:
        took[name] = round(timed(lambda: queries[name](spark, SF).write.format("noop").mode("overwrite").save()), 4)
        other[name] = round(timed(lambda: db.execute(sql[name]).fetchall()), 4)
        print(name, took[name], other[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1], "cpus": int(CPUS), "duckdb": other, "duckdb_total": round(sum(other.values()), 3)}))


if __name__ == "__main__":
    main()
