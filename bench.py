"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ("fact_group_route_month", "route_ratios", "city_month", "panel_route_month", "route_month_context", "node_day_hour", "inbound_leg_asof", "flight_features", "binary_metrics")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from skyledger.plans import legs
    from skyledger.plans.queries import QUERIES

    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    # legs are staged once, as files, and the fact once from them; what is timed after them starts from those tables
    began = time.time()
    legs.legs(spark, sf)
    times["staged_legs"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
