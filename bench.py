"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tickloom import workload  # noqa: E402
from tickloom.operators import accounting, selection, weights  # noqa: E402
from tickloom.operators.calendar import calendar_of, run_monthly  # noqa: E402
from tickloom.plans.research import on_trade_dates, signal_dates  # noqa: E402
from tickloom.session import cut_lineage, delete_cut_tables, get_session  # noqa: E402
from tickloom.operators.stats import perf_stats  # noqa: E402

HEADLINE = [
    "latest_row",
    "latest_date_rows",
    "new_or_changed_rows",
    "vintage_refresh",
    "holdings_rollup",
    "gap_fill_controlled",
    "rebase_100",
    "total_return",
    "select_quantile",
    "er_ewma",
    "cov_sample",
    "cov_ledoit_wolf",
    "nav",
    "perf_stats",
    "research_chain",
]
DAYS, ASSETS, NAMES = 10_000, 1_000, 500


def panel_run(spark) -> int:
    """10,000 business days x 1,000 assets; monthly, 500 random names, random weights, value, statistics."""
    step = F.pmod(F.xxhash64("asset", "n"), F.lit(20_001)).cast("double") / 1e6 - 0.01
    business = F.date_add(F.lit("1980-01-07").cast("date"), (F.floor(F.col("n") / 5) * 7 + F.col("n") % 5).cast("int"))
    cells = spark.range(DAYS * ASSETS).select(
        (F.col("id") % DAYS).alias("n"), F.concat(F.lit("A"), F.floor(F.col("id") / DAYS)).alias("asset")
    )
    # a bounded walk: the level depends on the day and the asset alone
    level = 100 + F.col("n") / 100 + 20 * F.sin(F.col("n") / 50 + F.pmod(F.xxhash64("asset"), F.lit(97))) + 100 * step
    panel = cut_lineage(cells.select(business.alias("date"), "asset", level.alias("value")))
    calendar = calendar_of(panel)
    dates = signal_dates(run_monthly(calendar), calendar)
    chosen = selection.select_randomly(selection.select_all(panel, dates), NAMES, seed=1)
    schedule = cut_lineage(on_trade_dates(weights.w_random(chosen, seed=2), dates))
    line = accounting.nav(panel, calendar, schedule)
    series = line.select(F.lit("run").alias("series"), F.col("date").alias("ts"), F.col("index").alias("price"))
    return perf_stats(series).count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    workload.QUERIES["latest_row"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    started = time.time()
    panel_run(spark)
    times["panel_10000x1000"] = round(time.time() - started, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)
    }))
    delete_cut_tables()
    spark.stop()


if __name__ == "__main__":
    main()
