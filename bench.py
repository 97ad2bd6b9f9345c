"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every figure is one cold run of the whole query in a warm session: the JVM is
started and the files are touched once before the clock starts.
"""

from __future__ import annotations

import json
import os
import time

from checks import queries as q
from salesmix.operators import moments as mom
from salesmix.plans import convergence as conv
from salesmix.plans import gibbs
from salesmix.plans import reports as rep
from salesmix.session import local_session, stored, work_dir
from salesmix.sources import retail

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run_all(df) -> None:
    """Execute a plan completely without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, memory="16g")
    for name in ("lineitem", "orders", "customer", "part", "nation", "region", "events"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").count()
    timings: dict[str, float] = {}

    def clock(name, fn):
        begin = time.perf_counter()
        result = fn()
        timings[name] = round(time.perf_counter() - begin, 3)
        return result

    def registered(name):
        clock(name, lambda: run_all(q.REGISTRY[name](spark, SF_DIR)))

    facts = clock("weekly_facts", lambda: stored(retail.weekly_facts(spark, SF_DIR), "facts"))
    xs = ["x1", "x2", "x3"]
    lines = retail.hier_lines(spark, SF_DIR)
    clock("group_gram_p4", lambda: run_all(mom.group_gram(lines, "y1", xs)))
    rows = conv.model_rows(facts)
    clock("group_gram_p11", lambda: run_all(mom.group_gram(
        rows, "blended_units_total_log", q.sc.DRIVERS)))
    model = retail.demand_model(facts)
    clock("decomposition_quarter", lambda: run_all(
        rep.historic_decomposition(facts, model, "quarter")["data"]))
    for name in ("historic_decomposition", "weekly_series", "sales_table", "whatif_summary",
                 "median_of", "geweke_report"):
        registered(name)

    folder = work_dir(spark, "bench-gibbs")
    spec = gibbs.FitSpec(p=4)
    clock("gibbs_init", lambda: gibbs.gibbs_init(mom.group_gram(lines, "y1", xs), spec, folder))
    clock("gibbs_10_iterations", lambda: run_all(
        gibbs.gibbs_run(spark, folder, spec, 2, 11)))
    print(json.dumps({"metric": "total time of headline queries",
                      "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
