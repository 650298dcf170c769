"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is materialised in full through the ``noop`` sink (every row computed,
nothing collected to the driver), three times: ``queries`` reports the fastest run (steady
state, generated code compiled), ``first_run`` the first one. The session is warmed up
on one query first so JVM start-up is not counted. ``jobs`` times one ``run_enrich`` of all
tables into a scratch folder (the path that users take; mostly the making of its partition
folders at this size), and is not part of the headline.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("rollup_hourly", "rollup_daily", "rollup_monthly", "retention_points_idle3",
            "ltv_points_daily_by_cluster", "seg_elbow")


def materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from playerlytics.plans import catalog as C
    from playerlytics.plans import jobs
    from playerlytics.session import local_session, scratch

    spark = local_session(cpus, cpus, app="playerlytics-bench")
    materialise(C.QUERIES["rollup_daily"](spark, sf_dir))          # warm-up

    times, first = {}, {}
    for name in HEADLINE:
        runs = [timed(lambda: materialise(C.QUERIES[name](spark, sf_dir))) for _ in range(3)]
        first[name], times[name] = runs[0], min(runs)
    with scratch(spark, "bench") as out:
        job = {"run_enrich": timed(lambda: jobs.run_enrich(spark, C.events(spark, sf_dir), out, None, "both"))}
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "first_run": first, "jobs": job, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
