"""python -m lagloom list | run NAME SF_DIR [--out PATH] | report SF_DIR --out FOLDER | audit SF_DIR --out FOLDER
| load FILES SCHEMA --out TABLE | loop SF_DIR MODULE:FUNCTION --out FOLDER

``run`` prints a query's first rows or writes all of them as Parquet. ``report`` writes the ranked scan as CSV, the
audit as Markdown and the datasets of the charts as JSON. ``audit`` audits one session (the latest by default) and
writes its report and the files that the loop reads. ``load`` appends files that are new to a table. ``loop`` runs
hypotheses that a function generates over the tables.
"""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import SparkSession

from lagloom.plans import registry


def main() -> None:
    registry.load()
    p = argparse.ArgumentParser(prog="lagloom", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("--out")
    report = sub.add_parser("report")
    report.add_argument("sf_dir")
    report.add_argument("--out", required=True)
    audits = sub.add_parser("audit")
    audits.add_argument("sf_dir")
    audits.add_argument("--session")
    audits.add_argument("--out", required=True)
    load = sub.add_parser("load")
    load.add_argument("path")
    load.add_argument("schema")
    load.add_argument("--out", required=True)
    load.add_argument("--since", default="2021-01-01")
    loops = sub.add_parser("loop")
    loops.add_argument("sf_dir")
    loops.add_argument("generate", help="module:function(topic, lag) -> reply")
    loops.add_argument("--iterations", type=int, default=50)
    loops.add_argument("--seconds", type=float)
    loops.add_argument("--out", required=True)
    args = p.parse_args()
    if args.what == "list":
        print("\n".join(registry.QUERIES))
        return
    from lagloom.sources import shared, sinks

    spark = SparkSession.builder.getOrCreate()
    q = {name: (lambda f=f: f(spark, args.sf_dir)) for name, f in registry.QUERIES.items()}
    if args.what == "run":
        df = q[args.name]()
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=60)
        shared.clear(spark)
        return
    if args.what == "audit":
        from lagloom.operators import audit
        from lagloom.plans import stand_ins

        run = audit.run(stand_ins.log(spark, args.sf_dir), args.session and int(args.session))
        audit.write_report(run, args.out)
        shared.clear(spark)
        return
    if args.what == "load":
        from lagloom.streaming import rollup

        rollup.load(spark, args.path, args.schema, args.out, f"{args.out}-progress", args.since).awaitTermination()
        return
    if args.what == "loop":
        from lagloom.operators import loop
        from lagloom.plans import stand_ins

        sinks.views(spark, {t: stand_ins.table(spark, args.sf_dir, t) for t in stand_ins.TABLES})
        module, function = args.generate.rsplit(":", 1)
        generate = getattr(importlib.import_module(module), function)
        made = loop.Loop(generate, loop.spark_runner(spark), max_seconds=args.seconds, memory=loop.Memory(args.out))
        made(args.iterations)
        return
    os.makedirs(args.out, exist_ok=True)
    sinks.ranked_csv(q["signal_scan"](), os.path.join(args.out, "scan"))
    sinks.audit_report(q["audit_summary"](), q["convergence_top"](), os.path.join(args.out, "audit.md"))
    charts = ("outcome_buckets", "rolling_confirm_rate", "cumulative_tokens", "timing_buckets", "score_histogram", "lag_effectiveness", "attempts_distribution", "error_type_frequency", "top_signals")
    sinks.chart_data({name: q[name]() for name in charts}, os.path.join(args.out, "charts.json"))


if __name__ == "__main__":
    main()
