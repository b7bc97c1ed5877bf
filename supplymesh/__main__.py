"""python -m supplymesh COMPANY: the analysis of a company over the curated relationships, or over tables that are given."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="supplymesh", description=__doc__)
    p.add_argument("company", nargs="?", default="AMD")
    p.add_argument("--max-depth", type=int, default=2)
    p.add_argument("--max-candidates", type=int, default=5)
    p.add_argument("--edges", help="Parquet table of relationships")
    p.add_argument("--hits", help="Parquet table of search hits")
    p.add_argument("--pages", help="Parquet table of page extracts")
    p.add_argument("--profiles", help="Parquet table of company profiles")
    p.add_argument("--news", help="Parquet table of news items")
    p.add_argument("--stage-seconds", type=float, default=180.0, help="time limit of a stage")
    p.add_argument("--as-of", help="time from which news is looked back, such as 2026-01-31 00:00:00")
    p.add_argument("--skip-risk", action="store_true")
    p.add_argument("--history", help="folder of the table that the run is added to")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from supplymesh.operators.graph import Limits
    from supplymesh.plans import analysis, control
    from supplymesh.sources import tables

    spark = SparkSession.builder.appName("supplymesh").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    config = analysis.Config(limits=Limits(max_depth=a.max_depth, per_parent=a.max_candidates), skip_risk=a.skip_risk, as_of=a.as_of)
    read = lambda path: spark.read.parquet(path) if path else None
    inputs = analysis.Inputs(edges=read(a.edges), hits=read(a.hits), pages=read(a.pages), profiles=read(a.profiles), news=read(a.news))
    made = analysis.analyse(spark, a.company, config=config, inputs=inputs, stages=control.Stages(spark, a.stage_seconds))
    for r in made["report"].collect():
        print(f"{r.part:>10} {r.place:>3}  {r.line}")
    for r in made["timings"].orderBy("seq").collect():
        print(f"{r.stage:>24} {r.seconds:8.1f} s{'  timed out' if r.timed_out else ''}")
    if a.history:
        names = made["scores"].agg(F.array_sort(F.collect_list("name")).alias("suppliers"))
        run = made["health"].join(names).join(made["risks"].agg(F.count("*").alias("risk_count"))).select(F.lit(a.company).alias("company"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("tables").alias("mode"), F.col("overall_score").alias("health_score"), F.col("status").alias("health_status"), "supplier_count", "risk_count", "suppliers")
        tables.append_history(run, a.history)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
