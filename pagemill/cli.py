"""python -m pagemill.cli extract PAGES|URL... INSTRUCTION [--store DIR] [--out DIR] [--format table|json|csv] | templates STORE [--status S] | migrate STORE | version"""

from __future__ import annotations

import argparse

VERSION = "0.1.0"


def main(argv: list[str] | None = None, **own: object) -> int:
    """`own` is for tests: what fetches (`fetch`, `resolve`, `robots`, `clock`). Exit code 0 if some page succeeded (extract), or if the command did."""
    parser = argparse.ArgumentParser(prog="pagemill")
    sub = parser.add_subparsers(dest="command", required=True)
    extract = sub.add_parser("extract", help="records of a Parquet table of pages (page_id, url, html)")
    extract.add_argument("pages", help="the table, or URLs between commas, which are fetched")
    extract.add_argument("instruction")
    extract.add_argument("--store", help="folder of the job, result and template tables")
    extract.add_argument("--out")
    extract.add_argument("--format", choices=["table", "json", "csv"], default="table")
    extract.add_argument("--max-records", type=int, default=100)
    listed = sub.add_parser("templates", help="the templates of a store, the last used first")
    listed.add_argument("store")
    listed.add_argument("--status")
    migrate = sub.add_parser("migrate", help="makes the tables of a store")
    migrate.add_argument("store")
    sub.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from pagemill.api import Engine
    from pagemill.plans.model import Options
    from pagemill.sources.store import Store

    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    if args.command == "migrate":
        Store(spark, args.store).migrate()
        return 0
    if args.command == "templates":
        Engine(spark, store=Store(spark, args.store)).templates(args.status).select("id", "domain", "url_pattern", "strategy", "status", "success_score", "last_used_at").show(truncate=False)
        return 0
    with Engine(spark, store=Store(spark, args.store) if args.store else None) as engine:
        options = Options(max_records=args.max_records, output_format="csv" if args.format == "csv" else "json")
        if args.pages.lower().startswith(("http://", "https://")):
            urls = spark.createDataFrame(list(enumerate(args.pages.split(","))), "page_id long, url string")
            result = engine.extract_urls(urls, args.instruction, options=options, **own)
        else:
            result = engine.extract(spark.read.parquet(args.pages), args.instruction, options=options)
    if args.out:
        (result.save_csv if args.format == "csv" else result.save_json)(args.out)
    elif args.format == "json":
        for row in result.response_json().toLocalIterator():
            print(row.json)
    elif args.format == "csv":
        from pagemill.sources.export import csv_text

        rows = result.csv()
        print(",".join(rows.columns))
        for row in csv_text(rows).toLocalIterator():
            print(row.value, end="")
    else:
        result.show()
    return 0 if result.jobs.where("status = 'success'").take(1) else 1


if __name__ == "__main__":
    raise SystemExit(main())
