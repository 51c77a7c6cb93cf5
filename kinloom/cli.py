"""Command line: match two tables and write the report."""

from __future__ import annotations

import argparse
import logging
import os
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from kinloom import export
from kinloom.config import AppConfig, DatabaseConfig, ExportConfig, MatchingConfig
from kinloom.functions.similarity import parse_threshold
from kinloom.metrics import shuffle_settings
from kinloom.operators import setops
from kinloom.plans.algorithms import HOUSEHOLD, Algorithm, MatchOptions, match
from kinloom.schema import TableColumns
from kinloom.sources.tables import Source, in_ranges, jdbc, merged_env, persons

_log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinloom", description="Record linkage and household matching on Spark")
    p.add_argument("table1")
    p.add_argument("table2")
    p.add_argument("algorithm", type=int, help="1 to 7")
    p.add_argument("out")
    p.add_argument("format", nargs="?", default="csv", choices=["csv", "xlsx", "both", "parquet"], help="xlsx: a folder of sheets")
    p.add_argument("--source", help="folder of Parquet or CSV tables; without it a database is read")
    p.add_argument("--source2", help="the second table's folder, if it is another one")
    p.add_argument("--kind", default="parquet", choices=["parquet", "csv", "catalog"])
    p.add_argument("--env-file", help="KEY=value settings; the environment overrides them")
    p.add_argument("--threshold", help="95, 95%% or 0.95")
    p.add_argument("--direct-fuzzy-normalization", action="store_true", help="exact rules even out full stops and hyphens")
    p.add_argument("--blocking", choices=["soundex", "keys"])
    p.add_argument("--last-initial", action="store_true", help="fuzzy rules compare persons of equal last initial only")
    p.add_argument("--partitions", type=int, default=64, help="ranges of ids in which a database table is read")
    p.add_argument("--workbook", action="store_true", help="xlsx: one file on the driver, joined from blocks that the executors compress, instead of a folder of sheets")
    p.add_argument("--verbose", action="store_true", help="log what is done")
    p.add_argument("--check-only", action="store_true", help="check the tables' columns and stop")
    return p


def app_config(args: argparse.Namespace, env: dict[str, str], prefix: str = "DB") -> AppConfig:
    password = env.get(f"{prefix}_PASSWORD") or env.get(f"{prefix}_PASS", "")
    database = DatabaseConfig(env.get(f"{prefix}_HOST", ""), env.get(f"{prefix}_USER", ""), password, env.get(f"{prefix}_NAME", ""), int(env.get(f"{prefix}_PORT") or 3307))
    matching = MatchingConfig(args.algorithm, None, args.direct_fuzzy_normalization)
    return AppConfig(database, matching=matching, export=ExportConfig(args.out, args.format)).validate(needs_database=not args.source)


def sources(args: argparse.Namespace, env: dict[str, str]) -> tuple[Source, Source]:
    """Where either table is; DB2_* settings name a second database."""
    if args.source:
        return Source(args.kind, args.source), Source(args.kind, args.source2 or args.source)
    one = app_config(args, env).database
    two = app_config(args, env, "DB2").database if env.get("DB2_HOST") else one
    return tuple(jdbc(d.jdbc_url(), user=d.username, password=d.password) for d in (one, two))  # type: ignore[return-value]


def run(spark: SparkSession, args: argparse.Namespace, env: dict[str, str]) -> dict[str, object]:
    """Check, match, write; returns what was done."""
    app_config(args, env)
    began = time.time()
    one, two = sources(args, env)
    for role, (source, name) in enumerate(((one, args.table1), (two, args.table2)), 1):
        TableColumns.of(source.table(spark, name)).validate(role)
    if args.check_only:
        return {"checked": True}
    algorithm = Algorithm(args.algorithm)
    least = 0.5 if algorithm in HOUSEHOLD else 0.6
    threshold = parse_threshold(args.threshold, least=least)
    options = MatchOptions(min_confidence=0.0 if algorithm <= 2 else threshold, punctuation=args.direct_fuzzy_normalization, blocking=args.blocking, last_initial=args.last_initial)
    one, two = in_ranges(spark, one, args.table1, partitions=args.partitions), in_ranges(spark, two, args.table2, partitions=args.partitions)
    a, b = persons(spark, one, args.table1), persons(spark, two, args.table2)
    _log.info("settings: %s", shuffle_settings(spark))
    _log.info("matching %s with %s by %s", args.table1, args.table2, algorithm.name)
    rows = match(a, b, algorithm, options)
    if args.format in ("csv", "both"):
        export.write_csv(export.report(rows, algorithm), f"{args.out}/csv" if args.format == "both" else args.out)
    if args.format == "parquet":
        export.report(rows, algorithm).write.mode("overwrite").parquet(args.out)
    if args.format in ("xlsx", "both"):
        if algorithm in HOUSEHOLD:
            sheets = export.household_sheets(rows)
        else:
            algo1, algo2 = match(a, b, 1, options), match(a, b, 2, options)
            fuzzy = rows if algorithm in (3, 4) else None
            context = {"Table 1": args.table1, "Table 2": args.table2, "Algorithm": algorithm.name}
            sheets = export.pair_sheets(algo1, algo2, setops.summary(setops.match_counts(a, b, algo1, algo2, fuzzy), context=context))
        if args.workbook:
            export.write_workbook(sheets, args.out if args.format == "xlsx" else f"{args.out}/report.xlsx")
        else:
            export.write_sheets(sheets, f"{args.out}/sheets" if args.format == "both" else args.out)
    _log.info("done in %.1f s", time.time() - began)
    return {"algorithm": algorithm.name, "seconds": time.time() - began}


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    env = merged_env(args.env_file, dict(os.environ)) if args.env_file else dict(os.environ)
    spark = SparkSession.builder.appName("kinloom").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    print(run(spark, args, env))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
