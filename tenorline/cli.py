"""Command line: analyze (hourly or daily), cal-lint, organize."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import pipelines
from .plans.settings import load
from .sources.files import lint_files
from .sources.inventory import organise


def main(args: list[str] | None = None) -> int:
    """Runs a command; returns its exit code."""
    parser = argparse.ArgumentParser(prog="tenorline")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("--mode", choices=["hourly", "daily"], default="hourly")
    analyze.add_argument("--settings", required=True)
    analyze.add_argument("--root", help="folder of the minute data")
    analyze.add_argument("--metadata", help="file of the contracts' expiries")
    analyze.add_argument("--calendar", help="calendar file instead of those in the settings")
    analyze.add_argument("--max-files", type=int, help="only the first files by name (hourly mode)")
    analyze.add_argument("--output-dir")
    analyze.add_argument("--log-level", choices=["DEBUG", "INFO", "WARN", "WARNING", "ERROR"], default="WARN")
    check = commands.add_parser("cal-lint")
    check.add_argument("paths", nargs="+")
    check.add_argument("--json", dest="report", help="file for the issues as JSON")
    sort = commands.add_parser("organize")
    sort.add_argument("--source", required=True)
    sort.add_argument("--destination", required=True)
    sort.add_argument("--inventory")
    sort.add_argument("--dry-run", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tenorline").getOrCreate()
    if given.command == "analyze":
        spark.sparkContext.setLogLevel(given.log_level.replace("WARNING", "WARN"))
        own = lambda path: path and str(Path(path).resolve())  # noqa: E731  the settings' own paths start at their folder
        data = {"minute_root": own(given.root), "max_files": given.max_files}
        over = {"output_dir": own(given.output_dir), "metadata_path": own(given.metadata), "metadata": {"contracts": own(given.metadata)} if given.metadata else None}
        over = {k: v for k, v in over.items() if v} | {"data": {k: v for k, v in data.items() if v}}
        s = load(given.settings, over | ({"business_days": {"calendar_paths": [own(given.calendar)]}} if given.calendar else {}))
        pipelines.write(spark, getattr(pipelines, given.mode)(spark, s, pipelines.kept_in(spark, f"{s.output_dir}/work")), s)
        return 0
    if given.command == "cal-lint":
        code, issues = lint_files(spark, given.paths)
        for i in issues:
            print(f"{'ERROR' if i['level'] == 'error' else 'WARN'}: {i['message']}{' on ' + i['date'] if i['date'] else ''}")
        if given.report:
            Path(given.report).write_text(json.dumps(issues, indent=2))
            print(f"Wrote JSON report to {given.report}")
        print({0: "Calendars passed.", 1: "Calendars have errors.", 2: "Calendars could not all be read."}[code])
        return code
    listed = organise(spark, given.source, given.destination, given.dry_run)
    if given.inventory and not given.dry_run:
        listed.write.mode("overwrite").option("header", True).csv(given.inventory)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
