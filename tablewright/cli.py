"""python -m tablewright.cli import | validate | transform"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .plans import config as cfg
from .plans import report, schema_import
from .plans.deploy import ship_package
from .plans.transform import TransformError, transform
from .plans.validate import InvalidDataset, validate
from .sources.sinks import stamp
from .sources.tables import MissingInput

FORMATS = ("table", "json", "markdown", "markdown_summary_action")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablewright")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("path", nargs="?", default=".")
    v.add_argument("--format", default="table")
    v.add_argument("--output-dir")
    v.add_argument("--strict", action="store_true")
    v.add_argument("--fail-fast", action="store_true", default=None)
    v.add_argument("--debug", action="store_true")
    t = sub.add_parser("transform")
    t.add_argument("path", nargs="?", default=".")
    i = sub.add_parser("import")
    i.add_argument("definitions", nargs="+")
    i.add_argument("--checklist")
    i.add_argument("--output", default="classes.json")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "import":
            schema_import.write(schema_import.build(args.definitions, args.checklist), args.output)
            return 0
        path = cfg.discover(args.path)
        config = cfg.load(path)
        spark = spark or SparkSession.builder.getOrCreate()
        ship_package(spark)
        if args.command == "transform":
            if config.transform is None:
                raise cfg.ConfigError(["transform: is missing"])
            for file in transform(spark, config.transform, str(path.parent)).files:
                print(file)
            return 0
        results = validate(spark, config, str(path.parent), args.fail_fast)
        kind = args.format
        if kind not in FORMATS:
            print(f"unknown format {kind!r}, using table", file=sys.stderr)
            kind = "table"
        for w in results.warnings:
            print(w, file=sys.stderr)
        parts = report.json_parts(results) if kind == "json" else report.table_parts(results, args.debug) if kind == "table" else [report.as_markdown(results)]
        folder = args.output_dir or ("./validation_results" if kind == "markdown_summary_action" else None)
        if folder:
            name = "validation-results.md" if kind == "markdown_summary_action" else f"validation-{stamp()}.{'json' if kind == 'json' else 'md' if kind == 'markdown' else 'txt'}"
            Path(folder).mkdir(parents=True, exist_ok=True)
            with open(Path(folder) / name, "w", encoding="utf-8") as file:
                file.writelines(parts)
        else:
            sys.stdout.writelines(parts)
        return report.exit_code(results, args.strict)
    except (cfg.ConfigError, InvalidDataset, TransformError, MissingInput, OSError, ValueError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return report.FAULT


if __name__ == "__main__":
    sys.exit(main())
