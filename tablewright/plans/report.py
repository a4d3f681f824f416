"""Results as JSON, Markdown and a plain table, and exit codes."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .validate import DatasetResult, Results

CODES = {"pass": 0, "fail": 1, "warn": 2}
FAULT = 3
EXAMPLES = 3
MARKS = {"pass": "✅", "warn": "⚠️", "fail": "❌"}


def exit_code(results: Results, strict: bool = False) -> int:
    """0 passed, 1 failed, 2 warnings under strict; 3 stands for errors of the run."""
    return 0 if results.status == "warn" and not strict else CODES[results.status]


def _rows(d: DatasetResult, severity: str | None = None) -> Iterator[dict]:
    """All violations of a dataset, or those of one severity, a partition at a time."""
    own = d.violations if severity is None else d.violations.filter(F.col("severity") == severity)
    for r in own.orderBy("tag", "field_name", "row_number").toLocalIterator():
        yield r.asDict()


def json_parts(results: Results) -> Iterator[str]:
    """The JSON of results with all violations, in parts, so that none of it need be held whole."""
    text = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    head = {"status": results.status, "summary": results.summary(), "warnings": results.warnings, "totalProcessingTimeMs": round(results.seconds * 1000)}
    yield text(head).removesuffix("\n}") + ',\n  "datasets": ['
    for k, d in enumerate(results.datasets):
        own = {"name": d.name, "class": d.class_name, "rows": d.rows, "status": d.status, "counts": d.counts, "processingTimeMs": round(d.seconds * 1000), "schemaViolations": [vars(v) for v in d.schema]}
        yield ("," if k else "") + "\n" + text(own).removesuffix("\n}") + ',\n  "violations": ['
        for n, row in enumerate(_rows(d)):
            yield ("," if n else "") + "\n" + text(row)
        yield "]}"
    yield "]}\n"


def as_json(results: Results) -> str:
    """All in one text; for many violations json_parts."""
    return "".join(json_parts(results))


def examples(d: DatasetResult, n: int = EXAMPLES) -> DataFrame:
    """The first n different violations of each kind and field, in order. The limit holds before the exchange and after it, so no task holds more than n of a group; of a row that is told twice one is kept."""
    kinds = ["severity", "field_name", "tag"]
    order = Window.partitionBy(*kinds).orderBy("row_number", "value", "error_message")
    first = d.violations.filter("row_number is not null").select(*kinds, "row_number", "value", "error_message").withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= n)
    return first.groupBy(*kinds, "place").agg(F.first("row_number").alias("row_number"), F.first("value").alias("value"), F.first("error_message").alias("error_message")).orderBy(*kinds, "place")


def as_markdown(results: Results) -> str:
    out = ["# Validation results", "", f"**Status:** {MARKS[results.status]} {results.status}", "", "| Dataset | Class | Rows | Status | Errors | Warnings | Infos |", "| --- | --- | --- | --- | --- | --- | --- |"]
    out += [f"| {d.name} | {d.class_name} | {d.rows} | {MARKS[d.status]} | {d.counts['error']} | {d.counts['warning']} | {d.counts['info']} |" for d in results.datasets]
    for d in results.datasets:
        out += ["", f"## {d.name}"]
        out += [f"- {v.severity}: {v.error_message}" for v in d.schema]
        few: dict[tuple, list[str]] = {}
        for x in examples(d).collect():  # at most EXAMPLES a kind and field
            few.setdefault((x["severity"], x["field_name"], x["tag"]), []).append(f"  - row {x['row_number']}: {x['error_message']}")
        for f in d.violations.groupBy("severity", "field_name", "tag").agg(F.count("value").alias("n")).orderBy("severity", "field_name", "tag").collect():
            out.append(f"- {f['severity']}: `{f['field_name']}` {f['tag']} ({f['n']})")
            out += few.get((f["severity"], f["field_name"], f["tag"]), [])
    s = results.summary()
    out += ["", f"{s['passed']} of {s['datasets']} datasets passed; {s['errors']} errors, {s['warnings']} warnings, {s['infos']} infos."]
    return "\n".join(out) + "\n"


def as_table(results: Results, debug: bool = False) -> str:
    """All in one text; for many violations under debug table_parts."""
    return "".join(table_parts(results, debug))


def table_parts(results: Results, debug: bool = False) -> Iterator[str]:
    """A grid, then by severity one line a kind and field, with its first violation and their number; with debug all violations, a partition at a time."""
    grid = [("Dataset", "Class", "Rows", "Status", "Errors", "Warnings", "Infos")] + [(d.name, d.class_name, str(d.rows), d.status, *(str(d.counts[s]) for s in ("error", "warning", "info"))) for d in results.datasets]
    widths = [max(len(r[k]) for r in grid) for k in range(len(grid[0]))]
    for r in grid:
        yield "  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() + "\n"
    for d in results.datasets:
        first = F.min_by(F.struct("error_message", "row_number"), "row_number").alias("first")
        kinds = [] if debug else [{**r.asDict(), **r["first"].asDict()} for r in d.violations.groupBy("severity", "tag", "field_name").agg(first, F.count("tag").alias("n")).orderBy("tag", "field_name").collect()]
        for severity in ("error", "warning", "info"):
            if not d.counts[severity]:
                continue
            yield f"{d.name}: {severity}\n"
            for v in d.schema:
                if v.severity == severity:
                    yield f"  {v.field_name}: {v.error_message}\n"
            for r in _rows(d, severity) if debug else (k for k in kinds if k["severity"] == severity):
                yield f"  {r['field_name']}: {r['error_message']} (row {r['row_number']})" + (f" and {r['n'] - 1} more" if r.get("n", 1) > 1 else "") + "\n"
