"""Command line: scan a tree, report, and on request remove dead declarations."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from loomgrain.plans import findings, fixes, report
from loomgrain.plans.scan import is_monorepo, scan, scan_monorepo
from loomgrain.sources.tree import find_root


SNIPPET, BROKEN = 6, 5  # lines of a removed declaration, and names still read, that are shown


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must lie between 0 and 1")
    return value


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: nothing found, 1: findings, 2: failure."""
    p = argparse.ArgumentParser(prog="loomgrain")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--fix", action="store_true", help="remove dead declarations at or over 0.8; needs -y")
    p.add_argument("--json", action="store_true")
    p.add_argument("--only", choices=findings.DETECTORS)
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--min-confidence", type=_share, default=0.7)
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("-y", "--yes", action="store_true")
    a = p.parse_args(args)
    try:
        spark = spark or SparkSession.builder.getOrCreate()
        root = find_root(a.paths[0])
        options = {"only": [a.only] if a.only else None, "ignore": a.ignore, "min_confidence": a.min_confidence, "verbose": a.verbose}
        whole = a.paths == ["."] or len(a.paths) == 1 and find_root(a.paths[0]) == root
        result = scan_monorepo(spark, root, **options) if whole and is_monorepo(root) else scan(spark, root, a.paths, **options)
        if a.json:
            print(report.to_json(result))
        else:
            for line in report.render(result, not a.no_color and sys.stdout.isatty()):
                print(line)
        if a.fix:
            planned = fixes.plan(result)
            for r in planned.orderBy("file", "startLine").toLocalIterator():
                print(f"remove {r['symbol']} ({r['file']}:{r['startLine']}-{r['endLine']})")
                lines = r["snippet"].split("\n")
                for line in [*lines[:SNIPPET], *([f"...{len(lines) - SNIPPET} more lines"] if len(lines) > SNIPPET else [])]:
                    print(f"  - {line}")
            if a.yes:
                pending = fixes.batches(result, planned)
                broken = [b for p in pending for b in p.broken_by]
                for file, name in broken[:BROKEN]:
                    print(f"not removed: {name} is still read in {file}")
                if len(broken) > BROKEN:
                    print(f"...and {len(broken) - BROKEN} more")
                print(f"{len(fixes.commit(pending))} files changed")
            else:
                print("nothing changed; -y removes them")
        return 0 if result.issues.isEmpty() and result.insights.isEmpty() else 1
    except Exception as e:
        print(f"loomgrain: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
