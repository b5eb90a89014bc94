"""Reports of a scan: JSON rows, text for a terminal."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.plans.scan import Result

RANK = {k: i for i, k in enumerate("dead-code unused-export empty-wrapper useless-async empty-catch useless-type-predicate duplicate same-shape-types".split())}


def with_file(df: DataFrame, root: str) -> DataFrame:
    """Findings with ``at`` (the file they belong to) and ``relativeFile``."""
    at = F.coalesce("location.file", "primary.file", "file", F.col("chain")[0]["location"]["file"], F.col("files")[0], "folder")
    rel = F.when(at.startswith(root + "/"), F.expr(f"substring(_at, {len(root) + 2})")).otherwise(F.col("_at"))
    return df.withColumn("_at", at).withColumn("relativeFile", rel).withColumnRenamed("_at", "at")


def json_rows(df: DataFrame, root: str) -> DataFrame:
    """One ``json`` string a finding, nulls left out, ``relativeFile`` added."""
    return with_file(df, root).drop("at").select(F.to_json(F.struct("*")).alias("json"))


def to_json(result: Result) -> str:
    """The whole report as one versioned document."""
    rows = {k: [json.loads(r["json"]) for r in json_rows(getattr(result, k), result.root).toLocalIterator()] for k in ("issues", "insights")}
    return json.dumps({"version": 1, "rootDir": result.root, "filesScanned": result.files_scanned, "durationMs": result.duration_ms, **rows}, indent=2)


def _names(symbols: list) -> str:
    shown = ", ".join(s["symbol"] for s in symbols[:3])
    return shown + (f" +{len(symbols) - 3} more" if len(symbols) > 3 else "")


def describe(f: dict) -> str:
    """One line about a finding."""
    kind = f["kind"]
    places = lambda ms: ", ".join(f"{os.path.basename(m['file'])}:{m['line']}" for m in ms)
    if kind == "dead-code":
        return f"{f['symbolKind']} {f['symbol']} is never used"
    if kind == "unused-export":
        return f"{f['symbol']} is exported but only used in its own file ({f['localUses']}x)"
    if kind == "empty-wrapper":
        return f"{f['outerName']} only forwards to {f['innerCall']}"
    if kind == "useless-async":
        return f"{f['functionName']} is async but never awaits"
    if kind == "empty-catch":
        return "catch only rethrows" if f.get("rethrowsOnly") else "catch swallows every error" if f.get("swallowsAll") else "catch block is empty"
    if kind == "useless-type-predicate":
        return f"{f['predicateName']} is just {f['collapsesTo']}"
    if kind == "duplicate":
        return f"{round(f['similarity'] * 100)}% similar to {places(f['matches'])}: {f['preview']}"
    if kind == "same-shape-types":
        return f"{f['primaryName']} has the shape of {', '.join(f['matchNames'])} ({f['fieldCount']} fields)"
    if kind == "orphaned-file":
        return "file is unreachable" + (f" ({_names(f['deadSymbols'])})" if f["deadSymbols"] else "")
    if kind == "dead-wrapper-chain":
        return f"{f['outerName']} is dead and only forwards to {f['innerCall']}"
    if kind == "dead-duplicate-pair":
        return f"{f['primarySymbol']} and {', '.join(f['matchSymbols'])} are duplicates and all dead"
    if kind == "wrapper-only-file":
        return f"{f['wrapperCount']} of {f['totalExports']} exports are wrappers"
    if kind == "over-abstraction-chain":
        return " -> ".join(c["name"] for c in f["chain"]) + f" -> {f['terminalCall']}"
    if kind == "scaffold-folder":
        return f"{len(f['files'])} unused {f['scaffold']} files"
    return kind


def _paint(text: str, confidence: float, color: bool) -> str:
    code = "32" if confidence >= 0.8 else "33" if confidence >= 0.5 else "90"
    return f"\x1b[{code}m{text}\x1b[0m" if color else text


def _count(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def render(result: Result, color: bool = True) -> Iterator[str]:
    """Lines for a terminal: insights, then issues by file, kind and line, then the totals."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for k, i in RANK.items()], F.lit(99))
    n = {"insights": 0, "issues": 0}
    for r in with_file(result.insights, result.root).orderBy("kind", "relativeFile").toLocalIterator():
        f = r.asDict(True)
        n["insights"] += 1
        yield f"  {_paint('●', f['confidence'], color)} {f['relativeFile']}  {describe(f)}  {f['confidence']:.2f}"
    last = None
    line = F.coalesce("location.line", "primary.line")
    for r in with_file(result.issues, result.root).withColumn("_line", line).orderBy("relativeFile", rank, "_line").toLocalIterator():
        f = r.asDict(True)
        n["issues"] += 1
        if f["relativeFile"] != last:
            last = f["relativeFile"]
            yield f"\n{last}"
        yield f"  {_paint('●', f['confidence'], color)} {str(f['_line'] or '').rjust(5)}  {f['kind'].ljust(22)} {describe(f)}  {f['confidence']:.2f}"
    yield f"\n{_count(n['insights'], 'insight')}, {_count(n['issues'], 'issue')} in {_count(result.files_scanned, 'file')} ({result.duration_ms / 1000:.1f}s)"
