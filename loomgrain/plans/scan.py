"""Scanning a source tree or a monorepo: facts once, detectors over them, roll-up, floor."""

from __future__ import annotations

import os
import re
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.frontend.facts import extract, relation
from loomgrain.operators.shared import settled, side_by_side, written
from loomgrain.plans import conventions as rules
from loomgrain.plans import findings
from loomgrain.plans.links import Links
from loomgrain.sources import tree

ANY = "*"


@dataclass
class Result:
    """``issues`` and ``insights`` share one schema; ``facts`` and ``files`` are what they were made of.

    A monorepo's result has its packages' results as ``parts``; ``stages`` says how many milliseconds each stage took.
    """

    issues: DataFrame
    insights: DataFrame
    files_scanned: int
    duration_ms: int
    root: str
    facts: DataFrame | None = None
    files: DataFrame | None = None
    parts: list[Result] = field(default_factory=list)
    stages: dict[str, int] = field(default_factory=dict)

    def part_of(self, file: str) -> Result:
        """The result of the innermost package that holds a file."""
        inside = [p for p in self.parts if file == p.root or file.startswith(p.root + "/")]
        return max(inside, key=lambda p: len(p.root), default=self)


class Stages(dict):
    """Milliseconds by stage. With ``LOOMGRAIN_PROFILE`` set, each is told on standard error as it ends."""

    def __init__(self):
        super().__init__()
        self.since = time.time()

    def end(self, name: str) -> None:
        now = time.time()
        self[name] = int((now - self.since) * 1000)
        self.since = now
        if os.environ.get("LOOMGRAIN_PROFILE"):
            print(f"{name}: {self[name]} ms", file=sys.stderr)


def scan(spark: SparkSession, root: str, paths: list[str] | None = None, only: list[str] | None = None, ignore: list[str] | None = None, min_confidence: float = 0.0, verbose: bool = False, consumed: set[str] = frozenset(), in_monorepo: bool = False) -> Result:
    """Scan one project.

    ``only`` names detectors (insights run on whatever issues there are); ``verbose`` keeps the issues that
    insights sum up; the roll-up comes before the confidence floor. ``consumed`` names symbols used from
    outside, ``*`` meaning all. The project's root is the nearest folder with a project file from the first path (no
    paths: from ``root``) upwards; all paths are taken below it, and paths that are the root itself mean all of it.
    """
    began, stages = time.time(), Stages()
    unknown = set(only or ()) - set(findings.DETECTORS)
    if unknown:
        raise ValueError(f"no such detector: {', '.join(sorted(unknown))}")
    given = [os.path.normpath(os.path.join(os.path.abspath(root), p)) for p in paths or ()]
    start = given[0] if given else os.path.abspath(root)
    home = tree.find_root(start if os.path.isdir(start) else os.path.dirname(start))
    rels = tree.discover(home, [p for p in given if p != home] or None, ignore)
    stages.end("discover")
    config = tree.compiler_config(home)
    files = written(tree.read(spark, home, rels), "files")
    facts = written(extract(files, config.aliases), "facts")
    packages = tree.workspace_packages(home)
    stages.end("facts")
    links = Links(home, files, facts, packages)
    links.facts = facts
    stages.end("links")
    production = files.where(~rules.is_test(F.col("rel")) & ~rules.is_generated(F.col("rel"), F.col("text"))).select("rel")
    real = facts.join(production, "rel", "left_semi")
    functions, outside = relation(real, "functions"), spark.createDataFrame([(s,) for s in sorted(consumed)], "symbol string")
    detectors = {
        "duplicates": [lambda: findings.duplicates(real, files)],
        "dead-code": [lambda: findings.dead_code(relation(real, "decls"), links, config.allow_js, outside)],
        "empty-wrappers": [lambda: findings.empty_wrappers(functions)],
        "ai-signatures": [lambda: findings.type_predicates(functions), lambda: findings.same_shapes(relation(real, "types"))],
        "code-smells": [lambda: findings.useless_async(functions), lambda: findings.empty_catches(relation(real, "catches"))],
    }
    parts = side_by_side(*[run for name, runs in detectors.items() if name in (only or findings.DETECTORS) for run in runs])
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    issues = settled(issues.withColumn("id", F.monotonically_increasing_id()))
    stages.end("detectors")
    insights, used = findings.insights(issues, links, in_monorepo or bool(tree.workspace_globs(home)))
    if not verbose:
        issues = issues.join(used, "id", "left_anti")
    issues = issues.drop("id")
    if min_confidence > 0:
        issues, insights = issues.where(F.col("confidence") >= min_confidence), insights.where(F.col("confidence") >= min_confidence)
    issues, insights = settled(issues), settled(insights)
    stages.end("insights")
    return Result(issues, insights, len(rels), int((time.time() - began) * 1000), home, facts, files, stages=stages)


def is_monorepo(root: str) -> bool:
    return bool(tree.workspace_globs(root))


_CLAUSE = re.compile(r"(import|export)\s+(?:type\s+)?([^;'\"]*?)\s*from\s+['\"]([^'\"]+)['\"]")


def without_comments(text: str) -> str:
    """Source without comments; strings and templates stay."""
    return re.sub(r"('(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`)|//[^\n]*|/\*.*?(?:\*/|\Z)", lambda m: m[1] or " ", text, flags=re.S)


def default_export_name(text: str) -> str | None:
    """The name of what a file exports by default, if it has one."""
    text = without_comments(text)
    m = re.search(r"export\s+default\s+(?:async\s+)?(?:function\s*\*?|(?:abstract\s+)?class)\s+([A-Za-z_$][\w$]*)", text) or re.search(r"export\s+default\s+(?!async\b|function\b|class\b|abstract\b|new\b|await\b)([A-Za-z_$][\w$]*)\s*;?\s*$", text, re.M)
    m = m or re.search(r"export\s*\{[^}]*?([A-Za-z_$][\w$]*)\s+as\s+default\b", text)
    return m[1] if m else None


def cross_workspace_imports(spark: SparkSession, root: str, packages: list[tuple[str, str]]) -> dict[str, set[str]]:
    """Package folder -> names that other packages import from it; ``*`` where that can't be told.

    One sweep over every source below the root: each file's import clauses are taken apart where the file is
    read, and what comes back is distinct (folder, name) pairs.
    """
    out: dict[str, set[str]] = {d: set() for _, d in packages}
    if not packages:
        return out
    found = tree.manifests(root)
    defaults = {}
    for _, d in packages:
        entry = tree.locate_entry(root, d, found.get(d, {}))
        if entry:
            with open(f"{root}/{entry}", encoding="utf-8", errors="replace") as f:
                defaults[d] = default_export_name(f.read())
    owners = sorted(packages, key=lambda p: -len(p[0]))
    sources = [r for r in tree._walk(root, tree.SWEEP_IGNORED) if tree.SOURCE.search(r)]

    def names(frames):
        import pandas as pd

        for pdf in frames:
            rows = set()
            for rel, raw in zip(pdf["rel"], pdf["text"], strict=True):
                text = without_comments(raw)
                for word, clause, spec in _CLAUSE.findall(text):
                    owner = next((d for n, d in owners if spec == n or spec.startswith(n + "/")), None)
                    if owner is None or rel.startswith(owner + "/"):
                        continue
                    block = re.search(r"\{([^}]*)\}", clause)
                    for part in block[1].split(",") if block else ():
                        name = re.split(r"\s+as\s+", re.sub(r"^type\s+", "", part.strip()))[0].strip()
                        if name and name != "default":
                            rows.add((owner, name))
                        elif name:
                            rows.add((owner, defaults.get(owner) or ANY))
                    space = re.search(r"\*\s+as\s+([A-Za-z_$][\w$]*)", clause)
                    if clause.strip().startswith("*") and (word == "export" or not space):
                        rows.add((owner, ANY))
                    elif space:
                        used = set(re.findall(rf"\b{re.escape(space[1])}\.([A-Za-z_$][\w$]*)", text))
                        rows |= {(owner, u) for u in used or {ANY}}
                    if word == "import" and re.match(r"[A-Za-z_$]", clause.strip()):
                        rows.add((owner, defaults.get(owner) or ANY))
            yield pd.DataFrame(sorted(rows), columns=["folder", "name"])

    for r in tree.read(spark, root, sources).mapInPandas(names, "folder string, name string").distinct().collect():
        out[r["folder"]].add(r["name"])
    return out


def scan_monorepo(spark: SparkSession, root: str, **options) -> Result:
    """Scan each workspace package with the names that others consume of it; a plain scan where there are none.

    Findings of all packages are one relation.
    """
    began = time.time()
    root = os.path.abspath(root)
    packages = tree.workspace_packages(root)
    if not packages:
        return scan(spark, root, **options)
    consumed = cross_workspace_imports(spark, root, packages)
    results = side_by_side(*[lambda d=d: scan(spark, os.path.join(root, d), **{**options, "paths": None}, consumed=consumed[d], in_monorepo=True) for _, d in packages], at_once=4)
    issues, insights = results[0].issues, results[0].insights
    for r in results[1:]:
        issues, insights = issues.unionByName(r.issues), insights.unionByName(r.insights)
    return Result(issues, insights, sum(r.files_scanned for r in results), int((time.time() - began) * 1000), root, parts=results)
