"""Small trees, scanned end to end."""

import json

import pytest

from loomgrain.cli import main
from loomgrain.plans import fixes, report
from loomgrain.plans.scan import cross_workspace_imports, default_export_name, scan, scan_monorepo
from loomgrain.sources import tree


def plant(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(root)


def long_body(name, rows="rows", total="total"):
    return (
        f"export function {name}({rows}: number[]) {{\n  let {total} = 0;\n  let best = -1;\n  for (const r of {rows}) {{\n    if (r > best) {{ best = r; }}\n    {total} += r * 2 - 1;\n"
        f"    if ({total} > 100) {{ {total} = {total} / 2; }}\n    const extra = best + {total} * 3;\n    {total} = extra > 5 ? extra - 1 : extra + 1;\n  }}\n  return {total} + best;\n}}\n"
    )


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = plant(
        tmp_path_factory.mktemp("tree"),
        {
            "package.json": {"name": "x", "main": "dist/index.js", "scripts": {"go": "tsx ./tools/run.ts"}},
            "tsconfig.json": '{ // aliases\n "compilerOptions": { "paths": { "@/*": ["./src/*"] }, }, }',
            "src/index.ts": "import './polyfill';\nimport { used, type Shape } from './a';\nimport { viaBarrel } from './barrel';\nimport Thing from './thing';\nimport { inner as renamed } from '@/deep/alias';\nimport { lost } from '~/lib/far';\n"
            "const later = () => import('./lazy');\nconsole.log(used(), viaBarrel, Thing, renamed, lost, later);\nexport { relisted } from './relist';\n",
            "src/polyfill.ts": "export const quiet = 1;\n",
            "src/a.ts": "export function used() { return helper + 1; }\nexport function unusedOne() { return 2; }\nexport const helper = 3;\nconst one = 1, two = 2;\nconsole.log(two);\nexport interface Shape { a: string }\nexport const _private = 4;\n"
            "export function many(a: string): void;\nexport function many(a: number): void;\nexport function many(a: unknown) {}\n",
            "src/barrel.ts": "export * from './c';\nexport { d as viaD } from './d';\n",
            "src/c.ts": "export const viaBarrel = 1;\n",
            "src/d.ts": "export const d = 1;\nexport const notListed = 2;\n",
            "src/thing.ts": "export default function Thing() { return 1; }\n",
            "src/deep/alias.ts": "export const inner = 1;\nexport const outer = 2;\n",
            "src/lib/far.ts": "export const lost = 1;\n",
            "src/lazy.ts": "export const lazily = 1;\n",
            "src/relist.ts": "const relisted = 1;\nexport { relisted };\n",
            "src/dec.ts": "function D() { return (c: unknown) => c; }\n@D()\nexport class Service { run() { return 1; } }\n",
            "tools/run.ts": "export const tool = 1;\n",
            "src/tested.ts": "export function onlyTested() { return 5; }\n",
            "src/__tests__/tested.test.ts": "import { onlyTested } from '../tested';\nonlyTested();\nexport const testHelper = 1;\n",
            "src/made.gen.ts": "export const made = 1;\n",
            "src/head.ts": "// DO NOT EDIT\nexport const headed = 1;\n",
            "src/one.ts": long_body("sumOne"),
            "src/other.ts": "// renamed copy\n" + long_body("addAll", "values", "acc"),
            "src/wrap.ts": "import { load } from './c';\nexport function first(id: string) { return second(id); }\nexport function second(id: string) { return third(id); }\nexport function third(id: string) { return load(id); }\n",
            "src/types.ts": "export interface User { id: string; name: string; age: number }\nexport interface Person { id: string; name: string; age: number }\nexport interface CardV1 { x: number; y: number; z: number }\nexport interface CardV2 { x: number; y: number; z: number }\n",
            "src/view.vue": "<script>import { fromTemplate } from './tpl'; import './whole'</script>",
            "src/tpl.ts": "export const fromTemplate = 1;\nexport const notFromTemplate = 2;\n",
            "src/whole.ts": "export const anything = 1;\n",
            "src/components/ui/a.tsx": "export const A = 1;\n", "src/components/ui/b.tsx": "export const B = 1;\n", "src/components/ui/c.tsx": "export const C = 1;\n",
            "lib/nowhere.ts": "export const nobody = 1;\n",
            "node_modules/m/index.ts": "export const foreign = 1;\n", "dist/x.ts": "export const built = 1;\n", "ignored/y.ts": "export const hidden = 1;\n", ".gitignore": "ignored/\n",
        },
    )
    return scan(spark, root, verbose=True)


@pytest.fixture(scope="module")
def issues(result):
    return [r.asDict(True) for r in result.issues.collect()]


@pytest.fixture(scope="module")
def insights(result):
    return [r.asDict(True) for r in result.insights.collect()]


def of(found, kind):
    return [f for f in found if f["kind"] == kind]


def test_dead_and_alive(issues):
    dead = {i["symbol"]: i["confidence"] for i in of(issues, "dead-code")}
    assert {"unusedOne", "one", "notListed", "outer", "notFromTemplate", "nobody"} <= set(dead)
    assert not {"used", "viaBarrel", "Thing", "inner", "lost", "relisted", "d", "Service", "tool", "onlyTested", "quiet", "lazily", "fromTemplate", "anything", "_private", "Shape", "two", "helper"} & set(dead)
    assert not {"testHelper", "made", "headed", "foreign", "built", "hidden"} & set(dead)
    assert dead["unusedOne"] == pytest.approx(0.9) and dead["one"] == pytest.approx(0.95)
    assert [i["symbol"] for i in of(issues, "dead-code")].count("many") == 1


def test_exports_used_at_home_only(issues):
    assert {i["symbol"]: i["localUses"] for i in of(issues, "unused-export")}["helper"] == 1


def test_duplicates_across_files(issues):
    d = of(issues, "duplicate")
    assert len(d) == 1 and d[0]["similarity"] > 0.5
    assert {p["file"].rsplit("/", 1)[1] for p in [d[0]["primary"], *d[0]["matches"]]} == {"one.ts", "other.ts"}


def test_same_shapes_without_versions(issues):
    s = of(issues, "same-shape-types")
    assert [(x["primaryName"], x["matchNames"], x["fieldCount"]) for x in s] == [("User", ["Person"], 3)]


def test_wrapper_insights(issues, insights):
    assert {i["outerName"] for i in of(issues, "empty-wrapper")} == {"first", "second", "third"}
    chain = of(insights, "over-abstraction-chain")
    assert [c["name"] for c in chain[0]["chain"]] == ["first", "second", "third"] and chain[0]["terminalCall"] == "load(id)" and chain[0]["confidence"] == pytest.approx(0.85)
    only = of(insights, "wrapper-only-file")
    assert (only[0]["wrapperCount"], only[0]["totalExports"]) == (3, 3)
    assert [w["outerName"] for w in of(insights, "dead-wrapper-chain")] == ["first"]


def test_unreachable_files(insights):
    lost = {i["file"].split("/tree0/")[-1]: i for i in of(insights, "orphaned-file")}
    assert "lib/nowhere.ts" in lost and [s["symbol"] for s in lost["lib/nowhere.ts"]["deadSymbols"]] == ["nobody"]
    assert not any("components/ui" in f or "__tests__" in f for f in lost) and "src/c.ts" not in lost and "src/tpl.ts" not in lost
    folder = of(insights, "scaffold-folder")
    assert folder[0]["folder"].endswith("src/components/ui") and len(folder[0]["files"]) == 3


def test_dead_duplicate_pair(insights):
    pair = of(insights, "dead-duplicate-pair")
    assert {pair[0]["primarySymbol"], *pair[0]["matchSymbols"]} == {"sumOne", "addAll"}


def test_reports(result):
    doc = json.loads(report.to_json(result))
    assert doc["version"] == 1 and all("relativeFile" in i for i in doc["issues"])
    text = "\n".join(report.render(result, color=False))
    assert "src/a.ts" in text and "unusedOne is never used" in text and "insights, " in text


def test_fix_plan_and_rollback(spark, tmp_path):
    root = plant(tmp_path, {
        "package.json": {"main": "index.ts"}, "index.ts": "import { keep } from './m';\nkeep();\n",
        "m.ts": "export function keep() { return 1; }\nexport function gone() { return 2; }\nexport const x = 1, y = 2;\nconsole.log(y);\n",
    })
    r = scan(spark, root)
    planned = fixes.plan(r)
    assert {p["symbol"] for p in planned.collect()} == {"gone", "x"}
    pending = fixes.prepare(r, planned)
    assert not pending.rolled_back
    assert fixes.commit([pending]) == [f"{root}/m.ts"]
    assert (tmp_path / "m.ts").read_text() == "export function keep() { return 1; }\nexport const y = 2;\nconsole.log(y);\n"
    fixes.rollback([pending])
    assert "gone" in (tmp_path / "m.ts").read_text()
    forced = fixes.prepare(r, planned.where("symbol = 'gone'").selectExpr("file", "'keep' AS symbol", "symbolKind", "startLine", "endLine", "snippet", "0 AS start_pos", "37 AS end_pos"))
    assert forced.rolled_back and fixes.commit([pending, forced]) == []


def test_monorepo(spark, tmp_path):
    root = plant(tmp_path, {
        "package.json": {"workspaces": ["packages/*"]},
        "packages/a/package.json": {"name": "@s/a", "main": "src/index.ts"}, "packages/a/src/index.ts": "export { shared } from './s';\n", "packages/a/src/s.ts": "export const shared = 1;\n",
        "packages/a/src/more.ts": "export const taken = 1;\nexport const left = 2;\n",
        "packages/b/package.json": {"name": "@s/b", "main": "src/index.ts"}, "packages/b/src/index.ts": "import { taken } from '@s/a/src/more';\n// import { left } from '@s/a';\nimport Def, * as all from '@s/a';\nconsole.log(taken, Def);\nall.shared;\n",
    })
    packages = tree.workspace_packages(root)
    assert packages == [("@s/a", "packages/a"), ("@s/b", "packages/b")]
    assert cross_workspace_imports(spark, root, packages)["packages/a"] == {"taken", "shared", "*"}
    (tmp_path / "packages/b/src/index.ts").write_text("import { taken } from '@s/a/src/more';\nconsole.log(taken);\n")
    r = scan_monorepo(spark, root, only=["dead-code"])
    assert {i["symbol"] for i in r.issues.collect()} == {"left"}
    assert r.insights.isEmpty()


def test_default_export_names():
    assert default_export_name("export default function foo() {}") == "foo" and default_export_name("const a = 1;\nexport { a as default }") == "a"
    assert default_export_name("export default class Bar {}") == "Bar" and default_export_name("export default () => 1") is None


def test_discovery(tmp_path):
    root = plant(tmp_path, {"a.ts": "", "_registry.ts": "", "b.d.ts": "", "c.min.js": "", ".h.ts": "", "x/d.jsx": "", "x/e.css": "", "skip/f.ts": "", ".gitignore": "skip\n!skip/keep\n*.tmp.ts\n", "g.tmp.ts": ""})
    assert tree.discover(root) == ["_registry.ts", "a.ts", "x/d.jsx"]
    assert tree.discover(root, ["x"]) == ["x/d.jsx"] and tree.discover(root, ["a.ts"]) == ["a.ts"] and tree.discover(root, ignore=["x/**"]) == ["_registry.ts", "a.ts"]


def test_manifest_targets():
    known = {"src/index.ts", "lib/a.ts", "lib/b.tsx", "src/x/y.ts"}
    assert tree.expand_target("", "./dist/index.js", known) == ["src/index.ts"]
    assert sorted(tree.expand_target("", "./lib/*.js", known)) == ["lib/a.ts", "lib/b.tsx"]
    assert tree.expand_target("", "./dist/*/y.js", known) == ["src/x/y.ts"] and tree.expand_target("", "lib/a", known) == ["lib/a.ts"]


def test_command_line(spark, tmp_path, capsys):
    root = plant(tmp_path, {"package.json": {"main": "index.ts"}, "index.ts": "console.log(1);\n", "m.ts": "try { a() } catch {}\n"})
    assert main([root, "--only", "code-smells", "--no-color"], spark) == 1
    assert "swallows every error" in capsys.readouterr().out
    assert main([root, "--only", "code-smells", "--ignore", "m.ts", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["issues"] == []
    with pytest.raises(SystemExit):
        main([root, "--min-confidence", "2"], spark)
