"""Sources of a tree: ignore rules, roots, entries of packages, framework and registry manifests."""

import os
import stat

import pytest
from pyspark.sql import functions as F
from test_scan import of, plant

from loomgrain.frontend.facts import extract, facts_of, relation
from loomgrain.plans import conventions as rules
from loomgrain.plans import findings, fixes
from loomgrain.plans.scan import scan, scan_monorepo
from loomgrain.sources import tree


@pytest.mark.parametrize(
    ("rules", "path", "hidden"),
    [
        ("*.[jt]s", "a.ts", True), ("*.[!jt]s", "a.ts", False), ("*.[^jt]s", "a.cs", True), ("file[0-9].ts", "file7.ts", True), ("file[0-9].ts", "filex.ts", False), ("[]x].ts", "].ts", True),
        (r"\#note.ts", "#note.ts", True), (r"\!keep.ts", "!keep.ts", True), (r"a\*.ts", "a*.ts", True), (r"a\*.ts", "ab.ts", False), (r"end\ ", "end ", True), ("end ", "end", True),
        ("{a,b}.ts", "a.ts", False), ("{a,b}.ts", "{a,b}.ts", True), ("a/**", "a/b/c.ts", True), ("a/**/z.ts", "a/z.ts", True), ("/only.ts", "x/only.ts", False), ("x/y.ts", "z/x/y.ts", False), ("logs/", "x/logs/a.ts", True), ("logs/", "logs", False),
        ("*.ts\n!keep.ts", "keep.ts", False), ("dir\n!dir/keep.ts", "dir/keep.ts", True), ("a[/]b.ts", "a/b.ts", False), ("lone[.ts", "lone[.ts", True),
    ],
)
def test_ignore_syntax(tmp_path, rules, path, hidden):
    ignore = tree.GitIgnore(str(tmp_path))
    ignore.rules.clear()
    ignore.add(rules)
    assert ignore.hides(path) is hidden


def test_globs_with_alternatives(tmp_path):
    assert tree.glob_regex("{a,b*}/x").match("bcd/x") and tree.glob_regex("{a,{b,c}d}").match("cd") and not tree.glob_regex("{a,b}").match("ab")


def test_ignore_files_above_the_root_count_and_those_below_do_not(tmp_path):
    root = plant(tmp_path, {".gitignore": "up.ts\n", "p/.gitignore": "own.ts\n", "p/up.ts": "", "p/own.ts": "", "p/in/.gitignore": "deep.ts\n", "p/in/deep.ts": ""})
    assert tree.discover(f"{root}/p") == ["in/deep.ts"]


@pytest.mark.parametrize(
    ("manifest", "files", "entry"),
    [
        ({"main": "dist/x.js"}, ["src/index.tsx", "dist/x.js"], "src/index.tsx"), ({}, ["index.cjs"], "index.cjs"), ({"main": "lib/m.js", "module": "lib/n.js"}, ["lib/m.js", "lib/n.js"], "lib/m.js"),
        ({"module": "lib/n.js"}, ["lib/n.js"], "lib/n.js"), ({"exports": "lib/e.js"}, ["lib/e.js"], "lib/e.js"), ({"exports": {".": {"require": "./r.cjs"}}}, ["r.cjs"], "r.cjs"),
        ({"exports": {".": {"require": "./r.cjs", "import": "./i.mjs"}}}, ["r.cjs", "i.mjs"], "i.mjs"), ({"exports": {".": {"types": "./t.d.ts"}}}, ["t.d.ts"], None), ({"main": "gone.js"}, [], None),
    ],
)
def test_package_entries(tmp_path, manifest, files, entry):
    root = plant(tmp_path, {f"p/{f}": "" for f in files} | {"p/package.json": manifest})
    assert tree.locate_entry(root, "p", manifest) == (entry and f"p/{entry}")


def test_manifest_targets_come_from_built_places():
    known = {"src/a.tsx", "src/b.ts", "b.jsx", "lib/c.ts", "p/src/deep/d.ts"}
    assert tree.expand_target("", "./dist/a.js", known) == ["src/a.tsx"] and sorted(tree.expand_target("", "build/b.mjs", known)) == ["b.jsx", "src/b.ts"]
    assert tree.expand_target("", "lib/c.js", known) == ["lib/c.ts"] and tree.expand_target("p", "out/deep/d.cjs", known) == ["p/src/deep/d.ts"] and tree.expand_target("", "src/b", known) == ["src/b.ts"]


def test_scan_walks_up_to_the_project(spark, tmp_path):
    root = plant(tmp_path, {"package.json": {"main": "index.ts"}, "index.ts": "import './in/a';\n", "in/a.ts": "try { go() } catch {}\n", "in/deep/b.ts": "try { go() } catch {}\n"})
    files = lambda r: sorted(os.path.relpath(i["location"]["file"], root) for i in r.issues.collect())
    whole = scan(spark, f"{root}/in/deep", only=["code-smells"])
    assert whole.root == root and files(whole) == ["in/a.ts", "in/deep/b.ts"]
    part = scan(spark, root, ["in/deep"], only=["code-smells"])
    assert part.root == root and files(part) == ["in/deep/b.ts"]
    assert files(scan(spark, f"{root}/in", ["..", "deep"], only=["code-smells"])) == ["in/deep/b.ts"]
    assert set(whole.stages) == {"discover", "facts", "links", "detectors", "insights"}


def test_stages_are_told_on_request(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("LOOMGRAIN_PROFILE", "1")
    scan(spark, plant(tmp_path, {"package.json": {}, "a.ts": "export const a = 1;\n"}), only=["code-smells"])
    assert "detectors: " in capsys.readouterr().err


def wrappers(text):
    return {f["name"]: f["wrapper_call"] for f in facts_of("a.ts", text)["functions"] if f["wrapper_call"]}


def test_public_names_for_private_functions_are_no_wrappers():
    assert wrappers("export function getUser(id: string) { return _fetchUser(id); }\nexport function load(id: string) { return fetchUser(id); }\nfunction _own(id: string) { return _other(id); }") == {"load": "fetchUser(id)", "_own": "_other(id)"}
    assert wrappers("export function get(id: string) { return api._get(id); }") == {}


@pytest.mark.parametrize(
    "holder",
    ["return { go(id) { return load(id); } };", "use({ go: (id) => load(id) });", "new Api({ deep: { go(id) { return load(id); } } });", "const api: Api = { go(id) { return load(id); } };", "api = { go: function (id) { return load(id); } } as Api;", "const make = () => ({ go(id) { return load(id); } });"],
)
def test_members_of_objects_handed_over_are_exempt(holder):
    assert wrappers(f"function outer() {{ {holder} }}") == {}


def test_members_of_a_plain_object_count():
    assert wrappers("const plain = { go(id) { return load(id); } };") == {"go": "load(id)"}


def idle(text):
    return {f["name"] for f in facts_of("a.ts", text)["functions"] if f["idle_async"]}


def test_async_without_need():
    assert idle("async function a() { const x = 1; return x; }\nasync function b() { return load(); }\nasync function c() { return new Promise(go); }\nasync function d() { return Promise.all(xs); }") == {"a"}
    assert idle("async function a() { await go(); }\nasync function b() { const f = async () => { await go(); }; f(); }\nasync function c(): Promise<number> { return 1; }\nasync function d(_unused) {}\nasync function e() {}") == {"b", "e"}
    assert idle("const a = async () => 1;\nconst b = async () => load();\nconst c: F = async () => 1;\nasync function d() { if (x) { return Promise.resolve(1); } return 2; }\nasync function e() { for await (const x of y) {} }") == {"a", "d"}


def monorepo(tmp_path):
    return plant(tmp_path, {
        "package.json": {"workspaces": ["packages/*"]},
        "packages/a/package.json": {"name": "@s/a", "main": "src/index.ts"}, "packages/a/src/index.ts": "export { live } from './live';\n", "packages/a/src/live.ts": "export const live = 1;\n",
        "packages/a/src/orphan.ts": "import { live } from './live';\nimport Def, { used as u, type Gone } from './live';\nexport const safeDead = live + Def;\nexport const kept: number = u;\nconsole.log(kept);\n",
        "packages/b/package.json": {"name": "@s/b", "main": "src/index.ts"}, "packages/b/src/index.ts": "import { live } from '@s/a';\nimport { two } from './two';\nexport const x = live + two;\n",
        "packages/b/src/two.ts": "export function deadTwo() { return 2; }\nexport const two = 2;\n",
    })


def test_fixes_over_packages_are_written_all_or_none(spark, tmp_path):
    root = monorepo(tmp_path)
    orphan, two = f"{root}/packages/a/src/orphan.ts", f"{root}/packages/b/src/two.ts"
    os.chmod(two, 0o755)
    result = scan_monorepo(spark, root, only=["dead-code"], verbose=True)
    assert result.part_of(orphan).root == f"{root}/packages/a" and result.part_of("/elsewhere").root == root
    planned = fixes.plan(result, 0.8).where("symbol in ('safeDead', 'deadTwo')")
    assert {r["symbol"] for r in planned.collect()} == {"safeDead", "deadTwo"}
    broken = planned.selectExpr("file", "CASE symbol WHEN 'deadTwo' THEN 'two' ELSE symbol END AS symbol", "symbolKind", "startLine", "endLine", "snippet", "CASE symbol WHEN 'deadTwo' THEN 43 ELSE start_pos END AS start_pos", "CASE symbol WHEN 'deadTwo' THEN 64 ELSE end_pos END AS end_pos")
    pending = fixes.batches(result, broken)
    before = {f: open(f).read() for f in (orphan, two)}
    assert [p.rolled_back for p in pending] == [False, True] and fixes.commit(pending) == []
    assert {f: open(f).read() for f in before} == before
    assert sorted(fixes.commit(fixes.batches(result, planned))) == [orphan, two]
    assert open(two).read() == "export const two = 2;\n" and stat.S_IMODE(os.stat(two).st_mode) == 0o755
    assert open(orphan).read() == "import { used as u, type Gone } from './live';\nexport const kept: number = u;\nconsole.log(kept);\n"


def test_a_write_that_fails_leaves_everything_as_it_was(tmp_path, monkeypatch):
    root = plant(tmp_path, {"a.ts": "one\n", "b.ts": "two\n"})
    pending = [fixes.Pending(before={f"{root}/a.ts": "one\n"}, after={f"{root}/a.ts": "1\n"}), fixes.Pending(before={f"{root}/b.ts": "two\n"}, after={f"{root}/b.ts": "2\n"})]
    real, calls = os.replace, []

    def failing(a, b):
        calls.append(b)
        if len(calls) == 2:
            raise OSError("full")
        real(a, b)

    monkeypatch.setattr(os, "replace", failing)
    with pytest.raises(OSError, match="full"):
        fixes.commit(pending)
    assert (tmp_path / "a.ts").read_text() == "one\n" and (tmp_path / "b.ts").read_text() == "two\n" and sorted(os.listdir(root)) == ["a.ts", "b.ts"]


def test_entries_of_frameworks_registries_and_packages(spark, tmp_path):
    root = plant(tmp_path, {
        "package.json": {"dependencies": {"next": "1"}, "workspaces": ["libs/*"]}, "registry.json": {"items": [{"files": ["ui/listed.ts", {"path": "ui/object.ts"}]}]},
        "ui/listed.ts": "export const listed = 1;\n", "ui/object.ts": "export const object = 1;\n", "ui/free.ts": "export const free = 1;\n", "app/page.tsx": "export default function Page() { return 1; }\n",
        "_registry.ts": "export const all = [{ path: './ui/named.ts' }];\n", "ui/named.ts": "export const named = 1;\n",
        "libs/x/package.json": {"name": "@l/x"}, "libs/x/src/y.ts": "export const inPackage = 1;\n", "libs/z/package.json": {"name": "@l/z"}, "libs/z/src/w.ts": "export const unasked = 1;\n",
        "main.ts": "import { inPackage } from '@l/x/src/y';\nconsole.log(inPackage);\n",
    })
    dead = {i["symbol"] for i in of([r.asDict(True) for r in scan(spark, root, only=["dead-code"], verbose=True).issues.collect()], "dead-code")}
    assert {"free", "unasked"} <= dead and not {"listed", "object", "Page", "inPackage"} & dead


@pytest.mark.parametrize(
    ("rel", "code", "spared"),
    [
        ("app/api/route.ts", "export async function GET(id: string) { const x = 1; return x; }", True), ("lib/api.ts", "export async function GET(id: string) { const x = 1; return x; }", False),
        ("app/page.tsx", "export default async function Page() { const x = 1; return x; }", True), ("app/page.tsx", "export async function helper() { const x = 1; return x; }", False),
        ("pages/a.tsx", "export async function getStaticProps() { const x = 1; return x; }", True), ("pages/api/go.ts", "export default async function handler() { const x = 1; return x; }", True),
        ("lib/act.ts", "'use server';\nexport async function act() { const x = 1; return x; }", True), ("middleware.ts", "export default async function middleware() { const x = 1; return x; }", True),
    ],
)
def test_framework_conventions(spark, rel, code, spared):
    functions = extract(spark.createDataFrame([(f"/r/{rel}", rel, code)], "file string, rel string, text string"))
    assert findings.useless_async(relation(functions, "functions")).isEmpty() is spared


def test_path_rules(spark):
    paths = {"a.gen.ts": "generated", "x/b_pb.js": "generated", "c.pb.ts": "generated", "models/d.ts": "layered", "src/entities.ts": "", "schema/e.ts": "layered", "vendor/f.ts": "skipped", "lib/g.stories.tsx": "skipped", "benchmarks/h.ts": "skipped", "lib/i.ts": ""}
    rows = spark.createDataFrame([(p, "") for p in paths], "rel string, text string")
    got = rows.select("rel", rules.is_generated(F.col("rel"), F.col("text")).alias("generated"), F.col("rel").rlike(rules.LAYERED).alias("layered"), F.col("rel").rlike(rules.ORPHAN_SKIP).alias("skipped")).collect()
    assert {r["rel"]: next((k for k in ("generated", "layered", "skipped") if r[k]), "") for r in got} == paths


def statements(n, start=0):
    return "".join(f"  const a{k} = rows.map((r) => r * {k} + b{k}(r, total));\n" for k in range(start, start + n))


def duplicates_of(spark, tmp_path, files):
    root = plant(tmp_path, {"package.json": {}} | files)
    return [i.asDict(True) for i in scan(spark, root, only=["duplicates"], verbose=True).issues.collect()]


def test_matches_are_clipped_to_function_bodies(spark, tmp_path):
    outside = "".join(f"const c{k} = rows.map((r) => r * {k} + d{k}(r, total));\n" for k in range(8))
    assert duplicates_of(spark, tmp_path / "o", {"a.ts": outside, "b.ts": "// other\n" + outside}) == []  # code outside functions never matches
    found = duplicates_of(spark, tmp_path / "i", {"a.ts": f"{outside}export function one(rows, total) {{\n{statements(8)}}}\n", "b.ts": f"{outside}\nexport function two(rows, total) {{\n{statements(8)}}}\n"})
    windows = [i for i in found if "AST shape" not in i["preview"]]
    assert len(windows) == 1 and {p["file"].rsplit("/", 1)[1] for p in [windows[0]["primary"], *windows[0]["matches"]]} == {"a.ts", "b.ts"}
    assert windows[0]["primary"]["line"] >= 9  # what lies before the function is cut off


def test_siblings_in_a_list_are_not_copies(spark, tmp_path):
    item = lambda n: "{ run: (rows, total) => {\n" + statements(6) + f"  return a0 + {n};\n" + "} },\n"
    listed = "export const all = [\n" + item(1) + item(2) + "];\n"
    apart = "export const one = " + item(1).rstrip(",\n") + ";\nexport const two = " + item(2).rstrip(",\n") + ";\n"
    windows = lambda found: [i for i in found if "AST shape" not in i["preview"]]
    assert windows(duplicates_of(spark, tmp_path / "l", {"a.ts": listed})) == []
    assert windows(duplicates_of(spark, tmp_path / "a", {"a.ts": apart}))


def test_long_and_short_files_are_left_out_of_duplicates(spark, tmp_path):
    body = f"export function one(rows, total) {{\n{statements(8)}}}\n"
    assert duplicates_of(spark, tmp_path / "l", {"a.ts": body, "b.ts": body.replace("one", "two") + "\n" * 5000}) == []
    assert duplicates_of(spark, tmp_path / "s", {"a.ts": "export function f(x) { return x + 1; }\n", "b.ts": "export function g(x) { return x + 1; }\n"}) == []


@pytest.mark.parametrize(("package", "path"), [("next", "app/x/page.tsx"), ("@sveltejs/kit", "src/routes/+page.ts"), ("astro", "src/pages/a.ts"), ("@remix-run/react", "app/routes/a.tsx"), ("nuxt", "composables/a.ts"), ("@solidjs/start", "src/routes/a.tsx"), ("@builder.io/qwik", "src/routes/a.tsx")])
def test_frameworks_name_their_entries(spark, tmp_path, package, path):
    def dead(name, deps):
        root = plant(tmp_path / name, {"package.json": {"devDependencies": deps}, path: "export const thing = 1;\n", "lib/other.ts": "export const other = 1;\n"})
        return {i["symbol"] for i in scan(spark, root, only=["dead-code"], verbose=True).issues.collect() if i["kind"] == "dead-code"}

    assert dead("with", {package: "1"}) == {"other"} and "thing" in dead("without", {})


def test_registry_files_name_entries_beside_and_above_them(spark, tmp_path):
    root = plant(tmp_path, {
        "package.json": {}, "ui/_registry.ts": "export const all = [{ path: 'beside.ts' }, { path: 'above.ts' }, { path: 'both.ts' }];\n", "ui/beside.ts": "export const beside = 1;\n", "above.ts": "export const above = 1;\n",
        "ui/both.ts": "export const both = 1;\n", "both.ts": "export const upperBoth = 1;\n", "ui/free.ts": "export const free = 1;\n",
    })
    dead = {i["symbol"] for i in scan(spark, root, only=["dead-code"], verbose=True).issues.collect() if i["kind"] == "dead-code"}
    assert {"free", "upperBoth"} <= dead and not {"beside", "above", "both"} & dead


def test_a_package_import_keeps_what_it_names_in_that_package(spark, tmp_path):
    root = plant(tmp_path, {
        "package.json": {"workspaces": ["libs/*"]}, "libs/x/package.json": {"name": "@l/x"}, "libs/x/src/y.ts": "export const same = 1;\n", "libs/z/package.json": {"name": "@l/z"}, "libs/z/src/w.ts": "export const same = 2;\n",
        "main.ts": "export { same } from '@l/x';\n",
    })
    dead = {os.path.relpath(i["location"]["file"], root) for i in scan(spark, root, only=["dead-code"], verbose=True).issues.collect() if i["symbol"] == "same"}
    assert dead == {"libs/z/src/w.ts"}
