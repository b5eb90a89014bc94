import pytest

from loomgrain.frontend.facts import facts_of, targets_of
from loomgrain.frontend.parser import parse
from loomgrain.frontend.scanner import tokenize


def norms(source):
    return [t[0] for t in tokenize(source)]


def test_tokens_lose_names_and_literals_but_not_words():
    assert norms("const total = price * 2;") == ["const", "$ID", "=", "$ID", "*", "$LIT", ";"]
    assert norms("type Of = string") == ["type", "$ID", "=", "string"]


def test_templates_go_on_after_their_braces():
    assert norms("`a${x + {y: 1}.y}b${z}c`;") == ["$LIT", "$ID", "+", "{", "$ID", ":", "$LIT", "}", ".", "$ID", "$LIT", "$ID", "$LIT", ";"]


def test_closing_angles_come_singly_and_comments_are_trivia():
    assert norms("a >>= b // c\n/* d */ e") == ["$ID", ">", ">", "=", "$ID", "$ID"]
    assert [t[2] for t in tokenize("a\n\nb")] == [1, 3]


def test_imports_are_not_tokens_but_local_export_lists_are():
    f = facts_of("x.ts", "import { a } from './a';\nexport * from './b';\nexport { a };\n")
    assert [t["text"] for t in f["tokens"]] == ["export", "{", "a", "}", ";"]


@pytest.mark.parametrize(
    "source",
    [
        "const f = async <T,>(x: T): Promise<T[]> => { await g<number>(x); return [x] };",
        "class A<T> extends B<T> implements C { private readonly x?: number = 1; static #y = 2; get z() { return this.x } @d() m(@p() a: string): void {} [k: string]: unknown; }",
        "for (const [a, { b = 1, ...c }] of xs) if (a) continue; else break;",
        "type F<T> = T extends (infer U)[] ? { [K in keyof U]?: U[K] } : never;",
        "const el = <A.B x={1} {...p}>hi {x ? <i/> : null} <></></A.B>;",
        "label: while (1) { switch (x) { case 1: break label; default: y = /[/]x/g.test(z) } }",
        "declare module 'x' { export function f(a: number): string }\nnamespace N.M { export const q = 1 }",
        "export default abstract class { constructor(private a = 1) { super() } }",
        "let v = a ? (b) : (c) => d; const w = (x) ? y : z; v ??= w?.[0]?.(1)!;",
        "function is(x: unknown): x is string { return typeof x === 'string' }\nfunction a(x: any): asserts x {}",
        "enum E { A = 1, 'b' }\nabstract class Q { abstract m(): void }\nimport type { T } from 't'; export type { T } from 't';",
    ],
)
def test_parses_whole(source):
    assert not [n for n in parse(source, "x.tsx").walk() if n.kind == "Unparsed"]


def test_a_broken_statement_does_not_take_the_rest():
    f = facts_of("x.ts", "const = ;;; {{{ \nexport function ok() { return 1; }\n")
    assert [d["symbol"] for d in f["decls"]] == ["ok"]


def wrappers(source, path="x.tsx"):
    return {f["name"]: f["wrapper_call"] for f in facts_of(path, source)["functions"] if f["wrapper_call"]}


def test_wrappers():
    assert wrappers("function a(x, y) { return b(x, y); }") == {"a": "b(x, y)"}
    assert wrappers("const a = async (x) => await api.get(x) as T;") == {"a": "api.get(x)"}
    assert wrappers("function a(x) { const r = b(x); return r; }") == {"a": "b(x)"}
    assert wrappers("const Box = ({ ...rest }) => (<Inner {...rest} />);") == {"Box": "<Inner {...rest} />"}


@pytest.mark.parametrize(
    "source",
    [
        "function a(x, y) { return b(y, x); }", "function a(x = 1) { return b(x); }", "function a(x) { return b(x + 1); }", "function a() { return b(); }", "function a<T>(x: T) { return b(x); }",
        "const a: Fn = (x) => b(x);", "/** @deprecated */\nfunction a(x) { return b(x); }", "const a = (x) => [1].includes(x);", "const a = (x) => re.test(x);", "class A { m(x) { return this.n(x); } }",
        "class A extends B { m(x) { return n(x); } }", "const a = (x) => make().get(x);", "function a(x) { return a(x); }", "function run(x) { return _run(x); }", "const f = useCallback((x) => b(x));",
        "const o = { m(x) { return n(x); } } as T; call({ m(x) { return n(x); } });", "const Box = (p) => <Inner {...p} extra />;", "const Box = (p) => <Inner {...p}>text</Inner>;",
        "function a(x) { log(); const r = b(x); return r; }", "function a({ x }) { return b(x); }", "function is(x): x is T { return b(x); }",
    ],
)
def test_not_wrappers(source):
    assert {k: v for k, v in wrappers(source).items() if k != "m" or "call(" not in source} == {}


def test_type_guards():
    def collapsed(body, ret="x is T"):
        return facts_of("x.ts", f"const f = (x: unknown): {ret} => {body};")["functions"][0]["collapses_to"]

    assert collapsed("typeof x === 'string'") == 'typeof x === "string"'
    assert collapsed("'number' != typeof x") == 'typeof x != "number"'
    assert collapsed("x !== null") == "x !== null" and collapsed("x instanceof Date") == "x instanceof Date" and collapsed("Array.isArray(x)") == "Array.isArray(x)"
    assert collapsed("x.kind === 'a'") is None and collapsed("list.includes(x)") is None and collapsed("typeof x === 'string'", "boolean") is None


def test_async_and_catches():
    def idle(source):
        return [f["name"] for f in facts_of("x.ts", source)["functions"] if f["idle_async"]]

    assert idle("async function a(n) { const k = n + 1; return k; }") == ["a"]
    for quiet in ("async function a() { await b(); }", "async function a() { for await (const x of y) z(x); }", "async function a() { return b(); }", "async function a() { return new Promise(r); }", "async function a(): Promise<number> { return 1; }", "async function a(_x) {}", "const a: F = async () => 1;"):
        assert idle(quiet) == []
    assert idle("async function a() { return [1].map(async (x) => { await x; }).length; }") == ["a"]

    def catches(source):
        return [(c["swallows_all"], c["rethrows_only"]) for c in facts_of("x.ts", source)["catches"]]

    assert catches("try { a() } catch {}") == [(True, None)] and catches("try { a() } catch (e) {}") == [(False, None)] and catches("try { a() } catch (e) { throw e }") == [(False, True)]
    for quiet in ("try { a() } catch (_e) {}", "try { a() } catch { /* fine */ }", "try { a() } catch {} // fine", "try { a() } catch (e) { throw e.cause }", "try { a() } catch (e) { log(e); throw e }"):
        assert catches(quiet) == []


def test_local_uses_respect_scopes():
    source = "const a = 1;\nconst b = 2;\nfunction f(a: number) { return a; }\nfunction g() { const b = 3; return b; }\nconsole.log(f(b), g);\n"
    assert {d["symbol"]: d["local_uses"] for d in facts_of("x.ts", source)["decls"]} == {"a": 0, "b": 1, "f": 1, "g": 1}


def test_shapes_of_types():
    f = facts_of("x.ts", "interface A { b?: string ; a: number; c(x: number): void }\ntype B = { c(x:number): void, a: number, b?: string };\ntype C = { a: number; b: string; c(x: number): void };")
    members = {t["name"]: t["members"] for t in f["types"]}
    assert members["A"] == members["B"] != members["C"]


def test_targets():
    assert targets_of("src/a/b.ts", "../c.js", []) == ["src/c.js"]
    assert targets_of("src/a.ts", "@/lib/x", [("@/", "", ["src/*"])]) == ["src/lib/x"]
    assert targets_of("src/a.ts", "react", []) == []
