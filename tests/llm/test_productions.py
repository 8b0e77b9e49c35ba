"""Valid and invalid pieces of Java, JavaScript and TypeScript."""

import pytest

from quarryline.llm.grammar import syntax_error


def java(body: str) -> str:
    return f"class A {{ int f(int x) {{ {body} }} }}"


JAVA_BAD = [
    "int x = 1 int y = 2;", "int a = b int c = 2;", "int a = f() int c = 2;", "return 1", "if x > 1 { return 1; }", "x = 1; else { return 2; }", "if (x > 1) { return 1; } x = 2; y(); else { return 3; }", "if (x > 1) { a(); } else { b(); } else { c(); }",
    "if (a) { x(); } else if (b) { y(); } else { z(); } else { w(); }", "for (int i = 0; i < 3) { a(); }", "for (int i = 0) { a(); }", "while { a(); }", "try { a(); } return 1;", "try { a(); }", "catch (E e) { a(); }", "finally { a(); }", "case 1: return 2;", "switch x { case 1: return 2; }",
    "return new;", "throw;", "f(, 1);", "f(1,);", "x = ;", "int[] v = {1, 2} return v;", "Runnable r = () -> { a() };", "do { a(); } while;",
]
JAVA_GOOD = [
    "return switch (x) { case 1 -> 2; case 3: yield 3; default -> { int y = x; yield y; } };", "switch (x) { case 1: case 2: a(); break; default: }", "int[] v = {1, 2, 3}; int[][] w = {{1}, {2}}; return v[0];", "for (int i = 0, j = 1; i < 3; i++, j--) { a(); } for (var q : w) b(q); for (;;) { break; }", "if (x > 1) return 1; else return 2;",
    "if (x > 1) { a(); } else if (x < 1) { b(); } else { c(); }", "if (a) for (int i : v) b(); else c();", "if (a) if (b) { c(); } else { d(); } else { e(); }", "try (R r = open()) { a(r); }", "try { a(); } catch (E | F e) { b(); } finally { c(); }", "Runnable r = () -> { a(); }; Object o = new Object() { int g() { return 1; } };",
    "List<int[]> v = new ArrayList<>(); int y = (int) x; long z = 1L;", "do { a(); } while (x > 1); label: while (true) { break label; }", "Map<String, List<Integer>> m = of(1, 2); return m.get(1).size() > 1 ? 1 : 2;", "int a = 1, b = 2; char c = 'x'; @SuppressWarnings({\"a\", \"b\"}) int d = a < b ? a : b;", "{ int y = 1; } synchronized (this) { a(); }",
    "if (o instanceof String s && s.length() > 1) { return 1; } assert x > 1 : \"no\"; throw new E();",
]
JAVA_FILES_GOOD = [
    "enum E { A, B(1) { int g() { return 1; } }, C; int f() { return 1; } }", "enum E { A, B }", "package a.b;\nimport static a.B.*;\n@interface X { int value() default 1; String[] names() default {}; }", "record P(int x, int y) { P { if (x < 0) throw new E(); } }", "interface I extends J, K { default int f() { return 1; } int g(); }",
    "abstract class A<T extends B & C> extends D<T> implements E, F { static { a(); } abstract int g() throws X; @A({\"x\"}) int[] v = {1}; }", "sealed interface S permits A, B { }", "class A { void f() { } }\n;",
]
SCRIPT_BAD = [
    "if x > 1 { a(); }", "for (let i = 0; i < 3) { a(); }", "for (x) { a(); }", "let a = 1, let b = 2;", "let a = 1, const b = 2;", "try { a(); }", "try { a(); } b();", "try a();", "case 1: x();", "const x;", "const x = ;", "while { a(); }", "switch (a) { case 1: b(); } case 2: c();", "function { a(); }", "class A extends { }",
    "x = 1; else { a(); }", "if (a) { b(); } else { c(); } else { d(); }", "a + ", "a.", "throw;", "new;", "f(, 1);", "const o = { a: 1\n b: 2 };", "const o = { a: f(1)\n 'b': 2 };", "} finally { a(); }", "x = 2\nfinally { a(); }", "const f = (a, b = > a;",
]
SCRIPT_GOOD = [
    "if (a) b(); else c();", "if (a) b()\nelse c()", "if (a) { b() } else if (c) { d() } else { e() }", "if (a) if (b) { c() } else { d() } else { e() }", "for (let i = 0; i < 3; i++) { a(i) }", "for (const [k, v] of m) a(k)", "for (const k in m) { a(k) }", "async function f() { for await (const x of y) { z(x) } }", "let a = 1, b = 2\nconst c = 3",
    "try { a() } catch { b() }", "try { a() } catch (e) { b(e) } finally { c() }", "switch (a) { case 1: { b(); break } case 2: default: c() }", "const o = { a: 1, 'b': x ? y : z, c: x ? f(1) : g(2), d() { return 1 }, get e() { return 2 }, if: 1, case: 2, catch: 3, [k]: 4, ...r }", "class A extends B { static x = 1; catch(e) { return e } finally() { } async *g() { yield 3 } get if() { return 1 } }",
    "const f = async (a, b = 2) => ({ a: a ? b : 1 }), g = x => { return { y: x } }", "export default { a: 1 }\nexport { x as default }", "import a, { b as c } from './d'\nimport * as e from 'f'\nimport 'g'", "p.catch(e => 1).finally(() => 2)\nx = a ? b : c ? d : e", "label: for (;;) { break label }", "var x\nlet y\nx = function () { return 1 }\nnew Foo\nnew Bar()", "const { a, b: c } = d, [e, , g] = h", "do { a() } while (b)\nc()", "x = `a ${b ? `c` : d} e`\nr = /a[/]b/g.test(x)",
]
TYPE_BAD = ["let x: = 1", "type A = ", "type A = ;", "enum { A }", "class A implements { }", "interface A extends { }", "if x > 1 { a(); }", "for (let i = 0; i < 3) { }", "try { a(); } b();"]
TYPE_GOOD = [
    "let x: number = 1, y: { a: string\n b?: number } = z", "type A<T extends B = C> = T extends infer U ? { [K in keyof U]?: U[K] } : never", "enum E { A, B = 2 }\nconst enum F { C }", "interface I extends J<K> { if?: string; case: number; f(a: number): void; new (x: string): I }", "declare const V: string;\ndeclare function f(a?: number): asserts a is number;",
    "export abstract class A<T> extends B<T> implements C, D { constructor(private readonly x: number) { super() } abstract g(): void; static async h<K extends keyof T>(k: K): Promise<T[K]> { return this.y![k] } }", "const f = <T,>(x: T): T => x, g = (a: string | undefined) => a as unknown as number", "function f<const T extends readonly unknown[]>(a: T, b: (x: number) => { y: string }): void { }",
    "namespace N { export const a = 1 }\nexport type { X } from './x'\nimport type Y from 'y'", "const o = { a: 1 as const, b: <C>d, e: x! } satisfies F",
]


@pytest.mark.parametrize("text", JAVA_BAD)
def test_java_bad(text):
    assert syntax_error(java(text), "java")


@pytest.mark.parametrize("text", [java(t) for t in JAVA_GOOD] + JAVA_FILES_GOOD)
def test_java_good(text):
    assert not syntax_error(text, "java")


@pytest.mark.parametrize("text", ["class A extends { }", "class A implements { int x; }", "class A { int x = 1 }", "enum { A }", "class A { void f() { } } class", "class A { int f() { } } else { }"])
def test_java_files_bad(text):
    assert syntax_error(text, "java")


@pytest.mark.parametrize("language", ["javascript", "typescript"])
@pytest.mark.parametrize("text", [t for t in SCRIPT_BAD if t != "const x;" and "a: 1\n" not in t and "a: f(1)" not in t and "const b" not in t])
def test_scripts_bad(text, language):
    assert syntax_error(text, language)


@pytest.mark.parametrize("text", SCRIPT_BAD)
def test_javascript_bad(text):
    assert syntax_error(text, "javascript")


@pytest.mark.parametrize("language", ["javascript", "typescript"])
@pytest.mark.parametrize("text", SCRIPT_GOOD)
def test_scripts_good(text, language):
    assert not syntax_error(text, language)


@pytest.mark.parametrize("text", TYPE_BAD)
def test_typescript_bad(text):
    assert syntax_error(text, "typescript")


@pytest.mark.parametrize("text", TYPE_GOOD)
def test_typescript_good(text):
    assert not syntax_error(text, "typescript")
