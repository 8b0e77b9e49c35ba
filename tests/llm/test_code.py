import ast
import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import docpairs, origin, parsing
from quarryline.llm.corpus import assemble, current_chunks
from quarryline.llm.grammar import analyse, syntax_error
from quarryline.functions.lexers import json_error

FILES = "file_id long, repo_id int, relative_path string, hash string, size long, last_modified timestamp, language string, starts int"
CHUNKS = "file_id long, repo_id int, relative_path string, chunk_id string, ordinal int, start_line int, end_line int, content string, file_hash string, language string"
t = lambda n: dt.datetime(2025, 1, n)

JS = "import { a as b } from './x.js';\nexport class Q extends P {\n  static async go(x = [], ...y) {\n    const r = /[({\\[]+/g.exec(`t-${x.map((z) => `${z}`)}-1`);\n    return x?.y ?? 3 / 2;\n  }\n  #p = 1;\n}\nfor (const k of q) { if (k) go(k); }\nlabel: for (;;) { break label; }\n"
TS = "interface R { id: number; t?: string | null; readonly q: ReadonlyArray<string> }\ntype E<T> = T extends readonly (infer U)[] ? U : never;\nexport async function f(a: Array<{ id: number }>, b?: Record<string, unknown>): Promise<string[]> {\n  return a!.map((x) => [x as any, <const>['q'], { k: 1 } as const]);\n}\n"
JAVA = 'package a.b;\nimport static a.Loader.*;\n\n@Deprecated(since = "1")\npublic class A<T extends B> {\n    private final Map<String, List<T>> m = new HashMap<>();\n    <U> U go(final List<? extends U> x) throws IOException {\n        for (var i : x) { if (i == null) continue; log.info("x } {}", \'{\'); }\n        String s = """\n            text "quoted" {\n            """;\n        return (U) x.get(0);\n    }\n}\n'


@pytest.mark.parametrize("language,text", [("javascript", JS), ("typescript", TS), ("typescript", JS), ("java", JAVA), ("python", ""), ("javascript", ""), ("java", ""), ("json", '{"a": [1, null, "\\u00e9", {}]}'), ("python", "def f():\n    '''=======\n    ('''\n    return f\"{1}\"\n")])
def test_valid_texts(language, text):
    assert syntax_error(text, language) == ""
    assert syntax_error(text.replace("\n", "\r\n"), language) == ""


BROKEN = [
    ("javascript", TS), ("javascript", JAVA), ("javascript", "import os\nimport re\n"), ("javascript", JS + "<<<<<<< HEAD\nx\n"), ("javascript", JS[:-9]), ("javascript", JS.replace("'./x.js'", "'./x.js")), ("javascript", "const {{ name }} = 1;\n"), ("javascript", "const <%= a %> = 1;\n"),
    ("typescript", JAVA), ("typescript", "def f(x):\n    return x\n"), ("typescript", TS + "=======\n"), ("typescript", "go((x);\n"), ("typescript", "const x = “a”;\n"), ("typescript", "<!DOCTYPE html>\n<html></html>\n"), ("java", JS), ("java", TS), ("java", "{\"a\": 1}\n"), ("java", JAVA[:-2]), ("java", JAVA.replace("'{'", "'{")),
    ("java", JAVA.replace("String s = ", "String s = ;\nint ")), ("java", "import os\nimport re\n"), ("java", "version pointer-v1\noid sha256:ab\nsize 1\n"), ("python", JS), ("python", "def f():\n\treturn 1\n        x\n"), ("python", "x = (1\n"), ("python", "if x:\n"), ("json", ""), ("json", '{"a": 1,}'), ("json", "{'a': 1}"), ("json", '{"a" 1}'), ("json", "[1] x"), ("json", "[NaN]"),
]


@pytest.mark.parametrize("language,text", BROKEN)
def test_broken_texts(language, text):
    assert syntax_error(text, language)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]:,"\\ 1e-.truefalsn\n', max_size=25))
def test_json_automaton_equals_the_reader(text):
    try:
        json.loads(text, parse_constant=lambda s: 1 / 0)
        good = True
    except (ValueError, ZeroDivisionError):
        good = False
    assert (json_error(text) == "") == good


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["def f(a):", "    return a", "x = [1,", "2]", "'''doc", "'''", "# c (", "if x:", "    pass", "", "\ty = 1", "s = 'a'"]), max_size=8))
def test_python_lexer_never_flags_what_parses(lines):
    text = "\n".join(lines) + "\n"
    try:
        ast.parse(text)
    except SyntaxError:
        return
    assert syntax_error(text, "python") == ""


def test_assemble_overlapping_chunks():
    text = "\n".join(f"l{i}" for i in range(1, 21)) + "\n"
    lines = text.split("\n")
    cut = [(1, 8), (7, 15), (7, 15), (9, 12), (15, 21)]
    assert assemble([a for a, _ in cut], [b for _, b in cut], ["\n".join(lines[a - 1 : b]) for a, b in cut]) == text


def rows(*texts):
    files = [(i, i % 3, p, f"h{i}", None, t(2), "", 0) for i, (p, _) in enumerate(texts)]
    chunks = [(i, i % 3, p, f"c{i}", 0, 1, (x or "").count("\n") + 1, x, f"h{i}", "") for i, (p, x) in enumerate(texts)]
    return files, chunks


def test_current_text_and_states(spark):
    files, chunks = rows(("a.py", "x = 1\n"), ("b.py", "x = (\n"), ("c.js", None), ("d.TXT", "x"), ("e.json", ""), ("f.py", ""))
    files += [(0, 0, "a.py", "old", 1, t(1), "", 0), files[0], (None, 0, "z.py", "h", 1, t(1), "", 0), (9, 0, None, "h9", 1, t(1), "", 0)]
    chunks += [(0, 0, "a.py", "o", 0, 1, 1, "x = ((", "old", ""), chunks[0], (None, 0, "", "", 0, 1, 1, "x", None, "")]
    f, c = spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS)
    got = {r.file_id: r.error is None for r in parsing.parse_states(f, c).collect()}
    assert got == {0: True, 1: False, 4: False, 5: True}
    rates = {(r.repo_id, r.language): (r.files, r.invalid) for r in parsing.invalid_rates(parsing.parse_states(f, c)).collect()}
    assert rates[1, "python"] == (1, 1) and rates[1, "json"] == (1, 1)
    assert parsing.parse_states(f.limit(0), c.limit(0)).count() == 0
    assert current_chunks(f, c.limit(0)).count() == 0


DOCS = '/** Adds two numbers for the total. @param a the a */\nfunction tooFar() {}\n/**\n * Adds two numbers.\n *\n * @param a x\n */\nexport async function addAll(a, b) { return 1; }\n/** Add all. */\nconst addAll2 = function () {};\n/** @param x y */\nconst other = (x) => x;\n/** TODO: write this */\nfunction later() {}\n/** Keeps rows. */\nclass K {\n  /** Reads one row from the store. */\n  static async read(x = [], y) { if (x) { return y; } }\n  /** Only a field. */\n  field = 3;\n}\nconst s = "/** No. */ function no() {}";\n'


def test_functions_of_scripts():
    error, lexed = analyse(DOCS, "javascript")
    assert not error
    found = {(n, line): d for line, n, d, _ in docpairs.functions(DOCS, "javascript", lexed)}
    told = {k for k, d in found.items() if not docpairs.trivial(d, k[0])}
    assert told == {("tooFar", 2), ("addAll", 8), ("read", 18)}
    code = {n: c for _, n, _, c in docpairs.functions(DOCS, "javascript", lexed)}
    assert code["read"].endswith("return y; } }") and code["addAll"].startswith("export async function")


def test_functions_of_java_and_typescript():
    java = "class A {\n/** Counts rows of a table. */\n@Test(x = 1)\n@Other\npublic static <T> Map<String, List<T>> count(\n  final int x\n) throws E {\n return null; }\n/** A field. */ int f = 3;\n/** A type. */ class B {}\n}\n"
    _, lexed = analyse(java, "java")
    assert [(line, n) for line, n, _, _ in docpairs.functions(java, "java", lexed)] == [(5, "count")]
    ts = "/** Sorts what it gets. */\nexport const sorter = async <T>(x: Array<{ id: T }>): Promise<{ a: T }> => { return x; };\n/** Says no. */\nabstract class Q { /** Loads it from disk. */ private load(a?: string): { x: number } { return { x: 1 }; } }\n"
    _, lexed = analyse(ts, "typescript")
    assert [(line, n) for line, n, _, _ in docpairs.functions(ts, "typescript", lexed)] == [(2, "sorter"), (4, "load")]


def test_python_functions_equal_the_parser():
    text = 'class A:\n    """Class."""\n    @x\n    async def f(\n        self,\n    ) -> dict[str, int]:\n        r"""Reads a thing (once.\n\n        Args:\n            self: it\n        """\n        def g(): "Says a lot"; return 1\n    def h(self):\n        f"""not a docstring"""\n    def i(self):\n        "a" "b"\n    def j(self):\n        "a".x()\n'
    _, lexed = analyse(text, "python")
    got = [(line, n) for line, n, _, _ in docpairs.functions(text, "python", lexed)]
    want = [(x.lineno, x.name) for x in ast.walk(ast.parse(text)) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) and ast.get_docstring(x) is not None]
    assert sorted(got) == sorted(want)
    assert docpairs.docstring_description("Reads.\n\nArgs:\n    a: b\n\nMore text.") == "Reads.\n\nMore text."


def test_trivial():
    for d in ("", " .", "----", "TODO", "FIXME describe later", "Load the row.", "loads", "A load"):
        assert docpairs.trivial(d, "loadRow") == (d != "loads")
    assert not docpairs.trivial("TODO later\nReturns the greatest row.", "loadRow")


def test_pairs_of_rows(spark):
    files, chunks = rows(("a.js", DOCS), ("b.js", DOCS + "("), ("c.py", None))
    f, c = spark.createDataFrame(files * 2, FILES), spark.createDataFrame(chunks * 2, CHUNKS)
    got = docpairs.documented_functions(f, c).collect()
    assert {(r.file_id, r.line_no, r.function_name) for r in got} == {(0, 2, "tooFar"), (0, 8, "addAll"), (0, 18, "read")} and len(got) == 3
    assert docpairs.documented_functions(f.limit(0), c.limit(0)).count() == 0


def hand(i):
    return f"import os\nimport re\n\nclass Store{i}:\n    def load_{i}(self, rows):\n        # keep the order of rows here\n        for row in rows:\n            if row and len(row) > {i}:\n                self.handle(row, limit={i * 7})\n        return sorted(rows, key=lambda r: r.name{i})\n\n    def handle(self, row, limit):\n        value = self.cache.get(row.name, limit)\n        raise RuntimeError('failed {i}')\n"


def machine(i):
    return f"_sym = {{}}\n\nclass D{i}:\n" + "".join(f"    FIELD_{k:04d} = _sym.setdefault({k}, ('x{i}', {k}, 4, 0x{k:04x}))\n" for k in range(i, i + 40))


def test_foreign_files(spark):
    texts = [(f"src/h{i}.py", hand(i)) for i in range(40)] + [(f"gen/m{i}.py", ("# Code generated by tool v1. DO NOT EDIT.\n" if i % 2 else "") + machine(i)) for i in range(20)]
    texts += [("a/table.py", "X = [\n" + ",\n".join(", ".join(f"{(7 * k * j) % 97 / 13:.5f}" for k in range(8)) for j in range(40)) + ",\n]\n"), ("lib/one.py", hand(99)), ("other/two.py", "# MIT licence, (c) the x contributors\n" + hand(99)), ("src/hand.py", "# Do not edit the order of this list without asking.\n" + hand(77)), ("bad.py", "# @generated by x\n" + machine(5) + "("), ("e.py", ""), ("n.py", None)]
    files, chunks = rows(*texts)
    got = {r.relative_path: r for r in origin.foreign_files(spark.createDataFrame(files * 2, FILES), spark.createDataFrame(chunks * 2, CHUNKS)).collect()}
    assert set(got) == {f"gen/m{i}.py" for i in range(20)} | {"a/table.py", "lib/one.py", "other/two.py"}
    assert got["lib/one.py"].copied and got["other/two.py"].notice == "third party"
    empty = origin.foreign_files(spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS))
    assert empty.count() == 0
