"""Copies that differ in white space only, and what the forest makes of copies and of declared data."""

from quarryline.llm import origin
from tests.llm.test_code import CHUNKS, FILES, hand, rows

NOTICE = "# Copied from the sparrow project, release 1.2; see upstream for changes\n"


def found(spark, texts):
    files, chunks = rows(*texts)
    return {r.relative_path: r for r in origin.foreign_files(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS)).collect()}


def test_copies_differ_in_white_space(spark):
    texts = [(f"src/h{i}.py", hand(i)) for i in range(100, 200)]
    texts += [x for i in range(210, 240) for x in ((f"vendor/v{i}.py", NOTICE + hand(i)), (f"src/v{i}.py", hand(i)))]
    odd = [("a/lf.py", hand(299)), ("b/crlf.py", hand(299).replace("\n", "\r\n")), ("c/tabs.py", hand(298).replace("    ", "\t")), ("d/blanks.py", hand(298)), ("e/trail.py", hand(298).replace("\n", "  \n"))]
    got = found(spark, texts + odd)
    assert {p for p, _ in odd} <= set(got) and all(got[p].copied for p, _ in odd)
    assert all(got[f"vendor/v{i}.py"].notice == "third party" and got[f"src/v{i}.py"].notice == "" for i in range(210, 240))
    assert not any(p.startswith("src/h") for p in got)


def test_copies_without_any_notice_tell_nothing(spark):
    assert found(spark, [("a/x.py", hand(1)), ("b/y.py", hand(1)), ("c/z.py", hand(2))]) == {}


def test_notices_are_hidden():
    cases = [
        ("javascript", "const a = 1;\nfunction f(b) { return a + b; }\n//# sourceMappingURL=x.js.map", "compacted"), ("json", '{"lockfileVersion": 3, "packages": {"a": 1}}', "record"), ("json", "[1, 2, 3]", "data"), ("json", '{"name": "x", "rows": [1, 2]}', ""),
        ("typescript", "export const rows: number[][] = [[1, 2], [3, 4]];", "data"), ("java", 'final class R {\n  static final String[] V = {"a", "b"};\n}', "data"), ("python", "ROWS = [1, 2]\n", "data"), ("python", "ROWS = [f(x) for x in y]\ndef g(): pass\n", ""), ("javascript", "const f = (a) => a + 1;", ""),
    ]
    for language, text, notice in cases:
        got, rest = origin.notice_of("", text, language)
        assert got == notice, text
        assert len(rest) == len(text) if not notice else text.endswith(rest) or text.startswith(rest), text
    assert origin.notice_of("// Code generated by x. DO NOT EDIT.", "const a = 1;", "javascript")[0] == "generated"
