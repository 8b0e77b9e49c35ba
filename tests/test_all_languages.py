"""Code structure over the chunks of all languages."""

from quarryline.plans.reference_rank import query

CHUNKS = [
    ("py", "a/x.py", "def one(a):\n    return a\n\none(1)\n"), ("js", "x.js", "function two(a, b) {\n}\ntwo(1, 2);\n"), ("ts", "x.ts", "function three(a, b) {\n}\nthree(1, 2);\n"),
    ("java", "X.java", "public class Four {\n}\n"), ("json", "x.json", "{}"), ("none", None, "x"), ("odd", "x.zig", "function five(a) {\n}"), ("null", "y.py", None),
]


def test_all_languages(spark, tmp_path):
    spark.createDataFrame(CHUNKS, "chunk_id string, relative_path string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    run = lambda name: query.queries[f"ref_{name}"](spark, str(tmp_path)).collect()
    kinds = {r.chunk_id: r.kind for r in run("K01_structure_kind")}
    assert kinds == {"py": "function", "js": "function", "ts": "function", "java": "class", "json": "code", "none": "code", "odd": "code"}
    assert {(r.chunk_id, r.callee) for r in run("J12_call_edges")} >= {("py", "one"), ("js", "two"), ("ts", "three")}
    assert {(r.chunk_id, r.parameters) for r in run("K15_parameters")} == {("js", "a, b"), ("ts", "a, b"), ("odd", "a")}
