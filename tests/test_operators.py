import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import text as X
from quarryline.functions import vectors as V
from quarryline.operators import analyzers as N
from quarryline.operators import changes as C
from quarryline.operators import chunkers as K
from quarryline.operators import metrics as M
from quarryline.operators import retrieval as R
from quarryline.operators import summary as P
from quarryline.sources import files as S
from quarryline.streaming import watch as W


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vector_search_goldens(spark):
    rows = [("chunk-1", [0.1, 0.2, 0.3, 0.4]), ("chunk-2", [0.2, 0.3, 0.4, 0.5]), ("chunk-3", [0.8, 0.7, 0.6, 0.5])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    q = [0.15, 0.25, 0.35, 0.45]
    assert [r.id for r in R.dot_search(df, "v", q, 2, 0.0, "id").orderBy(F.desc("dot")).collect()] == ["chunk-3", "chunk-2"]
    got = R.cosine_search(df, "v", q, 2, "id").collect()
    assert [r.id for r in got] == ["chunk-2", "chunk-1"] and got[0].score == pytest.approx(0.9988701838, abs=1e-9)
    with pytest.raises(ValueError):
        R.top_k(df, "id", 0)
    assert one(spark, V.cosine(V.literal([0, 0]), V.literal([1, 1])).alias("z"), V.dot(V.literal([1]), V.literal([1, 2])).alias("n")) == (0.0, None)


def test_bm25_goldens(spark):
    part = lambda tf, df: R.bm25_term(F.lit(float(tf)), F.lit(float(df)), F.lit(100.0), F.lit(800.0), F.lit(1000.0))
    r = one(spark, part(3, 10).alias("a"), part(2, 20).alias("b"), part(2, 0).alias("c"), R.normalised(F.lit(5.0)).alias("d"), R.normalised(F.lit(15.0)).alias("e"), R.hybrid(F.lit(0.8), F.lit(0.6)).alias("h"))
    assert r.a == pytest.approx(3.7789027957, abs=1e-9) and r.b == pytest.approx(2.0882935852, abs=1e-9) and (r.c, r.d, r.e) == (0.0, 0.5, 1.0) and r.h == pytest.approx(0.68)
    assert one(spark, R.query_terms(F.lit("a bb ccc getUserData")).alias("t")).t == ["bb", "ccc", "getuserdata"]


def test_boost_and_explanation(spark):
    b = lambda s, f, k: R.boosted(F.lit(s), F.lit("call load in Store"), F.lit(f), F.lit(k))
    r = one(spark, b(0.5, "load", None).alias("f"), b(0.5, None, "store").alias("k"), b(0.5, "load", "store").alias("b"), b(0.9, "load", None).alias("cap"), b(0.5, "", "").alias("n"))
    assert [round(x, 6) for x in r] == [0.6, 0.575, 0.575, 1.0, 0.5]


def test_chunkers(spark):
    assert K.boundary_ranges("A" * 10000, 4000, 0.1) == [(0, 4000), (3600, 7600), (7200, 10000)]
    lines = "\n".join(f"Line {i}: Some content here" for i in range(1, 201))
    got = K.boundary_ranges(lines, 1000)
    assert all(e - s <= 1200 for s, e in got) and got[0][0] == 0 and got[-1][1] == len(lines)
    assert K.boundary_ranges("  \n ") == [] and K.boundary_ranges("Small text content") == [(0, 18)]
    df = spark.createDataFrame([(1, "\n".join(["x" * 99] * 100)), (2, "y" * 5000 + "\nshort"), (3, ""), (4, None)], "id int, t string")
    got = {(r.id, r.start_line, r.end_line, r.size) for r in K.line_chunks(df, "t").collect()}
    assert got == {(1, 1, 40, 4000), (1, 36, 75, 4000), (1, 71, 100, 3000), (2, 1, 1, 5001), (2, 1, 2, 5007)}
    assert [(r.chunk_no, len(r.chunk)) for r in K.fixed_chunks(df, "t").where("id = 2").orderBy("chunk_no").collect()] == [(0, 4000), (1, 1606)]


def test_token_batches(spark):
    r = one(spark, K.token_batches(F.array(*[F.lit(x) for x in (300, 300, 100, 700, 10)]), 600).alias("b"), K.token_batches(F.array(F.lit(1), F.lit(1), F.lit(1)), 600, 2).alias("c"))
    assert r.b == [0, 0, 1, 2, 3] and r.c == [0, 0, 1]


def test_changes(spark):
    old = spark.createDataFrame([("existing", "1"), ("modified", "2"), ("deleted", "3"), (None, "9")], "path string, hash string")
    new = spark.createDataFrame([("existing", "1"), ("modified", "x"), ("new", "4")], "path string, hash string")
    got = {(r.path, r.change) for r in C.changes(old, new).collect()}
    assert got == {("existing", "unchanged"), ("modified", "modified"), ("deleted", "deleted"), ("new", "added"), (None, "deleted")}
    assert C.changes(old, new.limit(0)).where("change = 'deleted'").count() == 4
    assert {r.path for r in C.upserted(old, new, "path").collect()} == {"existing", "modified", "deleted", "new", None}


def test_dense_numbers(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    assert [r.number for r in C.dense_numbers(df, "k", 20).orderBy("k").collect()] == list(range(715))
    assert C.dense_numbers(df.limit(0), "k").count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", None)], "g string, v double")
    r = M.descriptive(df, ["g"], "v").first()
    assert (r.g, r.mean, r.median, r.p95) == ("a", 5.5, 6.0, 10.0) and r.deviation == pytest.approx(2.8722813233)
    assert one(spark, M.rate(F.lit(1), F.lit(0)).alias("r")).r == 0.0


def test_project_score(spark):
    assert one(spark, P.project_score(F.lit(50), F.lit(5000), F.lit(1), F.lit(2)).alias("s")).s == 2
    df = spark.createDataFrame([("r", "a/b/c.py"), ("r", "a/d.py"), ("r", "e.py")], "repo string, path string")
    assert {(r.directory, r.files, r.depth) for r in P.directory_rollup(df, "repo", "path").collect()} == {("a", 2, 1), ("a/b", 1, 2)}


def test_exclusion():
    rx = re.compile(S.exclusion_regex(("**/*.test.js", "**/*.spec.js")))
    kept = [p for p in ("index.js", "node_modules/package.json", ".git/config", "dist/bundle.js", "image.png", "keep.js", "exclude.test.js", "a/also.spec.js", "x.lock") if not rx.match(p)]
    assert kept == ["index.js", "keep.js"]
    assert not re.match(S.exclusion_regex((), False), "x.lock") and re.match(S.exclusion_regex((), False), "a/x.lock")


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin2").write_bytes(b"\x00\x01")
    (tmp_path / "node_modules/c.js").write_text("1")
    assert {r.rel_path for r in S.scan_tree(spark, str(tmp_path)).collect()} == {"src/a.py", "src/b.bin2"}
    got = S.read_tree(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.language, r.content) for r in got] == [("src/a.py", "python", "x = 1\n")]


def test_text_functions(spark):
    r = one(
        spark,
        X.code_kind(F.lit("// c\nfunction f() {}")).alias("k"),
        X.first_of(F.lit("class A {}\n go(x)"), X.FUNCTION_NAMES).alias("f"),
        X.imported_modules(F.lit("import a from 'm'\nconst z = require('q')")).alias("i"),
        X.sanitized(F.lit("")).alias("s"),
        X.bytes_formatted(F.lit(1536)).alias("b"),
        X.duration_formatted(F.lit(3725)).alias("d"),
        X.error_class(F.lit("HTTP 429")).alias("e"),
        X.nesting_depth(F.lit("a(b{\n}\n)")).alias("n"),
    )
    assert (r.k, r.f, r.i, r.s, r.b, r.d, r.e, r.n) == ("function", "go", ["m", "q", "m"], "repo", "1.5KB", "1h 2m", "RATE_LIMIT_EXCEEDED", 2)


def test_analyzers(spark):
    js = "import React from 'react';\nasync function load(a, b) {\n}\nconst go = async (x) => 1;\nclass A extends B {\n}\n/** d */\n"
    r = one(spark, *[N.symbols(F.lit(js), "javascript", k).alias(k) for k in N.KINDS])
    assert [s.name for s in r.functions] == ["load", "go"] and [s.name for s in r.classes] == ["A"] and [s.name for s in r.imports] == ["react"] and len(r.docstrings) == 1
    assert one(spark, N.split_parameters(F.lit("a: Map<x, y>, b = 'q,r', c")).alias("p")).p == ["a: Map<x, y>", "b = 'q,r'", "c"]
    df = spark.createDataFrame([("x", "<a b='1'><c>t</c></a>"), ("y", "<"), ("z", None)], "k string, t string")
    assert {(n.key, n.path, n.text) for n in N.xml_nodes(df, "k", "t").collect()} == {("x", "/a", ""), ("x", "/a/c", "t")}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 5000), max_size=30))
def test_batch_size_stays_in_bounds(values):
    size, quick = W.START, 0
    for v in values:
        size, quick = W.next_batch(size, quick, v)
        assert W.SMALLEST <= size <= W.LARGEST


def test_watch_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "path string, body string, ts timestamp, action string"
    t = lambda n: dt.datetime(2025, 1, 1, 0, 0, n)
    spark.createDataFrame([("a", "1", t(1), "add"), ("b", "1", t(1), "add"), ("a", "2", t(2), "change")], schema).coalesce(1).write.parquet(str(source))
    run = lambda: W.watch(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    spark.createDataFrame([("b", None, t(3), "unlink"), ("c", "9", t(3), "add")], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    kept = W.watched(spark, str(tmp_path / "t"), T._parse_datatype_string(schema.replace("action string, ", "").replace(", action string", ""))).read()
    assert {(r.path, r.body) for r in kept.collect()} == {("a", "2"), ("c", "9")}


def test_stateful_stream_equals_batch(spark, tmp_path):
    rows = [("p", i, float(1000 + 900 * (i % 3))) for i in range(20)]
    spark.createDataFrame(rows, "k string, at long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = W.adaptive_batches(spark.readStream.schema("k string, at long, v double").parquet(str(tmp_path / "in")), "k", "at", "v")
    q = stream.writeStream.format("memory").queryName("sizes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select size from sizes order by at desc limit 1").first().size
    batch = W.adaptive_sizes(spark.createDataFrame(rows, "k string, at long, v double"), "k", "at", "v").first()
    assert (batch.answers, batch.size) == (20, last)
