import pytest
from pyspark.sql import functions as F

from quarryline.config import Config, load, merged, version_key
from quarryline.operators import embedding as E
from quarryline.plans.pipelines import index_repository, search, summarise
from quarryline.sources.store import Store


def test_index_search_and_update(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("import os\n\ndef load_rows(path):\n    return open(path).read()\n")
    (src / "b.js").write_text("class Cart extends Base {\n}\nfunction total(items) {\n}\n")
    (src / "gone.md").write_text("# words about ovens\n")
    store = Store(spark, str(tmp_path / "store"))
    assert index_repository(spark, str(src), store, "r1") == {"added": 3, "modified": 0, "deleted": 0, "unchanged": 0, "rejected": 0}
    hit = search(store, "def load_rows(path):", 1).first()
    assert hit.rel_path == "a.py" and hit.function_name == "load_rows" and hit.lines == "1-5" and "function 'load_rows'" in hit.why
    (src / "gone.md").unlink()
    (src / "a.py").write_text("def other():\n    pass\n")
    (src / "long.js").write_text("x" * 9000)
    assert index_repository(spark, str(src), store, "r1") == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1, "rejected": 1}
    assert {r.rel_path for r in store.read("chunks").collect()} == {"a.py", "b.js"}
    assert store.read("vectors").join(store.read("chunks"), "chunk_id").count() == store.read("chunks").count() == 2
    assert store.repositories().count() == 1 and store.mark_for_reindex("hash", 64).first().needs_reindex is False
    assert store.read("embed_cache").count() == 4
    store.drop_repository("r1")
    assert store.read("chunks").count() == 0


def files_under(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_a_change_writes_only_its_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "repo_id string, chunk_id string, embedding array<float>, provider string, text_sha string"
    rows = lambda *r: spark.createDataFrame([(a, b, [1.0], "p", c) for a, b, c in r], schema)
    store.replace("vectors", rows(("r/1", "a", "1"), ("r 2", "b", "1"), (None, "c", "1"), ("r3", "d", "1")))
    before = files_under(tmp_path)
    store.upsert("vectors", rows(("r 2", "b", "2"), ("r 2", "e", "2")), "repo_id", "chunk_id")
    fresh = files_under(tmp_path) - before
    assert fresh and all("repo_id=r 2" in f or "repo_id=r%202" in f for f in fresh)
    before = files_under(tmp_path)
    store.remove("vectors", rows(("x", "c", "")), "chunk_id")  # the row of a null repository
    assert files_under(tmp_path) - before == set()
    store.append("vectors", rows(("r/1", "f", "3")))
    assert all("r%2F1" in f for f in files_under(tmp_path) - before)
    assert {(r.repo_id, r.chunk_id, r.text_sha) for r in store.read("vectors").collect()} == {("r/1", "a", "1"), ("r/1", "f", "3"), ("r 2", "b", "2"), ("r 2", "e", "2"), ("r3", "d", "1")}
    assert {r.chunk_id for r in store.read("vectors", ["r/1"]).collect()} == {"a", "f"}
    before = files_under(tmp_path)
    store.drop_repository("r/1")
    assert files_under(tmp_path) == before and {r.repo_id for r in store.read("vectors").collect()} == {"r 2", "r3"}
    store.vacuum(keep=1)
    assert len(files_under(tmp_path)) < len(before) and store.read("vectors").count() == 3
    empty = Store(spark, str(tmp_path / "none"))
    assert empty.read("files").count() == 0 and not empty.exists("files")


class Broken:
    name, dimensions, max_tokens = "broken", 64, 10

    def embed(self, texts):
        raise OSError("down")


def test_fallback_and_errors(spark):
    waits = []
    vectors, name, error = E.attempt([Broken(), E.HashEmbedder()], ["a b"], 3, 1.0, waits.append)
    assert name == "hash" and not error and waits == [1.0, 2.0] and len(vectors[0]) == 64
    assert E.attempt([Broken()], ["a"], 1) == (None, "", "broken: down")
    df = spark.createDataFrame([("1", "a b"), ("2", None), ("3", "x" * 100_000)], "k string, t string")
    got = {r.key: (r.embedding is not None, r.error) for r in E.embedded(df, "k", "t", lambda: [E.HashEmbedder()]).collect()}
    assert got == {"1": (True, None), "2": (False, "no text"), "3": (False, "over the token limit")}
    with pytest.raises(ValueError):
        E.create("none")


def test_cache_embeds_each_text_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, t string")
    cache = spark.createDataFrame([], "model string, text_sha string, embedding array<float>")
    rows, gained = E.with_cache(df, "k", "t", cache, lambda: [E.HashEmbedder()], "hash")
    assert gained.count() == 2 and rows.where("embedding is not null").count() == 3 and rows.count() == 4
    assert E.with_cache(df, "k", "t", gained, lambda: [], "hash")[0].where(F.col("embedding").isNotNull()).count() == 3


def test_config(tmp_path):
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": None}) == {"a": {"b": 3, "c": 2}, "d": None}
    (tmp_path / "c.json").write_text('{"chunk_size": 100, "chunk_overlap": 10, "odd": 1}')
    c = load(str(tmp_path / "c.json"), {"QUARRYLINE_BATCH_SIZE": "7", "QUARRYLINE_EXCLUDE": "a,b"})
    assert (c.chunk_size, c.batch_size, c.exclude) == (100, 7, ("a", "b"))
    with pytest.raises(ValueError):
        load(None, {"QUARRYLINE_CHUNK_SIZE": "0"})
    assert Config(chunk_overlap=4000).errors() and version_key("1.10.0") > version_key("1.9")


def test_summary(spark):
    df = spark.createDataFrame([("r", "src/a.py", "x = 1\ny = 2\n"), ("r", "test/b.js", "// c\n"), ("r", "README.md", "# t\n")], "repo string, path string, content string")
    assert summarise(df, "repo", "path", "content").first().overview.startswith("This is a Python project with 3 files and approximately 2 lines of code. The project uses javascript, python. The project includes test files. Documentation is present.")
