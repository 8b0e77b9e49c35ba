"""Composite jobs: index a tree into the store, search the store, summarise a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.config import Config
from quarryline.functions import text as X
from quarryline.functions import vectors as V
from quarryline.operators import analyzers as N
from quarryline.operators import changes as C
from quarryline.operators import chunkers as K
from quarryline.operators import embedding as E
from quarryline.operators import retrieval as R
from quarryline.operators import summary as P
from quarryline.sources.files import read_tree
from quarryline.sources.store import Store


#: Fixed value: a chunk of more estimated tokens is left out of the store.
TOKEN_LIMIT = 2048


def cut_lines(files: DataFrame, target: int) -> DataFrame:
    """Chunks of whole lines of each file, large ones included."""
    rows = K.line_chunks(files.select("rel_path", F.col("hash").alias("file_hash"), "language", "content"), "content", target)
    rows = rows.select("rel_path", "file_hash", "language", F.col("chunk_no").alias("ordinal"), "start_line", "end_line", "size", F.col("chunk").alias("content"))
    return rows


def rejected(files: DataFrame, target: int) -> DataFrame:
    """(rel_path, ordinal, start_line, end_line, tokens) of the chunks that `chunked` leaves out: single lines that are too long."""
    tokens = X.tokens_estimated(F.col("content"))
    return cut_lines(files, target).where(tokens > TOKEN_LIMIT).select("rel_path", "ordinal", "start_line", "end_line", tokens.alias("tokens"))


def chunked(files: DataFrame, repo_id: str, target: int) -> DataFrame:
    """Chunks of whole lines with ids, structure and kind; chunks over TOKEN_LIMIT estimated tokens are left out (see rejected)."""
    rows = cut_lines(files, target).where(X.tokens_estimated(F.col("content")) <= TOKEN_LIMIT)
    rows = rows.withColumn("repo_id", F.lit(repo_id)).withColumn("chunk_id", X.chunk_id(F.lit(repo_id), F.col("rel_path"), F.col("ordinal"), F.col("file_hash")))
    return with_structure(rows)


def with_structure(rows: DataFrame) -> DataFrame:
    """Adds the five kinds of symbols of each row's language, and its kind."""
    known = sorted(k for k in N.PATTERNS if k)
    for kind in N.KINDS:  # one expression a kind: the language picks its patterns
        value = N.symbols(F.col("content"), "", kind)
        for language in known:
            value = F.when(F.col("language") == language, N.symbols(F.col("content"), language, kind)).otherwise(value)
        rows = rows.withColumn(kind, value)
    some = lambda k: F.size(k) > 0
    return rows.withColumn("kind", F.when(some("functions"), "function").when(some("classes"), "class").when(some("imports"), "import").when(some("comments"), "comment").otherwise("code"))


def migrate(store: Store, legacy: DataFrame, repo_id: str) -> None:
    """Bring chunks of the plain kind (chunk_id, rel_path, file_hash, ordinal, start_line, end_line, size, content) into the store
    with their structure; those that are there already stay as they are, so it can be repeated."""
    new = C.without(legacy, store.read("chunks", [repo_id]), "chunk_id")
    rows = with_structure(new.withColumns({"repo_id": F.lit(repo_id), "language": X.language(F.col("rel_path"))}))
    store.append("chunks", rows.select(*store.read("chunks").columns))


def repaired(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, vectors, report): each chunk once and with text, vectors only of chunks that there are; report has what was
    (repeated, without_text, orphans) and what is still to be embedded (missing)."""
    per = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("content").alias("content"))
    good = per.where("content is not null").select("chunk_id", "content")
    kept = C.only(vectors, good, "chunk_id")
    counts = per.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("content").isNull()).alias("without_text"))
    orphans = C.without(vectors, good, "chunk_id").agg(F.count("*").alias("orphans"))
    missing = C.without(good, vectors, "chunk_id").agg(F.count("*").alias("missing"))
    return good, kept, counts.crossJoin(orphans).crossJoin(missing)  # one row each


def index_repository(spark: SparkSession, root: str, store: Store, repo_id: str, config: Config | None = None, force: bool = False) -> dict[str, int]:
    """Bring the store in step with a directory tree: only added and modified files are chunked and embedded, deleted ones
    leave. Returns counts of added, modified, deleted and unchanged files, and of the chunks left out as too long (see rejected)."""
    config = config or Config()
    current = read_tree(spark, root, config.exclude, config.max_file_size).withColumn("repo_id", F.lit(repo_id)).cache()
    stored = store.read("files", [repo_id])
    change = C.changes(stored, current, "rel_path").cache()
    fresh = current if force else current.join(change.where("change in ('added', 'modified')").select("rel_path"), "rel_path", "left_semi")
    chunks = chunked(fresh, repo_id, config.chunk_size).cache()
    provider = config.provider
    vectors, gained = E.with_cache(chunks.select("repo_id", "chunk_id", "content"), "chunk_id", "content", store.read("embed_cache"), lambda: [E.create(provider)], provider)
    touched = change.where("change <> 'unchanged'") if not force else change
    before = store.read("chunks", [repo_id])
    old = before.join(touched.select("rel_path"), "rel_path", "left_semi").select("chunk_id").cache()
    old.count()
    new_vectors = vectors.select("repo_id", "chunk_id", "embedding", F.lit(provider).alias("provider"), "text_sha")
    store.replace_repositories("vectors", C.without(store.read("vectors", [repo_id]), old, "chunk_id").unionByName(new_vectors), [repo_id])
    store.replace_repositories("chunks", C.without(before, old, "chunk_id").unionByName(chunks.select(*before.columns)), [repo_id])
    store.append("embed_cache", gained)
    counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}  # four rows at most
    store.replace_repositories("files", current.select(*stored.columns), [repo_id])
    totals = current.agg(F.count("*").alias("files")).crossJoin(store.read("chunks", [repo_id]).agg(F.count("*").alias("chunks")))
    row = totals.select(F.lit(repo_id).alias("repo_id"), F.lit(repo_id).alias("alias"), F.lit(root).alias("path"), F.lit(provider).alias("provider"), F.lit(E.create(provider).dimensions).alias("dimensions"), "files", "chunks", F.current_timestamp().alias("indexed_at"))
    store.replace_repositories("repositories", row, [repo_id])
    left_out = rejected(fresh, config.chunk_size).count()
    for df in (current, change, chunks, old):
        df.unpersist()
    return {k: counts.get(k, 0) for k in ("added", "modified", "deleted", "unchanged")} | {"rejected": left_out}


def search(store: Store, query: str, k: int = 8, repos: list[str] | None = None, provider: str = "hash") -> DataFrame:
    """The k chunks nearest to the query's vector, with boosted score, lines, text and why; boosts come after the cut."""
    vector = E.create(provider).embed([query])[0]
    scope = store.read("vectors", repos)
    best = R.cosine_search(scope.where("embedding is not null"), "embedding", vector, k, "chunk_id").select("repo_id", "chunk_id", "score")
    hits = store.read("chunks", repos).join(F.broadcast(best), ["repo_id", "chunk_id"])  # k rows
    name, class_ = F.try_element_at("functions", F.lit(1))["name"], F.try_element_at("classes", F.lit(1))["name"]
    score = R.boosted(F.col("score"), F.lit(query), name, class_)
    return hits.select(
        F.round(score, 4).alias("score"), "repo_id", "rel_path", F.concat_ws("-", "start_line", "end_line").alias("lines"), "language", "kind", name.alias("function_name"), class_.alias("class_name"), F.col("content").alias("context"),
        R.explanation(score, F.lit(query), F.col("content"), F.col("kind"), name, class_, F.col("language"), F.col("start_line"), F.col("end_line")).alias("why"),
    )


def summarise(files: DataFrame, repo: str, path: str, text: str) -> DataFrame:
    """(repo, overview): one sentence or more on each repository."""
    lang = X.display_language(F.col(path))
    rows = files.select(repo, path, lang.alias("language"), X.code_lines(F.col(text)).alias("loc"), X.ending(F.col(path)).alias("_e"))
    per = rows.groupBy(repo, "language").agg(F.sum("loc").alias("loc"))
    primary = P.primary(per, repo, "language", "loc")
    low = F.lower(path)
    total = rows.groupBy(repo).agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc"), F.bool_or(F.col(path).contains("test") | F.col(path).contains("spec")).alias("tests"), F.bool_or(low.contains("readme") | F.col(path).contains("doc")).alias("docs")
    )
    tech = P.technologies(rows, repo, F.col(path), F.col("_e")).groupBy(repo).agg(F.array_sort(F.collect_set("technology")).alias("t"))
    n = F.size("t")
    uses = F.when(n > 0, F.concat(F.lit("The project uses "), F.array_join(F.slice("t", 1, 3), ", "), F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" other technologies"))).otherwise(""), F.lit(".")))
    first = F.concat(F.lit("This is a "), F.col("language"), F.lit(" project with "), F.col("files").cast("string"), F.lit(" files and approximately "), F.col("loc").cast("string"), F.lit(" lines of code."))
    return primary.join(total, repo).join(tech, repo, "left").select(repo, F.concat_ws(" ", first, uses, F.when(F.col("tests"), "The project includes test files."), F.when(F.col("docs"), "Documentation is present.")).alias("overview"))


def updated_summaries(stored: DataFrame, files: DataFrame, changed: DataFrame, repo: str, path: str, text: str) -> DataFrame:
    """(repo, overview) after a change: only the files of the repositories in `changed` are read again; the others keep theirs."""
    fresh = summarise(C.only(files, changed, repo), repo, path, text)
    return C.without(stored, changed, repo).unionByName(fresh)
