"""The store: Parquet tables partitioned by repository, changed by whole partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators.changes import upserted, without
from quarryline.sources.versions import Versions

SYMBOLS = "array<struct<type:string,name:string>>"
#: The schemas that tables are written with.
SCHEMAS = {
    "files": "repo_id string, rel_path string, hash string, size bigint, last_modified timestamp, language string",
    "chunks": f"repo_id string, chunk_id string, rel_path string, file_hash string, ordinal int, start_line int, end_line int, size int, language string, kind string, content string, imports {SYMBOLS}, functions {SYMBOLS}, classes {SYMBOLS}, comments {SYMBOLS}, docstrings {SYMBOLS}",
    "vectors": "repo_id string, chunk_id string, embedding array<float>, provider string, text_sha string",
    "embed_cache": "model string, text_sha string, embedding array<float>",
    "sources": "set_name string, path string",
    "catalog": "entry_id string, rel_path string, alias string",
    "repositories": "repo_id string, alias string, path string, provider string, dimensions int, files bigint, chunks bigint, indexed_at timestamp",
}


class Store:
    """Tables under a folder, those with a repo_id partitioned by it. A change writes the partitions it touches (see Versions)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> Versions:
        schema = T._parse_datatype_string(SCHEMAS[name])
        return Versions(self.spark, f"{self.root}/{name}", schema, "repo_id" if "repo_id" in schema.names else None)

    def exists(self, name: str) -> bool:
        return self.table(name).number() >= 0

    def read(self, name: str, repos: list[str] | None = None) -> DataFrame:
        """A table, or the partitions of some repositories; empty with its schema where it was never written."""
        return self.table(name).read(repos)

    def replace(self, name: str, df: DataFrame) -> None:
        """Write df (checked against the schema) as the whole table."""
        self.table(name).commit(df, None)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows: only they are written."""
        self.table(name).commit(df, set())

    def replace_repositories(self, name: str, df: DataFrame, repos: list[str]) -> None:
        """Put df, whose rows are of these repositories, in the place of their partitions."""
        t = self.table(name)
        t.commit(df, {t.folder_of(r) for r in repos})

    def _touched(self, name: str, df: DataFrame, keys: tuple[str, ...]) -> list:
        """The repositories with rows of the keys of df: one value a repository, from a read of the keys alone."""
        stored = self.read(name).select("repo_id", *[k for k in keys if k != "repo_id"])
        return [r[0] for r in stored.join(df.select(*keys).distinct(), list(keys), "left_semi").select("repo_id").distinct().collect()]

    def upsert(self, name: str, df: DataFrame, *keys: str) -> None:
        """Delete, then insert: rows with the keys of df are replaced, wherever they are."""
        t = self.table(name)
        new = df.select(*t.schema.names)
        if t.column is None:
            return t.commit(upserted(t.read(), new, *keys), None)
        touched = self._touched(name, new, keys)
        return t.commit(upserted(t.read(touched), new, *keys), {t.folder_of(v) for v in touched})

    def remove(self, name: str, gone: DataFrame, *keys: str) -> None:
        """Rows without the keys of `gone`; partitions that lose nothing are not written again."""
        t = self.table(name)
        if t.column is None:
            return t.commit(without(t.read(), gone, *keys), None)
        touched = self._touched(name, gone, keys)
        return t.commit(without(t.read(touched), gone, *keys), {t.folder_of(v) for v in touched})

    def drop_repository(self, repo_id: str) -> None:
        """Take a repository's partitions out of every table; nothing is written but the manifests."""
        for name in SCHEMAS:
            t = self.table(name)
            if t.column and t.number() >= 0:
                t.commit(None, {t.folder_of(repo_id)})

    def vacuum(self, keep: int = 2) -> None:
        for name in SCHEMAS:
            self.table(name).vacuum(keep)

    def add_source(self, set_name: str, path: str) -> None:
        """Put a path into a named set of sources; one that is there already stays once."""
        self.upsert("sources", self.spark.createDataFrame([(set_name, path)], SCHEMAS["sources"]), "set_name", "path")

    def remove_sources(self, gone: DataFrame) -> None:
        """Take (set_name, path) pairs out of their sets."""
        self.remove("sources", gone, "set_name", "path")

    def drop_set(self, set_name: str) -> None:
        self.replace("sources", self.read("sources").where(F.col("set_name") != set_name))

    def repositories(self) -> DataFrame:
        return self.read("repositories").select("repo_id", "alias").distinct()

    def mark_for_reindex(self, provider: str, dimensions: int) -> DataFrame:
        """(repo_id, needs_reindex): repositories whose vectors are of another provider or size."""
        r = self.read("repositories")
        return r.select("repo_id", (~F.col("provider").eqNullSafe(F.lit(provider)) | ~F.col("dimensions").eqNullSafe(F.lit(dimensions))).alias("needs_reindex"))
