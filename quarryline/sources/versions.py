"""A partitioned Parquet table that changes by whole partitions: the base of the store and of the watch loop."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Versions:
    """A table under a folder, partitioned by one column or not at all.

    Data lies in `version=<id>/<column>=<value>`; a numbered manifest lists the folders that make the table, and CURRENT
    names the manifest. A change writes only the partitions it touches into a new version, then a manifest, then CURRENT:
    a reader never sees half a change, a failed job leaves the table as it was, and repeating one overwrites its own files.
    There is one writer at a time. What no recent manifest lists goes with `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, column: str | None):
        self.spark, self.root, self.schema, self.column = spark, root.rstrip("/"), schema, column

    def _path(self, *parts: str):
        """A path and its file system, local or shared by the cluster."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list[str]:
        p, fs = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _text(self, *parts: str) -> str | None:
        p, fs = self._path(*parts)
        return "\n".join(r[0] for r in self.spark.read.text(p.toString()).collect()) if fs.exists(p) else None  # one small file

    def _write(self, text: str, *parts: str) -> None:
        p, fs = self._path(*parts)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def number(self) -> int:
        """The number of the current manifest; -1 where nothing was ever written."""
        mark = self._text("CURRENT")
        return int(mark) if mark else -1

    def folders(self, number: int | None = None) -> list[tuple[str, str]]:
        """(version, partition folder) of a manifest; the folder is '' for a table without a partition column."""
        number = self.number() if number is None else number
        return [tuple(x) for x in json.loads(self._text("_manifests", f"{number}.json") or "[]")] if number >= 0 else []

    def folder_of(self, value) -> str:
        """The folder of a partition value, as Spark names it."""
        if value is None:
            value = "__HIVE_DEFAULT_PARTITION__"
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return utils.getPartitionPathString(self.column, str(value))

    def read(self, values: list | None = None, number: int | None = None) -> DataFrame:
        """The table, or the partitions of some values; empty with its schema where there is nothing."""
        found = self.folders(number)
        if values is not None:
            wanted = {self.folder_of(v) for v in values}
            found = [f for f in found if f[1] in wanted]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/version={v}/{p}".rstrip("/") for v, p in found]
        return self.spark.read.schema(self.schema).option("basePath", self.root).parquet(*paths).select(*self.schema.names)

    def commit(self, df: DataFrame | None, drop: set[str] | None, version: str | None = None, base: int | None = None) -> int:
        """Put the rows of df in the place of the folders `drop` (None: of all); the number of the new manifest.

        `base` is the manifest the change starts from; a change of the same base and version is the same change.
        """
        base = self.number() if base is None else base
        kept = [f for f in self.folders(base) if drop is not None and f[1] not in drop]
        version = version or uuid.uuid4().hex
        if df is not None:
            typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            writer = typed.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
            (writer.partitionBy(self.column) if self.column else writer).parquet(f"{self.root}/version={version}")
            names = [n for n in self._list(f"version={version}") if n.startswith(f"{self.column}=")] if self.column else [""]
            kept += [(version, n) for n in names]
        self._write(json.dumps(sorted(kept)), "_manifests", f"{base + 1}.json")
        self._write(str(base + 1), "CURRENT")
        return base + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the versions that none of the last `keep` manifests lists, and the manifests before these."""
        last = self.number()
        live = {v for n in range(max(0, last - keep + 1), last + 1) for v, _ in self.folders(n)}
        gone = [n for n in self._list() if n.startswith("version=") and n.removeprefix("version=") not in live]
        for parts in [(n,) for n in gone] + [("_manifests", n) for n in self._list("_manifests") if n.endswith(".json") and int(n[:-5]) <= last - keep]:
            p, fs = self._path(*parts)
            fs.delete(p, True)
        return gone
