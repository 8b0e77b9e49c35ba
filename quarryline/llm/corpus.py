"""Current texts of source files, put together from their chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.lexers import LANGUAGES

#: Columns of what current_chunks returns, in order, as the Python side reads them.
COLUMNS = ["file_id", "repo_id", "relative_path", "size", "language", "starts", "ends", "texts"]


def current_files(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, relative_path, hash, size): the row of each file with the greatest last_modified.

    Equal times: the greatest (hash, relative_path, repo_id, size). Rows without file_id or hash are no files.
    """
    newest = F.max_by(
        F.struct("repo_id", "relative_path", "hash", "size"),
        F.struct("last_modified", F.coalesce("hash", F.lit("")), F.coalesce("relative_path", F.lit("")), F.coalesce("repo_id", F.lit(0)), F.coalesce("size", F.lit(0))),
    )
    return files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(newest.alias("v")).select("file_id", "v.*").where(F.col("hash").isNotNull())


def language_of(path) -> F.Column:
    ending = F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), F.when(ending.isin(*LANGUAGES), ending))


def current_chunks(files: DataFrame, chunks: DataFrame, languages: tuple[str, ...] = tuple(set(LANGUAGES.values()))) -> DataFrame:
    """COLUMNS: one row for each current file of the languages that has text, with its chunks sorted by line.

    A file with a null content among its current chunks has no text, nor has one without chunks. Repeated chunks count
    once: they collapse in the map-side part of the aggregation, so a chunk repeated in a third of all rows is not
    gathered in one task. Chunks are shuffled once, by (file_id, file_hash); the join and the lists use that partitioning.
    """
    wanted = current_files(files).withColumn("language", language_of(F.col("relative_path"))).where(F.col("language").isin(*languages))
    pieces = (
        chunks.where(F.col("file_id").isNotNull() & F.col("file_hash").isNotNull())
        .groupBy("file_id", F.col("file_hash").alias("hash"))
        .agg(
            F.sort_array(F.collect_set(F.struct("start_line", "end_line", "content"))).alias("pieces"),
            F.bool_or(F.col("content").isNull()).alias("lost"),
        )
        .where(~F.col("lost"))
    )
    return wanted.join(pieces, ["file_id", "hash"]).select(
        "file_id", "repo_id", "relative_path", "size", "language", F.col("pieces.start_line").alias("starts"), F.col("pieces.end_line").alias("ends"), F.col("pieces.content").alias("texts")
    )


def assemble(starts: list, ends: list, texts: list) -> str:
    """A file's text from its chunks: lines a neighbour already gave are left out. A chunk without lines goes on where the last ended."""
    if len(texts) == 1:
        return texts[0]
    out, line = [], 0
    for s, e, t in zip(starts, ends, texts):
        shared = line - s + 1 if s is not None else 0
        last = e if e is not None else line + t.count("\n") + 1
        if shared > 0:
            if last <= line:
                continue
            at = 0
            for _ in range(shared):
                at = t.find("\n", at) + 1
                if not at:
                    break
            if not at:
                continue
            t = t[at:]
        out.append(t)
        line = last
    return "\n".join(out)


def map_texts(current: DataFrame, each: Callable[[int, int, str, int, str, str], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows that each(file_id, repo_id, relative_path, size, language, text) gives for every current file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            columns = [b.column(i) for i in range(8)]
            for r in range(b.num_rows):
                f, repo, path, size, language, starts, ends, texts = (c[r].as_py() for c in columns)
                rows.extend(each(f, repo, path, size, language, assemble(starts, ends, texts)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return current.select(*COLUMNS).mapInArrow(run, schema)
