"""Splitting oversized texts at natural boundaries (problem 1)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token is a run of word characters, a run of blanks, one line end, or one other character.
TOKEN = re.compile(r"\r\n|\n|\r|[ \t]+|\w+|.", re.S)

#: The limits (12 bytes a row) are broadcast up to this many rows of configuration, counted first; else the join shuffles.
BROADCAST_ROWS = 500_000

PIECES = "chunk_id string, repo_id int, piece int, start_char int, end_char int, start_line int, end_line int, content string"


def boundaries(text: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Token offsets (prefix sums of token lengths) and the sorted boundary arrays, strongest kind first.

    Kinds: after a blank line; after a line; after the end of a statement or sentence; after a blank; between tokens.
    """
    kinds: list[list[int]] = [[], [], [], []]
    lengths, at, line_blank = [], 0, True
    previous = ""
    for m in TOKEN.finditer(text):
        t = m[0]
        at += len(t)
        lengths.append(len(t))
        if t[-1] in "\r\n":
            kinds[1].append(at)
            if line_blank:
                kinds[0].append(at)
            line_blank = True
        elif t[0] in " \t":
            kinds[3].append(at)
            if previous in ".;!?}":
                kinds[2].append(at)
        else:
            line_blank = False
        previous = t
    offsets = np.cumsum(np.asarray(lengths, dtype=np.int64)) if lengths else np.zeros(0, np.int64)
    return offsets, [np.asarray(k, dtype=np.int64) for k in kinds] + [offsets]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open character ranges of at most `limit` characters that cover text in order.

    Each range ends at the strongest boundary in the last half of its window, else at the last boundary of any kind,
    else (one token longer than the window) exactly at the limit. The next one starts `overlap` characters back.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    _, kinds = boundaries(text)
    out, start, done = [], 0, 0
    while True:
        if start + limit >= n:
            out.append((start, n))
            return out
        end = 0
        for floor in (max(done, start + limit // 2), done):
            for k in kinds:
                i = bisect_right(k, start + limit) - 1
                if i >= 0 and k[i] > floor:
                    end = int(k[i])
                    break
            if end:
                break
        end = end or start + limit
        out.append((start, end))
        done, start = end, max(end - overlap, start + 1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("chunk_id", pa.string()), ("repo_id", pa.int32()), ("piece", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())]
    )
    for b in batches:
        rows: list[tuple] = []
        for cid, repo, line, text, limit, overlap in zip(*(b.column(i).to_pylist() for i in range(6))):
            newlines = [m.start() for m in re.finditer("\n", text)]
            for i, (s, e) in enumerate(cut(text, limit, overlap)):
                # the line of a character is the number of line feeds before it
                first = None if line is None else line + bisect_right(newlines, s - 1)
                last = None if line is None else line + bisect_right(newlines, e - 2)
                rows.append((cid, repo, i, s, e, first, last, text[s:e]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def limits_in_force(config: DataFrame, default_repo: int = 0) -> DataFrame:
    """(repo_id, chunk_size, chunk_overlap): for each repository the row with the greatest updated_at.

    Equal times: the greater size, then the greater overlap. A null or non-positive size, and an overlap that is null,
    negative or not below the size, are taken from repo `default_repo` (an overlap still too large becomes half the size).
    The table has one row for each repository, so it is bounded by the number of repositories.
    """
    top = F.max_by(
        F.struct("chunk_size", "chunk_overlap"),
        F.struct("updated_at", F.coalesce("chunk_size", F.lit(-1)), F.coalesce("chunk_overlap", F.lit(-1))),
    )
    latest = config.groupBy("repo_id").agg(top.alias("v")).select("repo_id", "v.chunk_size", "v.chunk_overlap")
    d = latest.where(F.col("repo_id") == default_repo).select(F.col("chunk_size").alias("d_size"), F.col("chunk_overlap").alias("d_overlap"))
    ids = latest.join(F.broadcast(d), F.lit(True), "left")  # at most one row on the right
    size = F.when(F.col("chunk_size") > 0, F.col("chunk_size")).otherwise(F.col("d_size"))
    fits = lambda c: (c >= 0) & (c < F.col("size"))
    return ids.withColumn("size", size).select(
        "repo_id",
        F.col("size").alias("chunk_size"),
        F.when(fits(F.col("chunk_overlap")), F.col("chunk_overlap"))
        .when(fits(F.col("d_overlap")), F.col("d_overlap"))
        .otherwise((F.coalesce("size", F.lit(0)) / 2).cast("int"))
        .alias("chunk_overlap"),
    )


def split_oversized(chunks: DataFrame, config: DataFrame, default_repo: int = 0) -> DataFrame:
    """Ordered pieces (PIECES) of every chunk whose content has more characters than its repository's chunk_size.

    Columns used: chunk_id, repo_id, start_line, content; others are ignored. Sizes and overlaps as limits_in_force says; a
    repository without a row has those of `default_repo`. Null content and content within the limit give no rows; repeated
    rows count once; rows with null chunk_id are told apart by repository, line and content. Piece i+1 begins exactly
    chunk_overlap characters before the end of piece i. end_line is the line of a piece's last character; both lines are
    null where start_line is. Empty tables give no rows.

    Plan: the limits are broadcast while the configuration has at most BROADCAST_ROWS rows, else the join is shuffled and
    left to adaptive execution; the length filter runs in the JVM before any text reaches Python or a shuffle.
    """
    limits = limits_in_force(config, default_repo)
    few = config.count() <= BROADCAST_ROWS
    own = limits.select(F.col("repo_id").alias("_r"), F.col("chunk_size").alias("_size"), F.col("chunk_overlap").alias("_overlap"))
    rest = limits.where(F.col("repo_id") == default_repo).select(F.col("chunk_size").alias("_dsize"), F.col("chunk_overlap").alias("_doverlap"))
    big = (
        chunks.select("chunk_id", "repo_id", "start_line", "content")
        .where(F.col("content").isNotNull())
        .join(F.broadcast(own) if few else own, F.col("repo_id") == F.col("_r"), "left")
        .join(F.broadcast(rest), F.lit(True), "left")  # at most one row
        .withColumn("_limit", F.coalesce("_size", "_dsize"))
        .where(F.length("content") > F.col("_limit"))
        .withColumn("_step", F.coalesce("_overlap", "_doverlap"))
        .withColumn("_hash", F.xxhash64("content"))
        .dropDuplicates(["chunk_id", "repo_id", "start_line", "_hash"])
    )
    return big.select("chunk_id", "repo_id", "start_line", "content", "_limit", "_step").mapInArrow(_pieces, PIECES)
