"""Chunkers of the retrieval engine: fixed stride, by lines, and by nearby boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP = 4000, 0.15


def fixed_chunks(df: DataFrame, text: str, target: int = TARGET) -> DataFrame:
    """One row for each window of `target` characters, 15 % shared with the next; the last ends with the text.

    Adds chunk_no (from 0) and chunk. Empty and null texts give no rows.
    """
    step = target - int(target * OVERLAP)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - target) / step)).cast("int")
    rows = df.where(F.length(text) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(target)))


def _line_fold(text: Column, target: int) -> Column:
    """The chunks of a text by a fold over its lines, in the JVM: a struct array of (first, last, size)."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1)
    chunk = "array<struct<first:int,last:int,size:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(1).alias("first"), F.lit(0).alias("size"), F.array().cast(chunk).alias("out"))

    def step(a, n):
        closes = (a["size"] + n > target) & (a["size"] > 0)
        back = F.greatest(F.lit(1), F.floor((a["at"] - a["first"]) * F.lit(OVERLAP)).cast("int"))
        fresh = F.greatest(a["first"], a["at"] - back + 1)
        reused = F.aggregate(F.slice(sizes, fresh, a["at"] - fresh + 2), F.lit(0), lambda s, x: s + x)
        one = F.struct(a["first"].alias("first"), a["at"].alias("last"), a["size"].alias("size"))
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(closes, fresh).when(a["size"] == 0, a["at"] + 1).otherwise(a["first"]).alias("first"),
            F.when(closes, reused).otherwise(a["size"] + n).alias("size"),
            F.when(closes, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"),
        )

    end = lambda a: F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["at"].alias("last"), a["size"].alias("size"))))
    return F.aggregate(sizes, zero, step, end)


def line_chunks(df: DataFrame, text: str, target: int = TARGET) -> DataFrame:
    """One row for each chunk of whole lines; adds chunk_no, start_line, end_line, size and chunk (trimmed).

    A chunk closes when the next line would exceed `target`; the next begins with the last 15 % of its lines, one at
    least. A blank rest is dropped. Null texts give no rows.
    """
    rows = df.where(F.col(text).isNotNull()).select("*", F.posexplode(_line_fold(F.col(text), target)).alias("chunk_no", "_c"))
    body = F.array_join(F.slice(F.split(F.col(text), "\n", -1), F.col("_c.first"), F.col("_c.last") - F.col("_c.first") + 1), "\n")
    bare = F.regexp_replace(body, r"^\s+|\s+$", "")
    return rows.select("*", F.col("_c.first").alias("start_line"), F.col("_c.last").alias("end_line"), F.col("_c.size").alias("size"), bare.alias("chunk")).drop("_c").where(F.length("chunk") > 0)


def snap(text: str, at: int, near_line: int = 200, near_blank: int = 100) -> int:
    """`at` moved behind the nearest line end, else behind the nearest white space: backwards first, then forwards."""
    if at >= len(text):
        return len(text)
    back = text.rfind("\n", max(0, at - near_line), at + 1)
    if back >= 0 and back + 1 != at:
        return back + 1
    ahead = text.find("\n", at, min(len(text), at + near_line))
    if ahead >= 0:
        return ahead + 1
    for i in (*range(at, max(0, at - near_blank) - 1, -1), *range(at, min(len(text), at + near_blank))):
        if text[i].isspace() and i + 1 != at:
            return i + 1
    return at


def boundary_ranges(text: str, target: int = TARGET, overlap: float = OVERLAP, least: int = 100) -> list[tuple[int, int]]:
    """Half-open ranges of chunks that end and begin at nearby boundaries."""
    if not text or text.isspace():
        return []
    if len(text) <= least:
        return [(0, len(text))]
    out, at, back = [], 0, int(target * overlap)
    while at < len(text):
        end = snap(text, min(len(text), at + target))
        if not text[at:end].strip():
            at = end
            continue
        out.append((at, end))
        if end == len(text):
            break
        following = snap(text, max(at + 1, end - back))
        at = following if following > at else end
    return out


def boundary_chunks(df: DataFrame, key: str, text: str, target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """(key as string, chunk_no, start_line, end_line, size, chunk): chunks that end at a line end or blank near the target.

    The cut depends on the text step by step, hence an Arrow map; null and blank texts give no rows.
    """
    schema = pa.schema([("key", pa.string()), ("chunk_no", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("size", pa.int32()), ("chunk", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (s, e) in enumerate(boundary_ranges(t or "", target, overlap)):
                    first = t.count("\n", 0, s) + 1
                    bare = t[s:e].strip()
                    rows.append((k, i, first, first + t.count("\n", s, e), len(bare), bare))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), schema.types)], schema=schema)

    return df.select(F.col(key).cast("string"), text).mapInArrow(run, "key string, chunk_no int, start_line int, end_line int, size int, chunk string")


def surrounding(text: Column, first: Column, last: Column, lines: int = 2) -> Column:
    """struct(before, after): up to `lines` lines on each side of a chunk; null where there are none."""
    every = F.split(text, "\n", -1)
    start = F.greatest(F.lit(1), first - lines)
    before = F.slice(every, start, first - start)
    after = F.slice(every, last + 1, lines)
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.struct(some(before).alias("before"), some(after).alias("after"))


def token_batches(sizes: Column, budget: int, most: int = 1 << 30) -> Column:
    """The batch number of each item: a batch closes when an item would exceed the budget or it has `most` items (a fold)."""
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        cut = (a["n"] > 0) & ((a["sum"] + x > budget) | (a["n"] >= most))
        batch = F.when(cut, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(batch.alias("batch"), F.when(cut, x).otherwise(a["sum"] + x).cast("long").alias("sum"), F.when(cut, F.lit(1)).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda a: a["out"])


def whole_texts(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): texts put together from their chunks by line number; lines a chunk before already gave are left out.

    Repeated chunks collapse before the shuffle. A text with a null content among its chunks has none. A chunk without a
    start goes on where the last one ended.
    """
    piece = F.struct(F.coalesce("start_line", F.lit(0)).alias("start"), F.coalesce("end_line", F.lit(0)).alias("end"), "content")
    lists = chunks.groupBy(*keys).agg(F.sort_array(F.collect_set(piece)).alias("_p"), F.bool_or(F.col("content").isNull()).alias("_lost")).where(~F.col("_lost"))
    zero = F.struct(F.lit(0).alias("line"), F.array().cast("array<string>").alias("lines"))

    def step(a, p):
        lines = F.split(p["content"], "\n")
        start = F.when(p["start"] > 0, p["start"]).otherwise(a["line"] + 1)
        shared = F.greatest(F.lit(0), a["line"] - start + 1)
        fresh = F.slice(lines, shared + 1, F.greatest(F.lit(0), F.size(lines) - shared))
        return F.struct((F.when(F.size(fresh) > 0, start + F.size(lines) - 1).otherwise(a["line"])).cast("int").alias("line"), F.concat(a["lines"], fresh).alias("lines"))

    return lists.select(*keys, F.aggregate("_p", zero, step, lambda a: F.array_join(a["lines"], "\n")).alias("text"))
