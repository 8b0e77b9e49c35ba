"""Source files that do not parse (problem 2)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.corpus import current_chunks, map_texts
from quarryline.llm.grammar import syntax_error


def parse_states(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, error): every current file of a known language with a text; error is null if it parses.

    An empty Python, JavaScript, TypeScript or Java file is valid, an empty JSON file is not. Files without text (a null
    content, no chunks) have no row. Repeated rows count once, other columns are ignored, empty tables give no rows. Null
    file_id or hash: no file.
    """
    arrow = pa.schema([("file_id", pa.int64()), ("repo_id", pa.int32()), ("language", pa.string()), ("error", pa.string())])

    def each(file_id, repo_id, path, size, language, text):
        yield file_id, repo_id, language, syntax_error(text, language)[:200] or None

    return map_texts(current_chunks(files, chunks), each, "file_id long, repo_id int, language string, error string", arrow)


def invalid_rates(states: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, rate) of what parse_states returns; pre-aggregated before its shuffle."""
    return states.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.count("error").alias("invalid"), F.round(F.count("error") / F.count("*"), 6).alias("rate"))
