"""What an editor asks of search results: the text to show over a word, where it is defined, the symbols of a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of symbols in the editor protocol, the width of a range, and the most symbols of an answer (a feature of it).
FUNCTION, CLASS, WIDTH, MOST = 12, 5, 1000, 50


def _line(lines: Column, at: int) -> Column:
    """The first or last line of a range like `3-7`, from 0; a single number is both."""
    parts = F.split(lines, "-")
    n = F.try_element_at(parts, F.lit(at + 1)).try_cast("int")
    return F.greatest(F.coalesce(n, parts[0].try_cast("int"), F.lit(1)) - 1, F.lit(0))


def _uri(root: str, path: Column) -> Column:
    return F.concat(F.lit(f"file://{root.rstrip('/')}/"), F.regexp_replace(path, r"\\", "/"))


def locations(results: DataFrame, root: str) -> DataFrame:
    """(uri, start_line, start_character, end_line, end_character) of every result of a search for a word that has a file."""
    r = results.where(F.col("rel_path").isNotNull())
    return r.select(_uri(root, F.col("rel_path")).alias("uri"), _line(F.col("lines"), 0).alias("start_line"), F.lit(0).alias("start_character"), _line(F.col("lines"), 1).alias("end_line"), F.lit(WIDTH).alias("end_character"))


def workspace_symbols(results: DataFrame, root: str) -> DataFrame:
    """(name, kind, uri, start_line, end_line, container) of the best results that name a function or, else, a class."""
    best = results.orderBy(F.desc("score"), "rel_path", "lines").limit(MOST)
    f, c = F.nullif("function_name", F.lit("")), F.nullif("class_name", F.lit(""))
    named = best.where(f.isNotNull() | c.isNotNull())
    return named.select(F.coalesce(f, c).alias("name"), F.when(f.isNotNull(), FUNCTION).otherwise(CLASS).alias("kind"), _uri(root, F.col("rel_path")).alias("uri"), _line(F.col("lines"), 0).alias("start_line"), _line(F.col("lines"), 1).alias("end_line"), F.col("rel_path").alias("container"))


def hover(results: DataFrame, word: str) -> DataFrame:
    """(value): the Markdown shown over a word, from the best result; no row where nothing is found."""
    text = F.concat(F.lit("```"), F.coalesce(F.nullif("language", F.lit("")), F.lit("text")), F.lit("\n"), F.col("context"), F.lit("\n```\n\n"))
    part = lambda x: F.coalesce(x, F.lit(""))
    best = results.orderBy(F.desc("score"), "rel_path", "lines").limit(1)
    return best.select(F.concat(F.lit(f"**{word}**\n\n"), part(text), part(F.concat(F.lit("_"), F.col("why"), F.lit("_\n\n"))), part(F.concat(F.lit("📁 File: `"), F.col("rel_path"), F.lit("`")))).alias("value"))
