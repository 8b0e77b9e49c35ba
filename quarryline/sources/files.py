"""Scanning directory trees into tables of files, and the exclusion patterns that go with it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import ending, language, looks_textual, mime_type

#: Directories left out at any depth, also at the root.
EXCLUDED_DIRECTORIES = ("node_modules", "dist", "build", ".next", "out", ".git", ".svn", ".cache", "tmp", "temp", "coverage")
#: Further directories left out below the root only.
EXCLUDED_BELOW = ("docs/build", "docs/dist", "docs/.docusaurus", "docs/node_modules", ".vscode", ".idea")
#: Names left out, as globs.
EXCLUDED_NAMES = (
    "*.lock", "*.min.*", "*.bin", "*.exe", "*.dll", "*.so", "*.dylib", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg", "*.ico", "*.mp4", "*.mov", "*.avi", "*.webm",
    "*.zip", "*.gz", "*.tar", "*.rar", "*.7z", "*.bz2", ".DS_Store", "Thumbs.db", "*.tmp", "*.swp", "*.swo",
)
MAX_INDEXED, MAX_READ = 1_572_864, 10 * 1024 * 1024


def default_globs() -> list[str]:
    return [g for d in EXCLUDED_DIRECTORIES for g in (f"**/{d}/**", f"{d}/**")] + [f"**/{d}/**" for d in EXCLUDED_BELOW] + [f"**/{n}" for n in EXCLUDED_NAMES]


def glob_regex(glob: str, root_too: bool = True) -> str:
    """A glob as a regular expression. With root_too a leading **/ also matches nothing and a trailing /** also the
    directory itself; without it every ** is any text, so that **/*.lock leaves a root-level x.lock alone."""
    out = []
    for part in re.findall(r"^\*\*/|/\*\*$|/\*\*/|\*\*|\*|\?|[^*?]", glob):
        if part in ("**/", "/**", "/**/") and root_too:
            out.append({"**/": "(?:.*/)?", "/**": "(?:/.*)?", "/**/": "(?:/.*/)?"}[part])
        elif "**" in part:
            out.append(part.replace("**", ".*"))
        else:
            out.append({"*": "[^/]*", "?": "."}.get(part) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", part))
    return "^" + "".join(out) + "$"


def exclusion_regex(extra: tuple[str, ...] = (), root_too: bool = True) -> str:
    """One alternation of all patterns, so that a path is matched once."""
    return "|".join(f"(?:{glob_regex(g, root_too)})" for g in [*default_globs(), *extra])


def excluded(path: Column, extra: tuple[str, ...] = (), root_too: bool = True) -> Column:
    return path.rlike(exclusion_regex(extra, root_too))


def scan_tree(spark: SparkSession, root: str, extra: tuple[str, ...] = (), max_size: int = MAX_READ) -> DataFrame:
    """(path, rel_path, extension, mime_type, language, size, last_modified) of the regular files under root that are not
    excluded and not larger than max_size. Listing is parallel; contents are not read (size is pushed to the source)."""
    base = "file:" + root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
    rel = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(base) - 4, 1 << 20)
    return files.select("path", rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")).where(~excluded(F.col("rel_path"), extra)).select(
        "path", "rel_path", ending(F.col("rel_path")).alias("extension"), mime_type(F.col("rel_path")).alias("mime_type"), language(F.col("rel_path")).alias("language"), "size", "last_modified"
    )


def read_tree(spark: SparkSession, root: str, extra: tuple[str, ...] = (), max_size: int = MAX_INDEXED) -> DataFrame:
    """The files of scan_tree with content and SHA-256; files whose first bytes are not text are left out."""
    base = "file:" + root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
    rel = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(base) - 4, 1 << 20)
    text = F.decode("content", "UTF-8")
    return (
        files.withColumn("rel_path", rel)
        .where(~excluded(F.col("rel_path"), extra))
        .select("path", "rel_path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), language(F.col("rel_path")).alias("language"), text.alias("content"))
        .where(looks_textual(F.col("content")))
    )
