"""Source files nobody wrote by hand in their repository: machine-made, compacted, third-party or bulk data (problem 3)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.corpus import current_chunks, map_texts
from quarryline.llm.grammar import syntax_error
from quarryline.sources.tables import bounded_sample, written

#: Rows the forest is fitted on at most, its size, and the share of trees that decides. Files without a notice count as
#: hand-written in the fit though some are not, so the share is below one half.
FIT_FILES, TREES, DEPTH, SHARE = 20_000, 40, 8, 0.25
#: A text of fewer characters, apart from its header, says nothing of its origin.
LEAST_LENGTH = 40

#: How header notices say that a file is machine-made, or taken over from a third party.
GENERATED = re.compile(
    r"@generated|<auto-generated|auto-?generated\b|automatically (?:generated|produced|created|written)|code generated by|generated by\b(?! hand)|generated from\b|machine[- ]generated|this (?:file|code) (?:is|was|has been) (?:auto\w* )?(?:generated|produced|created) (?:by|from|with)|do not (?:edit|modify)(?: this file| by hand| manually|[.!;\s*/-]*$)|regenerate with|manual changes will be lost|automatisch (?:erzeugt|generiert|erstellt)|nicht von hand|nicht (?:manuell )?bearbeiten|généré (?:par|automatiquement|à partir)|ne pas (?:modifier|éditer)|generado (?:por|automáticamente|a partir)|no (?:editar|modificar)\b|gerado (?:por|automaticamente)",
    re.I | re.M,
)
THIRD_PARTY = re.compile(
    r"copied from (?:the )?[\w.\-]+|see upstream|upstream for changes|@licen[sc]e\b|\b(?:MIT|BSD|Apache|ISC|MPL|GPL|LGPL)\b[ -]*(?:2(?:\.0)?|3(?:\.0)?)?[ -]*licen[sc]e|licensed under the|permission is hereby granted|\(c\)[^\n]{0,60}\b(?:contributors|authors)\b|^/\*! *[\w.\-]+ v?\d+\.\d+|vendored from|taken from [\w.\-]+ v?\d|redistributed",
    re.I | re.M,
)
HAND = re.compile(r"written by hand|maintained by|ask before you change", re.I)
#: What a compactor leaves at the end, and how the record of a package manager begins.
SOURCE_MAP = re.compile(r"(?://|/\*)# sourceMappingURL=[^\n]*\s*\Z")
RECORD = re.compile(r"\{\s*\"(?:lockfileVersion|locked|_resolved)\"\s*:[^,\n]*,?")
#: How a file begins that declares one literal and nothing else: what stands before the literal.
_SCRIPT_HEAD = re.compile(r"(?:export\s+(?:default\s+)?)?(?:(?:const|let|var)\s+[\w$]+(?:\s*:[^=\n]+)?\s*=|module\.exports\s*=)\s*")
DECLARATION = {
    "javascript": _SCRIPT_HEAD,
    "typescript": _SCRIPT_HEAD,
    "python": re.compile(r"[A-Za-z_]\w*(?:\s*:[^=\n]+)?\s*=\s*"),
    "java": re.compile(r"(?:package [\w.]+;\s*)?(?:public )?(?:final )?class \w+ \{\s*(?:(?:public|private|static|final) )+[\w<>]+(?:\[\])* \w+ =\s*"),
    "json": re.compile(r""),
}
_STATEMENT = re.compile(r"\b(?:function|def|return|import|require|lambda|class|new)\b|=>|\)\s*\{")
_HEAD = re.compile(r"\s*(?:/\*[\s\S]*?\*/|//[^\n]*|\#[^\n]*)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_WORDS, _DIGITS = re.compile(r"[A-Za-z_$]+"), re.compile(r"\d+")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_BLOB = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_BRACES_COMMENT = re.compile(r"/(?:\*[\s\S]*?\*/|/[^\n]*)")
_COMMENT = {"python": re.compile(r"\#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''"), "java": _BRACES_COMMENT, "javascript": _BRACES_COMMENT, "typescript": _BRACES_COMMENT}


def split_header(text: str) -> tuple[str, str]:
    """The comments a text begins with, and the rest."""
    text = text.removeprefix("\ufeff")
    pos = 0
    while (m := _HEAD.match(text, pos)) and m.end() > pos:
        pos = m.end()
    return text[:pos], text[pos:].strip()


def notice_of(header: str, body: str, language: str) -> tuple[str, str]:
    """(notice, body without it): what a text says of its own origin.

    A notice is a comment of a generator or a third party at the head, the reference to a map that a compactor leaves at
    the end, the version a package manager's record begins with, or a declaration of one literal that the whole file is.
    """
    notice = "generated" if GENERATED.search(header) and not HAND.search(header) else "third party" if THIRD_PARTY.search(header) else ""
    if m := SOURCE_MAP.search(body):
        notice, body = notice or "compacted", body[: m.start()]
    if language == "json" and (m := RECORD.match(body)):
        return notice or "record", body[m.end() :]
    if m := DECLARATION[language].match(body):
        rest = body[m.end() :]
        if rest[:1] == "[" if language == "json" else rest[:1] in ("[", "{", "(", '"', "'") and not _STATEMENT.search(rest):
            return notice or "data", rest
    return notice, body


def features(body: str, language: str) -> list[float]:
    """Compression ratio, token entropy, identifier lengths, comment density and line figures of a text without its notice."""
    data = body.encode("utf-8", "replace")
    n = max(1, len(body))
    names = _NAME.findall(body)
    counts = Counter(names)
    total = max(1, len(names))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    lines = body.split("\n")
    shapes = set(map(str.strip, _WORDS.sub("a", _DIGITS.sub("0", body)).split("\n")))
    numbers = sum(map(len, _NUMBER.findall(body)))
    blobs = sum(map(len, _BLOB.findall(body)))
    return [
        len(zlib.compress(data, 6)) / max(1, len(data)),
        entropy,
        entropy / math.log2(total) if total > 1 else 1.0,
        sum(map(len, names)) / total,
        sum(1 for x in names if len(x) <= 2) / total,
        sum(map(len, _COMMENT[language].findall(body))) / n if language in _COMMENT else 0.0,
        n / len(lines),
        math.log1p(max(map(len, lines))),
        (numbers + blobs) / n,
        blobs / n,
        numbers / n,
        len(shapes) / len(lines),
        math.log1p(n),
        len(names) / n,
        len(counts) / total,
    ]


def described_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, repo_id, relative_path, size, language, features, notice, hash, same, text) of current texts.

    hash (128 bits) and same (the length) are of the body with its white space made one blank each.
    """
    arrow = pa.schema([("file_id", pa.int64()), ("repo_id", pa.int32()), ("relative_path", pa.string()), ("size", pa.int64()), ("language", pa.string()), ("features", pa.list_(pa.float64())), ("notice", pa.string()), ("hash", pa.string()), ("same", pa.int64()), ("text", pa.string())])

    def each(file_id, repo_id, path, size, language, text):
        header, body = split_header(text)
        notice, rest = notice_of(header, body, language)
        plain = " ".join(body.split())
        yield file_id, repo_id, path, size, language, features(rest, language), notice, hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=16).hexdigest(), len(plain), text

    return map_texts(current_chunks(files, chunks), each, "file_id long, repo_id int, relative_path string, size long, language string, features array<double>, notice string, hash string, same long, text string", arrow)


def foreign_files(files: DataFrame, chunks: DataFrame, share: float = SHARE) -> DataFrame:
    """(file_id, repo_id, relative_path, size, share, notice, copied): current files that nobody wrote by hand in their repository.

    The forest alone finds them: from the text without its notice, and from whether the same text (but for its header and
    for white space) stands in another repository. Its labels are the notices, which it does not see; a notice speaks for
    all copies of its text, and a file without one counts as hand-written in the fit. Exact checks follow: a text that does not parse, or of under LEAST_LENGTH
    characters, is no case. Where no file, or each, has a notice, there is nothing to tell apart and the label itself is
    the share. Files of other languages, null or empty texts, repeated rows and earlier versions give no rows; a null size
    stays null; empty tables give no rows. Other columns are ignored.

    Plan: the texts are described once and written to the shared folder; equal texts come from a pre-aggregated group of
    hashes, never from comparing pairs; the forest is fitted on at most FIT_FILES rows, chosen by a hash; only the texts of
    the files found are read again, to parse them.
    """
    all_ = written(described_files(files, chunks), "described")
    copies = all_.groupBy("hash").agg(F.min("repo_id").alias("_a"), F.max("repo_id").alias("_b"), F.max("notice").alias("told")).where("_a <> _b").select("hash", "told")
    plain = (
        all_.select("file_id", "features", "notice", "hash", "same")
        .join(copies, "hash", "left")
        .select("file_id", "notice", "same", F.col("told").isNotNull().alias("copied"), (F.coalesce("told", "notice") != "").cast("double").alias("label"), "features")
        .withColumn("v", array_to_vector(F.concat("features", F.array(F.col("copied").cast("double")))))
    )
    long_ = plain.where(F.col("same") >= LEAST_LENGTH)
    sample = bounded_sample(long_.select("file_id", "v", "label"), ["file_id"], FIT_FILES)
    kinds = [r["label"] for r in sample.groupBy("label").count().collect()]  # at most two rows
    if len(kinds) > 1:
        model = RandomForestClassifier(featuresCol="v", numTrees=TREES, maxDepth=DEPTH, seed=11, cacheNodeIds=False, subsamplingRate=0.7, minInstancesPerNode=2).fit(sample)
        scored = model.transform(long_).withColumn("share", vector_to_array("probability")[1])
    else:
        scored = long_.withColumn("share", F.col("label"))
    found = scored.where(F.col("share") >= share).select("file_id", "share", "notice", "copied")
    schema = pa.schema([("file_id", pa.int64()), ("repo_id", pa.int32()), ("relative_path", pa.string()), ("size", pa.int64()), ("share", pa.float64()), ("notice", pa.string()), ("copied", pa.bool_())])

    def parses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [not syntax_error(t, x) for t, x in zip(b.column(8).to_pylist(), b.column(7).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(7)], schema=schema).filter(pa.array(good, pa.bool_()))

    texts = all_.select("file_id", "repo_id", "relative_path", "size", "language", "text")
    return texts.join(found, "file_id").select("file_id", "repo_id", "relative_path", "size", "share", "notice", "copied", "language", "text").mapInArrow(parses, "file_id long, repo_id int, relative_path string, size long, share double, notice string, copied boolean")
