"""Ranking chunks: cosine, inner product, BM25, hybrid, and what is said about a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions import vectors as V
from quarryline.functions.text import clamped, half_up

#: The scorer's parameters and the weights of the hybrid score.
K1, B, AVERAGE = 1.5, 0.75, 1000.0
HYBRID = (0.7, 0.2, 0.1)
#: Words of a language that are no terms.
KEYWORDS = {
    "javascript": "abstract await boolean break byte case catch char class const continue debugger default delete do double else enum export extends false final finally float for function goto if implements import in instanceof int interface let long native new null package private protected public return short static super switch synchronized this throw throws transient true try typeof var void volatile while with yield",
    "python": "and as assert break class continue def del elif else except exec finally for from global if import in is lambda not or pass print raise return try while with yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
}


def top_k(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k highest scores; ties by the given columns. A bounded heap in each task, then one merge."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return df.orderBy(F.desc(score), *ties).limit(k)


def top_k_per(df: DataFrame, by: str, score: str, k: int, *ties: str) -> DataFrame:
    """The k highest scores of each group, with `rank`; the group limit works before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_search(df: DataFrame, vector: str, query: list[float], k: int, *ties: str) -> DataFrame:
    """Exact search by cosine against a literal query vector: a narrow projection and a top-k."""
    return top_k(df.withColumn("score", V.cosine(F.col(vector), V.literal(query))), "score", k, *ties)


def dot_search(df: DataFrame, vector: str, query: list[float], k: int, threshold: float, *ties: str) -> DataFrame:
    """By inner product; the score is clamped to 0..1 and the threshold applies after the cut to k."""
    best = top_k(df.withColumn("dot", V.dot(F.col(vector), V.literal(query))), "dot", k, *ties)
    return best.withColumn("score", clamped(F.col("dot"))).where(F.col("score") >= threshold)


def boosted(score: Column, query: Column, function_name: Column, class_name: Column) -> Column:
    """1.2 times for a function the query names, 1.15 times for a class (which replaces the former), at most 1."""
    hit = lambda n: (F.length(n) > 0) & F.lower(query).contains(F.lower(n))
    return F.when(hit(class_name), F.least(F.lit(1.0), score * 1.15)).when(hit(function_name), F.least(F.lit(1.0), score * 1.2)).otherwise(score)


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), "[^a-zA-Z0-9_]+"), lambda t: F.length(t) > 1)


def generic_terms(text: Column) -> Column:
    """Words of three characters or more, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([a-zA-Z][a-zA-Z0-9]{2,})(?![A-Za-z0-9_])"), 1), F.lower)


def code_terms(text: Column, language: str) -> Column:
    """Identifiers without the language's keywords, then the words of string literals of 3 to 49 characters."""
    first = "a-zA-Z_" if language == "python" else "a-zA-Z_$"
    names = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_])([{first}][{first}0-9]*)"), 1), F.lower)
    kept = F.filter(names, lambda t: ~t.isin(*KEYWORDS[language].split()))
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1) if language == "java" else F.regexp_extract_all(text, F.lit("([\"'`])([^\"'`]+)\\1"), 2)
    inner = F.flatten(F.transform(F.filter(quoted, lambda s: F.length(s).between(3, 49)), lambda s: F.filter(F.split(F.lower(s), "[^a-zA-Z0-9]+"), lambda t: F.length(t) > 2)))
    return F.concat(kept, inner)


def term_frequency(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """One term's part; 0 where df or n is 0; a term of more than half of the documents gives nothing."""
    idf = F.greatest(F.lit(0.0), F.ln((n - df + 0.5) / (df + 0.5)))
    return F.when((df == 0) | (n == 0), F.lit(0.0)).otherwise(idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length / average)))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents with a query term; a repeated query term counts again.

    Only rows of the query's terms leave the scan; document counts and lengths come from one aggregate over all rows.
    """
    wanted = sorted(set(query))
    stats = docs.agg(F.count(text).cast("double").alias("n"), F.avg(F.length(text)).alias("average"))
    found = docs.select(key, F.length(text).alias("length"), F.explode(F.filter(generic_terms(F.col(text)), lambda t: t.isin(*wanted))).alias("term"))
    tf = found.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    times = F.create_map(*[F.lit(x) for t in wanted for x in (t, float(query.count(t)))])
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row of totals
    part = bm25_term(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"), k1, b) * times[F.col("term")]
    return scored.groupBy(key).agg(F.sum(part).alias("score"))


def normalised(score: Column, most: float = 10.0) -> Column:
    return clamped(score / F.lit(float(most)))


def hybrid(vector: Column, lexical: Column, weights: tuple[float, float, float] = HYBRID) -> Column:
    total = sum(weights)
    return vector * F.lit(weights[0] / total) + lexical * F.lit(weights[1] / total)


def partial_matches(text: Column, query: Column) -> Column:
    """Words of the query over two characters that stand in the text, in order."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 2) & F.lower(text).contains(w))


def explanation(score: Column, query: Column, text: Column, kind: Column, function_name: Column, class_name: Column, language: Column, first: Column, last: Column) -> Column:
    """What made a result relevant, as one sentence."""
    hit = lambda n: (F.length(n) > 0) & F.lower(query).contains(F.lower(n))
    reasons = F.filter(
        F.array(
            F.when(hit(function_name), F.concat(F.lit("function '"), function_name, F.lit("'"))),
            F.when(hit(class_name), F.concat(F.lit("class '"), class_name, F.lit("'"))),
            F.when(F.lower(text).contains(F.lower(query)), F.lit("direct content match")),
        ),
        lambda x: x.isNotNull(),
    )
    semantic = (
        F.when(kind == "function", " - semantic match in function").when(kind == "class", " - semantic match in class definition").when(kind == "import", " - related imports").when(kind == "comment", " - documentation/comments").otherwise(" - semantic similarity")
    )
    why = F.when(F.size(reasons) > 0, F.concat(F.lit(" - found in "), F.array_join(reasons, ", "))).otherwise(semantic)
    return F.concat(half_up(score * 100).cast("string"), F.lit("% match"), why, F.lit(" ("), F.coalesce(language, F.lit("unknown")), F.lit(", lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))


def confidence(score: Column) -> Column:
    return F.when(score > 0.8, "High").when(score > 0.6, "Medium").otherwise("Low")


def context_block(rank: Column, path: Column, lines: Column, language: Column, text: Column) -> Column:
    """One numbered section with a fenced block, as a prompt holds it."""
    return F.concat(F.lit("## "), rank.cast("string"), F.lit(". "), path, F.lit(" ("), lines, F.lit(")\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```\n"))
