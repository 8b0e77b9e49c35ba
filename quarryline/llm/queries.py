"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, docpairs, origin, packing, parsing, secrets, subjects
from quarryline.llm.chunk_split import split_oversized
from quarryline.llm.knn import nearest, similar_pairs
from quarryline.sources.tables import table


def p1_pieces(spark: SparkSession, base: str) -> DataFrame:
    return split_oversized(table(spark, base, "chunks"), table(spark, base, "performance_config"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return p1_pieces(spark, base).where("piece = 0 and chunk_id is not null").select("chunk_id").distinct()


def p1_rebuilt(spark: SparkSession, base: str) -> DataFrame:
    """(chunk_id, repo_id, digest, pieces): every split chunk put together from its pieces again, each beginning where the text before it ends."""
    piece = F.struct("piece", "start_char", "content")
    lists = p1_pieces(spark, base).where("chunk_id is not null").groupBy("chunk_id", "repo_id").agg(F.sort_array(F.collect_set(piece)).alias("p"))
    text = F.aggregate("p", F.lit(""), lambda a, p: F.concat(a, F.substr(p["content"], F.length(a) - p["start_char"] + 1)))
    return lists.select("chunk_id", "repo_id", F.sha2(text, 256).alias("digest"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return similar_pairs(table(spark, base, "embedded_chunks"))


def p5_topk(spark: SparkSession, base: str) -> DataFrame:
    return nearest(table(spark, base, "embedded_chunks")).withColumn("score", F.round("score", 6))


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.token_ids(table(spark, base, "documents"))


def p8_placements(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_containers(table(spark, base, "documents"))


def p8_whole(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, placed): how often each document is placed; all of its pieces together count once."""
    placed = p8_placements(spark, base).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"))
    return placed.select("doc_id", F.when((F.col("n") == F.col("pieces")) & (F.col("last") + 1 == F.col("pieces")), 1).otherwise(F.col("n")).alias("placed"))


def p2_states(spark: SparkSession, base: str) -> DataFrame:
    return parsing.parse_states(table(spark, base, "files"), table(spark, base, "chunks"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return p2_states(spark, base).where("error is not null").select("file_id")


def p2_rates(spark: SparkSession, base: str) -> DataFrame:
    return parsing.invalid_rates(p2_states(spark, base))


def p6_pairs(spark: SparkSession, base: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, base, "files"), table(spark, base, "chunks"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_pairs(spark, base).select("file_id", "line_no", "function_name").distinct()


def p4_masked(spark: SparkSession, base: str) -> DataFrame:
    return secrets.find_secrets(table(spark, base, "chunks"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    found = p4_masked(spark, base).where("chunk_id is not null")
    return found.select("chunk_id", F.explode("line_nos").alias("line_no")).distinct()


def p3_files(spark: SparkSession, base: str) -> DataFrame:
    return origin.foreign_files(table(spark, base, "files"), table(spark, base, "chunks"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return p3_files(spark, base).select("file_id")


def p9_subjects(spark: SparkSession, base: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, base, "documents"), table(spark, base, "subject_labels"), table(spark, base, "subjects"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return p9_subjects(spark, base).where("doc_id is not null").select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, base: str) -> DataFrame:
    return subjects.composition(p9_subjects(spark, base))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rebuilt": p1_rebuilt, "p5_found": p5_found, "p5_topk": p5_topk, "p9_found": p9_found, "p9_subjects": p9_subjects, "p9_composition": p9_composition, "p3_found": p3_found, "p3_files": p3_files, "p4_found": p4_found, "p4_masked": p4_masked, "p2_found": p2_found, "p2_rates": p2_rates, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_ids": p7_ids, "p8_placements": p8_placements, "p8_whole": p8_whole}

_VECTORS = """
with v as (
  select provider, model_version, vec_id, max(embedding) as embedding from embedded_chunks
  where len(embedding) = 64 and vec_id is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
  group by all),
s as (
  select a.provider, a.model_version, a.vec_id, b.vec_id as neighbour,
    round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as score
  from v a join v b on a.provider is not distinct from b.provider and a.model_version is not distinct from b.model_version and a.vec_id <> b.vec_id),
h as (select *, row_number() over (partition by provider, model_version, vec_id order by score desc, neighbour) as hit_no from s qualify hit_no <= 5)
"""

ORACLES = {
    "p1_found": """
with latest as (
  select repo_id, arg_max(coalesce(chunk_size, -1), (updated_at, coalesce(chunk_size, -1))) as s from performance_config group by repo_id),
d as (select s from latest where repo_id = 0)
select distinct chunk_id from chunks c left join latest l using (repo_id)
where length(content) > case when l.s > 0 then l.s else (select s from d) end
""",
    "p1_rebuilt": """
with latest as (
  select repo_id, arg_max(coalesce(chunk_size, -1), (updated_at, coalesce(chunk_size, -1))) as s from performance_config group by repo_id),
d as (select s from latest where repo_id = 0)
select distinct chunk_id, c.repo_id, sha256(content) as digest from chunks c left join latest l on l.repo_id = c.repo_id
where length(content) > case when l.s > 0 then l.s else (select s from d) end
""",
    "p8_whole": "select doc_id, count(*) as placed from documents group by 1",
    "p5_topk": _VECTORS + "select provider, model_version, vec_id, hit_no, neighbour, round(score, 6) as score from h",
    "p5_found": _VECTORS + "select distinct least(vec_id, neighbour) as vec_a, greatest(vec_id, neighbour) as vec_b from h where score >= 0.85",
}
