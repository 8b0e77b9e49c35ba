"""Change detection between two states of a collection, and the updates that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(stored: DataFrame, current: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """(key, change): added, modified, deleted or unchanged, by one full outer join. Each side has a key once; a null hash
    equals only a null hash. Null keys do not match and come out as added and deleted."""
    s = stored.select(F.col(key).alias("_k"), F.col(hash_).alias("_old"), F.lit(True).alias("_s"))
    c = current.select(key, F.col(hash_).alias("_new"), F.lit(True).alias("_c"))
    kind = F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return c.join(s, F.col(key) == F.col("_k"), "full_outer").select(F.coalesce(key, "_k").alias(key), kind.alias("change"))


def stat_check(stored: DataFrame, current: DataFrame, key: str = "path", size: str = "size", time: str = "last_modified") -> DataFrame:
    """(key, state): new, unchanged (size and time as stored) or potential; only the latter needs its content hashed."""
    s = stored.select(F.col(key).alias("_k"), F.col(size).alias("_size"), F.col(time).alias("_time"), F.lit(True).alias("_s"))
    same = F.col(size).eqNullSafe(F.col("_size")) & F.col(time).eqNullSafe(F.col("_time"))
    return current.join(s, F.col(key) == F.col("_k"), "left").select(key, F.when(F.col("_s").isNull(), "new").when(same, "unchanged").otherwise("potential").alias("state"))


def hash_check(stored: DataFrame, current: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """(key, state): valid, invalid or missing, for every stored key."""
    c = current.select(F.col(key).alias("_k"), F.col(hash_).alias("_h"), F.lit(True).alias("_c"))
    return stored.join(c, F.col(key) == F.col("_k"), "left").select(key, F.when(F.col("_c").isNull(), "missing").when(F.col(hash_).eqNullSafe(F.col("_h")), "valid").otherwise("invalid").alias("state"))


def without(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not in `gone`."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def only(df: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    return df.join(kept.select(*keys).distinct(), list(keys), "left_semi")


def upserted(stored: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of `new` in the place of all stored rows with the same keys (delete, then insert)."""
    return without(stored, new, *keys).unionByName(new)


def last_events(events: DataFrame, key: str, time: str, *ties: str) -> DataFrame:
    """The latest event of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *[F.desc(t) for t in ties])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def significant(path: Column) -> Column:
    """Package files, readmes, configuration and source files."""
    return path.rlike(r"package\.json$") | path.rlike("(?i)README") | path.rlike("(?i)config") | path.rlike(r"\.(js|ts|py|java|cpp|c|cs)$")


def dense_numbers(df: DataFrame, by: str, parts: int = 200) -> DataFrame:
    """Adds `number`: 0, 1, 2, … in the order of a numeric column without equal values, without one task seeing all rows.

    Rows are put into ranges by approximate quantiles; each range numbers its own rows and begins where the one before ends
    (a table of at most `parts` rows, so it is broadcast).
    """
    splits = sorted(set(df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.01))) or [0.0]
    bucket = F.size(F.filter(F.array(*[F.lit(float(x)) for x in splits]), lambda s: s < F.col(by)))
    cut = df.withColumn("_bucket", bucket)
    begin = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(begin), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(by)) - 1
    return cut.withColumn("_own", own).join(F.broadcast(offsets), "_bucket").withColumn("number", F.col("_own") + F.col("_start")).drop("_own", "_start", "_bucket")
