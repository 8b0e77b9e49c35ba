"""Aggregates and windows over metric rows (time, provider, value, success, batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a key that one window task holds at most, and the ranges a table's order is cut into to number rows.
BLOCK_ROWS, RANGES = 65_536, 200


def rate(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place floor(share * n) of the sorted values (an array), 0 when empty."""
    place = F.floor(F.size(values) * F.lit(share)).cast("int") + 1
    return F.coalesce(F.try_element_at(values, F.least(place, F.size(values))), F.lit(0.0))


def running_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _to, _n): for each different value of a group how many rows have it or a smaller one, and the group's rows.

    Equal values are counted first (map-side). The values are cut into RANGES by approximate quantiles, counts run within
    (group, range), and a range begins where those before it end; so no task sees all values of a group. Nulls do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_key") if by else F.lit(1).alias("_key"), F.col(value).alias("_v"))
    splits = sorted(set(rows.select(F.col("_v").cast("double").alias("x")).approxQuantile("x", [i / RANGES for i in range(1, RANGES)], 0.01)))
    span = F.size(F.filter(F.array(*[F.lit(float(x)) for x in splits]), lambda s: s < F.col("_v").cast("double"))) if splits else F.lit(0)
    counted = rows.groupBy("_key", "_v").agg(F.count("*").alias("_c")).withColumn("_range", span)
    run = counted.withColumn("_own", F.sum("_c").over(Window.partitionBy("_key", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy("_key")
    before = F.sum("_m").over(per.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.groupBy("_key", "_range").agg(F.sum("_c").alias("_m")).select("_key", "_range", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_m").over(per).alias("_n"))
    both = run.join(starts, ["_key", "_range"])
    return both.select(*[F.col("_key")[c].alias(c) for c in by], F.col("_v").alias(value), (F.col("_own") + F.col("_start")).alias("_to"), "_n")


def ranked_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, one column for each share): the values at floor(share * n) of each group's order. Null values do not count."""
    place = lambda s: F.least(F.floor(F.col("_n") * F.lit(s)), F.col("_n") - 1)
    return running_counts(df, by, value).groupBy(*by).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_to") > place(s), F.col(value))).alias(k) for k, s in shares.items()])


def descriptive(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, upper median, min, max, p95 (nearest rank) and population deviation of each group."""
    plain = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("deviation"))
    return plain.join(ranked_statistics(df, by, value, {"median": 0.5, "p95": 0.95}), by)


def run_totals(df: DataFrame, by: list[str], value: str, ok: Column) -> DataFrame:
    """Counts, sums and rates of each group's rows."""
    n, good = F.count("*"), F.count_if(ok)
    return df.groupBy(*by).agg(
        n.alias("total"), F.sum(value).alias("sum"), F.avg(value).alias("average"), F.min(value).alias("min"), F.max(value).alias("max"), rate(good, n).alias("success_rate"), rate(n - good, n).alias("error_rate")
    )


def _splits_below(x: Column, splits: list[float]) -> Column:
    """How many of the sorted splits are smaller than x (none where x is null).

    No lambda: in comparing plans Spark numbers a lambda's variables from 0, as it numbers a session's first columns. Where
    both have the same number, it takes a filter on the column for one that needs no column, and puts it where there is none.
    """
    v = F.coalesce(x, F.lit(float("-inf")))
    return (F.array_position(F.sort_array(F.array_append(F.array(*[F.lit(float(s)) for s in splits]), v)), v) - 1).cast("int") if splits else F.lit(0)


def positions(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds _range and _pos: the place (from 0) of each row in the order of its key, though no task sees all rows of a key.

    The first order column is cut into RANGES by approximate quantiles; rows are numbered within (key, range), and a range
    begins where those before it end. Nulls come first.
    """
    kind = dict(df.dtypes)[order[0]]
    first = F.unix_micros(F.col(order[0]).cast("timestamp")) if kind.startswith("timestamp") else F.col(order[0])
    rows = df.withColumn("_x", first.cast("double"))
    splits = sorted(set(rows.approxQuantile("_x", [i / RANGES for i in range(1, RANGES)], 0.01)))
    rows = rows.withColumn("_range", _splits_below(F.col("_x"), splits)).drop("_x")
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(by, "_range").agg(F.count("*").alias("_n")).select(F.col(by).alias("_k"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col(by).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))
    return rows.withColumn("_own", own).join(starts, same).withColumn("_pos", F.col("_own") + F.col("_start")).drop("_own", "_start", "_k", "_r")


def over_last(df: DataFrame, by: str, order: list[str], rows: int, columns: dict[str, Column | None], frames: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Adds `columns`, aggregates over the last `rows` rows of a key up to each row (or over `frames`, within these), and _pos.

    A key's order is cut into blocks of BLOCK_ROWS; a block also gets the rows before it that its first rows look back to.
    So a key that holds most rows is many tasks' work.
    """
    placed = positions(df, by, order)
    own = F.floor(F.col("_pos") / BLOCK_ROWS)
    late = F.col("_pos") % BLOCK_ROWS >= BLOCK_ROWS - (rows - 1)
    copies = placed.withColumn("_own", own).withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(by, "_block").orderBy("_pos")
    frames = frames or {}
    out = copies.withColumns({name: c.over(w.rowsBetween(*frames.get(name, (1 - rows, 0)))) for name, c in columns.items()})
    return out.where("_block = _own").drop("_own", "_block", "_range")


def moving_average(df: DataFrame, by: str, order: list[str], value: str, rows: int, name: str) -> DataFrame:
    """Mean of the last `rows` rows of a group, this one included."""
    return over_last(df, by, order, rows, {name: F.avg(value)}).drop("_pos")


def trend(df: DataFrame, by: str, order: list[str], value: str, rows: int = 3) -> DataFrame:
    """Adds recent and previous means of `rows` rows and whether the value fell, held or rose."""
    out = over_last(df, by, order, 2 * rows, {"recent": F.avg(value), "previous": F.avg(value)}, {"recent": (1 - rows, 0), "previous": (1 - 2 * rows, -rows)}).drop("_pos")
    ratio = F.try_divide(F.col("recent"), F.col("previous"))
    return out.withColumn("trend", F.when(ratio.isNull(), "unknown").when(ratio < 0.95, "falling").when(ratio < 0.98, "easing").otherwise("steady"))


def run_lengths(df: DataFrame, by: str, order: list[str], state: Column) -> DataFrame:
    """Adds state and run: how many rows in a row, up to this one, have the state (gaps and islands).

    Runs are counted within ranges of the order; a row in the first run of its range adds what the ranges before carry over,
    which a fold over a key's ranges (at most RANGES) gives.
    """
    placed = positions(df.withColumn("state", state), by, order)
    w = Window.partitionBy(by, "_range").orderBy("_pos")
    out = placed.withColumn("_c", F.when(F.col("state").eqNullSafe(F.lag("state").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    out = out.withColumn("_i", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("run", F.row_number().over(Window.partitionBy(by, "_range", "_i").orderBy("_pos")))
    last = F.struct("_pos", "state", "run", "_i")
    edges = out.groupBy(by, "_range").agg(F.min_by("state", "_pos").alias("head"), F.max(last).alias("z"))
    edges = edges.select(by, F.struct("_range", "head", F.col("z.state").alias("tail"), F.col("z.run").alias("length"), (F.col("z._i") == 1).alias("whole")).alias("e"))
    zero = F.struct(F.lit(None).cast("boolean").alias("tail"), F.lit(0).alias("length"), F.array().cast("array<struct<_r:int,carry:int>>").alias("out"))

    def step(a, e):
        carry = F.when((F.size(a["out"]) > 0) & e["head"].eqNullSafe(a["tail"]), a["length"]).otherwise(0)
        return F.struct(e["tail"].alias("tail"), (e["length"] + F.when(e["whole"], carry).otherwise(0)).cast("int").alias("length"), F.concat(a["out"], F.array(F.struct(e["_range"].alias("_r"), carry.cast("int").alias("carry")))).alias("out"))

    carried = edges.groupBy(by).agg(F.sort_array(F.collect_list("e")).alias("es")).select(F.col(by).alias("_k"), F.explode(F.aggregate("es", zero, step, lambda a: a["out"])).alias("c")).select("_k", "c.*")
    both = out.join(carried, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return both.withColumn("run", F.col("run") + F.when(F.col("_i") == 1, F.col("carry")).otherwise(0)).drop("_c", "_i", "_k", "_r", "carry", "_range", "_pos")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the mean of the two values in the middle."""
    at = lambda place: F.min(F.when(F.col("_to") > place, F.col(value)))
    return running_counts(df, by, value).groupBy(*by).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias("median"))


def sliding_counts(df: DataFrame, by: str, time: str, value: str, seconds: int = 60) -> DataFrame:
    """Adds requests and amount of the last `seconds` up to each row, and the wait until the oldest of them leaves."""
    at = F.unix_micros(time)
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("requests", F.count("*").over(w)).withColumn("amount", F.sum(value).over(w)).withColumn("wait_ms", ((F.min(at).over(w) + seconds * 1_000_000 - at) / 1000).cast("long"))


def evictions(df: DataFrame, by: str, order: list[str], size: str, limit: float) -> DataFrame:
    """Adds evicted: rows that must go, oldest first, until what stays of a group is within the limit."""
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("kept_size", F.sum(size).over(newest)).withColumn("evicted", F.col("kept_size") > limit)


def separation(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(separation): the mean cosine of all pairs with the same label less that of all other pairs.

    A sum over pairs of unit vectors is the square of their sum less their own squares, so only one sum of vectors a label
    is needed, and no pair is made. Zero vectors have no direction and do not count.
    """
    unit = df.where(F.exists(vector, lambda x: x != 0)).select(F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    parts = unit.select("l", F.posexplode(F.transform("v", lambda x: x / length)).alias("k", "x")).groupBy("l", "k").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    labels = parts.groupBy("l").agg(F.sum(F.col("s") ** 2).alias("square"), F.max("n").alias("n"))
    same = labels.agg(F.sum((F.col("square") - F.col("n")) / 2).alias("same"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("n").alias("n"))
    every = parts.groupBy("k").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") ** 2).alias("square"))
    both = same.crossJoin(every)  # one row each
    pairs, total = F.col("n") * (F.col("n") - 1) / 2, (F.col("square") - F.col("n")) / 2
    return both.select((F.try_divide("same", "pairs") - F.try_divide(total - F.col("same"), pairs - F.col("pairs"))).alias("separation"))


def correlation(x: str, y: str) -> Column:
    """Pearson's, 0 where it is not defined."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def provider_score(latency: Column, throughput: Column, reliability: Column) -> Column:
    """0.4 / (1 + latency in s) + 0.4 * throughput share + 0.2 * reliability; parts that are null count neither way."""
    parts = [(F.lit(1.0) / (1 + latency / 1000), 0.4), (F.least(throughput / 100, F.lit(1.0)), 0.4), (reliability, 0.2)]
    total = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    weight = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def health_score(preference: Column, failures: Column, unhealthy: Column, response: Column, cooling: Column) -> Column:
    score = 100 + 10 * preference - 20 * failures - F.when(unhealthy, 50).otherwise(0) + F.greatest(F.lit(0.0), 50 - response / 100) - F.when(cooling, 100).otherwise(0)
    return F.greatest(score, F.lit(0.0))
