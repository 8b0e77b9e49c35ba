"""Exact k nearest vectors by a block matrix join over int8 tiles (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a part at most while a group has up to SPREAD parts, and at most when it has more; and the rows and columns of a product tile.
PART, LARGEST_PART, SPREAD = 16_384, 65_536, 6
TILE_ROWS, TILE_COLUMNS = 1024, 4096
#: The list of groups (provider and model) is broadcast up to this many, counted first; else the join shuffles.
BROADCAST_GROUPS = 100_000
DECIMALS = 9
#: Provider and model as texts that are never null ('' for null, else '=' and the value), so that joins keep their partitioning.
GROUP = ["_p", "_m"]
KEY = [*GROUP, "h1", "h2"]


def usable_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(_p, _m, vec_id, embedding) of the usable rows, each vec_id once.

    Usable: dim finite numbers, not all zero, vec_id not null. Of rows that share (provider, model_version, vec_id) the
    one with the greatest embedding is kept. A null provider or model_version is a value of its own.
    """
    e = F.col("embedding")
    ok = (
        (F.size(e) == dim)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(e, lambda x: x != 0)
        & F.col("vec_id").isNotNull()
    )
    return _named(vectors.where(ok)).groupBy(*GROUP, "vec_id").agg(F.max("embedding").alias("embedding"))


def _named(vectors: DataFrame) -> DataFrame:
    never_null = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return vectors.withColumns({"_p": never_null("provider"), "_m": never_null("model_version")})


def _value(column: str) -> F.Column:
    return F.when(F.col(column) != "", F.substring(column, 2, 1 << 30))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length as int8 codes, their scales, and the norms of what the codes leave out."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


class Heaps:
    """The best k+1 (score, id) of each row of a part, merged tile by tile; ids has up to k+1 ids of equal vectors a row,
    padded with -1."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: float):
        self.ids, self.x, self.k, self.floor = ids, x, k, floor
        codes, scale, rest = quantise(x)
        self.codes, self.scale, self.rest = codes.astype(np.float32), scale.astype(np.float32), rest
        self.kept: list = []
        self.size = 0
        self.least = np.full(len(x), floor)

    def offer(self, i: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        """Scores of the rows i with the representatives whose ids `found` has a row for."""
        good = score >= self.least[i]
        i, found, score = i[good], found[good], score[good]
        if found.shape[1] > 1:  # a representative stands for up to k+1 ids with the same score
            real = found >= 0
            i, score, found = np.repeat(i, real.sum(axis=1)), np.repeat(score, real.sum(axis=1)), found[real]
        else:
            found = found[:, 0]
        self.kept.append((i, found, score))
        self.size += len(i)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the best of each row; its k+1st score is what others must reach (k+1: a row may find itself)."""
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        i, found, score = (np.concatenate(c) for c in zip(empty, *self.kept))
        order = np.lexsort((found, -score, i))
        i, found, score = i[order], found[order], score[order]
        count = np.bincount(i, minlength=len(self.x))
        rank = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        best = rank <= self.k
        full = rank == self.k
        self.least[i[full]] = np.maximum(self.least[i[full]], score[full])
        self.kept = [(i[best], found[best], score[best])]
        self.size = int(best.sum())
        return self.kept[0]


def _need(least: np.ndarray, tile: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """What a row's upper bounds must reach: its k+1st score so far or, before there is one, its k+1st lower bound in the tile."""
    need = least - slack
    unset = np.flatnonzero(least <= -1)
    if len(unset) and tile.shape[1] > k + 1:
        at = tile.shape[1] - k - 1
        need[unset] = np.partition(tile[unset], at, axis=1)[:, at] - 2 * slack[unset]
    return need.astype(np.float32)


def compare(a: Heaps, b: Heaps | None) -> None:
    """Every pair of a row of a and a row of b (of two rows of a, if b is None), each product once, offered to both sides.

    With unit vectors u = q + r the cosine differs from the product of the codes by at most |r_a| + |r_b| + |r_a||r_b|.
    int8 products are summed exactly in float32 for 64 dimensions (64 * 127 * 127 < 2**24); for more the slack grows. Pairs whose upper bound reaches what one of
    the two rows needs are computed again in double precision.
    """
    other, rounding = b or a, 1e-5 * max(1.0, a.x.shape[1] / 64)
    for left in range(0, len(a.x), TILE_ROWS):
        rows = slice(left, min(left + TILE_ROWS, len(a.x)))
        for right in range(left if b is None else 0, len(other.x), TILE_COLUMNS):
            cols = slice(right, min(right + TILE_COLUMNS, len(other.x)))
            tile = a.codes[rows] @ other.codes[cols].T
            tile *= a.scale[rows, None]
            tile *= other.scale[cols]
            slack_a = a.rest[rows] * (1 + float(other.rest[cols].max())) + float(other.rest[cols].max()) + rounding
            slack_b = other.rest[cols] * (1 + float(a.rest[rows].max())) + float(a.rest[rows].max()) + rounding
            near = tile >= _need(a.least[rows], tile, a.k, slack_a)[:, None]
            near |= tile >= _need(other.least[cols], tile.T, a.k, slack_b)
            i, j = np.nonzero(near)
            i, j = i + left, j + right
            if b is None:
                once = i <= j  # in the square on the diagonal a pair stands twice
                i, j = i[once], j[once]
            exact = np.round(np.einsum("ij,ij->i", a.x[i], other.x[j]), DECIMALS)
            a.offer(i, other.ids[j], exact)
            apart = i != j if b is None else slice(None)
            other.offer(j[apart], a.ids[i[apart]], exact[apart])
            for h in (a, b) if b else (a,):
                if h.size > 4 * (h.k + 1) * len(h.x) or h.least[rows if h is a else cols].min() <= -1:
                    h.merge()


def _padded(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), int(min(width, sizes.max(initial=1)))), -1, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _tiles(k: int, floor: float, dim: int):
    """From rows sorted by (_p, _m, a, b, side) to (_p, _m, h1, h2, ids, scores): the best of each row within the pair of parts."""
    schema = pa.schema([("_p", pa.string()), ("_m", pa.string()), ("h1", pa.int64()), ("h2", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def heaps(rows: pa.Table) -> Heaps:
        x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        return Heaps(_padded(rows.column("ids").combine_chunks(), k + 1), x / np.linalg.norm(x, axis=1)[:, None], k, floor)

    def tile(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        side = rows.column("side").to_numpy()
        cut = int(np.searchsorted(side, 1))
        halves = [h for h in (rows.slice(0, cut), rows.slice(cut)) if h.num_rows]
        if key[2] != key[3] and len(halves) < 2:
            return  # the other part is empty
        both = [heaps(h) for h in halves]
        compare(both[0], both[1] if len(both) > 1 else None)
        for h, own in zip(both, halves):
            i, found, score = h.merge()
            ends = np.r_[0, np.cumsum(np.bincount(i, minlength=len(h.x)))].astype(np.int32)
            out = pa.Table.from_arrays(
                [*(own.column(c) for c in ("_p", "_m", "h1", "h2")), pa.ListArray.from_arrays(pa.array(ends), pa.array(found)), pa.ListArray.from_arrays(pa.array(ends), pa.array(score))], schema=schema
            )
            yield from out.filter(pa.array(np.diff(ends) > 0)).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            at = 0
            for now, same in groupby(zip(*(b.column(c).to_pylist() for c in ("_p", "_m", "a", "b")))):
                n = sum(1 for _ in same)
                if now != key and held:
                    yield from tile(key, held)
                    held = []
                key = now
                held.append(b.slice(at, n))
                at += n
        if held:
            yield from tile(key, held)

    return run


def nearest(vectors: DataFrame, k: int = 5, min_score: float = -1.0, dim: int = 64) -> DataFrame:
    """(provider, model_version, vec_id, hit_no, neighbour, score): the k most similar other vectors of every usable vector.

    Similar is cosine, rounded to 9 decimals; ties go to the smaller vec_id. Pairs under `min_score` are left out. Only
    vectors of the same provider and model_version are compared (null is a value of its own). Unusable rows (see
    usable_vectors) neither ask nor answer; an empty table gives no rows; other columns are ignored.

    Plan: equal embeddings collapse to one representative with the k+1 smallest ids of its members, so copies, however
    many, cost one row (the group limit works before the shuffle and moves no embedding). A group's representatives are
    split by hash into g parts; each of the g(g+1)/2 pairs of parts is one tile, whose products serve both sides, so a
    row moves g times and a task holds two parts at any size. The g lists of a row are merged to its best. Exact, hence
    quadratic in a group's different vectors.
    """
    usable = usable_vectors(vectors, dim).withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    narrow = usable.select(*KEY, "vec_id")
    by_id = Window.partitionBy(*KEY).orderBy("vec_id")
    equal = narrow.withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= k + 1).groupBy(*KEY).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    reps = equal.withColumn("vec_id", F.col("ids")[0]).join(usable.select(*GROUP, "vec_id", "embedding"), [*GROUP, "vec_id"])
    groups = _named(vectors).groupBy(*GROUP).agg(F.count("*").alias("n"))
    most = max(1, LARGEST_PART * 64 // max(64, dim))  # longer vectors, smaller parts: a task's memory stays
    parts = F.greatest(F.ceil(F.col("n") / most), F.least(F.ceil(F.col("n") / PART), F.lit(SPREAD))).cast("int")
    groups = groups.select(*GROUP, parts.alias("g"))
    few = _named(vectors).select(*GROUP).distinct().count() <= BROADCAST_GROUPS
    split = reps.join(F.broadcast(groups) if few else groups, GROUP).withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.col("g")).cast("int"))
    copies = split.select(*KEY, "ids", "embedding", "part", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).select(
        *KEY, "ids", "embedding", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), (F.col("part") > F.col("other")).cast("int").alias("side")
    )
    tasks = max(48, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = (
        copies.repartition(tasks, *GROUP, "a", "b")
        .sortWithinPartitions(*GROUP, "a", "b", "side")
        .mapInArrow(_tiles(k, min_score, dim), "_p string, _m string, h1 long, h2 int, ids array<long>, scores array<double>")
    )
    lists = best.select(*KEY, F.transform(F.arrays_zip("ids", "scores"), lambda h: F.struct((-h["scores"]).alias("s"), h["ids"].alias("id"))).alias("hits"))
    merged = lists.groupBy(*KEY).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("vec_id")), 1, k)
    return (
        narrow.join(merged, KEY)
        .select(*GROUP, "vec_id", F.posexplode(others).alias("pos", "hit"))
        .select(_value("_p").alias("provider"), _value("_m").alias("model_version"), "vec_id", (F.col("pos") + 1).alias("hit_no"), F.col("hit.id").alias("neighbour"), (-F.col("hit.s")).alias("score"))
    )


def similar_pairs(vectors: DataFrame, k: int = 5, min_score: float = 0.85, dim: int = 64) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs in which one is among the k nearest of the other and the cosine reaches min_score."""
    hits = nearest(vectors, k, min_score, dim)
    return hits.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
