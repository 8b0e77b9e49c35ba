"""Filling containers of fixed capacity with whole documents (problem 8)."""

from __future__ import annotations

import base64
import functools
import math
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.bpe import PATTERN, VOCABULARIES

CAPACITY = 2048
#: Documents packed together by one task; a larger group leaves less space in its last container.
GROUP_ROWS = 8192
#: The search of a group ends after so many containers in a row that nothing could be moved from, and after so many exchanges looked at.
PATIENCE, EFFORT = 64, 2_000_000


@functools.lru_cache(maxsize=2)
def _counter(folder: str, name: str) -> tiktoken.Encoding:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, tokens) of every row; null and empty texts have 0 tokens. Texts do not leave their partition."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(folder, tokenizer).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(count(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


def least_containers(sizes: list[int], capacity: int) -> int:
    """A number of containers no packing can go below: what the total needs; what is left of the items from a size on when
    those over half a container have one each and take what fits beside them; the items over a k-th, of which fewer than k share one."""
    x = np.sort(np.asarray([n for n in sizes if n], np.int64))
    total = np.r_[0, np.cumsum(x)]
    between = lambda a, b: (int(np.searchsorted(x, b) - np.searchsorted(x, a)), int(total[np.searchsorted(x, b)] - total[np.searchsorted(x, a)]))
    best = -(-int(total[-1]) // capacity)
    for size in np.unique(x[x * 2 <= capacity]):
        alone, _ = between(capacity - size + 1, capacity + 1)
        half, filled = between(capacity // 2 + 1, capacity - size + 1)
        _, rest = between(size, capacity // 2 + 1)
        best = max(best, alone + half + max(0, -(-(rest - (half * capacity - filled)) // capacity)))
    for k in range(2, 17):
        best = max(best, -(-int((x * k > capacity).sum()) // (k - 1)))
    return best


class Bins:
    """Containers with their items, and the best-fit start and the swap search over them."""

    def __init__(self, capacity: int, patience: int = PATIENCE, effort: int = EFFORT):
        self.capacity, self.patience, self.effort = capacity, patience, effort
        self.items: list[list[tuple[int, int]]] = []
        self.fill: list[int] = []

    def open(self, item: tuple[int, int]) -> None:
        self.items.append([item])
        self.fill.append(item[0])

    def start(self, items: list[tuple[int, int]]) -> None:
        """Best fit, largest first: free is sorted by (space, container)."""
        free: list[tuple[int, int]] = []
        for item in sorted(items, reverse=True):
            at = bisect_left(free, (item[0], -1))
            if at == len(free):
                self.open(item)
                k = len(self.fill) - 1
            else:
                k = free.pop(at)[1]
                self.items[k].append(item)
                self.fill[k] += item[0]
            if self.fill[k] < self.capacity:
                insort(free, (self.capacity - self.fill[k], k))

    def search(self) -> None:
        """Swap-based local search: while more containers are used than any packing needs, take the emptiest one and give its
        items away by moves, one-for-one and two-for-one exchanges with other underfull ones. Each step raises the sum of
        squared fills (the target, never emptier than the source, gets fuller), so it ends; a container left empty goes.
        It gives up after `patience` sources in a row without a step, and after `effort` exchanges looked at.
        """
        used = sum(map(bool, self.items))
        least = least_containers([x[0] for b in self.items for x in b], self.capacity)
        tried: set[int] = set()
        failed = 0
        while used > least and failed < self.patience and self.effort > 0:
            open_ = sorted((f, k) for k, f in enumerate(self.fill) if self.items[k] and f < self.capacity)
            source = next((k for _, k in open_ if k not in tried), None)
            if source is None:
                return
            if self._empty(source, [k for _, k in reversed(open_) if k != source]):
                failed = 0
                used -= not self.items[source]
            else:
                tried.add(source)
                failed += 1

    def _give(self, source: int, target: int, out: list, back: list) -> None:
        for x in out:
            self.items[source].remove(x)
            self.items[target].append(x)
        for x in back:
            self.items[target].remove(x)
            self.items[source].append(x)
        moved = sum(x[0] for x in out) - sum(x[0] for x in back)
        self.fill[source] -= moved
        self.fill[target] += moved

    def _step(self, source: int, target: int) -> bool:
        """The move, else the exchange, that fills the target most; the partner of an item is found by binary search."""
        space = self.capacity - self.fill[target]
        mine = sorted(self.items[source])
        sizes = [x[0] for x in mine]
        at = bisect_right(sizes, space)
        self.effort -= 1
        if at:
            self._give(source, target, [mine[at - 1]], [])
            return True
        best = (0, [], [])
        theirs = {y[0]: y for y in self.items[target]}
        self.effort -= len(theirs) * len(mine)
        for n, y in theirs.items():
            limit = n + space
            k = bisect_right(sizes, limit) - 1
            if k >= 0 and sizes[k] - n > best[0]:  # one for one
                best = (sizes[k] - n, [mine[k]], [y])
            for i in range(min(k, len(mine) - 1), 0, -1):  # two for one, the second one smaller or as large
                j = min(bisect_right(sizes, limit - sizes[i]), i) - 1
                if j >= 0 and sizes[i] + sizes[j] - n > best[0]:
                    best = (sizes[i] + sizes[j] - n, [mine[i], mine[j]], [y])
            if best[0] == space:
                break
        if best[0]:
            self._give(source, target, best[1], best[2])
        return bool(best[0])

    def _empty(self, source: int, targets: list[int]) -> bool:
        changed = False
        for t in targets:
            while self.effort > 0 and self.items[source] and self.fill[t] < self.capacity and self.fill[t] >= self.fill[source] and self._step(source, t):
                changed = True
        return changed


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(item, container, piece): an item within the capacity is whole; a larger one is cut into full pieces, which have a
    container each, and a rest that is packed like an item. Items of size 0 share the first container.
    """
    out, rest, container = [], [], 0
    for i, n in enumerate(sizes):
        full = n // capacity if n > capacity else 0
        for p in range(full):
            out.append((i, container, p))
            container += 1
        if n - full * capacity or not n:
            rest.append((n - full * capacity, i))
    bins = Bins(capacity)
    bins.start([x for x in rest if x[0]])
    bins.search()
    kept = [b for b in bins.items if b] or [[]]
    kept[0] = kept[0] + [x for x in rest if not x[0]]
    for b in kept:
        out += [(i, container, sizes[i] // capacity if sizes[i] > capacity else 0) for _, i in b]
        container += bool(b)
    return out


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, container, piece): a container for every document, whole unless it alone exceeds the capacity.

    Piece p of a document holds its tokens from p * capacity on; pieces of one document but the last fill their container.
    Null and empty texts have 0 tokens and share a container. Repeated rows are placed each; a null doc_id is placed like
    any other. Other columns are ignored; an empty table gives no rows. container is unique over the whole result.

    Plan: only (doc_id, tokens) is shuffled, into groups of about `group_rows` rows by a hash, so no key can be hot; each
    group is packed by one task, in bounded time, and leaves at most a few underfull containers, whatever the size of the table.
    """
    sized = token_counts(documents, tokenizer, folder)
    groups = max(1, math.ceil(documents.count() / group_rows))
    spread = sized.withColumn("_group", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(groups)).cast("long"))
    schema = pa.schema([("doc_id", pa.int64()), ("container", pa.int64()), ("piece", pa.int32())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        group = rows.column("_group")[0].as_py()
        item, container, piece = zip(*pack(rows.column("tokens").to_pylist(), capacity))
        return pa.Table.from_arrays([rows.column("doc_id").take(pa.array(item)), pa.array([(group << 32) + c for c in container]), pa.array(piece, pa.int32())], schema=schema)

    spark = documents.sparkSession  # a number of partitions that is named is not folded into fewer
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    return spread.repartition(tasks, "_group").groupBy("_group").applyInArrow(run, "doc_id long, container long, piece int")
