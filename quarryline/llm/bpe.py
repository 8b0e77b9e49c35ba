"""Encoding texts with a public byte-level BPE vocabulary by recursive DuckDB queries (problem 7)."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters only, on which the standard module agrees and is faster.
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Encoded words kept by a worker, and new words handed to one recursive query.
KEEP, AT_ONCE = 400_000, 20_000

#: Words of more characters are cut where no token of the vocabulary can reach across.
LONG = 32

#: The keyed table holds the newest token at each position of a word (-1 where it became part of the one before), so its size
#: does not grow with the steps; a step looks only at words that the step before has changed.
MERGE = """
with recursive t(w, i, tok) using key (w, i) as (
  select w, i, tok from words
  union all
  (with live as (
     select w, i, tok from recurring.t where tok >= 0 and w in (select w from t)),
   pair as (
     select w, i, tok, lead(tok) over a as nxt, lead(i) over a as j from live window a as (partition by w order by i)),
   ranked as (
     select p.w, p.i, p.j, m.merged, m.rank, min(m.rank) over (partition by p.w) as least
     from pair p left join merges m on m.l = p.tok and m.r = p.nxt),
   hit as (
     select *, coalesce(rank = least, false) as is_hit, row_number() over (partition by w order by i) as k
     from ranked where least is not null),
   run as (
     select *, k - row_number() over (partition by w, is_hit order by i) as island from hit),
   begun as (
     select w, i, j, merged, is_hit and row_number() over (partition by w, is_hit, island order by i) % 2 = 1 as starts from run)
   select w, unnest([i, j]) as i, unnest([merged, -1]) as tok from begun where starts)
)
select w, list(tok order by i) as ids from t where tok >= 0 group by w
"""


@functools.lru_cache(maxsize=2)
def _tables(folder: str, name: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Merge table (l, r, rank, merged), the id of each byte, and for each pair of bytes (the first one times 256 and the second)
    whether a token holds them side by side, from the published rank file.

    A token's parts are found as the vocabulary defines them: its bytes merged while a pair of lower rank remains.
    """
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    table = pa.table(
        {
            "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
            "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()),
            "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        }
    )
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(n) for a, n in (line.split() for line in f if line.strip())}
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
    every = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int32)
    within = np.ones(len(every), bool)
    within[np.cumsum([len(k) for k in ranks]) - 1] = False  # the last byte of a token has no next one
    joins = np.zeros(1 << 16, bool)
    joins[(every[:-1] * 256 + every[1:])[within[:-1]]] = True
    return table, single, joins


class Encoder:
    """Encodes words once each and keeps their ids; one for each Python worker."""

    def __init__(self, folder: str, name: str):
        merges, self.single, self.joins = _tables(folder, name)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.con.execute("create table merges as select * from merges")
        self.known: dict[str | bytes, list[int]] = {}
        self.split_any, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.A).findall

    def split(self, text: str) -> list[str | bytes]:
        words = (self.split_ascii if text.isascii() and not ODD_SPACE.search(text) else self.split_any)(text)
        if max(map(len, words), default=0) > LONG:
            return list(chain.from_iterable(self.pieces(w) if len(w) > LONG else (w,) for w in words))
        return words

    def pieces(self, word: str) -> list[bytes]:
        """A long word cut between bytes that no token holds side by side. A merge gives a token, so none reaches across such a
        place, and the ids of the word are those of its pieces."""
        data = word.encode("utf-8", "replace")
        x = np.frombuffer(data, np.uint8).astype(np.int32)
        cuts = (np.flatnonzero(~self.joins[x[:-1] * 256 + x[1:]]) + 1).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]

    def _merge(self, words: list[str | bytes]) -> None:
        data = [w if isinstance(w, bytes) else w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        starts = np.cumsum(sizes) - sizes
        w = np.repeat(np.arange(len(data), dtype=np.int32), sizes)
        i = (np.arange(int(sizes.sum())) - np.repeat(starts, sizes)).astype(np.int32)
        self.con.register("words", pa.table({"w": w, "i": i, "tok": self.single[np.frombuffer(b"".join(data), np.uint8)]}))
        found = self.con.sql(MERGE).to_arrow_table()
        self.con.unregister("words")
        for k, ids in zip(found.column("w").to_pylist(), found.column("ids").to_pylist()):
            self.known[words[k]] = ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.split(t) for t in texts]
        if len(self.known) > KEEP:
            self.known.clear()
        new = list(set(chain.from_iterable(parts)) - self.known.keys())
        for at in range(0, len(new), AT_ONCE):
            self._merge(new[at : at + AT_ONCE])
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]


@functools.lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def batches_of(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters, so memory doesn't follow the batch; one longer text is its own range."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def token_ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): the token ids of every row's text, without special tokens.

    An empty text has an empty list and so has a null text; doc_id may be null and rows may repeat (each row gives one
    row). Other columns are ignored. Strings of special tokens in a text are ordinary text. An empty table gives no rows.

    Method: texts are split by the vocabulary's pattern; the different words of a batch become token-position rows that a
    recursive DuckDB query joins with the merge table, contracting each word's leftmost pairs of least rank (all that do
    not overlap, in one step, which gives the same as one after the other since a merged token only takes part in later
    ranks) until none is left; an ordered aggregation gives the ids of a word. Long words are cut first where no token can reach across. Texts are then put together from words.
    A narrow map over partitions: no shuffle, nothing broadcast but the path.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in batches_of(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(enc.encode([t or "" for t in texts[s:e]]), pa.list_(pa.int32()))], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
