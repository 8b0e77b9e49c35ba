"""Subject areas of documents (problem 9)."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.sources.tables import bounded_sample

#: Labelled documents the space is fitted on at most, the characters of each at most, its dimensions, and the rounds that refine the centroids.
FIT_DOCUMENTS, FIT_LENGTH, DIMENSIONS, ROUNDS = 12_000, 20_000, 64, 6
#: A passage counts for a subject from this cosine and length of its vector on; a subject is a main one from this share of the counting passages on.
COSINE, WEIGHT, MAIN_SHARE = 0.3, 0.15, 0.25
#: A term must stand in this many documents of the sample.
LEAST = 3

WORD = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+|[A-ZÀ-ÖØ-Þ](?:[^\W\d_A-ZÀ-ÖØ-Þ]+|[A-ZÀ-ÖØ-Þ]+(?![^\W\d_A-ZÀ-ÖØ-Þ]))?").findall
PASSAGE = re.compile(r"[.!?:;](?=\s)|\n")


def words(text: str) -> list[str]:
    """Lower-case words; compound names are split at their capitals."""
    return [w.lower() for w in WORD(text)]


def passages(text: str) -> list[str]:
    """Sentences and lines of a text in composed form."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return [p for p in PASSAGE.split(text) if p and not p.isspace()]


class Numbers(dict):
    """The number of a word as it stands in a text, None for words that have none; lower case is made once for each word."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> int | None:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = self.index.get(word.lower())
        return found


@dataclass
class Space:
    """Terms with their weighted vectors, and the centroids (unit length) with the subject of each."""

    index: dict[str, int]
    vectors: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    subjects: list[str]
    both: np.ndarray | None = None  # the vectors with their products with the centroids, made once by each worker

    def shares(self, texts: list[str]) -> np.ndarray:
        """(texts, subjects): how much of each text's subject-bearing passages is about each subject; zero rows where none is."""
        number, ids, ends, doc = Numbers(self.index), [], [], []
        for d, t in enumerate(texts):
            for p in passages(t):
                found = [k for w in WORD(p) if (k := number[w]) is not None]
                if found:
                    ids += found
                    ends.append(len(ids))
                    doc.append(d)
        out = np.zeros((len(texts), len(self.subjects)))
        if not ids:
            return out
        # a passage's products with the centroids are the sums of its words' products: no matrix product, whose threads would
        # take cores that belong to other tasks
        both = np.concatenate([self.vectors, np.einsum("ij,kj->ik", self.vectors, self.centroids)], axis=1) if self.both is None else self.both
        self.both, width = both, self.vectors.shape[1]
        ids_, starts, doc_ = np.asarray(ids), np.r_[0, ends[:-1]].astype(int), np.asarray(doc)
        best = np.zeros((len(ends), len(self.subjects)), np.float32)
        size = np.zeros(len(ends), np.float32)
        at = 0
        while at < len(ends):  # a bounded number of words at a time
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + 200_000)))
            span = ids_[starts[at] : ends[to - 1]]
            v = np.add.reduceat(both[span], starts[at:to] - starts[at])
            norm = np.sqrt(np.einsum("ij,ij->i", v[:, :width], v[:, :width]))
            cos = v[:, width:] / np.maximum(norm, 1e-6)[:, None]
            for s in range(len(self.subjects)):
                best[at:to, s] = cos[:, self.owner == s].max(axis=1, initial=0)
            size[at:to] = norm
            at = to
        top = best.argmax(axis=1)
        ok = best[np.arange(len(top)), top] >= COSINE
        ok &= size >= WEIGHT
        np.add.at(out, (doc_[ok], top[ok]), size[ok] * best[np.arange(len(top)), top][ok])
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def _multiply(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Sparse (rows sorted) times dense, a bounded number of entries at a time."""
    out = np.zeros((n, right.shape[1]), np.float32)
    for at in range(0, len(rows), 100_000):
        r, part = rows[at : at + 100_000], right[cols[at : at + 100_000]] * values[at : at + 100_000, None]
        first = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        out[r[first]] += np.add.reduceat(part, first)
    return out


@dataclass
class Sample:
    """Labelled documents as numbers of their words: the words, each document's different ones with their counts, subjects and language."""

    index: dict[str, int]
    ids: list[np.ndarray]
    counts: list[np.ndarray]
    labels: list[set[str]]
    languages: list[str]

    def add(self, text: str, labels: set[str], language: str) -> None:
        """The text itself is not kept, so the driver holds eight bytes for a different word of a document."""
        give = self.index.setdefault
        ids, counts = np.unique(np.fromiter((give(w, len(self.index)) for w in words(unicodedata.normalize("NFC", text))), np.int32), return_counts=True)
        self.ids.append(ids)
        self.counts.append(counts.astype(np.int32))
        self.labels.append(labels)
        self.languages.append(language)

    def vocabulary(self) -> list[str]:
        """Words of two letters or more that stand in LEAST documents."""
        seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *self.ids]), minlength=len(self.index))
        return sorted(w for w, k in self.index.items() if seen[k] >= LEAST and len(w) > 1)

    def only(self, vocabulary: list[str]) -> Sample:
        """The sample over the words of a vocabulary, numbered in its order."""
        new = np.full(len(self.index) + 1, -1, np.int32)
        for k, w in enumerate(vocabulary):
            new[self.index[w]] = k
        ids = [new[x] for x in self.ids]
        return Sample({w: k for k, w in enumerate(vocabulary)}, [x[x >= 0] for x in ids], [n[x >= 0] for n, x in zip(self.counts, ids)], self.labels, self.languages)


def _telling(sample: Sample, subjects: list[str]) -> np.ndarray:
    """How much a term tells of the subject, 0 to 1: the divergence of the subjects of its documents from those of all
    documents, less what chance gives a term of so few documents."""
    seen = np.zeros((len(sample.index), len(subjects)))
    every = np.zeros(len(subjects))
    for ids, y in zip(sample.ids, sample.labels):
        own = [subjects.index(s) for s in y if s in subjects]
        for s in own:
            seen[ids, s] += 1 / len(own)
            every[s] += 1 / len(own)
    if every.sum() == 0:
        return np.ones(len(sample.index))
    n = seen.sum(axis=1)
    p = seen / np.maximum(n, 1e-9)[:, None]
    q = np.maximum(every / every.sum(), 1e-9)
    gain = np.where(p > 0, p * np.log(np.maximum(p, 1e-12) / q), 0).sum(axis=1)
    return np.where(n > 0, np.clip((gain - (len(subjects) - 1) / (2 * np.maximum(n, 1))) / 1.2, 0, 1), 0) ** 1.5


def fit(sample: Sample, described: dict[str, str], frequency: dict[str, int], total: int) -> Space:
    """Term weighting by the corpus-wide document frequency, truncated singular value decomposition of the sample
    (randomised subspace iteration), seed centroids for each subject and language from the labels, refined by turns of
    assigning the sample and averaging what a centroid keeps of its own label."""
    subjects = sorted(described)
    sample = sample.only(sorted(frequency))
    index, labels, languages, n = sample.index, sample.labels, sample.languages, len(sample.ids)
    if not index or not n:
        return Space({}, np.zeros((0, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, int), subjects)
    idf = np.log((1 + total) / (1 + np.array([frequency[w] for w in index], dtype=np.float64)))
    idf *= _telling(sample, subjects)
    r = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in sample.ids])
    c = np.concatenate(sample.ids)
    v = ((1 + np.log(np.concatenate(sample.counts))) * idf[c]).astype(np.float32)
    width = len(index)
    length = np.sqrt(np.bincount(r, v.astype(float) ** 2, n))
    v = (v / np.maximum(length, 1e-9)[r]).astype(np.float32)
    by_col = np.argsort(c, kind="stable")
    k = min(DIMENSIONS, n, width)
    basis = np.random.default_rng(7).normal(size=(width, min(k + 10, n, width))).astype(np.float32)
    for _ in range(5):
        left, _ = np.linalg.qr(_multiply(r, c, v, basis, n))
        basis, _ = np.linalg.qr(_multiply(c[by_col], r[by_col], v[by_col], left, width))
    _, _, turn = np.linalg.svd(_multiply(r, c, v, basis, n), full_matrices=False)
    terms = (basis @ turn.T)[:, :k]
    docs = _multiply(r, c, v, terms, n)
    mean = docs.mean(axis=0)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    # what all documents share says nothing of a subject
    shared = mean / max(1e-9, float(np.linalg.norm(mean)))
    terms = terms - np.outer(terms @ shared, shared)
    docs = unit(docs - np.outer(docs @ shared, shared))
    groups: dict[tuple[str, str], list[int]] = defaultdict(list)
    for d, y in enumerate(labels):
        if len(y) == 1:
            groups[next(iter(y)), languages[d]].append(d)
    seeds = [(s, docs[g].mean(axis=0)) for (s, _), g in sorted(groups.items()) if len(g) >= 2 and s in described]
    for s in subjects:  # a subject nobody labelled begins from its description
        if s not in {x for x, _ in seeds}:
            found = [index[w] for w in words(described[s] or "") if w in index]
            if found:
                seeds.append((s, (terms[found] * idf[found, None]).sum(axis=0)))
    if not seeds:
        return Space({}, np.zeros((0, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, int), subjects)
    owner = np.array([subjects.index(s) for s, _ in seeds])
    centroids = unit(np.stack([x for _, x in seeds]))
    given = np.zeros((n, len(subjects)), bool)
    for d, y in enumerate(labels):
        for s in y:
            if s in described:
                given[d, subjects.index(s)] = True
    for _ in range(ROUNDS):
        near = (docs @ centroids.T).argmax(axis=1)
        fresh = centroids.copy()
        for j in range(len(owner)):
            keep = (near == j) & given[:, owner[j]]
            if keep.sum() >= 2:
                fresh[j] = docs[keep].mean(axis=0)
        centroids = unit(fresh)
    return Space(index, (terms * idf[:, None]).astype(np.float32), centroids.astype(np.float32), owner, subjects)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int) -> Sample:
    """At most `most` labelled documents chosen by a hash of their id. A document's subjects are those that most of its labels
    name; ties keep all."""
    votes = labels.where("doc_id is not null and subject is not null").groupBy("doc_id", "subject").agg(F.countDistinct("labeler").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "subject")).alias("all"))
    chosen = best.select("doc_id", F.transform(F.filter("all", lambda x: x["n"] == F.col("top")), lambda x: x["subject"]).alias("subjects"))
    chosen = bounded_sample(chosen, ["doc_id"], most)
    rows = documents.select("doc_id", "text", "lang").where(F.length("text") <= FIT_LENGTH).join(F.broadcast(chosen), "doc_id")  # `most` rows
    sample = Sample({}, [], [], [], [])
    for r in rows.toLocalIterator():
        sample.add(r["text"], set(r["subjects"]), (r["lang"] or "")[:2].lower())
    return sample


def document_frequency(documents: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the (bounded) vocabulary stands, and the number of documents with text.

    Every partition counts its documents into one row a word, so what is shuffled is bounded by partitions times vocabulary.
    """
    index = {w: i for i, w in enumerate(vocabulary)}
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, number = np.zeros(len(index) + 1, np.int64), Numbers(index)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    if not t.isascii():
                        t = unicodedata.normalize("NFC", t)
                    counts[list({number[w] for w in WORD(t)} - {None})] += 1
                    counts[-1] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], schema=schema)

    rows = documents.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most one row a word
    n = {r["term"]: r["n"] for r in rows}
    return {w: n.get(i, 0) for w, i in index.items()}, n.get(len(vocabulary), 0)


def fit_on(documents: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = FIT_DOCUMENTS) -> Space:
    """The space fitted on a bounded labelled sample, weighted by frequencies over all documents."""
    described = {r["subject"]: r["description"] or "" for r in subjects.where("subject is not null").groupBy("subject").agg(F.max("description").alias("description")).collect()}  # the list of subjects, each once
    sample = labelled_sample(documents, labels, most)
    frequency, total = document_frequency(documents, sample.vocabulary())
    return fit(sample, described, frequency, total)


def subject_rows(documents: DataFrame, space: Space, main_share: float = MAIN_SHARE) -> DataFrame:
    """(doc_id, source, subject, share): a row for each main subject of each document.

    Passages that no centroid is near to (housekeeping, noise) do not count; a subject under `main_share` of what counts
    is a passing mention. Null, empty and meaningless texts give no row. Equal rows give equal rows each; a null doc_id is
    kept. Other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("subject", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources, texts = (b.column(i).to_pylist() for i in range(3))
            for at in range(0, len(ids), 500):
                shares = space.shares([t or "" for t in texts[at : at + 500]])
                d, s = np.nonzero(shares >= main_share)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at + i] for i in d], pa.int64()), pa.array([sources[at + i] for i in d], pa.string()), pa.array([space.subjects[j] for j in s], pa.string()), pa.array(shares[d, s])], schema=schema
                )

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, subject string, share double")


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """Fit on the labelled sample and give every document's main subjects (see subject_rows)."""
    return subject_rows(documents, fit_on(documents, labels, subjects))


def composition(rows: DataFrame) -> DataFrame:
    """(source, subject, documents): how many documents of each source are about each subject."""
    return rows.groupBy("source", "subject").agg(F.count("*").alias("documents"))
