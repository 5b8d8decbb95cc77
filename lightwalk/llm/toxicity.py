"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the examples (lower-cased, punctuation stripped at the ends); none is left out. Inverse document
frequencies come from all documents. Examples are vectors of ``(1 + ln tf) * idf ** power`` of length one. The index keeps
real postings: for each term the places and weights of the examples that have it, cut where a block of examples ends, with
the largest weight of each cut. For a text, the sum of its terms' largest weights bounds what any example of a block can
score; blocks are opened best bound first, a few at a time, until the k-th best similarity found is no worse than the next
bound, so the k nearest are exact (ties: smaller doc_id). Words that no example has would lower all similarities of a text
alike: cosines are those over the examples' words.

The nearest vote by similarity, and by its fourth power: the toxic share of the votes of the nearest 5, 15, 50 and 150 is
all that a logistic, fitted on other labelled documents, makes a calibrated score of. The nearest few are the evidence.

Examples and calibration are bounded samples (``per_class``, ``calibration``); every document counts for frequencies and
is scored, with its whole text.

Cases: texts without a word that an example has (null, empty) have no neighbours and the score of no votes; without labels
of both kinds the score is the labels' mean; repeated rows score alike; very long texts are one vector like any other; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .calibration import Logistic, labelled_samples, remainder

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\«»¿¡“”‘’…"
NEAREST = (5, 15, 50, 150)
SHARPNESS = (1, 4)  # powers of the similarity that a vote weighs


def word_counts(text: str | None) -> Counter[str]:
    """How often each word comes in the whole text."""
    total = Counter([token.strip(EDGES) for token in (text or "").lower().split()])
    total.pop("", None)
    return total


@dataclass
class Vocabulary:
    """The examples' words; their places in it are looked up in a table that a worker makes once."""

    words: pa.Array

    @cached_property
    def places(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def __getstate__(self):
        return {"words": self.words}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the known words of a text."""
        words = word_counts(text)
        found = list(map(self.places.get, words))
        known = np.array([x is not None for x in found], bool)
        return np.array([x for x in found if x is not None], np.int64), np.fromiter(words.values(), np.int64, len(words))[known]

    def present(self, text: str | None) -> list[int]:
        """Places of the known words of a text, each once."""
        found = set(map(self.places.get, {token.strip(EDGES) for token in (text or "").lower().split()}))
        found.discard(None)
        return list(found)


def weights(counts: np.ndarray, idf: np.ndarray, power: float) -> np.ndarray:
    """Weights of terms with these counts and inverse document frequencies, of length one."""
    w = (1 + np.log(counts)) * idf**power
    length = math.sqrt(float(w @ w))
    return w / length if length else w


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... ``count`` numbers each, end to end."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class BlockMax:
    """Postings of all terms over examples, in blocks of neighbours.

    Examples whose strongest frequent term is the same stand together, so that whole blocks have little in common with a
    text of another kind. Terms that a twentieth of the examples have keep a weight for every example, zeros included, and
    add exact sums for many texts at once; all others keep real postings and bounds. Weights are single-precision
    numbers, scores double.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, w: np.ndarray, vocabulary: int, block: int = 64):
        n = len(ids)
        sizes = np.diff(np.append(0, ends))
        owner = np.repeat(np.arange(n), sizes)
        often = np.bincount(terms, minlength=vocabulary) * 20 >= max(n, 1)
        kind = np.full(n, vocabulary)
        strong = np.lexsort((w, owner, ~often[terms]))[: np.count_nonzero(often[terms])]  # the strongest frequent term of each example comes last
        kind[owner[strong]] = terms[strong]
        order = np.lexsort((ids, sizes, kind))
        self.ids, self.order = np.asarray(ids)[order], order
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        at = place[owner]
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((np.count_nonzero(often), n))
        here = often[terms]
        self.rows[self.row[terms[here]], at[here]] = w[here].astype(np.float32)
        at, terms, w = at[~here], terms[~here], w[~here]
        by = np.lexsort((at, terms))
        self.place, self.weight = at[by], w[by].astype(np.float32).astype(float)
        term, cell = terms[by], at[by] // block
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (cell[1:] != cell[:-1]))) if len(term) else np.empty(0, np.int64)
        self.start, self.size, self.cell = first, np.diff(np.append(first, len(term))), cell[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.cuts = np.searchsorted(term[first], np.arange(vocabulary + 1))
        self.begin = np.arange(0, n, block)
        self.block, self.opened = block, 0

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, chunk: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text (terms, weights) the examples (as numbered when given) and similarities of its k nearest with any similarity at all, ties by id."""
        for first in range(0, len(texts), chunk):
            part = texts[first : first + chunk]
            asked = np.zeros((len(part), len(self.rows)))
            for i, (terms, w) in enumerate(part):
                row = self.row[terms]
                asked[i, row[row >= 0]] = w[row >= 0]
            for (terms, w), frequent in zip(part, asked @ self.rows, strict=True):
                yield self._nearest(terms, w, frequent, k)

    def _nearest(self, terms: np.ndarray, w: np.ndarray, frequent: np.ndarray, k: int, step: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """``frequent``: what frequent terms add for every example.

        ``step`` blocks are opened at a time; after each time the k-th similarity decides whether the next bound can matter.
        """
        if not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        counts = self.cuts[terms + 1] - self.cuts[terms]
        cut = _ranges(self.cuts[terms], counts)
        cell, factor, size = self.cell[cut], np.repeat(w, counts), self.size[cut]
        bound = np.maximum.reduceat(frequent, self.begin) + np.bincount(cell, factor * self.most[cut], len(self.begin))
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        by = np.argsort(cell, kind="stable")  # within a block terms keep their order, so sums come out alike
        ends = np.cumsum(np.bincount(cell, minlength=len(self.begin)))
        begins = np.append(0, ends[:-1])
        score = np.zeros(len(frequent))
        done = 0
        while done < len(order):
            if done:
                known = score[score > 0]
                if len(known) >= k and bound[order[done]] < np.partition(known, -k)[-k] - 1e-8:  # a hair of slack: sums are rounded in different orders
                    break
            now = order[done : done + step]
            some = by[_ranges(begins[now], ends[now] - begins[now])]
            post = _ranges(self.start[cut[some]], size[some])
            score += np.bincount(self.place[post], np.repeat(factor[some], size[some]) * self.weight[post], len(score))
            inside = _ranges(self.begin[now], np.minimum(self.block, len(score) - self.begin[now]))
            score[inside] += frequent[inside]
            done += len(now)
        self.opened += done
        near = np.flatnonzero(score > 0)
        if len(near) > k:
            near = near[score[near] >= np.partition(score[near], -k)[-k] - 1e-8]
        similar = np.round(score[near], 9)
        near, similar = near[similar > 0], similar[similar > 0]
        top = np.lexsort((self.ids[near], -similar))[:k]
        return self.order[near[top]], similar[top]


@dataclass
class ToxicityModel:
    """Examples (id, label, vector), frequencies, and how votes become a score."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    power: float
    ks: tuple[int, ...]
    logistic: Logistic = field(default_factory=lambda: Logistic.fit(np.empty((0, len(NEAREST) * len(SHARPNESS))), np.empty(0)))

    @cached_property
    def index(self) -> BlockMax:
        return BlockMax(self.ids, self.ends, self.terms, self.weights, len(self.idf))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def votes(self, texts: list[str | None]) -> list[tuple[list[float], np.ndarray, np.ndarray]]:
        """Of each text: the toxic share of the votes of so many nearest examples, for each number; the examples and their similarities."""
        counts = [self.vocabulary.counts(t) for t in texts]
        asked = [(terms, weights(n, self.idf[terms], self.power)) for terms, n in counts]
        out = []
        for near, similar in self.index.nearest(asked, max(self.ks)):
            shares, last = [], [min(k, len(near)) - 1 for k in self.ks]
            for sharp in SHARPNESS:
                votes = similar**sharp
                against, every = np.cumsum(votes * self.toxic[near]), np.cumsum(votes)
                shares += [float(against[i] / every[i]) if i >= 0 else 0.0 for i in last]
            out.append((shares, near, similar))
        return out

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, ks: tuple[int, ...] = NEAREST, per_class: int = 3000, calibration: int = 4000, power: float = 2.0) -> ToxicityModel:
        sample = labelled_samples(docs, labels, "toxic", learn, per_class, calibration)
        # At most 2 * per_class examples, as vectors of counts.
        rows = sample.where("role = 'example'").select("doc_id", "label", "text").mapInArrow(_counted, "doc_id long, label int, words array<string>, n array<int>").orderBy("doc_id").toArrow()
        lists = rows["words"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        terms, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["n"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vocabulary = Vocabulary(coded.dictionary)
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
        idf = _idf(docs, vocabulary)
        w = (1 + np.log(n)) * idf[terms] ** power
        owner = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
        w = w / np.maximum(np.sqrt(np.bincount(owner, w * w, len(ends))), 1e-300)[owner]
        model = ToxicityModel(vocabulary, idf, rows["doc_id"].to_numpy(), rows["label"].to_numpy().astype(np.int64), ends, terms.astype(np.int32), w.astype(np.float32), power, ks)
        got = model._voted(sample.where("role = 'calibration'")).select("label", "x").collect()
        got.sort(key=lambda r: (r.label, r.x))  # sums come out alike on every run
        model.logistic = Logistic.fit(np.array([r.x for r in got], float).reshape(-1, len(ks) * len(SHARPNESS)), np.array([r.label for r in got], float), ridge=1.0, squares=False)
        return model

    def _voted(self, docs: DataFrame) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                x = [x for x, _, _ in model.votes(batch["text"].to_pylist())]
                yield pa.record_batch([batch["label"], pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

        return docs.select("label", "text").mapInArrow(run, "label int, x array<double>")

    def score(self, docs: DataFrame, evidence: int = 5) -> DataFrame:
        """(doc_id, score, evidence): 0 to 1, higher: more likely toxic; the ``evidence`` nearest examples, nearest first."""
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                found = model.votes(batch["text"].to_pylist())
                score = model.logistic(np.array([x for x, _, _ in found], float).reshape(-1, len(model.ks) * len(SHARPNESS)))
                near, similar = (np.concatenate([np.empty(0, kind), *(f[j][:evidence] for f in found)]) for j, kind in ((1, np.int64), (2, float)))
                ends = np.cumsum([0, *(len(n[:evidence]) for _, n, _ in found)])
                columns = [pa.array(model.ids[near]), pa.array(similar), pa.array(model.toxic[near].astype(np.int32))]
                proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["doc_id", "similarity", "toxic"]))
                yield pa.record_batch([batch["doc_id"], pa.array(score), proof], names=["doc_id", "score", "evidence"])

        schema = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [sorted(word_counts(t).items()) for t in batch["text"].to_pylist()]
        columns = [pa.array([[w for w, _ in c] for c in counts], pa.list_(pa.string())), pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int32()))]
        yield pa.record_batch([batch["doc_id"], batch["label"], *columns], names=["doc_id", "label", "words", "n"])


def _idf(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Smoothed inverse document frequencies of the vocabulary over all documents; each task sums up before the shuffle."""
    sent, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(size + 1, np.int64)  # the last: documents
        for batch in batches:
            for text in batch["text"].to_pylist():
                total[known.present(text)] += 1
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(size + 1, np.int64)
    found[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 1


def op7_block_max_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = ToxicityModel.fit(docs, common.table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return model.score(docs).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
