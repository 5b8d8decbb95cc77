"""Compression classifier of quality: how much better one class's dictionary compresses a text than the other's.

Two zstandard dictionaries are built, from pieces of texts labelled good and of texts labelled bad, wherever in the text
they are. A whole text is cut into
chunks of ``chunk`` bytes, so that the dictionaries stay near every part of it, and each chunk is compressed with both.
The normalised difference of the sums, ``(bad - good) / max(bad, good)``, the same of the worst chunk, the rate with the
good dictionary and the length go through a logistic fitted on other labelled texts: a calibrated score.

Dictionaries and calibration take bounded samples of labelled documents (``per_class``, ``calibration``), and of each
sampled document a dictionary takes ``pieces`` pieces of ``piece`` characters, chosen by a hash over the whole text; every
document is scored as a whole.

Cases: null and empty texts get the score of an empty chunk; without labels of both kinds the score is the labels' mean;
repeated rows score alike; very long texts are compressed chunk by chunk to their end; an empty table gives an empty
result; further columns pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import common
from .calibration import Logistic, labelled_samples, remainder
from .token_files import _dictionary, train

FOLDS, HELD_OUT, CUT = 5, 0, 0.3


class Sizes:
    """Features of a text, by two compressors."""

    def __init__(self, good: bytes, bad: bytes, chunk: int = 2048, level: int = 3):
        import zstandard

        make = lambda d: zstandard.ZstdCompressor(level, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False)
        self.good, self.bad, self.chunk = make(good), make(bad), chunk

    def __call__(self, text: str | None) -> tuple[float, float, float, float]:
        data = (text or "").encode()
        good = bad = 0
        worst = 1.0
        for at in range(0, max(1, len(data)), self.chunk):
            part = data[at : at + self.chunk]
            g, b = len(self.good.compress(part)), len(self.bad.compress(part))
            good, bad = good + g, bad + b
            if at == 0 or len(part) >= 512:  # a short rest says little
                worst = min(worst, (b - g) / max(b, g))
        return (bad - good) / max(bad, good), worst, good / max(1, len(data)), float(np.log1p(len(data)))


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    logistic: Logistic

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, per_class: int = 1500, calibration: int = 3000, size: int = 65_536, pieces: int = 4, piece: int = 2048) -> QualityModel:
        sample = labelled_samples(docs, labels, "quality", learn, per_class, calibration)
        count = F.ceil(F.length("text") / piece).cast("int")
        numbered = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(F.xxhash64("doc_id", k).alias("h"), k.alias("k")))
        chosen = F.transform(F.slice(F.array_sort(numbered), 1, pieces), lambda x: F.substr("text", (x.k - 1) * piece + 1, F.lit(piece)))
        rows = sample.where("role = 'example' and text != ''").select("doc_id", "label", chosen.alias("pieces"))
        texts: dict[int, list[bytes]] = {0: [], 1: []}
        for row in rows.orderBy("doc_id").toLocalIterator():
            texts[row.label].extend(p.encode() for p in row.pieces)
        good, bad = train(texts[1], size), train(texts[0], size)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = Sizes(good, bad)
            for batch in batches:
                x = [list(sizes(t)) for t in batch["text"].to_pylist()]
                yield pa.record_batch([batch["doc_id"], batch["label"], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

        rows = sample.where("role = 'calibration'").select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x array<double>")
        got = rows.orderBy("doc_id").collect()
        return QualityModel(good, bad, Logistic.fit(np.array([r.x for r in got], float).reshape(-1, 4), np.array([r.label for r in got], float)))

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with the score (0 to 1, higher: better) in column ``name``, in place of one of that name."""
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            sizes = Sizes(model.good, model.bad)
            for batch in batches:
                x = np.array([sizes(t) for t in batch["text"].to_pylist()], float).reshape(-1, 4)
                kept = {n: batch[n] for n in batch.schema.names if n != name}
                yield pa.record_batch([*kept.values(), pa.array(model.logistic(x))], names=[*kept, name])

        schema = StructType([f for f in docs.schema.fields if f.name != name]).add(name, DoubleType())
        return docs.mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns from labels outside the held-out fold."""
    return QualityModel.fit(docs, labels, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)


def op5_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = fitted(docs, common.table(spark, sf_dir, "labels")).score(docs)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
