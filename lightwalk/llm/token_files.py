"""Token-id files: each document's ids compressed by itself with a shared zstandard dictionary.

A file holds the documents of one range of ascending doc_id:

    one zstandard frame a document: its ids as little-endian u16 or u32 (by vocabulary)
    index, column by column: doc_id i64, null flag u8, place of the frame u64, length of the frame u32, first token u64, tokens u64
    magic (8 bytes) | SHA-256 of the dictionary (32) | place of the index, number of documents (2 x u64)

so one short document costs one seek and one small frame. First tokens count from the file's first document; a file's own
place follows from the counts of the files before it. The dictionary is trained on serialized ids of a bounded sample (it
only helps compression), lies beside the files under its hash, and a reader refuses another one.

Cases: null and empty texts are one end id; repeated ids stay, ordered by a hash of their text, and may lie in several
files; rows without doc_id come first; very long texts are one frame like any other; an empty table gives no rows; further
columns are ignored. Files are written under a name of their own for each attempt, and only
names that a finished task reports are read, so a lost or repeated task leaves nothing wrong behind.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"LWTOKEN1"
FOOT = struct.Struct("<8s32sQQ")
INDEX = (("doc_id", "<i8"), ("missing", "u1"), ("at", "<u8"), ("size", "<u4"), ("start", "<u8"), ("tokens", "<u8"))
FILES = "part int, path string, documents long, tokens long"
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def train(samples: list[bytes], size: int = 65_536) -> bytes:
    """A zstandard dictionary; empty (plain compression) where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class Writer:
    def __init__(self, stream, dictionary: bytes, kind: str, level: int = 3):
        import zstandard

        self.stream, self.kind, self.hash = stream, kind, hashlib.sha256(dictionary).digest()
        self.zip = zstandard.ZstdCompressor(level, dict_data=_dictionary(dictionary))
        self.index: list[tuple] = []
        self.at, self.tokens = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.zip.compress(ids.astype(self.kind).tobytes())
        self.stream.write(frame)
        self.index.append((doc_id or 0, doc_id is None, self.at, len(frame), self.tokens, len(ids)))
        self.at, self.tokens = self.at + len(frame), self.tokens + len(ids)

    def finish(self) -> None:
        for (_, kind), column in zip(INDEX, zip(*self.index, strict=True) if self.index else [()] * len(INDEX), strict=True):
            self.stream.write(np.array(column, kind).tobytes())
        self.stream.write(FOOT.pack(MAGIC, self.hash, self.at, len(self.index)))


class Reader:
    """Random access to one file's documents."""

    def __init__(self, source, dictionary: bytes, kind: str):
        import zstandard

        self.source, self.kind = source, kind
        size = source.size()
        magic, self.hash, frames, count = FOOT.unpack(source.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or self.hash != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file of this dictionary")
        width = sum(np.dtype(k).itemsize for _, k in INDEX)
        raw, at, self.index = source.read_at(width * count, frames), 0, {}
        for name, k in INDEX:
            self.index[name] = np.frombuffer(raw, k, count, at)
            at += count * np.dtype(k).itemsize
        self.zip = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        at, size = int(self.index["at"][k]), int(self.index["size"][k])
        return np.frombuffer(self.zip.decompress(self.source.read_at(size, at)), self.kind)

    def __iter__(self) -> Iterator[tuple]:
        for k in range(len(self.index["doc_id"])):
            doc_id = None if self.index["missing"][k] else int(self.index["doc_id"][k])
            yield doc_id, int(self.index["start"][k]), self.ids(k)


def sampled(texts: DataFrame, limit: int, most: int = 32_768) -> list[str]:
    """Slices of about ``limit`` of the rows (id, text), at most twice as many: which rows, and where a slice of at most ``most`` characters begins, is told by a hash.

    Rows are chosen before any text is sent, so the driver gets no more from a large table than from a small one.
    """
    texts = texts.toDF("id", "text").where(F.length("text") > 0)
    hashed = texts.select("text", F.xxhash64("id", "text").alias("h"))
    share = min(1.0, limit / max(1, texts.count()))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * limit)
    begin = F.pmod(F.shiftright("h", 40), F.greatest(F.lit(1), F.length("text") - most + 1)).cast("int") + 1
    return [r[0] for r in chosen.select(F.substr("text", begin, F.lit(most)), "h").orderBy("h").collect()]


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "<u2", sample: int = 600) -> tuple[DataFrame, bytes]:
    """Writes all documents below ``folder``; gives the list of files and the dictionary."""
    import os

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    encoder = tokens.encoder(tokenizer, "bytes")
    serial = lambda text: np.append(np.frombuffer(encoder(text), "<u4"), 0).astype(kind)
    dictionary = train([serial(t).tobytes() for t in sampled(docs, sample)])
    store, path = _files(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.zdict") as f:
        f.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        encode, part = tokens.encoder(tokenizer, "bytes"), TaskContext.get().partitionId()
        writer = stream = name = None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()  # one text at a time
                if writer is None:
                    name = f"{path}/{part:06d}-{uuid.uuid4().hex}.tok"
                    stream = store.open_output_stream(name)
                    writer = Writer(stream, dictionary, kind)
                writer.add(doc_id, np.append(np.frombuffer(encode(text), "<u4"), np.uint32(0)))
        if writer is not None:
            writer.finish()
            stream.close()
            yield pa.record_batch([pa.array([part], pa.int32()), [os.path.basename(name)], pa.array([len(writer.index)]), pa.array([writer.tokens])], names=["part", "path", "documents", "tokens"])

    # Rows of one id, and equal ones, may go to several files; row numbers are told by the splits that Spark reads, on every attempt alike.
    numbered = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = numbered.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    return common.materialize(ordered.mapInArrow(run, FILES), "token-files"), dictionary


def read(files: DataFrame, folder: str, dictionary: bytes, kind: str = "<u2", task_tokens: int = 1 << 22) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files alone; start counts over all files.

    A task reads files of about ``task_tokens`` tokens, one document at a time.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        for batch in batches:
            for name, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    rows = [(doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, start, ids in Reader(source, dictionary, kind)]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    names = common.materialize(files.select("path", "base", "tokens"), "token-bases")
    count, total = names.agg(F.count("*"), F.sum("tokens")).first()
    return names.select("path", "base").repartition(max(1, min(count, -(-(total or 0) // task_tokens)))).mapInArrow(run, OUT)


def op3_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_dir(spark, "token-store")
    files, dictionary = write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(files, folder, dictionary)
