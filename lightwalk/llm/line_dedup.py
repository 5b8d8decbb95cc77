"""Line dedup by sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; 128 bits of its SHA-256
stand for it. The exact table counts the documents that have each key. Keys at the threshold or above are frequent, and
go into cuckoo filters, one a shard of the key space. Documents can be added to and removed from the counts, which inserts
keys that reach the threshold into the filters and deletes keys that fall below it: the dedup is reversible.

To rewrite documents, the filters travel to the text: lines that they do not hold stay, without a look at the table. Lines
that they hold are frequent, but for a few false positives; those are found by an anti-join of the held keys against the
exact table and travel along as exceptions. Both are sent only while their checked size is within ``max_sent`` bytes.
Beyond that, held or not, the keys of each document are joined with the table, and the frequent ones brought back to it.

Cases: null and empty texts have one empty line; empty keys never count; a row is a document, so a repeated row counts
again; rows without doc_id are kept; very long texts and lines are hashed as a whole; an empty table gives an empty result;
further columns pass through ``rewrite``, but for those of the two counts' names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed value: what is stripped.
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTERS = "shard int, filter binary"


# --- cuckoo filter -------------------------------------------------------------------------------------------------


class Cuckoo:
    """Buckets of four 16-bit fingerprints. A key's two buckets are ``i`` and ``i xor hash(fingerprint)``; full tables double."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None, keys: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of (n, 2) u64 keys, with a quarter of it free at least."""
        buckets = 1 << max(1, math.ceil(math.log2(max(1, len(keys)) / cls.SLOTS / 0.75)))
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        return ((keys[:, 1] >> np.uint64(48)).astype(np.uint16) % np.uint16(65_535)) + np.uint16(1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = self.prints(keys)
        first = (keys[:, 0] >> np.uint64(20)).astype(np.int64) & (self.buckets - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket, mark):
        return (bucket ^ (mark.astype(np.int64) * 0x5BD1E995 >> 3)) & (self.buckets - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, key: np.ndarray) -> bool:
        mark, a, b = (x[0] for x in self.places(key[None, :]))
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = a
        for kick in range(self.KICKS):
            slot = (int(mark) + kick) % self.SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self.other(np.int64(bucket), mark))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: np.ndarray) -> bool:
        mark, a, b = (x[0] for x in self.places(key[None, :]))
        for bucket in (a, b):
            found = np.flatnonzero(self.table[bucket] == mark)
            if len(found):
                self.table[bucket, found[0]] = 0
                return True
        return False

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)


def _words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys[:, 0] & np.uint64(0xFFFFF)) % np.uint64(shards)).astype(np.int64)


# --- keys ----------------------------------------------------------------------------------------------------------


def line_key(line: str) -> bytes:
    """The key's 128 bits; empty for an empty key."""
    key = line.encode().strip(BLANKS.encode()).lower()  # on bytes: A-Z only
    return hashlib.sha256(key).digest()[:16] if key else b""


def document_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(key) once for each document that has it, from the JVM alone."""
    line = F.explode(F.array_distinct(F.transform(F.split(F.col("text"), "\n"), lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER))))
    lines = docs.where(F.col("text").isNotNull()).select(line.alias("line")).where(F.length("line") >= min_chars)
    return lines.select(F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("key"))


def _shard_column(shards: int) -> F.Column:
    """The shard of a key, as ``_shard`` has it: the low 20 bits of its first eight bytes, little-endian."""
    byte = lambda k: F.conv(F.hex(F.substring("key", k, 1)), 16, 10).cast("int")
    low = byte(1) + byte(2) * 256 + (byte(3) % 16) * 65_536
    return F.pmod(low, F.lit(shards)).cast("int")


# --- state ---------------------------------------------------------------------------------------------------------


@dataclass
class LineDedup:
    """References of all keys (key, refs), filters of the frequent ones (shard, filter), and how they are made."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    threshold: int
    min_chars: int = 1

    @staticmethod
    def build(docs: DataFrame, threshold: int = 10, min_chars: int = 1, shard_keys: int = 65_536) -> LineDedup:
        refs = common.materialize(document_keys(docs, min_chars).groupBy("key").agg(F.count("*").alias("refs")), "line-refs")
        frequent = refs.where(F.col("refs") >= threshold)
        shards = max(1, math.ceil(frequent.count() / shard_keys))

        def make(rows: pa.Table) -> pa.Table:
            keys = _words(sorted(rows["key"].to_pylist()))
            return pa.table([pa.array([rows["shard"][0].as_py()], pa.int32()), pa.array([Cuckoo.of(keys).dump()], pa.binary())], names=["shard", "filter"])

        filters = frequent.select(_shard_column(shards).alias("shard"), "key").groupBy("shard").applyInArrow(make, FILTERS)
        return LineDedup(refs, common.materialize(filters, "line-filters"), shards, threshold, min_chars)

    def add(self, docs: DataFrame) -> LineDedup:
        return self._changed(docs, 1)

    def remove(self, docs: DataFrame) -> LineDedup:
        """Takes documents out that were added before."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineDedup:
        delta = document_keys(docs, self.min_chars).groupBy("key").agg((sign * F.count("*")).alias("delta"))
        both = self.refs.withColumn("delta", F.lit(0).cast("long")).unionByName(delta.withColumn("refs", F.lit(0).cast("long")))
        summed = common.materialize(both.groupBy("key").agg(F.sum("refs").alias("old"), (F.sum("refs") + F.sum("delta")).alias("refs")), "line-refs")
        now, was = F.col("refs") >= self.threshold, F.col("old") >= self.threshold
        step = F.when(now & ~was, 1).when(~now & was, -1).otherwise(0)
        crossing = summed.where((F.col("old") >= self.threshold) | now).select(_shard_column(self.shards).alias("shard"), "key", step.alias("step"))

        def update(old: pa.Table, rows: pa.Table) -> pa.Table:
            shard = (old if old.num_rows else rows)["shard"][0].as_py()
            keys, steps = rows["key"].to_pylist(), rows["step"].to_pylist()
            held = Cuckoo.load(old["filter"][0].as_py()) if old.num_rows else Cuckoo(2)
            full = False
            for key, step in sorted(zip(keys, steps, strict=True)):
                if step < 0:
                    held.delete(_words([key])[0])
                elif step > 0:
                    full = full or not held.insert(_words([key])[0])
            if full:  # made anew, larger, from the exact table's keys
                held = Cuckoo.of(_words([k for k, s in sorted(zip(keys, steps, strict=True)) if s >= 0]))
            return pa.table([pa.array([shard], pa.int32()), pa.array([held.dump()], pa.binary())], names=["shard", "filter"])

        filters = self.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(update, FILTERS)
        refs = summed.where("refs > 0").select("key", "refs")
        return LineDedup(refs, common.materialize(filters, "line-filters"), self.shards, self.threshold, self.min_chars)

    def frequent(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.threshold).select("key")

    def rewrite(self, docs: DataFrame, max_sent: int = 64 << 20, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
        """``docs`` with text (frequent lines gone, the others joined by newlines) and two counts, in place of columns of their names."""
        size = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        if size <= max_sent:
            filters = {r.shard: r.filter for r in self.filters.collect()}
            known = docs.sparkSession.sparkContext.broadcast((filters, frozenset()))
            held = docs.select("text").mapInArrow(_held(known, self.shards), "key binary").distinct()
            wrong = common.materialize(held.join(self.frequent(), "key", "left_anti"), "line-exceptions")
            if 100 * wrong.count() <= max_sent:
                known = docs.sparkSession.sparkContext.broadcast((filters, frozenset(bytes(r.key) for r in wrong.collect())))
                return docs.mapInArrow(_dropping(known, self.shards, counts), _rewritten(docs, counts))
        return self._joined(docs, counts)

    def _joined(self, docs: DataFrame, counts: tuple[str, str]) -> DataFrame:
        """The way without a bound on what is frequent: (row, key) pairs meet the table, and go back to their rows."""
        # Row numbers must not change between reads, so that they are written first.
        row, dropped = common.free_names(docs, "row", "gone")
        rows = common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")
        key = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.unhex(F.substring(F.sha2(F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER), 256), 1, 32)))
        pairs = rows.select(F.col(row).alias("r"), F.explode(F.array_distinct(key)).alias("key"))
        gone = pairs.join(self.frequent(), "key", "left_semi").groupBy(F.col("r").alias(row)).agg(F.collect_list("key").alias(dropped))
        joined = rows.join(gone, row, "left").drop(row)
        return joined.mapInArrow(_dropping(None, self.shards, counts, dropped), _rewritten(docs, counts))


def _rewritten(docs: DataFrame, counts: tuple[str, str]):
    from pyspark.sql.types import LongType, StructType

    kept = [f for f in docs.schema.fields if f.name not in counts]
    return StructType(kept).add(counts[0], LongType()).add(counts[1], LongType())


def _probe(keys: list[bytes], loaded: dict[int, Cuckoo], wrong: frozenset, shards: int) -> set[bytes]:
    """Those of the keys that the filters hold and that are no exceptions."""
    if not keys or not loaded:
        return set()
    words = _words(keys)
    held, shard = np.zeros(len(keys), bool), _shard(words, shards)
    for k in np.unique(shard):
        if k in loaded:
            at = np.flatnonzero(shard == k)
            held[at] = loaded[k].has(words[at])
    return {keys[i] for i in np.flatnonzero(held)} - wrong


def _lines(texts: list[str | None]) -> Iterator[list[tuple[str, bytes]]]:
    for text in texts:
        yield [(line, line_key(line)) for line in (text or "").split("\n")]


def _held(known, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, wrong = known.value
        loaded, seen = {k: Cuckoo.load(v) for k, v in filters.items()}, set()
        for batch in batches:
            keys = list({key for lines in _lines(batch["text"].to_pylist()) for _, key in lines if key})
            new = _probe(keys, loaded, wrong, shards) - seen
            if len(seen) < 1 << 17:  # only saves rows; what comes twice is made distinct later
                seen |= new
            yield pa.record_batch([pa.array(sorted(new), pa.binary())], names=["key"])

    return run


def _dropping(known, shards: int, counts: tuple[str, str], dropped: str | None = None):
    """Texts without their frequent lines: those that the filters hold, or those that the column ``dropped`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known is not None:
            filters, wrong = known.value
            loaded = {k: Cuckoo.load(v) for k, v in filters.items()}
        for batch in batches:
            docs = list(_lines(batch["text"].to_pylist()))
            if known is not None:
                gone = _probe(list({key for lines in docs for _, key in lines if key}), loaded, wrong, shards)
                each = [gone] * len(docs)
            else:
                each = [set(x or ()) for x in batch[dropped].to_pylist()]
            kept = [[line for line, key in lines if key not in gone] for lines, gone in zip(docs, each, strict=True)]
            out = {name: batch[name] for name in batch.schema.names if name not in (dropped, *counts)}
            out["text"] = pa.array(["\n".join(x) for x in kept], pa.string())
            out[counts[0]] = pa.array([len(x) for x in docs], pa.int64())
            out[counts[1]] = pa.array([len(x) - len(y) for x, y in zip(docs, kept, strict=True)], pa.int64())
            yield pa.record_batch(list(out.values()), names=list(out))

    return run


def op8_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = LineDedup.build(docs, threshold=10, min_chars=1).rewrite(docs)
    return found.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with l as (
  select rowid as row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from (select *, row_number() over () as rowid from documents)
), k as (select *, translate(trim(line, E' \t\n\v\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (select key from k where length(key) >= 1 group by key having count(distinct row) >= 10)
select any_value(k.doc_id) as doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (f.key is null), '')) as kept_sha256
from k left join f using (key) group by row
"""
