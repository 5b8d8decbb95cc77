"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, ``width``-word shingles with repeats (fewer words: all of
them; none: fingerprint zero), XXH64 with seed 42; a bit is 1 if over half the hashes have it.

Links are pairs of fingerprints with at most ``radius`` differing bits. Equal fingerprints are one from the start. The 64
bits are cut into ``radius + 2`` blocks; two linked fingerprints agree in at least two, so rows meet in buckets by every
pair of blocks, exactly. A bucket larger than ``tile`` is dealt into tiles of two parts each, so none has to fit into a
task. In a bucket fingerprints are stored as bit planes: bit b of all rows side by side. One fingerprint is compared with
all rows after it at once: each plane gives a difference bit for every row, carry-save counters add it to every row's
count, and a block of rows is left as soon as all its counts exceed the radius. A bucket gives only links that span its
groups, since all others follow; components are then found over fingerprints.

Cases: null and empty texts have fingerprint zero, linked like any other; repeated rows are one fingerprint; a component's
id ignores null ids; very long texts are hashed as a whole, a part at a time; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """As an unsigned number."""
    import xxhash

    words = text.encode().lower().split() if text else []  # on bytes: A-Z, and the six white-space characters
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += part.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# --- bit-sliced comparison -----------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) u64: bit b of row r is bit r of plane b; rows beyond the end are zero."""
    rows = -len(fps) % 64 + len(fps)
    bits = np.zeros((rows, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def bitset(rows: np.ndarray) -> np.ndarray:
    """Flags of rows as a bitset; rows that fill up its last word are set."""
    flags = np.ones(-len(rows) % 64 + len(rows), bool)
    flags[: len(rows)] = rows
    return np.packbits(flags, bitorder="little").view("<u8")


class Compared:
    """How many blocks of rows were compared, and how many of them were left before their last bit."""

    def __init__(self):
        self.blocks = self.abandoned = 0


def within(sliced: np.ndarray, value: int, radius: int, out: np.ndarray, block: int = 4, seen: Compared | None = None) -> np.ndarray:
    """Numbers of the rows at most ``radius`` bits from ``value``. ``sliced``: a bitset of rows for each bit; ``out``: rows not asked for.

    Counters are vertical: bit j of all rows' distances is one bitset, and carry-save addition of a difference bit updates
    all rows at once. A carry out of the last counter marks a row as beyond. Rows go in blocks of ``block`` words of 64;
    every few bits the blocks of which all rows are beyond are left, and only the others go on.
    """
    bits, words = sliced.shape
    blocks = -(-words // block)
    fill = blocks * block - words
    padded = np.pad(sliced, ((0, 0), (0, fill))).reshape(bits, blocks, block) if fill else sliced.reshape(bits, blocks, block)
    beyond = np.append(out, np.full(fill, 0xFFFFFFFFFFFFFFFF, np.uint64)).reshape(blocks, block)
    alive = np.flatnonzero((~beyond != 0).any(1))
    first = len(alive)
    beyond = beyond[alive]
    limit = radius.bit_length()
    counters = [np.zeros_like(beyond) for _ in range(limit)]
    ones = np.array([0, 0xFFFFFFFFFFFFFFFF], np.uint64)
    for k in range(bits):
        if not len(alive):
            break
        carry = padded[k, alive] ^ ones[value >> k & 1]
        for j in range(limit):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        beyond |= carry
        if radius & (radius + 1):  # not one less than a power of two: compare the count
            over, equal = np.zeros_like(carry), np.full_like(carry, 0xFFFFFFFFFFFFFFFF)
            for j in reversed(range(limit)):
                if radius >> j & 1:
                    equal &= counters[j]
                else:
                    over |= equal & counters[j]
                    equal &= ~counters[j]
            beyond |= over
        if k % 4 == 3 and k + 1 < bits:
            stay = (~beyond != 0).any(1)
            if not stay.all():
                alive, beyond, counters = alive[stay], beyond[stay], [c[stay] for c in counters]
    if seen is not None:
        seen.blocks += first
        seen.abandoned += first - len(alive)
    row, bit = np.nonzero(np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")) if len(alive) else (np.empty(0, int),) * 2
    return np.sort(alive[row] * block * 64 + bit)


def _varying(sliced: np.ndarray, rows: int) -> np.ndarray:
    """The bits in which the rows of a bucket differ at all; the others, which they agree in, add nothing to a distance."""
    ones = np.unpackbits(sliced.view(np.uint8), axis=1).sum(1, dtype=np.int64)
    return np.flatnonzero((ones > 0) & (ones < rows))


def large_links(fps: np.ndarray, radius: int, seen: Compared | None = None) -> np.ndarray:
    """(k, 2) spanning links of one large bucket of distinct fingerprints: each row against the planes of those after it."""
    label = np.arange(len(fps))
    sliced = planes(fps)
    bits = _varying(sliced, len(fps))
    sliced = np.ascontiguousarray(sliced[bits])
    for row in range(len(fps) - 1):
        word = row // 64  # what lies before the row's own word is done
        value = sum((int(fps[row]) >> int(b) & 1) << k for k, b in enumerate(bits))
        out = bitset(np.arange(word * 64, len(fps)) <= row)
        at = word * 64 + within(sliced[:, word:], value, radius, out, seen=seen)
        if len(at):
            roots = np.unique(label[np.append(at, row)])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    other = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[other], fps[label[other]]], 1)


def small_links(fps: np.ndarray, group: np.ndarray, radius: int, most: int, block: int = 1 << 15, seen: Compared | None = None) -> Iterator[np.ndarray]:
    """(k, 2) links within many small groups (``group`` ascending, at most ``most`` rows each).

    Rows at the same distance in the order are paired, and the pairs' differing bits laid out as planes.
    """
    for step in range(1, most):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            return
        for at in range(0, len(same), block):
            a = same[at : at + block]
            hit = a[within(planes(fps[a] ^ fps[a + step]), 0, radius, bitset(np.zeros(len(a), bool)), block=1, seen=seen)]
            yield np.stack([fps[hit], fps[hit + step]], 1)


def _bucket_links(radius: int, large: int = 96):
    """Over rows (bucket, fp) sorted by bucket: links of every bucket, which may go on from batch to batch."""

    def links(bucket: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
        starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]).any(1))) if len(fps) else np.empty(0, int)
        sizes = np.diff(np.append(starts, len(fps)))
        group = np.repeat(np.arange(len(starts)), sizes)
        for k in np.flatnonzero(sizes > large):
            yield large_links(fps[starts[k] : starts[k] + sizes[k]], radius)
        few = sizes[group] <= large
        yield from small_links(fps[few], group[few], radius, large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                bucket = np.concatenate([bucket, np.stack([batch[c].to_numpy() for c in ("pair", "key", "tile")], 1)])
                fps = np.concatenate([fps, batch["fp"].to_numpy().view(np.uint64)])
                if len(fps) < 20_000:
                    continue
                cut = np.flatnonzero((bucket != bucket[-1]).any(1))
                done = int(cut[-1]) + 1 if len(cut) else 0  # the last bucket may go on
            else:
                done = len(fps)
            for found in links(bucket[:done], fps[:done]):
                found = found.view(np.int64)
                yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
            bucket, fps = bucket[done:], fps[done:]

    return run


def links(fps: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """Links (a, b) that span all groups of ``fps`` (distinct longs ``fp``) within ``radius``, exactly."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("pair"), F.col("fp").bitwiseAND(F.lit(signed(x | y)).cast("long")).alias("key")) for k, (x, y) in enumerate(itertools.combinations(masks, 2))])
    rows = fps.select("fp", F.inline(pairs))
    counts = rows.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    counts = common.materialize(counts, "bucket-counts")
    met = rows.join(counts, ["pair", "key"])
    parts = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # A tile is a pair of parts; with one part it is the bucket itself.
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: (F.least(p, own) * parts + F.greatest(p, own)).cast("long"))
    met = met.select("pair", "key", "fp", F.explode(tiles).alias("tile"))
    met = met.repartition("pair", "key", "tile").sortWithinPartitions("pair", "key", "tile", "fp")
    return met.mapInArrow(_bucket_links(radius), "a long, b long")


def classes(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of all documents; component_id is the smallest doc_id reachable by links."""
    fps = common.materialize(fingerprints(docs, width), "fingerprints")
    distinct = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = common.components(links(distinct.select("fp"), radius))
    rooted = common.materialize(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    common.discard(distinct)
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
