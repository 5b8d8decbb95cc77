"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

A document becomes its ids and an end id 0; only one longer than a sequence is cut, into pieces of the full length and a
shorter last one. Full pieces are sequences already. The others are dealt into packs of bounded size, and each pack is
packed by a grouping genetic algorithm (Falkenauer): a genome is a grouping of the pack's pieces into bins; crossover
injects whole well-filled bins of one parent into the other, removes the bins there that hold a piece twice, and places
the displaced pieces by best fit, longest first. Several islands evolve each pack from different seeds; after each epoch
the elite of an island migrates to the next one. Then bins that are still wasteful are opened, and their pieces dealt
into fewer packs and packed again, so that a pack's last, half-empty bins cost little.

An island stops as soon as it needs no more bins than the lengths sum up to, which best fit alone often reaches where short
pieces abound; ``generations`` are spent on the packs where it does not.

Cases: null and empty texts are one end id; repeated rows and ids are packed each for itself; very long texts are cut into
full pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(tokenizer, "word"), 4 * capacity
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text) + bytes(4)
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [[]] * 5, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Open bins by room left, for best fit: the fullest bin that still has room for a piece."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has room r

    def add(self, bin_id: int, room: int) -> None:
        if room:
            self.at[room].append(bin_id)
            self.mask |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        rest = self.mask >> length
        if not rest:
            return None
        room = length + (rest & -rest).bit_length() - 1
        bin_id = self.at[room].pop()
        if not self.at[room]:
            self.mask &= ~(1 << room)
        return bin_id, room


def best_fit(lengths: np.ndarray, genome: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Places the ``loose`` pieces, in the order given, into the bins of ``genome`` (-1: loose) or new ones; bins are then numbered from 0."""
    placed = genome >= 0
    names, dense = np.unique(genome[placed], return_inverse=True)
    genome = genome.copy()
    genome[placed] = dense
    used = np.bincount(dense, weights=lengths[placed], minlength=len(names)).astype(int)
    bins, n = Bins(capacity), len(names)
    for bin_id, total in enumerate(used.tolist()):
        bins.add(bin_id, capacity - total)
    for item, length in zip(loose.tolist(), lengths[loose].tolist(), strict=True):
        found = bins.take(length)
        if found is None:
            found, n = (n, capacity), n + 1
        genome[item] = found[0]
        bins.add(found[0], found[1] - length)
    return genome


def fitness(lengths: np.ndarray, genome: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of equal ones, those with room in few bins: mean squared fill."""
    fill = np.bincount(genome, weights=lengths) / capacity
    return -len(fill), float(np.mean(fill**2))


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Bins of ``b``, the fuller the likelier, go whole into ``a``; bins of ``a`` that share a piece with them go, and what else was in those is placed anew."""
    fill = np.bincount(b, weights=lengths) / capacity
    chosen = rng.random(len(fill)) < np.where(fill >= np.quantile(fill, 0.5), 0.5, 0.05)
    injected = chosen[b]
    broken = np.zeros(a.max() + 1, bool)
    broken[a[injected]] = True
    genome = np.where(broken[a], -1, a)
    genome[injected] = b[injected] + a.max() + 1
    loose = np.flatnonzero(genome < 0)
    return best_fit(lengths, genome, loose[np.argsort(-lengths[loose], kind="stable")], capacity)


def mutate(lengths: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties some of the emptiest and a few random bins and places their pieces anew, in a slightly shuffled order."""
    fill = np.bincount(a, weights=lengths)
    count = max(1, len(fill) // 50)
    opened = np.zeros(len(fill), bool)
    opened[np.argsort(fill, kind="stable")[:count]] = True
    opened[rng.integers(0, len(fill), 2 * count)] = True
    loose = np.flatnonzero(opened[a])
    order = np.argsort(-lengths[loose] * rng.uniform(0.9, 1.0, len(loose)), kind="stable")
    return best_fit(lengths, np.where(opened[a], -1, a), loose[order], capacity)


def seeded(lengths: np.ndarray, capacity: int, population: int, seed: int) -> list[np.ndarray]:
    """First genomes of an island: best fit, longest first, and the same in disturbed orders."""
    rng = np.random.default_rng(seed)
    none = np.full(len(lengths), -1)
    noise = [np.ones(len(lengths))] + [rng.uniform(1 - 0.03 * (i + 1), 1.0, len(lengths)) for i in range(population - 1)]
    return [best_fit(lengths, none, np.argsort(-lengths * x, kind="stable"), capacity) for x in noise]


def evolve(lengths: np.ndarray, genomes: list[np.ndarray], capacity: int, generations: int, seed: int) -> list[np.ndarray]:
    """A steady-state epoch of one island, the best genome first. It ends early at as many bins as the lengths need."""
    rng = np.random.default_rng(seed)
    need = math.ceil(lengths.sum() / capacity)
    ranked = sorted(((fitness(lengths, g, capacity), g) for g in genomes), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -ranked[0][0][0] <= need:
            break
        i, j = sorted(rng.choice(len(ranked), 2, replace=False)) if len(ranked) > 1 else (0, 0)
        child = mutate(lengths, crossover(lengths, ranked[i][1], ranked[j][1], capacity, rng), capacity, rng)
        ranked = sorted([*ranked, (fitness(lengths, child, capacity), child)], key=lambda x: x[0], reverse=True)[: len(genomes)]
    return [g for _, g in ranked]


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    pack_items: int = 4096,
    islands: int = 2,
    epochs: int = 2,
    population: int = 4,
    generations: int = 60,
    rounds: int = 2,
    waste: int = 16,
) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32; lengths 1 to ``capacity``) with sequence_id and offset.

    A task holds one pack's pieces, ``pack_items`` on average. In all but the last round, bins with more than ``waste``
    tokens of room are opened again.
    """
    numbered = common.materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    done = [numbered.where(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = numbered.where(F.col("length") < capacity)
    for k in range(rounds):
        left, last = _round(left, capacity, pack_items, islands, epochs, population, generations, k), k == rounds - 1
        closed = left if last else left.where(F.col("room") <= waste)
        name = (F.col("pack").cast("long") * (1 << 21) + F.col("bin")) * rounds + k
        done.append(closed.select(*pieces.columns, name.alias("sequence_id"), "offset"))
        left = left.where(F.col("room") > waste).select(*numbered.columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*OUT)


def _round(pieces: DataFrame, capacity: int, pack_items: int, islands: int, epochs: int, population: int, generations: int, salt: int) -> DataFrame:
    """``pieces`` with pack, bin, offset and the room left in the bin."""
    packs = max(1, math.ceil(pieces.count() / pack_items))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(packs)).cast("int"))
    # One row a pack: its pieces, in an order of their own, as arrays. A pack's size is bounded by how they are dealt.
    packed = dealt.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("length", "uid", *[c for c in pieces.columns if c not in ("length", "uid")]))).alias("items"))
    packed = common.materialize(packed, "packs")
    genomes = packed.select("pack", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").alias("lengths"))
    genomes = genomes.withColumn("genomes", F.array().cast("array<binary>"))
    # As many tasks as keep every core busy: rows are few and small, but work.
    genomes = genomes.repartition(max(common.slots(pieces.sparkSession), packs * islands // 8), "pack", "island")
    for epoch in range(epochs):
        if epoch:
            # The elite of each island migrates to the next one.
            elite = genomes.select("pack", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("genomes", 1, 1).alias("guest"))
            genomes = genomes.join(elite, ["pack", "island"]).select("pack", "island", "lengths", F.concat("genomes", "guest").alias("genomes"))
        genomes = common.materialize(genomes.mapInArrow(_epoch(capacity, population, generations, epoch), genomes.schema), "genomes")
    best = common.materialize(genomes.select("pack", "lengths", F.element_at("genomes", 1).alias("genome")).mapInArrow(_scored(capacity), "pack int, score array<double>, genome binary"), "scored")
    best = best.groupBy("pack").agg(F.max_by("genome", "score").alias("genome"))
    placed = packed.join(best, "pack").mapInArrow(_placed(capacity), "pack int, place array<struct<bin:int,offset:long,room:long>>, items " + packed.schema["items"].dataType.simpleString())
    rows = placed.select("pack", F.explode(F.arrays_zip("place", "items")).alias("x")).select("pack", "x.place.*", "x.items.*")
    return common.materialize(rows, "placed")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


def _lengths(row: dict) -> np.ndarray:
    return row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lengths, island = _lengths(row), row["island"].as_py()
            known = [np.frombuffer(g, np.int32).astype(np.int64) for g in row["genomes"].as_py()]
            seed = (row["pack"].as_py() * 64 + island) * 64 + epoch
            genomes = known[-1:] + known[: population - 1] if known else seeded(lengths, capacity, population, seed)
            genomes = evolve(lengths, genomes, capacity, generations, seed)
            kept = pa.array([[g.astype(np.int32).tobytes() for g in genomes]], pa.list_(pa.binary()))
            yield pa.record_batch(
                [pa.array([row["pack"].as_py()], pa.int32()), pa.array([island], pa.int32()), pa.array([lengths], pa.list_(pa.int64())), kept], names=["pack", "island", "lengths", "genomes"]
            )

    return run


def _scored(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            genome = np.frombuffer(row["genome"].as_py(), np.int32)
            score = list(map(float, fitness(_lengths(row), genome, capacity)))
            yield pa.record_batch([pa.array([row["pack"].as_py()], pa.int32()), pa.array([score]), pa.array([genome.tobytes()])], names=["pack", "score", "genome"])

    return run


def _placed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                items = batch.column("items").slice(k, 1)
                genome = np.frombuffer(batch.column("genome")[k].as_py(), np.int32)
                lengths = items.flatten().field("length").to_numpy(zero_copy_only=False)
                order = np.argsort(genome, kind="stable")
                sums = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(genome[order], genome[order])
                offset = np.empty(len(genome), np.int64)
                offset[order] = sums - sums[first]
                room = capacity - np.bincount(genome, weights=lengths).astype(np.int64)[genome]
                place = pa.StructArray.from_arrays([pa.array(genome, pa.int32()), pa.array(offset), pa.array(room)], ["bin", "offset", "room"])
                place = pa.ListArray.from_arrays(pa.array([0, len(genome)], pa.int32()), place)
                yield pa.record_batch([batch.column("pack").slice(k, 1), place, items], names=["pack", "place", "items"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    return pack(cut(docs, tokenizer, capacity), capacity)


def op2_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
