"""Alignment of two tokenizers by a sweep over the byte offsets at which their tokens end.

Side A encodes a space and the text with a byte-level tokenizer, side B the text with a piece tokenizer that adds the space
itself, so that both cut the same bytes. Each token is an event at the offset of its last byte. Events of both sides are
dealt by document and sorted by offset within the partitions; a machine reads the stream once. Where a token of A and one of
B end together, the group that is open closes; every token of A in it is linked with every token of B in it. Between two
events the machine holds the open group and the document's running totals, no more of its tokens.

Events travel in blocks: the ids of one side whose tokens end in one ``window`` of bytes, with the offset where the first
begins. The ends follow from the lengths of the vocabulary's entries. Blocks keep the order of their events, and both sides'
blocks of a window are read before the next window, so no event of a later window can close a group of an earlier one.

The links of a document are kept per pair of ids, with their number. A pair's count is the number of documents that have
it; counts join the links again, broadcast if they are ``broadcast_rows`` at most, else by a shuffle with the same result.

Cases: null and empty texts, and those which one side does not give back byte for byte (for example U+2581, which the piece
tokenizer turns into a space) have no tokens: zeros and no groups; strings of special tokens are plain text; very long texts
are encoded whole and swept window by window; repeated rows and rows without doc_id are documents of their own; an empty
table gives an empty result; further columns are ignored.

Rows are told apart by their place in the scan: ``docs`` should be a scan or a written table, whose partitions come back
the same if an executor is lost.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

EVENTS = "row long, doc_id long, window long, side int, start long, ids binary"
SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<struct<a:int,b:int,n:long>>"
_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


class ByteLevel:
    """Side A: ids of a space and the text by a byte-level tokenizer, and the bytes of each id."""

    def __init__(self, path: str):
        self.encode = tokens.Encoder(path, "bytes", plain=True)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        byte_of = {c: k for k, c in enumerate(self.encode.letters)}
        vocabulary = {**told["model"]["vocab"], **{t["content"]: t["id"] for t in told.get("added_tokens", ())}}
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_of[k] = bytes(byte_of.get(c, 0) for c in token)

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(" " + text), "<u4")


class Pieces:
    """Side B: ids of a text by a piece model that puts a space before it, and the bytes of each id.

    Where no piece holds a space after another character, or a line feed, no token reaches from one word into the next:
    words with the white space before them are encoded, and held against their bytes, once while they are remembered. A
    mark that no piece joins to a letter is cut from its word as well. Other texts and other models are encoded whole. A
    word or text that does not come back byte for byte has no ids.
    """

    def __init__(self, path: str, remember: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.space = [self.model.piece_to_id("▁")]
        self.joins = ["▁", *(c for c in "\t\v\f\r" if any(c in p for p in names)), *tokens._SPACES]
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in names) and self.model.encode("\na")[:1] == self.space
        joined = {p[-1] for p in names if len(p) > 1 and p[-2].isalpha()}
        self.stops = {c: array("I", [self.model.piece_to_id(c)]).tobytes() for c in ".,;:!?" if c not in joined and c in names}
        self.known = tokens._Known(self._unit, remember)

    def _unit(self, unit: str) -> bytes:
        """Ids of a word with the white space before it."""
        stop = self.stops.get(unit[-1])
        if stop is not None and unit[1:-1].isalpha():
            return self.known[unit[:-1]] + stop
        if unit[0] == " ":
            ids = self.model.encode(unit[1:]) or self.space
        else:
            ids = self.model.encode(unit)[1:]  # the space that the model puts first is not in the text
        return array("I", ids).tobytes() if self._same(ids, unit) else b""

    def _same(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.bytes_of.__getitem__, ids)) == text.encode()

    def __call__(self, text: str) -> np.ndarray:
        whole = " " + text
        if not self.cuts or any(c in text for c in self.joins):
            ids = self.model.encode(text)
            return np.array(ids if self._same(ids, whole) else [], "<u4")
        runs = any(c in whole for c in tokens._RUNS)
        units = tokens._UNITS.findall(whole) if runs else whole.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
        return np.frombuffer(b"".join(map(self.known.__getitem__, units)), "<u4")


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """Both sides' tokenizers, kept by the worker from task to task."""
    return ByteLevel(path_a), Pieces(path_b)


@lru_cache(maxsize=4)
def _tables(path_a: str, path_b: str) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For each side: lengths of the ids in bytes, and their names with the mark that stands before them (first of a group, or later)."""
    found = []
    for table, first in zip((s.bytes_of for s in sides(path_a, path_b)), (b";", b"|"), strict=True):
        names = np.array([mark + str(k).encode() for mark in (b",", first) for k in range(len(table))], object)
        found.append((np.array([len(b) for b in table], np.int64), names))
    return tuple(found)


def _kind(path_a: str, path_b: str) -> str:
    return "<u2" if max(len(s.bytes_of) for s in sides(path_a, path_b)) <= 1 << 16 else "<u4"


def events(docs: DataFrame, path_a: str, path_b: str, window: int = 1 << 15) -> DataFrame:
    """Blocks of end events of both sides; a document without tokens has one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, tables, kind, packer = sides(path_a, path_b), _tables(path_a, path_b), _kind(path_a, path_b), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                ids = [side(text) for side in both] if text else []
                offsets = [np.cumsum(lengths[i]) for i, (lengths, _) in zip(ids, tables, strict=False)]
                size = len(text.encode()) + 1 if text else 0
                if not text or any(not len(ends) or ends[-1] != size for ends in offsets):  # a side's bytes can only be too few
                    rows.append((row, doc_id, 0, 0, 0, b""))
                    continue
                for side, (i, ends) in enumerate(zip(ids, offsets, strict=True)):
                    edges = [0, *np.searchsorted(ends, np.arange(window, int(ends[-1]), window), "right").tolist(), len(i)]
                    for w, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        if a < b:
                            rows.append((row, doc_id, w, side, int(ends[a - 1]) if a else 0, packer.compress(i[a:b].astype(kind).tobytes())))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, EVENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "window", "side", "start", "ids"])


class Machine:
    """The sweep over one document: the open group, and totals."""

    def __init__(self, tables, keep_text: bool):
        self.lengths, self.names = [t[0] for t in tables], [t[1] for t in tables]
        self.open: list[list[np.ndarray]] = [[], []]
        self.counts, self.groups, self.links = [0, 0], 0, 0
        self.digest, self.text = hashlib.sha256(), [] if keep_text else None
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def window(self, blocks: list[tuple[int, np.ndarray]], first: int, last: int) -> None:
        """Both sides' tokens that end in the bytes (first, last]; ``blocks``: per side the offset before its first token, and ids."""
        ends = [start + np.cumsum(length[ids]) - first for (start, ids), length in zip(blocks, self.lengths, strict=True)]
        for side, (_, ids) in enumerate(blocks):
            self.counts[side] += len(ids)
        marks = np.zeros((2, last - first + 1), bool)
        for side in (0, 1):
            marks[side, ends[side]] = True
        closes = np.cumsum(marks[0] & marks[1])  # groups closed up to an offset
        total = int(closes[-1])
        if not total:
            for side, (_, ids) in enumerate(blocks):
                self.open[side].append(ids)
            return
        ids, group = [], []
        for side, (_, new) in enumerate(blocks):
            of = closes[ends[side] - 1]
            inside = int(np.searchsorted(of, total))  # the rest stays open
            held = self.open[side]
            self.open[side] = [new[inside:]] if inside < len(new) else []
            before = sum(map(len, held))
            ids.append(np.concatenate([*held, new[:inside]]).astype(np.int64))
            group.append(np.concatenate([np.zeros(before, np.int64), of[:inside]]))
        self._close(ids, group, total)

    def _close(self, ids: list[np.ndarray], group: list[np.ndarray], total: int) -> None:
        sizes = [np.bincount(g, minlength=total) for g in group]
        starts = [np.cumsum(s) - s for s in sizes]
        marked = []
        for side in (0, 1):
            opening = np.zeros(len(ids[side]), np.int64)
            opening[starts[side]] = 1
            marked.append(self.names[side][ids[side] + opening * (len(self.names[side]) // 2)])
        out = np.empty(len(ids[0]) + len(ids[1]), object)
        out[np.arange(len(ids[0])) + starts[1][group[0]]] = marked[0]
        out[np.arange(len(ids[1])) + (starts[0] + sizes[0])[group[1]]] = marked[1]
        told = b"".join(out.tolist())
        told = told if self.groups else told[1:]
        self.digest.update(told)
        if self.text is not None:
            self.text.append(told)
        self.groups += total
        linked = int(np.dot(sizes[0], sizes[1]))
        self.links += linked
        base = len(self.lengths[1])
        weights = None
        if linked > 8 * (len(ids[0]) + len(ids[1])):  # large groups: equal ids of a group at once
            weights = []
            for side in (0, 1):
                span = len(self.lengths[side])
                keys, times = np.unique(group[side] * span + ids[side], return_counts=True)
                weights.append(times)
                group[side], ids[side] = np.divmod(keys, span)
            sizes = [np.bincount(g, minlength=total) for g in group]
            starts = [np.cumsum(s) - s for s in sizes]
        each = sizes[1][group[0]]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - starts[1][group[0]], each)
        codes = np.repeat(ids[0] * base, each) + ids[1][inner]
        if weights is None:
            codes, times = np.unique(codes, return_counts=True)
        else:
            codes, at = np.unique(codes, return_inverse=True)
            times = np.zeros(len(codes), np.int64)
            np.add.at(times, at, np.repeat(weights[0], each) * weights[1][inner])
        self.codes.append(codes)
        self.times.append(times)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of linked ids as a * (ids of B) + b, and how many links each has."""
        if len(self.codes) == 1:
            return self.codes[0], self.times[0]
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        times = np.zeros(len(codes), np.int64)
        np.add.at(times, at, np.concatenate(self.times))
        return codes, times


def swept(found: DataFrame, path_a: str, path_b: str, window: int = 1 << 15, keep_groups: bool = False) -> DataFrame:
    """One row a document from its events: totals, digest and (if asked for) text of its groups, and its linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kind, base, unpacker = _tables(path_a, path_b), _kind(path_a, path_b), len(sides(path_a, path_b)[1].bytes_of), zstandard.ZstdDecompressor()
        none = np.zeros(0, np.int64)
        at, machine, blocks, place = None, None, [None, None], 0
        rows, codes, times, held = [], [], [], 0

        def end_window() -> None:
            if blocks[0] is None and blocks[1] is None:
                return
            both = [b or (place * window, none) for b in blocks]
            last = max(start + int(table[0][ids].sum()) for (start, ids), table in zip(both, tables, strict=True))
            machine.window(both, place * window, last)
            blocks[:] = [None, None]

        def end_document() -> None:
            nonlocal held
            end_window()
            c, t = machine.pairs()
            told = machine.digest.hexdigest() if machine.groups else ""
            text = b"".join(machine.text).decode() if machine.text is not None else None
            rows.append((*at, *machine.counts, machine.groups, machine.links, told, text))
            codes.append(c)
            times.append(t)
            held += len(c) + 50

        def batch_of() -> pa.RecordBatch:
            kinds = (*[pa.int64()] * 6, pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            a, b = np.divmod(np.concatenate([none, *codes]), base)
            pairs = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.concatenate([none, *times]), pa.int64())], fields=list(_PAIR))
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pairs))
            made = pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs"])
            rows.clear(), codes.clear(), times.clear()
            return made

        for batch in batches:
            numbers = zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "window", "side", "start")), strict=True)
            for (row, doc_id, w, side, start), packed in zip(numbers, batch["ids"], strict=True):
                if at != (row, doc_id):
                    if at is not None:
                        end_document()
                        if held > 400_000:
                            yield batch_of()
                            held = 0
                    at, machine, place = (row, doc_id), Machine(tables, keep_groups), w
                elif w != place:
                    end_window()
                    place = w
                if packed.as_buffer().size:
                    blocks[side] = (start, np.frombuffer(unpacker.decompress(packed.as_buffer()), kind).astype(np.int64))
        if at is not None:
            end_document()
        yield batch_of()

    return found.repartition("row").sortWithinPartitions("row", "window", "side").mapInArrow(run, SWEPT)


def align(docs: DataFrame, path_a: str, path_b: str, window: int = 1 << 15, keep_groups: bool = False) -> DataFrame:
    """Groups and links of every document, as a written table (see ``swept``)."""
    return common.materialize(swept(events(docs, path_a, path_b, window), path_a, path_b, window, keep_groups), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): in how many documents two ids are linked, and whether no other id of B has more with that of A."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy(F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def scored(aligned: DataFrame, counts: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` and ``count_sum``. ``counts`` should be a written table."""
    both = lambda a, b: F.shiftleft(a.cast("long"), 32) + b
    told = counts.select(both(F.col("a"), F.col("b")).alias("pair"), "n_docs", "best")
    told = F.broadcast(told) if told.count() <= broadcast_rows else told
    links = aligned.select("row", F.explode("pairs").alias("link")).select("row", both(F.col("link.a"), F.col("link.b")).alias("pair"), F.col("link.n").alias("n"))
    sums = links.join(told, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs").join(sums, "row", "left").select(*[c for c in aligned.columns if c not in ("row", "pairs")], *zero)


def op13_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = align(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return scored(aligned, common.materialize(pair_counts(aligned), "pair-counts")).drop("groups")
