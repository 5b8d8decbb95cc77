"""Substring dedup: MinHash keys of sliding windows, Jaccard of whole passages, and removals by connected components.

Passages that repeat seldom start and end where lines do, so every place of a text is looked at. Two passages of over 50
words with a five-word Jaccard similarity of 0.8 have 25 words in a row in common: of n shingles at most n/9 are lost, a
changed word inside costs five, and what stays between the changes is 21 shingles at least. Therefore the keys are MinHash
values of every window of 25 words over its ten-word shingles (seeds): equal windows have equal keys, so with one band of
one row no such pair is missed. A value that stays the same from window to window is one key, at its least seed's place.

What is compared is the surrounding of the seed, so many words to both sides that every run of ``words`` words with the
seed is inside. Surroundings of equal content (64-bit hash) are one; different ones that meet in different documents are
linked if any ``words`` words around the seed have a Jaccard similarity of ``similarity`` or more over their five-word
shingles (A-Z lower-cased words between ASCII white space), word against word, or as sets where words were put in or left
out. A text of fewer words, but 25, is compared as a whole. Buckets are compared in tiles where they are large. Links make
components; a component in at least two documents is a repeated passage: its first occurrence (smallest doc_id) stays, the
others go.

A link also says which words around the seed are alike: from the first to the last shingle that both have. A removed
passage is what it has in common with an earlier document (with a later one where there is no earlier one), so that all of
a passage goes and nothing around it; seeds follow so closely that their spans join.

Cases: null, empty and short texts have no paragraphs; different texts of one doc_id, and texts without doc_id, are documents
of their own (of one doc_id the least text comes first, the others and those without doc_id after all others), equal ones
are one document; passages that repeat inside one document only are left alone; an empty table gives an empty result;
further columns pass through ``remove``, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, WINDOW = 5, 10, 25
_ODD = np.random.default_rng(20240101).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[60]
    x = (x ^ (x >> np.uint64(29))) * _ODD[61]
    return x ^ (x >> np.uint64(32))


def _combined(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each run of n words."""
    count = len(words) - n + 1
    return _mix(sum((words[k : k + count] * _ODD[salt + k] for k in range(1, n)), words[:count] * _ODD[salt]))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n values in a row, along the last axis, by doubling."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[..., : out.shape[-1] - step], out[..., step:])
        have += step
    return out


def minima(words: np.ndarray, text: np.ndarray, bands: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band: places of seeds and MinHash keys of all windows of texts that lie end to end (``text``: the text of each word), those of neighbours that share all seeds once."""
    if len(words) < WINDOW:
        return
    seeds = _combined(words, SEED, 8)
    within = text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :]
    for b in range(bands):
        key, new, at = np.full(np.count_nonzero(within), b + 1, np.uint64), np.zeros(np.count_nonzero(within), bool), None
        new[:1] = True
        for r in range(rows):
            # Seeds are mixed already: an odd factor permutes them anew. The place in the low half makes the first of equals the least.
            value = seeds * _ODD[34 + b * rows + r] >> np.uint64(32) << np.uint64(32) | np.arange(len(seeds), dtype=np.uint64)
            least = (_least(value, WINDOW - SEED + 1)[within] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            key = key * _ODD[58] + seeds[least]
            new[1:] |= least[1:] != least[:-1]
            at = least if at is None else at
        yield at[new], _mix(key[new])


def contents(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the surroundings of seeds at ``at``, up to ``side`` words to both sides within their text; words to the right."""
    left, right = np.minimum(at - begins, side), np.minimum(ends - at - SEED, side)
    power = np.cumprod(np.append(np.uint64(1), np.full(len(words), _ODD[59])), dtype=np.uint64)
    back = np.cumprod(np.append(np.uint64(1), np.full(len(words), np.uint64(pow(int(_ODD[59]), -1, 1 << 64)))), dtype=np.uint64)
    total = np.append(np.uint64(0), np.cumsum(words * power[:-1], dtype=np.uint64))
    first, last = at - left, at + SEED + right
    return _mix((total[last] - total[first]) * back[first] + left.astype(np.uint64) * _ODD[56] + right.astype(np.uint64) * _ODD[57]), right


def _together(texts: list[tuple[int, str]], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end, some at a time: ids, where each text ends, hashes of all words. A text is never cut."""
    ids, parts, total = [], [], 0
    for doc_id, text in texts:
        ids.append(doc_id)
        parts.append(word_hashes(text))
        total += len(parts[-1])
        if total >= most:
            yield np.array(ids), np.cumsum([len(p) for p in parts]), np.concatenate(parts)
            ids, parts, total = [], [], 0
    if ids:
        yield np.array(ids), np.cumsum([len(p) for p in parts]), np.concatenate(parts)


def windows(docs: DataFrame, side: int, bands: int, rows: int) -> DataFrame:
    """A row for each key: where its seed is, the words to the right of it in its surrounding, the hash of that, the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ends, hashed in _together(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                begins = np.append(0, ends[:-1])
                of = np.repeat(np.arange(len(ends)), ends - begins)
                for at, key in minima(hashed, of, bands, rows):
                    text = of[at]
                    content, right = contents(hashed, begins[text], ends[text], at, side)
                    place = (at - begins[text]).astype(np.int32)
                    columns = [pa.array(ids[text], pa.int64()), pa.array(place), pa.array(right.astype(np.int32)), *(pa.array(c.view(np.int64)) for c in (content, key))]
                    yield pa.record_batch(columns, names=["doc_id", "pos", "right", "content", "key"])

    return docs.mapInArrow(run, "doc_id long, pos int, right int, content long, key long")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key comes in more than one document.

    A key that goes on in the next batch either is in two documents already, and goes out as it comes, or has come from
    one document only, whose rows are held: at most the paragraphs of one document.
    """
    held, open_key = None, None  # the rows of one document under the last key; the last key, if in two documents
    for batch in itertools.chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held = None
        if rows is None or not rows.num_rows:
            continue
        key, first, last = (rows[c].to_numpy() for c in ("key", "doc", "last"))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        met = np.minimum.reduceat(first, starts) != np.maximum.reduceat(last, starts)
        if open_key is not None and key[0] == open_key:
            met[0] = True
        several = np.repeat(met, np.diff(np.append(starts, len(key))))
        # A content of many documents alone under a key meets no other content.
        alone = np.append(True, key[1:] != key[:-1]) & np.append(key[1:] != key[:-1], True)
        alone[0] &= open_key is None or key[0] != open_key
        if batch is not None and (not met[-1] or alone[-1]):
            held = rows.slice(int(starts[-1]))
            several[starts[-1] :] = False
        open_key = key[-1] if met[-1] and not alone[-1] else None
        yield rows.filter(pa.array(several & ~alone))


def _surroundings(docs: DataFrame, wanted: DataFrame, side: int) -> DataFrame:
    """(content, around) of the wanted (content, doc_id, pos): four bytes of each word's hash, zero beyond the text."""
    per = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "content")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, content = batch["wanted"].flatten().flatten()
            places = np.split(pos.to_numpy(), np.cumsum(batch["wanted"].value_lengths().to_numpy())[:-1])
            around, sent, have = [], 0, 0
            for k, (text, at) in enumerate(zip(batch["text"].to_pylist(), places, strict=True), 1):
                hashed = np.pad(np.maximum(word_hashes(text).astype(np.uint32), 1), side)
                around.append(hashed[at[:, None] + np.arange(2 * side + SEED)])
                have += len(at)
                if have >= 1 << 16 or k == batch.num_rows:
                    rows, ends = np.concatenate(around), np.arange(have + 1, dtype=np.int32) * np.int32(4 * (2 * side + SEED))
                    told = pa.Array.from_buffers(pa.binary(), have, [None, pa.py_buffer(ends), pa.py_buffer(rows)])
                    yield pa.record_batch([content.slice(sent, have), told], names=["content", "around"])
                    around, sent, have = [], sent + have, 0

    return docs.join(per.hint("shuffle_hash"), "doc_id").select("text", "wanted").mapInArrow(run, "content long, around binary")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Texts as (doc_id, text) with a number of their own in place of the doc_id, and the (number, id, text) of those whose doc_id is not theirs alone (None: all are).

    A doc_id stands for its least text; other texts of the same doc_id, and texts without one, get numbers beyond all doc_ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("least")).where("n > 1 or doc_id is null")
    odd = common.materialize(odd.select("doc_id", "least"), "shared-ids")
    if odd.isEmpty():
        return rows, None
    same = F.col("o.doc_id").eqNullSafe(F.col("r.doc_id"))
    several = rows.alias("r").join(odd.alias("o"), same).select("r.doc_id", "r.text", (F.col("r.doc_id").isNotNull() & (F.col("r.text") == F.col("o.least"))).alias("stands")).distinct()
    several = common.materialize(several, "texts-of-shared-ids")
    beyond = (rows.agg(F.max("doc_id")).first()[0] or 0) + 1
    names = common.materialize(several.select(F.when(F.col("stands"), F.col("doc_id")).otherwise(F.monotonically_increasing_id() + F.greatest(F.lit(beyond), F.lit(0))).alias("number"), F.col("doc_id").alias("id"), "text"), "numbers")
    alone = rows.alias("r").join(odd.alias("o"), same, "left_anti").select("r.doc_id", "r.text")
    return alone.unionByName(names.select(F.col("number").alias("doc_id"), "text")), names


def _named(found: DataFrame, names: DataFrame | None) -> DataFrame:
    """``found`` with the doc_ids in place of the numbers, the ``number``, and the ``text`` of those that share or lack a doc_id."""
    found = found.withColumn("first", F.col("doc_id") == F.col("component")).withColumn("number", F.col("doc_id"))
    if names is None:
        return found.withColumn("text", F.lit(None).cast("string"))
    own = names.select("number", F.col("id").alias("own"), "text")
    other = names.select(F.col("number").alias("component"), F.col("id").alias("whose"), F.lit(True).alias("named"))
    met = found.join(own, "number", "left").join(other, "component", "left")
    doc_id = F.when(F.col("text").isNotNull(), F.col("own")).otherwise(F.col("number"))
    return met.select(doc_id.alias("doc_id"), "pos", "start", "end", F.when(F.col("named"), F.col("whose")).otherwise(F.col("component")).alias("component"), "first", "number", "text")


def repeated(docs: DataFrame, words: int = 51, bands: int = 1, rows: int = 1, similarity: float = 0.8, tile: int = 4096) -> DataFrame:
    """(doc_id, pos, start, end, component, first boolean): every seed in a passage that repeats in another document, and the passage around it, by word position; ``first`` marks the document that keeps it."""
    side = words - SEED
    docs, names = numbered(docs)
    all_windows = common.materialize(windows(docs, side, bands, rows), "paragraphs")
    first = F.min(F.struct("doc_id", "pos")).alias("at")
    contents = common.materialize(all_windows.groupBy("content", "key").agg(first, F.max("doc_id").alias("last")), "contents")
    # Different contents that meet under a key, in different documents.
    banded = contents.select("content", F.col("at.doc_id").alias("doc"), "last", "key")
    banded = banded.repartition("key").sortWithinPartitions("key", "content")
    met = common.materialize(banded.mapInArrow(_meeting, banded.schema), "meeting")
    single = contents if bands * rows == 1 else contents.groupBy("content").agg(F.min("at").alias("at"), F.max("last").alias("last"))
    wanted = single.join(met.select("content").distinct(), "content").select("content", "at.*")
    sets = common.materialize(_surroundings(docs, wanted, side), "surroundings")
    sizes = met.groupBy("key").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("content"), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct((F.least(p, own) * parts + F.greatest(p, own)).cast("long").alias("tile")))
    dealt = met.join(sizes, "key").select("key", "content", "doc", "last", F.inline(tiles)).join(sets, "content")
    dealt = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile", "doc", "content").select("key", "tile", "content", "doc", "last", "around")
    near = common.materialize(dealt.mapInArrow(_verified(words, similarity), "a long, b long, a_lo int, a_hi int, b_lo int, b_hi int"), "near")
    common.discard(met)
    common.discard(sets)
    rooted = common.components(near.select("a", "b"))
    # What a content has in common with later documents, and with earlier ones.
    sided = near.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.col("a_lo").alias("later_lo"), F.col("a_hi").alias("later_hi"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")),
        F.struct(F.col("b").alias("node"), F.lit(None).cast("int").alias("later_lo"), F.lit(None).cast("int").alias("later_hi"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi")),
    )))
    alike = sided.groupBy("node").agg(F.min("later_lo").alias("later_lo"), F.max("later_hi").alias("later_hi"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rooted = rooted.join(alike, "node")
    # A content's class, and whether that is in two documents at least; the others are dropped before they meet the windows.
    classed = single.join(rooted, F.col("content") == F.col("node"), "left").select("content", F.col("at.doc_id").alias("doc"), "last", F.coalesce("root", "content").alias("class"), "later_lo", "later_hi", "lo", "hi")
    spread = classed.groupBy("class").agg(F.min("doc").alias("component"), F.max("last").alias("class_last")).where("component != class_last")
    kept = common.materialize(classed.join(spread, "class").drop("class", "class_last"), "repeated-contents")
    met_again = all_windows.drop("key").join(kept, "content")
    stays, copied, left = F.col("doc_id") == F.col("component"), F.col("doc_id") > F.col("doc"), -F.least("pos", F.lit(side))
    whole, both = F.col("right") + SEED, F.col("doc") != F.col("last")
    lo = F.when(stays, F.least("later_lo", "lo", F.when(both, left))).when(copied, left).otherwise(F.coalesce("lo", "later_lo", left))
    hi = F.when(stays, F.greatest("later_hi", "hi", F.when(both, whole))).when(copied, whole).otherwise(F.coalesce("hi", "later_hi", whole))
    found = met_again.select("doc_id", "pos", (F.col("pos") + lo).alias("start"), (F.col("pos") + hi).alias("end"), "component")
    found = common.materialize(found if bands == rows == 1 else found.distinct(), "repeated")
    for table in (all_windows, contents, near, kept):
        common.discard(table)
    return _named(found, names)


def compare(a: np.ndarray, b: np.ndarray, words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether surroundings (rows of ``a`` and ``b``) are alike around the seed; the words that are: (n, 4) first and end in a, first and end in b, counted from the seed.

    Only pairs with enough shingles at the same places, or a long enough run of them at the seed, are looked at closely.
    """
    side = words - SEED
    same = (a == b) & (a != 0)
    shingle = same[:, : 1 - SHINGLE].copy()
    for k in range(1, SHINGLE):
        shingle &= same[:, k : same.shape[1] - SHINGLE + 1 + k]
    least = np.minimum(needed(a, words), needed(b, words))
    enough = (1 + similarity) * shingle.sum(1) >= 2 * similarity * least - 1e-9
    left, right = np.logical_and.accumulate(shingle[:, side::-1], 1).sum(1), np.logical_and.accumulate(shingle[:, side + 1 :], 1).sum(1)
    enough |= left + right >= np.where(least < words - SHINGLE + 1, SEED - SHINGLE + 1, WINDOW - SHINGLE + 1)
    alike, spans = np.zeros(len(a), bool), np.zeros((len(a), 4), np.int64)
    some = np.flatnonzero(enough)
    if len(some):
        alike[some], spans[some] = _close(a[some], b[some], same[some], shingle[some], (left + right)[some], words, similarity)
    return alike, spans


def _close(a: np.ndarray, b: np.ndarray, same: np.ndarray, shingle: np.ndarray, seed: np.ndarray, words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    side = words - SEED
    inside = np.stack([(x != 0) for x in (a, b)])
    begin, end = inside.argmax(2), inside.shape[2] - inside[:, :, ::-1].argmax(2)
    length = np.minimum((end - begin).min(0), words)  # a text of fewer words is in its surrounding as a whole
    count = length - SHINGLE + 1
    total = np.zeros((len(a), shingle.shape[1] + 1), np.int32)
    np.cumsum(shingle, axis=1, out=total[:, 1:])
    k = np.arange(side + 1)
    if (count == words - SHINGLE + 1).all():
        got = total[:, words - SHINGLE + 1 :] - total[:, : side + 1]
    else:
        got = np.take_along_axis(total, np.minimum(k + count[:, None], shingle.shape[1]), 1) - total[:, : side + 1]
    fits = (k >= begin.max(0)[:, None]) & (k + length[:, None] <= end.min(0)[:, None]) & (k + length[:, None] >= words)
    near = fits & ((1 + similarity) * got >= 2 * similarity * count[:, None] - 1e-9)
    alike = near.any(1)
    first, last = near.argmax(1), side - near[:, ::-1].argmax(1) + count
    place = np.arange(shingle.shape[1])
    shared = shingle & (place >= first[:, None]) & (place < last[:, None])
    low, high = shared.argmax(1) - side, shingle.shape[1] - shared[:, ::-1].argmax(1) + SHINGLE - 1 - side
    spans = np.stack([low, high, low, high], 1)
    # Words put in or left out: more shingles are shared than stand side by side, and windows are compared as sets.
    # Where both ends of what both texts have stand side by side, sets add nothing to the span.
    row = np.arange(len(a))
    whole = alike & shingle[row, np.minimum(begin.max(0), shingle.shape[1] - 1)] & shingle[row, np.maximum(end.min(0) - SHINGLE, 0)]
    rest = np.flatnonzero(~whole & fits.any(1) & (seed >= np.where(length < words, SEED - SHINGLE + 1, WINDOW - SHINGLE + 1)) & ~same.all(1))
    sets = [_combined(np.ascontiguousarray(x[rest].T, np.uint64), SHINGLE, 2).T.copy() for x in (a, b)]
    for j, x in enumerate(sets):
        outside = ~np.logical_and.reduce([inside[j, rest, k : k + x.shape[1]] for k in range(SHINGLE)])
        x[outside] = np.broadcast_to(place.astype(np.uint64) * np.uint64(2) + np.uint64(j), x.shape)[outside]  # no shingle, and equal to none
    merged = np.sort(np.concatenate(sets, 1), 1)
    twice = [(np.diff(np.sort(x, 1), axis=1) == 0).sum(1) for x in sets]
    met = (merged[:, 1:] == merged[:, :-1]).sum(1) - sum(twice)
    for row in np.flatnonzero((met > total[rest, -1]) & ((1 + similarity) * met >= 2 * similarity * count[rest] - 1e-9)):
        i, one, two = rest[row], sets[0][row].tolist(), sets[1][row].tolist()
        n = int(count[i])
        places = np.flatnonzero(fits[i])
        if not twice[0][row] and not twice[1][row]:
            # A shingle at x and y is in both windows from the later one's end to the earlier one's start: the first and the last alike tell.
            _, x, y = np.intersect1d(sets[0][row], sets[1][row], assume_unique=True, return_indices=True)
            steps = np.zeros(len(place) + 2, np.int64)
            low, high = np.maximum(np.maximum(x, y) - n + 1, 0), np.minimum(x, y) + 1
            np.add.at(steps, low[low < high], 1)
            np.add.at(steps, high[low < high], -1)
            places = places[(1 + similarity) * np.cumsum(steps)[places] >= 2 * similarity * n - 1e-9]
            places = np.unique(places[[0, -1]]) if len(places) else places
        for at in places:
            x, y = one[at : at + n], two[at : at + n]
            both = set(x) & set(y)
            if len(both) >= similarity * len(set(x) | set(y)) - 1e-9:
                here = [[at + j - side for j, s in enumerate(z) if s in both] for z in (x, y)]
                found = [here[0][0], here[0][-1] + SHINGLE, here[1][0], here[1][-1] + SHINGLE]
                spans[i] = [min(p, q) if j % 2 == 0 else max(p, q) for j, (p, q) in enumerate(zip(spans[i], found, strict=True))] if alike[i] else found
                alike[i] = True
    return alike, spans


def marked(around: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of surroundings, zero where there is none; the second of equal ones in a row is another one, and so on."""
    x = _combined(np.ascontiguousarray(around.T, np.uint64), SHINGLE, 2).T
    there = np.logical_and.reduce([around[:, k : k + x.shape[1]] != 0 for k in range(SHINGLE)])
    x = np.sort(np.where(there, x, np.uint64(0)), 1)
    place = np.arange(x.shape[1])
    again = place - np.maximum.accumulate(np.where(np.diff(x, axis=1, prepend=~x[:, :1]) != 0, place, 0), 1)
    return np.where(x == 0, x, x + again.astype(np.uint64) * _ODD[55])


def needed(around: np.ndarray, words: int) -> np.ndarray:
    """Shingles of a window of each surrounding."""
    return np.minimum((around != 0).sum(1), words) - SHINGLE + 1


def shared(around: np.ndarray) -> np.ndarray:
    """Shingles of a bucket's surroundings as numbers from 0, -1 for those that only one has; one sort for the bucket."""
    x = marked(around)
    names, column, count = np.unique(x, return_inverse=True, return_counts=True)
    code = np.where((count > 1) & (names != 0), np.cumsum((count > 1) & (names != 0)) - 1, -1)
    return code[column.reshape(x.shape)]


def spanning(around: np.ndarray, known: np.ndarray, only: np.ndarray, words: int, similarity: float, bucket: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links (earlier row, later row, spans) that join the alike surroundings of each bucket (numbers that rise; None: all are one), rows in the order of documents.

    First the rows with a run of words around the seed in common that is long enough by itself meet, by sorting. In a group of
    near copies that joins nearly all. What is apart then is compared where the rarer shingles of two rows meet.
    """
    if not len(around):
        return
    root, linked = np.arange(len(around)), np.zeros(len(around), bool)
    bucket = np.zeros(len(around), np.int64) if bucket is None else bucket
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))

    def join(x: np.ndarray, y: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of the alike pairs: those that join components, and the first one of each surrounding, for what it has in common; all rows are in ``part``."""
        far = (root[x] != root[y]) & ~(known[x] & known[y] & (only[x] == only[y]))
        x, y = np.minimum(x[far], y[far]), np.maximum(x[far], y[far])
        alike, spans = compare(around[x], around[y], words, similarity)
        keep = []
        for t in np.flatnonzero(alike).tolist():
            i, j = x[t], y[t]
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i != j or not linked[x[t]] or not linked[y[t]]:
                root[max(i, j)] = min(i, j)
                linked[x[t]] = linked[y[t]] = True
                keep.append(t)
        while (root[part] != root[root[part]]).any():
            root[part] = root[root[part]]
        return x[keep], y[keep], spans[keep]

    for x, y in runs(around, bucket, starts, root, known, only, words, similarity):
        yield join(x, y, slice(None))
    for start, end in zip(starts, np.append(starts[1:], len(around)), strict=True):
        if (root[start:end] != root[start]).any():
            s = slice(start, end)
            for x, y in apart(around[s], known[s], only[s], root[s], words, similarity):
                for at in range(0, len(x), 4096):  # what one slice has joined the next one leaves out
                    yield join(start + x[at : at + 4096], start + y[at : at + 4096], s)


def least_shared(count: int, similarity: float) -> int:
    """Shingles that two windows of ``count`` have in common at least if they are alike."""
    return int(np.ceil((2 * similarity * count - 1e-3) / (1 + similarity)))


def runs(around: np.ndarray, bucket: np.ndarray, starts: np.ndarray, root: np.ndarray, known: np.ndarray, only: np.ndarray, words: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's rows with a common run around the seed that is long enough for being alike, each row with one other; ``root`` tells what is joined meanwhile.

    The run has k words to the left of the seed and the others to the right: for each k the rows are sorted by a hash of both.
    """
    side, outer = words - SEED, least_shared(words - SHINGLE + 1, similarity) + SHINGLE - 1 - SEED
    left, right = (np.zeros((outer + 1, len(around)), np.uint64) for _ in range(2))
    for k in range(outer):
        left[k + 1] = left[k] * _ODD[59] + around[:, side - 1 - k]
        right[k + 1] = right[k] * _ODD[59] + around[:, side + SEED + k]
    room, beyond = (around[:, :side] != 0).sum(1), (around[:, side + SEED :] != 0).sum(1)
    own, sizes = bucket.astype(np.uint64) * _ODD[55], np.diff(np.append(starts, len(around)))
    for k in sorted(range(outer + 1), key=lambda k: abs(k - outer // 2)):
        several = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), sizes)
        row = np.flatnonzero(several & (room >= k) & (beyond >= outer - k))
        if not len(row):
            continue
        key = _mix(left[k, row] * _ODD[57] + right[outer - k, row] * _ODD[56] + own[row])
        order = np.argsort(key)
        row, key = row[order], key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(row)))
        first = np.repeat(np.minimum.reduceat(row, begin), size)
        # Rows of the first one's document meet the first row of another document.
        same = known[row] & known[first] & (only[row] == only[first])
        other = np.repeat(np.minimum.reduceat(np.where(same, len(around), row), begin), size)
        met = np.where(same, other, first)
        new = (met < len(around)) & (row != first)
        new[new] = root[met[new]] != root[row[new]]
        if new.any():
            yield met[new], row[new]


def apart(around: np.ndarray, known: np.ndarray, only: np.ndarray, root: np.ndarray, words: int, similarity: float, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket's rows that are in different components (``root``, which may change meanwhile) and may be alike.

    Of two rows that have t shingles in common at least, each without its t - 1 most frequent ones, one that is left is in
    both: only rows that share such a rarer shingle are pairs. The rows of the largest component are not met with each other.
    """
    codes, count = shared(around), needed(around, words)
    there = codes >= 0
    often = np.bincount(codes[there], minlength=1)
    rank = np.empty(len(often), np.int64)
    rank[np.lexsort((np.arange(len(often)), often))] = np.arange(len(often))
    rare, have = np.sort(np.where(there, rank[codes], len(often)), 1), there.sum(1)
    for n in np.unique(count).tolist():
        kept = np.where(count >= n, have - least_shared(n, similarity) + 1, 0)
        row, at = np.nonzero(np.arange(rare.shape[1]) < kept[:, None])
        if not len(row):
            continue
        code, ends = rare[row, at], np.cumsum(np.bincount(row, minlength=len(around)))
        holders, sizes = row[np.argsort(code, kind="stable")], np.bincount(code)
        begins = np.cumsum(sizes) - sizes
        main = np.flatnonzero(root == np.bincount(root - root.min()).argmax() + root.min())[0]
        done, todo = np.zeros(len(around), bool), np.flatnonzero((root != root[main]) & (kept > 0))
        cost = np.cumsum([sizes[code[ends[i] - max(kept[i], 0) : ends[i]]].sum() for i in todo])
        for some in np.split(todo, np.flatnonzero(np.diff(cost // at_once)) + 1):
            some = some[root[some] != root[main]]
            mine = np.concatenate([np.arange(ends[i] - kept[i], ends[i]) for i in some]) if len(some) else np.zeros(0, np.int64)
            length = sizes[code[mine]]
            x, y = np.repeat(row[mine], length), holders[np.repeat(begins[code[mine]] - np.cumsum(length) + length, length) + np.arange(length.sum())]
            inside = np.zeros(len(around), bool)
            inside[some] = True
            may = (root[x] != root[y]) & ~done[y] & ~(inside[y] & (y < x)) & ((count[x] == n) | (count[y] == n)) & ~(known[x] & known[y] & (only[x] == only[y]))
            pairs, times = np.unique(x[may] * len(around) + y[may], return_counts=True)
            x, y = pairs // len(around), pairs % len(around)
            done[some] = True
            # A row's most promising partners first: mostly one of them joins it, and the others need not be looked at.
            order = np.lexsort((-times, x))
            x, y = x[order], y[order]
            turn = np.arange(len(x)) - np.maximum.accumulate(np.where(np.diff(x, prepend=-1) != 0, np.arange(len(x)), 0))
            for low, high in ((0, 1), (1, 4), (4, 16), (16, 1 << 62)):
                chosen = np.flatnonzero((turn >= low) & (turn < high) & (root[x] != root[y]))
                if len(chosen):
                    yield x[chosen], y[chosen]


def _verified(words: int, similarity: float, small: int = 12):
    """Of rows sorted by bucket (key, tile) and document: links that span the alike contents of each bucket, the earlier document's first. Two contents of one and the same document are not linked."""

    def links(bucket: np.ndarray, content: np.ndarray, only: np.ndarray, known: np.ndarray, around: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]).any(1)))
        sizes = np.diff(np.append(starts, len(bucket)))
        # The usual bucket is small: all its pairs at once, together with those of the others.
        group = np.repeat(np.where(sizes <= small, np.arange(len(starts)), -1), sizes)
        for step in range(1, small):
            same = np.flatnonzero((group[step:] == group[:-step]) & (group[step:] >= 0))
            same = same[~(known[same] & known[same + step] & (only[same] == only[same + step]))]
            for at in range(0, len(same), 1 << 14):
                x = same[at : at + (1 << 14)]
                alike, spans = compare(around[x], around[x + step], words, similarity)
                yield content[x][alike], content[x + step][alike], spans[alike]
        large = np.flatnonzero(np.repeat(sizes > small, sizes))
        number = np.repeat(np.arange(len(starts)), sizes)
        for x, y, spans in spanning(around[large], known[large], only[large], words, similarity, number[large]):
            yield content[large[x]], content[large[y]], spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if rows is None or not rows.num_rows:
                continue
            bucket = np.stack([rows[c].to_numpy() for c in ("key", "tile")], 1)
            cut = np.flatnonzero((bucket != bucket[-1]).any(1))
            done = rows.num_rows if batch is None else int(cut[-1]) + 1 if len(cut) else 0  # the last bucket may go on
            held = rows.slice(done)
            if not done:
                continue
            content, doc, last = (rows[c].to_numpy()[:done] for c in ("content", "doc", "last"))
            around = np.frombuffer(b"".join(rows["around"].slice(0, done).to_pylist()), np.uint32).reshape(done, -1)
            for a, b, spans in links(bucket[:done], content, doc, doc == last, around):
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b), *(pa.array(spans[:, k].astype(np.int32)) for k in range(4))], names=["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"])

    return run


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, removed, components, number, text): passages that overlap or touch in a document joined, by word position, kept and removed ones apart."""
    order = Window.partitionBy("number", "first").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("number", "first", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sort_array(F.collect_set("component")).alias("components"), F.first("text").alias("text")
    ).select("doc_id", "start", "end", (~F.col("first")).alias("removed"), "components", "number", "text")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the words of removed passages; what stood between stays as it was."""
    removed = spans(found).where("removed").groupBy("number").agg(F.first("doc_id").alias("id"), F.first("text").alias("own"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    column = next(c for k in itertools.count() if (c := f"cut_{k}") not in docs.columns)
    # A text of a shared doc_id is met by its doc_id and text, any other by its doc_id.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    by_id = removed.where("own is null").select("id", F.col("cuts").alias("a"))
    by_text = removed.where("own is not null").select(F.col("id").alias("also"), "own", F.col("cuts").alias("b"))
    met = rows.join(by_id, F.col("r.doc_id").cast("long") == F.col("id"), "left").join(by_text, F.col("r.doc_id").cast("long").eqNullSafe(F.col("also")) & (F.col("r.text") == F.col("own")), "left")
    met = met.select("r.*", F.coalesce("a", "b").alias(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            texts = []
            for text, cuts in zip(batch["text"].to_pylist(), batch[column].to_pylist(), strict=True):
                if cuts and text:
                    places = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
                    at, kept = 0, []
                    for c in cuts:
                        if c["end"] <= len(places):
                            kept.append(text[at : places[c["start"]][0]])
                            at = places[c["end"] - 1][1]
                    text = "".join(kept) + text[at:]
                texts.append(text)
            out = {n: batch[n] for n in batch.schema.names if n != column} | {"text": pa.array(texts, pa.string())}
            yield pa.record_batch(list(out.values()), names=list(out))

    return met.mapInArrow(run, docs.schema)


def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that has a repeated passage; component ids are the smallest doc_id with the passage."""
    found = spans(repeated(common.table(spark, sf_dir, "documents")))
    size = F.col("end") - F.col("start")
    return found.groupBy("number").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").alias("n_passages"),
        F.coalesce(F.sum(F.when(F.col("removed"), size)), F.lit(0)).cast("long").alias("n_words_removed"),
        F.coalesce(F.sum(F.when(~F.col("removed"), size)), F.lit(0)).cast("long").alias("n_words_kept"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("components")))).alias("component_ids"),
        F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("passages"),
    ).drop("number")
