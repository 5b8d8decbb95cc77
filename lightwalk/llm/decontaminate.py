"""Benchmark decontamination by an Aho-Corasick automaton over normalised benchmark windows.

Texts are lower-cased in A-Z and cut into words of letters and digits (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: ASCII
letters and digits, and everything beyond ASCII). Every ``width`` consecutive words of an item are a window; an item of
fewer words, but not none, is one window. Windows are cut from the items by tasks and counted. Up to ``max_windows`` pairs
of a window and an item are one automaton, which is sent to the tasks and scans each whole text once. More are dealt by
hash into parts of about that many: each part is an automaton of its own and a pass of its own over the texts, so that
neither the driver nor a task ever holds more than one, and the passes' hits are merged by row. Matches are word ranges,
which the words' places map back to the original text.

Cases: null and empty texts, and those without words, have no words and no hits; very long texts are scanned as a whole;
repeated rows are judged each for itself; an empty benchmark hits nothing; items without words are ignored; words of an
item without item_id count as hit, but it has no id to be listed by; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: ASCII characters that are no word become blanks, A-Z become a-z.
_PLAIN = {c: (chr(c).lower() if chr(c).isalnum() else " ") for c in range(128)}


def words(text: str | None) -> list[str]:
    return [w for w in text.translate(_PLAIN).split(" ") if w] if text else []


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, item): each window of an item once, with its id as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                w = words(text)
                found = sorted({f" {' '.join(w[k : k + width])} " for k in range(max(1, len(w) - width + 1) if w else 0)})
                yield pa.record_batch([pa.array(found, pa.string()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    return items.mapInArrow(run, "window string, item string").distinct()


def automaton(pairs: list[tuple[str, str | None]]):
    """Of (window, item): one pattern a window, with its words and its items."""
    import ahocorasick

    found: dict[str, set[str]] = {}
    for window, item in pairs:
        found.setdefault(window, set()).update(() if item is None else (item,))
    made = ahocorasick.Automaton()
    for pattern, items in found.items():
        made.add_word(pattern, (len(pattern), pattern.count(" ") - 1, sorted(items)))
    if found:
        made.make_automaton()
    return made if found else None


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str | None, made) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words; the merged ranges of hit words [first, end); the items that occur."""
    w = words(text)
    ranges, items = [], set()
    if w and made is not None:
        line = f" {' '.join(w)} "
        at = seen = 0
        for end, (length, count, found) in made.iter(line):
            first = end - length + 1
            seen += line.count(" ", at, first) if first >= at else -line.count(" ", first, at)  # words before the match
            at = first
            ranges.append((seen, seen + count))
            items.update(found)
    return len(w), merged(ranges), items


def spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as character ranges of the original text."""
    places = [m.span() for m in re.finditer("[^ ]+", text.translate(_PLAIN))]  # of the same length as the text
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


def _result(rows: list[tuple], batch: pa.RecordBatch, passed: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), RANGES)
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
    return pa.record_batch(columns + [batch[c] for c in passed], names=["doc_id", "n_words", "n_hit", "items", "spans", *passed])


def _told(doc_id, text: str | None, count: int, ranges: list[tuple[int, int]], items) -> tuple:
    return doc_id, count, sum(b - a for a, b in ranges), sorted(items), spans(text, ranges) if ranges else []


def find(docs: DataFrame, benchmark: DataFrame, width: int = 13, max_windows: int = 200_000, row: str | None = None) -> DataFrame:
    """Per document: words, hit words, the items that occur and the hit spans of its text. A column named ``row`` passes through."""
    spark, passed = docs.sparkSession, [row] if row else []
    pairs = common.materialize(windows(benchmark, width), "benchmark-windows")
    parts = max(1, -(-pairs.count() // max_windows))
    schema = StructType.fromDDL(SCHEMA)
    for c in passed:
        schema = schema.add(docs.schema[c])
    docs = docs.select(F.col("doc_id").cast("long"), "text", *passed)
    if parts == 1:
        sent = spark.sparkContext.broadcast([tuple(r) for r in pairs.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(sent.value)
            for batch in batches:
                texts = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                yield _result([_told(i, t, *scan(t, made)) for i, t in texts], batch, passed)

        return docs.mapInArrow(run, schema)
    numbered = common.materialize(docs.withColumn("__n", F.monotonically_increasing_id()), "scanned")
    hits = None
    for k in range(parts):
        part = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k)
        found = common.materialize(_pass(numbered, spark.sparkContext.broadcast([tuple(r) for r in part.collect()])), "hits")
        hits = found if hits is None else hits.unionByName(found)
    each = hits.groupBy("__n").agg(F.flatten(F.collect_list("ranges")).alias("__ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, ranges, items in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "__ranges", "__items")), strict=True):
                rows.append(_told(i, t, len(words(t)), merged([(r["start"], r["end"]) for r in ranges or ()]), items or ()))
            yield _result(rows, batch, passed)

    return numbered.join(each, "__n", "left").mapInArrow(merge, schema)


def _pass(numbered: DataFrame, sent) -> DataFrame:
    """(__n, ranges, items) of the rows that one part's automaton hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(sent.value)
        for batch in batches:
            rows = []
            for n, text in zip(batch["__n"].to_pylist(), batch["text"].to_pylist(), strict=True):
                _, ranges, items = scan(text, made)
                if ranges:
                    rows.append((n, [{"start": a, "end": b} for a, b in ranges], sorted(items)))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), RANGES, pa.list_(pa.string())), strict=True)], names=["__n", "ranges", "items"])

    return numbered.select("__n", "text").mapInArrow(run, "__n long, ranges array<struct<start:long,end:long>>, items array<string>")


def contaminated() -> F.Column:
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op10_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


OP10_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), s as (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as k, least(13, len(w)) as n from i where len(w) > 0
), win as (select distinct item, n, array_to_string(w[k : k + n - 1], ' ') as text from s
), p as (select r, w, unnest(range(1, len(w) + 1)) as k from d
), q as (select r, k, n, array_to_string(w[k : k + n - 1], ' ') as text from p, (select distinct n from win) where k + n - 1 <= len(w)
), m as (select r, k, n, item from q join win using (n, text)
), h as (select r, count(distinct place) as hit from (select r, unnest(range(k, k + n)) as place from m) group by r
), t as (select r, count(distinct item) as items, string_agg(distinct item, ',' order by item) as named from m group by r)
select doc_id, len(w) as n_words, coalesce(hit, 0) as n_hit, coalesce(items, 0) as n_items, sha256(coalesce(named, '')) as items_sha256, coalesce(hit > 0 and 20 * hit >= len(w), false) as contaminated
from d left join h using (r) left join t using (r)
"""
