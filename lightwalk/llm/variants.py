"""Spelling variants by a symmetric-delete join: words that share a form with one letter left out are compared.

Words are the maximal runs of ``[A-Za-zÀ-ÿ]`` with A-Z lower-cased. Every word that is frequent enough emits itself and its
distinct single deletions; two words at distance one share a key, so an equi-join on the keys finds every such pair, and an
exact test of the distance leaves nothing else. A key can be shared only by the words that one letter turns into it, which
bounds a group by the alphabet and the word's length, whatever the size of the corpus.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that count is ten times its own
or more. Counts grow tenfold along forms, so chains are short, and following them by doubling ends after few joins.

Words of more than ``LONG`` letters would emit deletions of quadratic size. They emit 61-bit sums of their deletions
instead, all computed in one walk over the word, and the texts join the pairs again for the exact test.

Cases: null and empty texts have no words; a null doc_id counts as an empty one where the contract's hash uses it; very
long texts and words are used whole; repeated rows count each for themselves; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUN = "[A-Za-zÀ-ÿ]"
#: Words of up to so many letters emit their deletions as text.
LONG = 64
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def lowered(run: Column) -> Column:
    """A-Z lower-cased, no other letter. Runs in ASCII alone take the shorter way."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, letters, letters.lower()))


def without(word: Column, k: Column) -> Column:
    """The word without its letter ``k``, from 0."""
    return F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.length(word)))


def occurrences(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``least`` letters, one occurrence in ``every`` misspelt by the hash of its document and run."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{least},}})"))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    word = F.when(F.col("h") % every == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _sums(word: str) -> list[int]:
    """The word's own sum and those of its distinct single deletions; equal texts have equal sums."""
    front, power = [0], [1]
    for c in word:
        front.append((front[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    size = len(word)
    found = {front[size]}
    for k in range(size):
        back = (front[size] - front[k + 1] * power[size - k - 1]) % _PRIME
        found.add((front[k] * power[size - k - 1] + back) % _PRIME)
    return list(found)


def _pairs_of_short(words: DataFrame) -> DataFrame:
    word = F.col("word")
    deleted = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda k: without(word, k))
    keyed = words.where(F.length(word) <= LONG).select("word", "n", F.explode(F.array_distinct(F.concat(F.array(word), deleted))).alias("key"))
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    near = F.levenshtein("word", "near", 1) == 1
    return keyed.join(other, "key").where((F.col("word") != F.col("near")) & near).select("word", "near", "near_n")


def _pairs_of_long(words: DataFrame) -> DataFrame:
    """Pairs with a word of more than ``LONG`` letters: keys carry hashes of the words, and the words join the pairs again."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [(i, k) for i, w in zip(batch["id"], batch["word"], strict=True) for k in _sums(w)]
            for at in range(0, len(keys), 100_000):
                yield pd.DataFrame(keys[at : at + 100_000], columns=["id", "key"])

    long = words.where(F.length("word") >= LONG).withColumn("id", F.xxhash64("word"))
    keyed = long.select("id", "word").mapInPandas(rows, "id long, key long")
    found = keyed.join(keyed.withColumnRenamed("id", "near_id"), "key").where("id != near_id").select("id", "near_id").distinct()
    both = found.join(long.drop("n"), "id").join(long.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_id")
    return both.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "near_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words at distance exactly one, once. ``words(word, n)`` should be a written table."""
    pairs = _pairs_of_short(words)
    if not words.where(F.length("word") > LONG).isEmpty():
        pairs = pairs.unionAll(_pairs_of_long(words))
    return pairs.distinct()


def forms(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    chosen = F.col("near_n") >= factor * F.col("n")
    return joined.select("word", "n", "n_near", F.when(chosen, F.col("near")).alias("form"), F.when(chosen, F.col("near_n")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``: the last word that forms lead to; the word itself where it has none.

    Each round doubles the way that a word has come: its root's root becomes its root, until no root has one.
    """
    formed = common.materialize(formed, "forms")
    links = common.materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(step, "root", "left_semi").isEmpty():
            break
        old, links = links, common.materialize(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        common.discard(old)
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame, least: int = 7, least_n: int = 2, every: int = 31, factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least ``least`` letters and ``least_n`` occurrences."""
    words = common.materialize(occurrences(docs, least, every).where(F.col("n") >= least_n), "words")
    return rooted(forms(words, factor))


def op12_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by its published table, made from the reversed polynomial; bytes of UTF-8 from code points below U+0100.
OP12_SQL = r"""
with recursive t0 as (select i, i as c, 0 as k from range(256) x(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from t0 where k < 8
), crc as materialized (select list(c order by i) as crcs from t0 where k = 8
), o as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')) as raw from documents
), q as (select coalesce(cast(doc_id as varchar), '') as id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times from o group by all
), y as (
  select run, times, flatten(list_transform(range(1, length(id || ':' || run) + 1), lambda k: case when unicode((id || ':' || run)[k]) < 128 then [unicode((id || ':' || run)[k])]
    else [192 + unicode((id || ':' || run)[k]) // 64, 128 + unicode((id || ':' || run)[k]) % 64] end)) as bytes from q
), h as (select run, times, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(bytes, lambda b: b::bigint)), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])), 4294967295) as h from y, crc
), w as (
  select case when h % 31 = 0 then run[1 : (h % length(run))::bigint] || run[(h % length(run))::bigint + 2 :] else run end as word, sum(times)::bigint as n from h group by 1 having length(word) >= 7 and sum(times) >= 2
), d as (select word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda k: word[1 : k - 1] || word[k + 1 :])))) as key from w
), p as (select distinct a.word, b.word as near, b.n as near_n from d a join d b using (key)
  where a.word != b.word and (length(a.word) != length(b.word) and key in (a.word, b.word) or length(a.word) = length(b.word) and len(list_filter(range(1, length(a.word) + 1), lambda k: a.word[k] != b.word[k])) = 1)
), g as (select word, count(*) as n_near, max(near_n) as top from p group by word
), z as (select p.word, n_near, top, min(near) as near from p join g on p.word = g.word and p.near_n = g.top group by all
), f as (select w.word, n, coalesce(n_near, 0) as n_near, case when top >= 10 * n then near end as form, case when top >= 10 * n then top end as form_n from w left join z using (word)
), r as (select word, word as root from f where form is null union all select f.word, r.root from f join r on f.form = r.word
)
select f.word, form, root, n, n_near, form_n from f join r using (word)
"""
