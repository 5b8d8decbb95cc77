"""Exact top-k inner-product search by MaxScore over vector shards.

Each dimension of a query is a term, and a shard's column for that dimension its postings. A block of postings knows
its largest and smallest impact, so ``max(q * high, q * low)`` bounds what a term can add to a score. Terms are ordered
by bound; the ones that remain once their bounds, added to the partial score, can still lift a candidate over the
query's threshold are probed, the rest of the candidates are dropped. Shards are searched independently and their
lists merged.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without a
``vec_id``; of rows with one ``vec_id`` the least vector stands; vectors of different lengths meet as if the shorter
ended in zeros; ties go to the smaller id; an empty table gives an empty result; further columns are ignored.
Integer scores are exact below 2**53 and 64-bit (wrapping) beyond.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part: ``floor(scale * x)``, x as double."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
        .select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors, as rows of equal width."""
    rows = rows.sort_by("vec_id")
    lists = rows["v"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows["vec_id"].to_numpy(), out


def _width(rows: pa.Table) -> int:
    return int(np.diff(rows["v"].combine_chunks().offsets.to_numpy()).max(initial=0))


def maxscore(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, block: int = 1024, step: int = 8):
    """Yield for each query its k best (ids, scores) in the shard; ``ids`` ascending, so that a later candidate must be strictly better."""
    reach = (np.abs(queries).max(0, initial=0).astype(float) * np.abs(vectors).max(0, initial=0)).sum()
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64  # exact in each
    blocks = []
    for at in range(0, len(ids), block):
        postings = np.ascontiguousarray(vectors[at : at + block].T.astype(kind))
        blocks.append((at, postings, postings.max(1), postings.min(1)))
    for query, self_id in zip(queries.astype(kind), own, strict=True):
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        for at, postings, high, low in blocks:
            bound = np.maximum(query * high, query * low)
            order = np.argsort(-np.abs(bound), kind="stable")
            rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[j]: the most that terms j.. can add
            full = len(best) == k
            if full and rest[0] <= best[-1]:
                continue
            # Essential terms: all until those that follow cannot by themselves make up the gap to the threshold.
            essential = len(order) if not full else min(len(order), int(np.argmax(rest - best[-1] <= 0)) or step)
            terms = order[:essential]
            score, rows = query[terms] @ postings[terms], None
            while full:
                alive = np.flatnonzero(score + rest[essential] > best[-1])
                rows = alive if rows is None else rows[alive]
                score = score[alive]
                if essential == len(order) or not len(rows):
                    break
                terms = order[essential : essential + step]
                score = score + query[terms] @ postings[np.ix_(terms, rows)]
                essential += len(terms)
            found = ids[at : at + block] if rows is None else ids[at + rows]
            other = found != self_id
            found, score = np.append(best_ids, found[other]), np.append(best, score[other])
            top = np.lexsort((found, -score))[:k]
            best_ids, best = found[top], score[top]
        yield best_ids, best


def top_k(
    vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256, shard_rows: int = 65_536, query_rows: int = 8_192
) -> DataFrame:
    """The k best other vectors of each query: (query_id, rank, vec_id, score).

    Vectors are dealt by hash into shards of about ``shard_rows``, queries into groups of about ``query_rows``; each
    shard meets each group once, so a task holds one shard and one group however many of either there are.
    """
    spark = vectors.sparkSession
    base = common.materialize(quantised(vectors, scale), "vectors")
    queries = base.where(is_query)
    shards = max(2 * common.slots(spark), math.ceil(base.count() / shard_rows))
    groups = max(1, math.ceil(queries.count() / query_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("shard", deal(shards)).withColumn("part", every(groups))
    right = queries.withColumn("part", deal(groups)).withColumn("shard", every(shards))

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if candidates.num_rows and asked.num_rows:
            width = max(_width(candidates), _width(asked))
            ids, rows = _matrix(candidates, width)
            own, wanted = _matrix(asked, width)
            for query_id, (found, score) in zip(own, maxscore(wanted, ids, rows, own, k), strict=True):
                out.append((np.full(len(found), query_id), found, score.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(search, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([a[1] * a[2] for a in list_zip(q.e, c.e)]) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select * from r where rank <= 5
"""
