"""Helpers shared by the corpus operators: table access, shared storage, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the cluster names its shared folder.
CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder URI under the cluster's shared folder, for one use.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset on a single machine (``local`` master, as in
    tests) a folder of this machine is chosen, once for the session; a cluster without it is refused.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lightwalk-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/lightwalk/{purpose}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write serve nothing any more.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/lightwalk/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks before it as no column of ``docs`` has."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def slots(spark: SparkSession) -> int:
    """Tasks worth starting at once."""
    return max(2, spark.sparkContext.defaultParallelism)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(node, root)``, root the smallest node of the component.

    Alternating large-star and small-star steps: each rewires a node's neighbours to the smallest node known in its
    neighbourhood, so the number of rounds follows the logarithm of the longest path, not its length. The minimum of a
    hub's neighbourhood is a partial aggregate joined back, so a hub never has to fit into one task. It ends when all is
    stars: no node has two neighbours below it, and no root one. Nodes without an edge are not returned. An empty input
    gives an empty result.
    """
    edges = materialize(_undirected(edges), "edges")
    while not _stars(edges):
        large = _star(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False)
        old, edges = edges, materialize(small, "edges")
        discard(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up > 0 and root > 0)").isEmpty()


def _undirected(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """One step: with m the minimum of a and its neighbours b, link to m the larger neighbours, or the smaller ones and a itself."""
    least = directed.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = directed.join(least, "a")
    if larger:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return linked.where("a != b").distinct()
