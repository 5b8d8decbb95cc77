"""Tables between steps, upserts and resumes, in shared storage."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a folder of this machine only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lightwalk-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Written as Parquet below ``spark.checkpoint.dir`` and read back, which ends its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, f"tables/{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def build_by_cell(selected: DataFrame, key: str, date: str, compute: Callable[[DataFrame], DataFrame], table: str, manifest: str, at_once: int = 8) -> DataFrame:
    """Computes the cells that are not done yet and writes them, so that a run that was killed goes on where it stopped; returns the manifest.

    Pending cells (``selected`` keys that the manifest does not have as done on this date) go ``at_once`` at a time through
    ``compute``: a DataFrame with the column ``key`` for the cells given. Their partitions of ``table`` are replaced, then
    the manifest gets a row for each: (key, status, date, rows). A run that dies between the two computes those cells again
    and replaces them by the same. A cell whose computation fails is told as failed, once its companions have been tried
    apart, and is pending in the next run. The last row of a cell counts. A cell that yields no row leaves the rows of an
    earlier date where they are.
    """
    spark = selected.sparkSession
    schema = f"{key} string, status string, date string, rows long, run long"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    known = lambda: spark.read.schema(schema).parquet(manifest) if files.exists(hadoop) else spark.createDataFrame([], schema)
    last = lambda: known().groupBy(key).agg(F.max_by(F.struct("status", "date", "rows"), "run").alias("x")).select(key, "x.*")
    done = last().where((F.col("status") == "ok") & (F.col("date") == date))
    todo = sorted(str(r[0]) for r in selected.select(F.col(key).cast("string").alias(key)).distinct().join(done, key, "left_anti").collect())  # names of cells of a region

    def built(keys: list[str]) -> dict[str, int]:
        some = spark.createDataFrame([(k,) for k in keys], f"{key} string")
        made = compute(some)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(table)
        found = spark.read.schema(made.schema).parquet(table).where(F.col(key).isin(keys)).groupBy(key).count()
        return {str(k): n for k, n in found.collect()}

    def told(keys: list[str], status: str, rows: dict[str, int]) -> None:
        run = time.time_ns()
        spark.createDataFrame([(k, status, date, rows.get(k, 0), run) for k in keys], schema).coalesce(1).write.mode("append").parquet(manifest)

    for at in range(0, len(todo), at_once):
        keys = todo[at : at + at_once]
        try:
            told(keys, "ok", built(keys))
        except Exception:  # noqa: BLE001 one cell of them: which one shows when they are tried apart
            for k in keys:
                try:
                    told([k], "ok", built([k]))
                except Exception:  # noqa: BLE001 a cell's failure is its own
                    told([k], "failed", {})
    return last()


def spread(df: DataFrame, by: str, at_once: int = 2_000) -> DataFrame:
    """``df`` over all slots, and at most some ``at_once`` rows to a task, where it has fewer files than that: costly rows would else wait for one core, and ten times the rows make a task ten times as long.

    A file counts as one task: how many a scan makes of a large one depends on its bytes, not on what its rows cost.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // at_once))
    return df.repartition(tasks, by) if len(df.inputFiles()) < tasks else df


def dealt(df: DataFrame, *by: str, rows: int | None = None, at_once: int = 250_000) -> DataFrame:
    """``df`` by a hash of ``by``, some ``at_once`` rows to a task: the sorts and windows by these columns that follow then take as much memory for ten times the rows.

    ``rows``: how many there are, counted where not told (of Parquet, from its footers).
    """
    rows = df.count() if rows is None else rows
    if rows <= at_once:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // at_once)), *by)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def pending(selected: DataFrame, manifest: DataFrame, key: str, date) -> DataFrame:
    """Selected keys that the manifest does not have as done since this date."""
    done = manifest.where((F.col("status") == "ok") & (F.col("date") >= F.lit(date).cast("date")))
    return selected.join(done, key, "left_anti")


def within_budget(files: DataFrame, shard: str, budget: int) -> DataFrame:
    """Files (shard, name, size, modified) that stay: the newest whose total is within ``budget`` for their shard."""
    newest = Window.partitionBy(shard).orderBy(F.desc("modified"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("total", F.sum("size").over(newest)).where(F.col("total") <= budget).drop("total")
