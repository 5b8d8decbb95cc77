"""A region in cells on shared storage: an index of cells beside their rows, of which only the cells that a window meets are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "cell_key string, id_base long, west double, south double, east double, north double, rows long, stamp string"


def write_region(rows: DataFrame, cells: DataFrame, base: str, stamp: str) -> None:
    """``rows`` (cell_key, local, ...) by cell, then the index of all ``cells`` (cell_key, id_base, west, south, east, north) with what each holds.

    The index comes last: a run that dies before leaves a region that still says what it held. Rows of a cell that is not
    declared are not written.
    """
    kept = rows.join(cells.select("cell_key"), "cell_key", "left_semi")
    kept.write.mode("overwrite").partitionBy("cell_key").parquet(f"{base}/cells")
    held = rows.sparkSession.read.schema(kept.schema).parquet(f"{base}/cells").groupBy("cell_key").agg(F.count("*").alias("rows"))
    index = cells.join(held, "cell_key", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)).cast("long"), "stamp": F.lit(stamp)})
    index.select(*[c.split()[0] for c in INDEX.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{base}/index")


@dataclass(frozen=True)
class Region:
    """A region as written by ``write_region``. ``rows`` is the schema of its rows; ids are ``id_base`` plus the local number, which takes ``bits`` bits."""

    spark: SparkSession
    base: str
    rows: str
    bits: int = 16

    def index(self) -> DataFrame:
        """The declared cells; none where nothing has been written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/index")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(f"{self.base}/index")

    def cells_in(self, west: float, south: float, east: float, north: float) -> DataFrame:
        """Cells whose box meets the window; touching counts."""
        return self.index().where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))

    def read(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (id, cell_key, local, ...) of the wanted cells of the index, and the cells (cell_key, declared, found) that failed.

        Names of cells go into the scan as a filter on partitions, so no other cell is listed or read. A cell that is gone
        or cannot be read, or holds another number of rows than declared, has failed: it gives no row, the others all theirs.
        """
        keys = [r.cell_key for r in wanted.select("cell_key").distinct().collect()]  # names of a window's cells
        reader = self.spark.read.schema(f"{self.rows}, cell_key string").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/cells")
        there = keys and path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        # All columns are read in both scans, or a file that breaks in one of them would count as whole.
        found = reader.parquet(f"{self.base}/cells").where(F.col("cell_key").isin(keys)) if there else self.spark.createDataFrame([], f"{self.rows}, cell_key string")
        whole = F.xxhash64(*found.columns)
        counted = found.groupBy("cell_key").agg(F.count(whole).alias("found"))
        told = wanted.select("cell_key", "id_base", F.col("rows").alias("declared")).join(counted, "cell_key", "left").na.fill({"found": 0})
        good = told.where("found = declared").select("cell_key", "id_base")
        rows = found.join(good, "cell_key").select((F.col("id_base") + F.col("local")).alias("id"), *[c for c in ("cell_key", *found.columns[:-1])])
        return rows, told.where("found <> declared").select("cell_key", "declared", "found")

    def at(self, ids: DataFrame) -> DataFrame:
        """``ids`` (id) with ``declared`` and the row of each as the struct ``row``; null, never zeros, where a cell is not there or has failed."""
        index, ordinal = self.index(), F.shiftright("id", self.bits)
        asked = ids.withColumn("ordinal", ordinal)
        cells = index.withColumn("ordinal", F.shiftright("id_base", self.bits))
        rows, _ = self.read(cells.join(asked.select("ordinal").distinct(), "ordinal", "left_semi"))
        held = rows.select("id", F.struct(*[c for c in rows.columns if c != "id"]).alias("row"))
        known = cells.select("ordinal", F.lit(True).alias("declared"))
        return asked.join(known, "ordinal", "left").join(held, "id", "left").select("id", F.coalesce("declared", F.lit(False)).alias("declared"), "row")
