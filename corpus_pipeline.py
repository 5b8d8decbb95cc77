"""A corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read back as the next one's ``docs``. All but the last return the columns of ``documents``. ``n_chars`` follows the text.

Cases: every stage judges rows, each by its own text; a row without doc_id stays as long as its text gives no reason to
go, and so does a row whose doc_id has another text too; of a group of near duplicates one row stays, of those with the
smallest doc_id (without doc_id only if none has one); null and empty texts are judged as empty ones, so one of them stays;
an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightwalk.llm import common, decontaminate, line_dedup, packing, quality, simhash

#: SQL cannot express compression, SimHash or tokenizers: the stages are tested one by one against brute force.
ORACLE_SQL = None


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score of 0.3 or more)."""
    labelled = common.table(spark, sf_dir, "documents")
    model = quality.fitted(labelled, common.table(spark, sf_dir, "labels"))
    (score,) = common.free_names(docs, "score")
    return _like(model.score(docs, score).where(F.col(score) >= quality.CUT), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents have."""
    found = line_dedup.LineDedup.build(docs, threshold=10).rewrite(docs, counts=tuple(common.free_names(docs, "lines", "dropped")))
    return _like(found.withColumn("n_chars", F.length("text").cast("long")), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, with the smallest doc_id."""
    (row,) = common.free_names(docs, "row")
    numbered = common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = simhash.classes(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    ids = numbered.select(F.col("doc_id").cast("long").alias("id"), row).join(classes, row)
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("first")).select(f"first.{row}")
    return _like(numbered.join(kept, row, "left_semi"), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row"))
    found = decontaminate.find(rows, common.table(spark, sf_dir, "benchmark"), row="whole_row")
    return found.where(~decontaminate.contaminated()).select("whole_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents, and its place in a sequence of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("lines", drop_lines),
    ("copies", drop_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
