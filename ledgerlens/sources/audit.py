"""The trail of what reviewers changed, and raw OCR results kept beside their packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = ["doc_id", "page", "field_path", "original_value", "new_value", "reason", "reviewer", "at"]


class AuditTrail:
    """DSL-15: an append-only table of corrections. Entry ids are hashes of what an entry says, so a repeated write shows once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self, entries: DataFrame) -> None:
        """entries: doc_id, page, field_path, original_value, new_value, reason, reviewer, at."""
        said = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _ENTRY])
        entries.select(F.sha2(said, 256).alias("entry_id"), *_ENTRY).write.mode("append").parquet(self.path)

    def entries(self, doc_id: str | None = None, page: int | None = None) -> DataFrame:
        """All entries, or those of a document, or of one of its pages."""
        out = self.spark.read.parquet(self.path)
        out = out if doc_id is None else out.where(F.col("doc_id") == doc_id)
        return (out if page is None else out.where(F.col("page") == page)).dropDuplicates(["entry_id"])

    def export(self, doc_id: str) -> DataFrame:
        """A document's entries as JSON lines, in order of time."""
        return self.entries(doc_id).orderBy("at", "entry_id").select(F.to_json(F.struct("entry_id", *_ENTRY[1:])).alias("value"))


def write_ocr(results: DataFrame, path: str, package: str) -> None:
    """SRC-9: keeps the raw OCR rows (page and more) of one package, in place of what it had."""
    results.write.mode("overwrite").parquet(f"{path}/package={package}")


def read_ocr(spark: SparkSession, path: str, package: str) -> DataFrame:
    """SRC-9: what write_ocr() kept, by page; an error where the package has none."""
    return spark.read.parquet(f"{path}/package={package}").orderBy("page")
