"""Sources and sinks: packets of files, manifests, sidecars, append-only stores and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def looks_like_pdf(name: Column, content_type: Column) -> Column:
    """SRC-3: by content type or, failing that, by suffix."""
    return F.coalesce(F.startswith(F.lower(content_type), F.lit("application/pdf")), F.lit(False)) | F.endswith(F.lower(name), F.lit(".pdf"))


def file_issues(name: Column, content_type: Column, size: Column, role: Column) -> Column:
    """SRC-2: the issues of one file, in order."""
    return F.array_compact(F.array(
        F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE"),
        F.when(~looks_like_pdf(name, content_type), "UNSUPPORTED_FILE_TYPE"),
        F.when(role.isNull(), "UNCLASSIFIED_DOCUMENT"),
    ))


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """SRC-1: path, size and SHA-256 of every file below a folder; files beyond most_bytes are reported, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is None:
        return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    small = files.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large)


def first_text(content: Column, most: int = 2000) -> Column:
    """SRC-4: the readable start of a file, for classification: its printable ASCII runs of four characters and more."""
    text = F.decode(F.substring(content, 1, 4 * most), "ISO-8859-1")
    return F.substring(F.array_join(F.regexp_extract_all(text, F.lit(r"[ -~]{4,}"), F.lit(0)), " "), 1, most)


def load_manifest(text: str) -> dict[str, list[tuple]]:
    """SRC-5: a manifest (JSON) as rows of roles, globs and header words; ValueError names what is wrong."""
    data = json.loads(text)
    roles, globs, words, seen = [], [], [], set()
    for r in data.get("roles", []):
        if not (name := r.get("role")) or name in seen:
            raise ValueError(f"role without a name of its own: {name!r}")
        if r.get("cardinality") not in ("exactly_one", "at_least_one", "zero_or_more"):
            raise ValueError(f"{name}: cardinality {r.get('cardinality')!r}")
        seen.add(name)
        roles.append((name, r["cardinality"], bool(r.get("canonical"))))
        globs += [(name, g) for g in r.get("filename_globs", [])]
        words += [(name, w) for w in r.get("header_keywords", [])]
    if not roles:
        raise ValueError("no roles")
    return {"roles": roles, "globs": globs, "words": words}


def read_sidecars(spark: SparkSession, path: str, schema: str, package: str) -> DataFrame:
    """SRC-6: extracted rows of one package; a row of another one fails the read."""
    df = spark.read.schema(schema).json(path)
    other = F.raise_error(F.concat(F.lit("package mismatch: "), F.coalesce("package_id", F.lit("none")))).cast("string")
    return df.withColumn("package_id", F.when(F.col("package_id").eqNullSafe(F.lit(package)), F.col("package_id")).otherwise(other))


def project_fields(kv: DataFrame, labels: DataFrame, keep_all: Column) -> DataFrame:
    """SRC-7: per page its fields, as an array; pages without any are kept where keep_all holds.

    kv: doc_id, page, key, value, role; labels: label, field."""
    l = labels.select(F.lower(F.trim("label")).alias("__k"), "field").dropDuplicates(["__k"])
    j = kv.withColumn("__k", F.lower(F.trim("key"))).join(F.broadcast(l), "__k", "left")
    fields = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value"))))
    return j.groupBy("doc_id", "page", "role").agg(fields.alias("fields")).where((F.size("fields") > 0) | keep_all)


class Store:
    """SRC-16, SRC-18: an append-only table of rows with a key and a sequence number, in parquet parts by run."""

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str = "seq", partition: str | None = None) -> None:
        self.spark, self.path, self.key, self.seq, self.partition = spark, path, key, seq, partition

    def append(self, rows: DataFrame) -> None:
        w = rows.write.mode("append")
        (w.partitionBy(self.partition) if self.partition else w).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def latest(self) -> DataFrame:
        """The last row of each key."""
        w = Window.partitionBy(self.key).orderBy(F.desc(self.seq))
        return self.read().withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Keys in order, `limit` of them from `offset` on."""
        return self.latest().orderBy(self.key).offset(offset).limit(limit)

    def next_revision(self, of: Column) -> int:
        """SNK-2: one more than the largest number so far, 1 for the first."""
        return (self.read().agg(F.max(of)).first()[0] or 0) + 1


def markdown_report(rows: DataFrame, keys: list[str], title: str) -> DataFrame:
    """SNK-1: one Markdown text a key: a heading and a line for each finding, in order of severity and id."""
    from ..functions.scoring import SEVERITY, rank

    order = F.struct((-rank(F.col("severity"), SEVERITY)).alias("s"), "finding_id", F.concat_ws(" | ", "severity", "rule_id", "summary").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat(F.lit("- "), x["line"]))
    return rows.groupBy(*keys).agg(F.concat(F.lit(f"# {title}\n"), F.array_join(lines, "\n")).alias("markdown"))
