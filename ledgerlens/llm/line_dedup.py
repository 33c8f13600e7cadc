"""Line dedup over levelled sorted runs of line hashes.

A store holds runs: tables of (key, n, last), bucketed and sorted by key, where
n documents hold the key and last is the largest of their ids. A batch is
summed by key and merge-anti-joined with all runs: keys that none of them holds
are the batch's own run, so that a key is in one run only; what the batch adds
to keys seen before is kept beside it as a tally. Once a level holds `fanout`
runs, they and their tallies are compacted into one run of the next level. The
runs' buckets and order spare the anti-joins a shuffle of them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, remove, small_batches, table_path, written
from .common import dropped as forget

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 4
_BLANKS = b" \t\n\r\x0b\x0c"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None for keys of under min_chars code points."""
    key = line.strip(_BLANKS)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()  # bytes.lower() changes A-Z alone


def line_keys(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """Per document and distinct long key: key, doc_id and the batch it comes in (by doc_id)."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, ids = [], []
            for doc, text in zip(part.column(0).to_pylist(), byte_values(part.column(1)), strict=True):
                own = {key_of(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, "key binary, doc_id long")
    return rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))


class LineRuns:
    """The levelled runs, as bucketed tables whose files are in the session's shared folder."""

    SCHEMA = "key binary, n long, last long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]  # runs, by level
        self.tallies: list[list[str]] = [[]]  # what came to keys of other runs, at the level of the batch
        self._paths: dict[str, str] = {}

    def _read(self, names: list[str]) -> DataFrame:
        """All rows of these tables, by their files: a union of bucketed scans is no bucketed scan."""
        paths = [self._paths[n] for n in names]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def _write(self, rows: DataFrame, into: list[list[str]], level: int) -> None:
        name = f"ledgerlens_lines_{uuid.uuid4().hex}"
        path = table_path(self.spark, f"lines-{level}")
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        while len(into) <= level:
            into.append([])
        into[level].append(name)
        self._paths[name] = path

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE {n}")
            remove(self.spark, self._paths.pop(n))

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def _names(self, of: list[list[str]]) -> list[str]:
        return [n for level in of for n in level]

    def all(self) -> DataFrame:
        """Every key once, over all runs and tallies."""
        return self._sum(self._read(self._names(self.levels) + self._names(self.tallies)))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines whose key stands in no run yet: a merge anti-join with each."""
        for name in self._names(self.levels):
            lines = lines.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """A batch (key, doc_id): its fresh keys become a run, what it adds to others a tally; full levels are compacted."""
        own = written(lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), "lines-batch")
        if any(self.levels):
            fresh = written(self.unseen(own), "lines-fresh")
            self._write(own.join(fresh.select("key").hint("merge"), "key", "left_anti"), self.tallies, 0)
            self._write(fresh, self.levels, 0)
            forget(fresh)
        else:
            self._write(own, self.levels, 0)
        forget(own)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            tallies = self.tallies[level] if level < len(self.tallies) else []
            keys = self._sum(self._read(runs))  # a key of another level's run stays a tally
            both = self._sum(self._read(runs + tallies)).join(keys.select("key").hint("merge"), "key", "left_semi")
            rest = self._sum(self._read(tallies)).join(keys.select("key").hint("merge"), "key", "left_anti") if tallies else None
            self._write(both, self.levels, level + 1)
            if rest is not None:
                self._write(rest, self.tallies, level + 1)
                self.tallies[level] = []
            self._drop(runs + tallies)
            level += 1

    def close(self) -> None:
        self._drop(self._names(self.levels) + self._names(self.tallies))


def dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped.

    Keys of at least min_chars code points in at least min_docs documents lose
    all their lines but those of the largest doc_id that holds them. Documents
    are rows: ids are taken to be unique, as in the SQL. A null or
    empty text is one empty line. A null doc_id is below every other. Rows that
    repeat a doc_id count as documents of their own and share its verdict.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lines = table_path(spark, "lines")
    line_keys(docs, min_chars, batches).write.partitionBy("batch").parquet(lines)
    lines = spark.read.schema("key binary, doc_id long, batch int").parquet(lines)
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("key", "doc_id"))
    common = written(runs.all().where((F.col("n") >= min_docs) & F.col("last").isNotNull()).select("key", "last"), "lines-common")
    runs.close()
    dropped = (
        lines.join(common, "key")
        .where("doc_id IS NULL OR doc_id < last")
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.collect_set("key").alias("__gone"))
    )
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    doc, text = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = inner.join(dropped, F.col(f"c{doc}").eqNullSafe(F.col("__doc")), "left").drop("__doc")

    from pyspark.sql.pandas.types import to_arrow_schema

    extra = T.StructType.fromDDL("kept_text string, n_lines bigint, n_dropped bigint")
    out = T.StructType([*inner.schema.fields, *extra.fields])
    arrow = to_arrow_schema(out)

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, n, n_gone = [], [], []
            for body, gone in zip(byte_values(part.column(text)), part.column(part.num_columns - 1).to_pylist(), strict=True):
                own = (body or b"").split(b"\n")
                drop = set(gone or ())
                kept = [x for x in own if key_of(x, min_chars) not in drop] if drop else own
                texts.append(b"\n".join(kept))
                n.append(len(own))
                n_gone.append(len(own) - len(kept))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(n_gone, pa.int64())]
            columns = [c.cast(arrow.field(part.num_columns - 1 + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], schema=arrow)

    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return rows.mapInArrow(rebuild, out).select(*own, *extra.names)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, key FROM (
    SELECT doc_id, pos, line, translate(trim(line, E' \t\n\r\x0b\x0c'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))
), common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE c.key IS NOT NULL AND l.doc_id < c.last) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.key IS NULL OR l.doc_id = c.last), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key
GROUP BY l.doc_id
"""
