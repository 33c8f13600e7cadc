"""Benchmark decontamination: one Aho-Corasick automaton over normalised
questions and answers, each text scanned once.

The automaton's alphabet is the benchmark's words, so a match's end is a word's
number, from which the place in the original text follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, byte_values, small_batches, words_of

WINDOW = 13
#: Bytes of benchmark text in one automaton, which takes about 160 times as much of each Python worker's memory;
#: a larger benchmark takes several, one after the other.
BLOCK_BYTES = 1 << 20


class Automaton:
    """Windows of benchmark items, found in sequences of words."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            n = min(window, len(words))
            for i in range(len(words) - n + 1) if n else ():
                owners.setdefault(tuple(words[i : i + n]), set()).add(item)
        self.number: dict[bytes, int] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in key)
            self.found.add_word(ids, (len(key), tuple(who)))
        if owners:
            self.found.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged runs [first, past the last] of hit words, and the items found."""
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return runs, items
        get = self.number.get
        hits = []
        for end, (n, who) in self.found.iter(tuple([get(w, 0) for w in words])):
            hits.append((end + 1 - n, end + 1))
            items.update(who)
        for a, b in sorted(hits):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return runs, items


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
def _pairs(a: str, b: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(a, T.LongType()), T.StructField(b, T.LongType())]))


_EXTRA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", _pairs("first", "past")),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("chars", _pairs("start", "end")),
])


def offsets(text: str, runs: list[list[int]]) -> list[dict[str, int]]:
    """Where runs of words stand in the original text, in characters."""
    words = [m.span() for m in re.finditer(WORD, text.translate(_LOWER))]
    return [{"start": words[a][0], "end": words[b - 1][1]} for a, b in runs]


def _scanner(items: list[tuple[str, bytes | None]], window: int, at: int, keep: list[int], schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(items, window)
        for batch in batches:
            n_words, runs, found, chars = [], [], [], []
            for text in byte_values(batch.column(at)):
                words = words_of(text)
                run, who = automaton.scan(words)
                n_words.append(len(words))
                runs.append([{"first": a, "past": b} for a, b in run])
                found.append(sorted(who))
                chars.append(offsets(text.decode(), run) if run else [])
            extra = [pa.array(x, schema.field(i + len(keep)).type) for i, x in enumerate((n_words, runs, found, chars))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *extra], schema=schema)

    return scan


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns in `keep`) with a struct column `decontam`: n_words, runs (hit words), items (ids as strings, sorted)
    and chars (the runs in the original text).

    A window is `window` consecutive item words; an item of fewer words, but
    not none, is one window. Null texts have no words. Items without an id are
    left out; rows of one id are one item. An empty benchmark finds nothing.
    Repeated documents each keep their row. Columns of any name pass through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    keep = docs.columns if keep is None else keep
    at, kept = docs.columns.index("text"), [docs.columns.index(c) for c in keep]
    out_type = T.StructType([*(inner.schema[i] for i in kept), *_EXTRA.fields])
    arrow = to_arrow_schema(out_type)
    benchmark = benchmark.where("item_id IS NOT NULL")
    parts = blocks(benchmark, block_bytes)
    own = [F.col(f"c{i}").alias(c) for i, c in zip(kept, keep, strict=True)]
    extra = F.struct(*_EXTRA.names).alias("decontam")
    if len(parts) == 1:
        return inner.mapInArrow(_scanner(parts[0](), window, at, kept, arrow), out_type).select(*own, extra)

    from .common import written

    # Beyond one automaton: each block scans the texts, and a document's runs are then merged.
    rows = written(inner.withColumn("__rid", F.monotonically_increasing_id()), "decontam-docs")
    wide = T.StructType([rows.schema["__rid"], *_EXTRA.fields])
    scans = None
    for part in parts:
        one = rows.mapInArrow(_scanner(part(), window, at, [len(docs.columns)], to_arrow_schema(wide)), wide)
        one = written(one, "decontam-block")
        scans = one if scans is None else scans.unionByName(one)
    merged = scans.groupBy("__rid").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("chars"))).alias("chars"),
    )
    merged = merged.withColumns({n: _folded(merged, n, *ab) for n, ab in (("runs", ("first", "past")), ("chars", ("start", "end")))})
    return rows.join(merged, "__rid").select(*own, extra)


def blocks(benchmark: DataFrame, most: int):
    """Makers of lists of items of about `most` bytes of text, so that each is fetched when its scan is set up."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))

    def fetch(k: int) -> list[tuple[str, bytes | None]]:
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        return [(str(r[0]), None if r[1] is None else r[1].encode()) for r in part.select("item_id", "text").collect()]

    return [lambda k=k: fetch(k) for k in range(n)]


def _folded(rows: DataFrame, name: str, a: str, b: str) -> Column:
    """A sorted array of ranges with those that overlap made one."""

    def fold(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last[a].alias(a), F.greatest(last[b], x[b]).alias(b))
        return F.when((F.size(done) > 0) & (x[a] < last[b]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(name, F.array().cast(rows.schema[name].dataType), fold)


def verdict() -> tuple:
    """n_hit and contaminated, from the column that scan() adds."""
    n_hit = F.aggregate("decontam.runs", F.lit(0).cast("long"), lambda acc, r: acc + r["past"] - r["first"])
    return n_hit, (n_hit > 0) & (20 * n_hit >= F.col("decontam.n_words"))


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_hit, contaminated = verdict()
    return scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]).select(
        "doc_id",
        F.col("decontam.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("decontam.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("decontam.items", ","), 256).alias("items_sha256"),
        contaminated.alias("contaminated"),
        F.col("decontam.chars").alias("chars"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the contaminated ones."""
    _, contaminated = verdict()
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~contaminated).select(*[F.col(f"`{c}`") for c in docs.columns])
