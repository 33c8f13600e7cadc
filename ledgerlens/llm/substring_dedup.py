"""Substring dedup: paragraph MinHash banding.

A paragraph is a line of MIN_WORDS words or more. Equal shingle sets are one
node; nodes whose MinHash bands collide are joined, verified by the exact
Jaccard similarity of their shingles, and clustered by components; all but the
first paragraph of a cluster are to be removed.

A passage that stands inside otherwise different paragraphs moves their
similarity too little for any banding. So documents of LONG words and more
also give anchored passages: runs of PASSAGE words that start at minima of a
hash over WINDOW places of the whole word sequence, whatever the lines. Two
documents that share LONG consecutive words share an anchored passage, and
equal ones are a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, byte_values, dropped, groups_of_bytes, mix, small_batches, written
from .graph import components
from .jaccard_join import candidate_groups, repeated, rows_with, set_node, text_key, verified

K, SIMILARITY = 5, 0.8
MIN_WORDS, MIN_DOCS = 25, 2
#: Of paragraphs at 0.8, 7 bands of 2 miss (1 - 0.8 ** 2) ** 7, or 0.0008. VALUES serve to estimate likeness.
BANDS, ROWS, VALUES = 7, 2, 32
LONG, PASSAGE = 50, 20
WINDOW = LONG - PASSAGE + 1


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on (of what is left, near the end)."""
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out[: len(words) - j] += words[j:]
    return mix(out + np.uint64(k))


_SEEDS = [(mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)), mix(np.arange(1001, VALUES + 1001, dtype=np.uint64))]


def signatures(tokens: list[np.ndarray]) -> list[bytes]:
    """VALUES MinHash values of each set of tokens, 16 bits each."""
    out, at = [], 0
    while at < len(tokens):
        to, n = at, 0
        while to < len(tokens) and (to == at or n + len(tokens[to]) <= 1 << 16):
            n, to = n + len(tokens[to]), to + 1
        flat = np.concatenate(tokens[at:to])
        begins = np.concatenate([[0], np.cumsum([len(t) for t in tokens[at : to - 1]], dtype=np.int64)])
        low = np.stack([np.minimum.reduceat(flat * a + b, begins) for a, b in zip(*_SEEDS, strict=True)], axis=1)
        out += [x.tobytes() for x in (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)]
        at = to
    return out


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash in every run of `window` places."""
    at = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1)
    return np.unique(at + np.arange(len(at)))


def line_pieces(place: int, end: int, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """line, first word in it and number of words for each line that the words from `place` to `end` touch.

    starts: where each line's words begin, and the end, counted from the document's first word.
    """
    out, n = [], int(np.searchsorted(starts, place, side="right")) - 1
    while place < end:
        to = min(end, int(starts[n + 1]))
        if to > place:
            out.append((n, place - int(starts[n]), to - place))
        place, n = to, n + 1
    return out


_OUT = "doc_id long, h long, starts array<int>, places array<int>, anchors array<long>, paragraphs array<struct<line: int, n_words: int, node: long, size: int, sketch: binary>>"


def prepare(docs: DataFrame) -> DataFrame:
    """A row a document, see _OUT: where its lines start, its anchored passages, and its paragraphs with size and sketch."""
    paragraph = pa.struct([("line", pa.int32()), ("n_words", pa.int32()), ("node", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(paragraph)]
    names = ["doc_id", "h", "starts", "places", "anchors", "paragraphs"]

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else []
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind.value_type))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = byte_values(batch.column(2))
            for a, b in groups_of_bytes(texts):
                split = [(t or b"").split(b"\n") for t in texts[a:b]]
                words, bounds = hasher([x for own in split for x in own])
                short, long = grams(words, K), grams(words, PASSAGE)
                starts, places, found, per, tokens, lines, at = [], [], [], [], [], [], 0
                for own in split:
                    begins = bounds[at : at + 1 + len(own)]
                    first, last = int(begins[0]), int(begins[-1])
                    starts.append((begins - first).astype(np.int32))
                    places.append(anchors(long[first : last - PASSAGE + 1], WINDOW).astype(np.int32) if last - first >= LONG else np.empty(0, np.int32))
                    found.append(long[first + places[-1]].view(np.int64))
                    full = np.flatnonzero(np.diff(begins) >= MIN_WORDS)
                    per.append(len(full))
                    for n in full.tolist():
                        tokens.append(np.unique(short[begins[n] : begins[n + 1] - K + 1]))
                        lines.append((n, int(begins[n + 1] - begins[n])))
                    at += len(own)
                held = [
                    {"line": n, "n_words": m, "node": set_node(t), "size": len(t), "sketch": s}
                    for (n, m), t, s in zip(lines, tokens, signatures(tokens), strict=True)
                ]
                offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
                columns = [lists(x, k) for x, k in zip((starts, places, found), kinds[2:5], strict=True)]
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(held, paragraph)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("h"), "text").mapInArrow(work, _OUT)


def _paragraphs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, h, line, component, node, copies) with the paragraph's text."""
    per = wanted.groupBy(F.col("doc_id").alias("__doc"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("line", "component", "node", "copies")).alias("lines"))
    per = written(per, "paragraphs-wanted")
    found = rows_with(docs.select("doc_id", "text"), per, "inner").select("text", "lines")
    names = ["component", "node", "copies"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for text, lines in zip(byte_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                split = text.split(b"\n")
                for x in lines:
                    rows.append(x)
                    texts.append(split[x["line"]])
            arrays = [pa.array([r[n] for r in rows], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "text"])

    cut_out = found.mapInArrow(cut, "component long, node long, copies long, text string")
    out = written(cut_out.dropDuplicates(["node"]), "paragraphs-to-verify")  # rows that repeat a document bring its paragraphs again
    dropped(per)
    return out


def clusters(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """node and class: components of paragraphs of SIMILARITY, nodes that link to none left out."""
    sets = paragraphs.groupBy("node").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "line")).alias("at"), F.first("size").alias("size"), F.first("sketch").alias("sketch")
    )
    sets = written(sets, "paragraph-sets")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    groups = candidate_groups(sets.select("node", "size", "sketch", bands.alias("keys")), BANDS, 1)
    checked = verified(_paragraphs(docs, sets.select("node", "copies", "at.*").join(groups, "node")))
    dropped(sets, groups)
    out = components(checked.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("component", "class")
    dropped(checked)
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, starts, places, anchors and found (node, first, n, stays): the union of its shared passages, cut at line ends."""
    for batch in batches:
        rows = []
        for doc, starts, places, nodes, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            of = {x["node"]: x for x in found}
            runs: dict[bool, list] = {True: [], False: []}
            for place, node in zip(places, nodes, strict=True):
                if (x := of.get(node)) is None:
                    continue
                held, first = runs[x["stays"]], (x["first"] is not None, x["first"] or 0)
                if held and place <= held[-1][1]:
                    held[-1] = (held[-1][0], place + PASSAGE, min(first, held[-1][2]), max(x["n"], held[-1][3]))
                else:
                    held.append((place, place + PASSAGE, first, x["n"]))
            starts = np.asarray(starts)
            for stays, held in runs.items():
                for place, end, (known, first), n in held:
                    rows += [(doc, *piece, first if known else None, n, not stays) for piece in line_pieces(place, end, starts)]
        names = ["doc_id", "line", "first_word", "n_words", "class_id", "n_docs", "removed"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def repeats(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each repeated span: doc_id, kind, line, first_word, n_words, class_id, n_docs and removed.

    kind "paragraph": a whole line of MIN_WORDS words or more whose cluster
    reaches over min_docs documents or more; "passage": what the union of
    touching anchored passages covers of one line; a passage that runs over
    line breaks has a row in each line. Lines and words count from 0. class_id
    is the doc_id whose copy stays (the smallest; of equal ids the first line),
    and removed is false for that copy alone. Null and empty texts have no
    spans, documents of under LONG words no passages. Rows that repeat doc_id and text are one
    document; a null doc_id is below every other. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = written(prepare(docs), "pieces")
    if repeated(rows):
        once = written(rows.dropDuplicates(["doc_id", "h"]), "pieces")
        dropped(rows)
        rows = once
    paragraphs = rows.select("doc_id", "h", F.explode("paragraphs").alias("p")).select("doc_id", "h", "p.*")
    found = clusters(docs, paragraphs)
    named = paragraphs.select("doc_id", "h", "line", "n_words", "node").join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    who = F.xxhash64("doc_id", "h")
    shared = named.groupBy("class").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low <> high")  # in two documents at least
    named = written(named.drop("node").join(shared.select("class"), "class"), "paragraphs-shared")
    per = named.groupBy("class").agg(F.count_distinct(who).alias("n_docs"), F.min(F.struct("doc_id", "h", "line")).alias("first"))
    whole = named.join(per.where(F.col("n_docs") >= min_docs), "class").select(
        "doc_id", F.lit("paragraph").alias("kind"), "line", F.lit(0).alias("first_word"), "n_words", F.col("first.doc_id").alias("class_id"), "n_docs",
        (~F.struct("doc_id", "h", "line").eqNullSafe(F.col("first"))).alias("removed"),
    )

    # A document holds each of its passages once here, so that passages are counted by documents.
    each = rows.select("doc_id", "h", F.explode(F.array_distinct("anchors")).alias("node"))
    often = written(each.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, min_docs)), "passages-often")
    passages = written(each.join(often, "node"), "passages-shared")
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first = passages.groupBy("node").agg(F.min_by("doc_id", order).alias("first"), F.min_by("h", order).alias("first_h"))
    marked = passages.join(first, "node").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")))
    per = marked.groupBy("doc_id", "h").agg(F.collect_list(F.struct("node", "first", "n", "stays")).alias("found"))
    mine = per.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "found")
    held = rows.join(mine, (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "starts", "places", "anchors", "found")
    part = held.mapInArrow(_spans, "doc_id long, line int, first_word int, n_words int, class_id long, n_docs long, removed boolean")
    return whole.unionByName(part.withColumn("kind", F.lit("passage")))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
