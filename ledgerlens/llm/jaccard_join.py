"""N-gram Jaccard join of documents along chosen paths.

Texts become sets of word shingles; equal sets are one node with a
multiplicity. In each run a set samples PATHS of its tokens, those smallest by
hashes of the run, so that similar sets tend to share samples; sets that share
one form a bucket. Small buckets are searched by brute force on sketches.
Larger ones shed what is close to a pivot and are split again and again on
sampled sketch tokens; what is still large after SPLITS levels is searched
whole, in pairs of blocks. Runs repeat until the share of joins that the last
one added says that the target recall is met. Candidate groups are at last
verified exactly, all pairs within a group in blocks, from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, byte_values, dropped, groups_of_bytes, mix, shingle_set, small_batches, written
from .graph import components, runs, spanning

K, SIMILARITY = 5, 0.8
#: Samples of a set in a run, and runs at most. Of pairs at 0.8 one run misses 0.2 ** 4, or 0.0016, two 0.000003.
PATHS, RUNS = 4, 3
#: The target. Runs are alike and independent, so if one adds a share of all joins that those before it had missed,
#: it misses no more itself, and together they miss no more than the square of that share.
RECALL = 0.998
#: Members of a bucket for brute force; texts, and their bytes, in a block of verification; bins of a sketch.
BUCKET, BLOCK, BLOCK_BYTES, BINS = 4096, 2048, 8 << 20, 64
#: Sketch similarity for a candidate, for sets of under FEW shingles, and (of sizes too) for leaving a large bucket.
CANDIDATE, CANDIDATE_FEW, FEW, CLOSE = 0.55, 0.3, 128, 0.9
#: Levels that large buckets are split, tokens sampled at each, and parts that a large bucket's pivot is sent to.
SPLITS, BRANCH, PARTS = 6, 2, 16
#: Keys broadcast at most; larger tables are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_PATH_SEEDS = mix(np.arange(1, RUNS * PATHS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def paths(tokens: np.ndarray) -> np.ndarray:
    """The first tokens of a set's paths: PATHS a run, each the smallest by a hash of its own."""
    low = None
    for i in range(0, len(tokens), 1 << 16):
        part = mix(tokens[None, i : i + (1 << 16)] ^ _PATH_SEEDS[:, None]).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return mix(low ^ _PATH_SEEDS)


def sketch(tokens: np.ndarray) -> bytes:
    """One-permutation MinHash: per bin 16 bits of its smallest token; an empty bin takes the next one's."""
    bins = (tokens >> np.uint64(58)).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))  # tokens are sorted, so a bin's first is its smallest
    full = np.zeros(BINS, bool)
    full[bins] = True
    out = np.zeros(BINS, np.uint16)
    out[full] = (mix(tokens[first[full]]) & np.uint64(0xFFFF)).astype(np.uint16)
    if not full.all():
        at = np.flatnonzero(full)
        empty = np.flatnonzero(~full)
        donor = at[np.searchsorted(at, empty) % len(at)]
        away = (donor - empty) % BINS
        out[empty] = (mix(out[donor].astype(np.uint64) * np.uint64(131) + away.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out.tobytes()


def text_key() -> Column:
    return F.xxhash64("text")


def prepare(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, h (of the text) and of its shingle set: node, size, keys and sketch; nulls for texts without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = byte_values(batch.column(2))
            node, size, keys, sketches = [], [], [], []
            for a, b in groups_of_bytes(texts):
                words, bounds = hasher(texts[a:b])
                for i in range(b - a):
                    tokens = shingle_set(words[bounds[i] : bounds[i + 1]], k)
                    size.append(len(tokens))
                    if not len(tokens):
                        node.append(None), keys.append(None), sketches.append(None)
                        continue
                    node.append(set_node(tokens))
                    keys.append(paths(tokens).view(np.int64))
                    sketches.append(sketch(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip((node, size, keys, sketches), list(schema)[2:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("h"), "text").mapInArrow(
        work, "doc_id long, h long, node long, size int, keys array<long>, sketch binary"
    )


def set_node(tokens: np.ndarray) -> int:
    """A set's name: 64 bits of a hash of all its tokens."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def alike(sketches: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows, left x right, could have Jaccard SIMILARITY, by sizes and sketches."""
    a, b = sketches[left], sketches[right]
    if len(left) * len(right) <= 64:
        same = (a[:, None, :] == b[None, :, :]).sum(-1)
    else:
        a, b, same = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.zeros((len(left), len(right)), np.uint8)
        for x, y in zip(a, b, strict=True):
            same += x[:, None] == y[None, :]
    small, large = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
    return (small >= SIMILARITY * large) & (same >= sketches.shape[1] * np.where(small < FEW, CANDIDATE_FEW, CANDIDATE))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, i, j, block, node, size, sketch, by (key, i, j): a spanning forest of the candidate pairs of blocks i and j of each bucket."""
    out: tuple[list, list] = ([], [])
    for group in runs(batches, [0, 1, 2]):
        nodes, block = group.column("node").to_numpy(), group.column("block").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(nodes), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x, y in spanning(alike(sketches, group.column("size").to_numpy(), left, right)):
            x, y = nodes[left[x]], nodes[right[y]]
            if x != y:
                out[0].append(x), out[1].append(y)
        if len(out[0]) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
            out = ([], [])
    yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def _search(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges of all candidate pairs of buckets (key, node, n): one block for those of up to BUCKET members, else pairs of blocks of about BUCKET."""
    placed = buckets.select("key", "node", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = in_pairs(placed.join(sets.select("node", "size", "sketch"), "node"), "key", ["node", "size", "sketch"])
    return written(spread.mapInArrow(_searched, "a long, b long"), "bucket-edges")


def in_pairs(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """rows, in `block` of so many `blocks` of their group, once for each pair of blocks i <= j that theirs is in, and neighbours by it."""
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p")
    spread = rows.select(group, "block", partner, *columns)
    by = [group, "i", "j"]
    spread = spread.select(group, F.least("block", "p").alias("i"), F.greatest("block", "p").alias("j"), "block", *columns)
    return spread.repartition(*by).sortWithinPartitions(*by)


def _pivoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large buckets with their pivot: edges to it, and for those not close to it the keys to split on.

    A member without an edge always stays. One that leaves is CLOSE to the pivot
    in size too, so a partner of it has SIMILARITY * CLOSE of the pivot's size
    or more, and of its likeness to it; edges reach as far, so that no partner is left behind without one.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        pivot = np.frombuffer(b"".join(batch.column("pivot_sketch").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        size, pivot_size = batch.column("size").to_numpy(), batch.column("pivot_size").to_numpy()
        est = (own == pivot).mean(1)
        small, large = np.minimum(size, pivot_size), np.maximum(size, pivot_size)
        edge = (small + 1 >= SIMILARITY * CLOSE * large) & (est >= CLOSE * np.where(small < FEW, CANDIDATE_FEW, CANDIDATE))
        stay = ~edge | (est < CLOSE) | (small < CLOSE * large)
        key = batch.column("key").to_numpy().view(np.uint64)
        keys = np.empty((BRANCH, len(key)), np.uint64)
        for i in range(BRANCH):  # the same bins, no two alike, are sampled for all members of a bucket
            at = ((mix(key) + np.uint64(i * (own.shape[1] // BRANCH))) % np.uint64(own.shape[1])).astype(np.int64)
            keys[i] = mix(key * np.uint64(5) + (at.astype(np.uint64) << np.uint64(16)) + own[np.arange(len(own)), at])
        nexts = [x if s else [] for x, s in zip(keys.T.view(np.int64).tolist(), stay, strict=True)]
        yield pa.RecordBatch.from_pydict({
            "node": batch.column("node"), "a": pa.array(np.where(edge, batch.column("pivot").to_numpy(), batch.column("node").to_numpy())),
            "keys": pa.array(nexts, pa.list_(pa.int64())),
        })


def _split(large: DataFrame, sets: DataFrame) -> DataFrame:
    """node (as b, too), a (the pivot where there is an edge to it, else the node) and keys, for members (key, node, pivot) of large buckets.

    A pivot goes to PARTS parts of its bucket, so that no task holds a bucket.
    """
    pivots = sets.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size"), F.col("sketch").alias("pivot_sketch"))
    pivots = large.select("pivot").distinct().join(pivots, "pivot").withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    dealt = large.join(sets.select("node", "size", "sketch"), "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    tried = dealt.join(pivots, ["pivot", "part"]).select("key", "node", "size", "sketch", "pivot", "pivot_size", "pivot_sketch")
    return written(tried.mapInArrow(_pivoted, "node long, a long, keys array<long>").withColumn("b", F.col("node")), "pivoted")


def bucket_edges(members: DataFrame, sets: DataFrame, joined: DataFrame | None) -> list[DataFrame]:
    """Tables of edges (a, b) whose components, with those in `joined`, hold every candidate pair of buckets (key, node).

    Buckets of the same members are one, and a bucket whose members are all in
    one component already adds nothing. Those of up to BUCKET members are
    searched by brute force, larger ones compared with their pivot and split.
    """
    found: list[DataFrame] = []
    for level in range(SPLITS + 1):
        often = written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
        held = members.join(often, "key")
        held = held.withColumn("component", F.col("node")) if joined is None else (
            held.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        )
        sized = held.groupBy("key", "n").agg(
            F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")
        ).where("low <> high")
        one = sized.groupBy("n", "who", "pivot").agg(F.min("key").alias("key"))
        kept = written(members.join(one.select("key", "n", "pivot"), "key"), "buckets")
        dropped(often)
        last = level == SPLITS
        found.append(_search(kept if last else kept.where(F.col("n") <= BUCKET), sets))
        large = kept.where(F.col("n") > BUCKET)
        if last or large.isEmpty():
            dropped(kept)
            return found
        found.append(_split(large, sets))
        dropped(kept)
        members = found[-1].select("node", F.explode("keys").alias("key"))
    return found


def candidate_groups(sets: DataFrame, per_run: int, most_runs: int) -> DataFrame:
    """node and component of candidate groups, which hold every pair that the paths brought together. sets: node, size, keys, sketch.

    A run takes `per_run` of the keys. From the second run on, the share of all
    joins of components that it has added is what the runs before it had
    missed; runs end once its square is within RECALL, or after most_runs.
    """
    joined, before = None, 0
    for run in range(most_runs):
        members = sets.select("node", F.explode(F.slice("keys", run * per_run + 1, per_run)).alias("key"))
        found = bucket_edges(members, sets, joined)
        edges = _union([x.select("a", "b") for x in found]).where("a <> b")
        after = components(edges if joined is None else edges.unionByName(joined.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        dropped(*found, *([joined] if joined is not None else []))
        joined = after
        merged = joined.where("node <> component").count()
        if run and (merged - before) ** 2 <= (1 - RECALL) * merged**2:
            break
        before = merged
    return joined


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """component, i, j, block, node, copies, text, by (component, i, j): links of each node, and a spanning forest of them."""
    hasher = WordHasher()
    for group in runs(batches, [0, 1, 2]):
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        words, bounds = hasher(byte_values(group.column("text").combine_chunks()))
        sets = [shingle_set(words[bounds[x] : bounds[x + 1]], K) for x in range(len(node))]
        left, right = (np.arange(len(node)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        near = linked(sets, left, right)
        edges = [(left[x], right[y]) for x, y in spanning(near)]
        if i == j:
            np.fill_diagonal(near, False)
        links, others = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        links[left], others[left] = near @ copies[right], near.sum(axis=1)
        if i != j:
            links[right], others[right] = copies[left] @ near, near.sum(axis=0)
        a, b = ([node[e[k]] for e in edges if e[0] != e[1]] for k in range(2))
        yield pa.RecordBatch.from_pydict({
            "node": pa.array([*node, *a], pa.int64()), "other": pa.array([*[None] * len(node), *b], pa.int64()),
            "links": pa.array([*links.tolist(), *[0] * len(a)], pa.int64()), "texts": pa.array([*others.tolist(), *[0] * len(a)], pa.int64()),
        })


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs, left x right, have Jaccard of SIMILARITY at least, exactly; a set has it with itself."""
    sizes = np.asarray([len(s) for s in sets], np.int64)
    both = np.zeros((len(left), len(right)), np.float32)
    if both.size <= 16:
        for x, a in enumerate(left):
            for y, b in enumerate(right):
                if min(sizes[a], sizes[b]) >= SIMILARITY * max(sizes[a], sizes[b]):
                    both[x, y] = sizes[a] if a == b else len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        joined, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        often = np.bincount(at) > 1  # tokens of one set alone add to no intersection but its own
        column = np.cumsum(often) - 1
        keep = often[at]
        at, owner = column[at[keep]], owner[keep]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        n, step = int(often.sum()), max(1, (4 << 20) // max(1, len(sets)))
        for a in range(0, n, step):
            part = slice(np.searchsorted(at, a), np.searchsorted(at, a + step))
            dense = np.zeros((len(sets), min(step, n - a)), np.float32)
            dense[owner[part], at[part] - a] = 1
            both += dense[left] @ dense[right].T
    both = np.where(left[:, None] == right[None, :], sizes[left][:, None], np.rint(both).astype(np.int64))
    return 5 * both >= 4 * (sizes[left][:, None] + sizes[right][None, :] - both)


def rows_with(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs whose (doc_id, hash of text) stand in keys (__doc, __h): a broadcast while they are few, else a shuffle."""
    small = keys.count() * 32 <= BROADCAST_BYTES
    keys = F.broadcast(keys) if small else keys
    return docs.join(keys, (text_key() == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__doc")), how)


def join(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, h, class_id, n_links, n_text_links and node.

    Two documents are linked if the Jaccard similarity of their sets of K-word
    shingles is SIMILARITY or more; texts of fewer words are one shingle, texts
    without words (null ones included) have no links. Classes are the
    components of links; class_id is the smallest doc_id in one (null only if
    all are). n_links counts the other documents linked, copies each;
    n_text_links the other sets. Copies (equal sets) are never expanded into
    pairs. Repeated rows are copies of each other. An empty table gives no rows.
    Two runs find a linked pair with a chance of about 0.99999 at 0.8 and more
    above; within a candidate group every pair is compared exactly.
    """
    small_batches(docs.sparkSession)
    rows = written(prepare(docs.select("doc_id", "text")), "shingled")
    sets = written(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "h")).alias("first"),
            *[F.first(c).alias(c) for c in ("size", "keys", "sketch")],
        ),
        "sets",
    )
    groups = candidate_groups(sets, PATHS, RUNS)
    grouped = written(sets.select("node", "copies", "first").join(groups, "node"), "grouped")
    dropped(groups)
    texts = docs.select("doc_id", "text")
    wanted = grouped.select(F.col("first.doc_id").alias("__doc"), F.col("first.h").alias("__h"), "component", "node", "copies")
    texts = rows_with(texts, wanted, "inner")
    if repeated(rows):
        texts = texts.dropDuplicates(["node"])
    checked = verified(written(texts.select("component", "node", "copies", "text"), "texts-to-verify"))
    dropped(grouped)

    classes = components(checked.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = checked.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    per = sets.select("node", "copies", "doc").join(counts, "node", "left").join(classes, "node", "left")
    per = per.withColumn("component", F.coalesce("component", "node"))
    lowest = per.groupBy("component").agg(F.min("doc").alias("class_id"))
    per = written(per.join(lowest, "component").select("node", "class_id", "copies", "links", "texts"), "classes")
    dropped(sets, checked, classes)
    return rows.select("doc_id", "h", "node").join(per, "node", "left").select(
        "doc_id", "h", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), "node",
    )


def verified(texts: DataFrame) -> DataFrame:
    """Exact links within candidate groups, for a written table (component, node, copies, text), which is dropped.

    node, other, links and texts: with other null, how many documents and other
    sets a node links to (a row for each pair of blocks), else an edge of a
    forest that spans the links. A group's blocks hold about BLOCK texts and
    BLOCK_BYTES, so what a task holds is bounded however large the group.
    """
    sizes = texts.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = texts.join(sizes.select("component", blocks.alias("blocks")), "component")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = in_pairs(placed, "component", ["node", "copies", "text"])
    out = written(spread.mapInArrow(_verify, "node long, other long, links long, texts long"), "verified")
    dropped(texts)
    return out


def repeated(rows: DataFrame) -> bool:
    """Whether any (doc_id, text) stands in more than one row."""
    return rows.groupBy("doc_id", "h").count().where("count > 1").limit(1).count() > 0


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_text_links")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, that of the smallest doc_id; texts without words stay."""
    found = written(join(docs), "classes-of-documents")
    one = found.where("node IS NOT NULL").groupBy("class_id").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.struct("doc_id", "h"))).alias("stays"))
    marked = found.where("node IS NOT NULL").join(one, found["class_id"].eqNullSafe(one["class_id"]))
    gone = marked.where(~F.struct("doc_id", "h").eqNullSafe(F.col("stays"))).select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h")).distinct()
    kept = rows_with(docs, written(gone, "not-first"), "left_anti")
    if not repeated(found.where("node IS NOT NULL")):
        return kept
    again = written(found.where("node IS NOT NULL").groupBy(F.col("doc_id").alias("__doc"), F.col("h").alias("__h")).count().where("count > 1").drop("count"), "repeated")
    twice = rows_with(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return rows_with(kept, again, "left_anti").unionByName(twice)
