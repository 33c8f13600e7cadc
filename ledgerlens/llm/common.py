"""What the operators share: durable tables, word splitting and hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- durable tables
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where it is unset and
    the master is local, as in tests, a temporary folder is made for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _OWN.get(context.applicationId) or _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="ledgerlens-"))
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder goes with the cluster's
        pass


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends if not before."""
    path = f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again.

    Cuts the lineage; a lost executor costs no recomputation, and expressions
    such as monotonically_increasing_id() keep their values from here on.
    dropped() frees the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes what written() has written for these."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with `__rid`, a number of each row that later reads of it find again.

    Rows of files have places there, whose hash it is (joins should add another
    key, such as a checksum, as hashes of many rows can meet); any other table is
    written and numbered.
    """
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__rid"))
    except AnalysisException:
        return written(docs.withColumn("__rid", F.monotonically_increasing_id()), name)


def small_batches(spark: SparkSession) -> None:
    """Keeps what a Python worker holds of its input to a few megabytes, whatever the length of texts.

    Sets the session's Arrow batch limits where it has none of its own.
    """
    for name, few in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", "4m")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, few)


# ---------------------------------------------------------------- native expressions
def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def native_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


# ---------------------------------------------------------------- bytes and numpy
def _word_table() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in keep else 32) for c in range(256))


WORD_TABLE = _word_table()


def byte_values(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """The words of one text: bytes.split() cuts at the blanks that WORD_TABLE leaves."""
    return (text or b"").translate(WORD_TABLE).split()


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes every word of many texts at once.

    A word's hash is a polynomial in its bytes, taken from prefix sums and
    moved to the word's start, so it doesn't depend on where the word stands.
    Buffers go through in pieces of about a megabyte, cut at blanks.
    """

    def __init__(self) -> None:
        self.up, self.down = _powers(_PIECE + 1)

    def _piece(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(buffer) >= len(self.up):
            self.up, self.down = _powers(len(buffer) + 1)
        inside = np.empty(len(buffer) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = buffer != 32
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.empty(len(buffer) + 1, np.uint64)
        total[0] = 0
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.up[: len(buffer)], out=total[1:])
        return start, mix((total[end] - total[start]) * self.down[start])

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All word hashes in order, and where each text's begin (one more entry than texts)."""
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        joined = b" ".join(t or b"" for t in texts).translate(WORD_TABLE)
        starts, hashes, at = [], [], 0
        while at < len(joined):
            to = len(joined)
            if to - at > _PIECE:
                cut = joined.rfind(b" ", at, at + _PIECE)
                cut = cut if cut > at else joined.find(b" ", at + _PIECE)
                to = to if cut < 0 else cut
            s, h = self._piece(np.frombuffer(joined, np.uint8, to - at, at))
            starts.append(s + at)
            hashes.append(h)
            at = to
        start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
        return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), bounds


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of fewer words, one of them all; of none, none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, k))


def groups_of_bytes(texts: list[bytes | None], most: int = 1 << 20):
    """Index ranges whose texts come to about `most` bytes, so that work space stays bounded."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
