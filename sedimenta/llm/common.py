"""Plumbing that the training-data operators share: shared-folder tables, Arrow
text buffers and vectorised word hashing over raw UTF-8 bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles, unless one document is longer.
BLOCK_BYTES = 2 << 20

_OWN_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of
    our own where that setting is absent and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: the master is {master!r}")
        if not _OWN_ROOT:
            _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="sedimenta-"))
        root = _OWN_ROOT[0]
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below :func:`shared_root`."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts
    its lineage in a way that survives the loss of any executor."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys in more than 1 / MOST_HOT of all rows and in LEAST_HOT rows are hot: at most MOST_HOT
#: keys, by definition few enough to broadcast.
MOST_HOT = 10_000
LEAST_HOT = 10_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, least: int = LEAST_HOT) -> DataFrame | None:
    """The hot ones among ``counts(keys, n)``, a written table; None where there are none."""
    seen = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.max(n), F.lit(0)).alias("most")).first()
    bound = max(least, seen["total"] // MOST_HOT)
    return counts.where(F.col(n) > bound).select(*keys) if seen["most"] > bound else None


def join_hot(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` with ``one`` (a row a key) by ``keys``; rows of hot keys stay where they are,
    as one task would get all rows of a key."""
    if hot is None:
        return rows.join(one, keys, how)
    few = F.broadcast(one.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(few, keys, "inner").unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(one, keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text buffers ---------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without copying the text.
    A null has no bytes.  Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, raw, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[first:last], offsets - first


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


# --- words as byte runs ---------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space (space, tab .. carriage return) separates.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words that ASCII other than digits and (lower-cased) letters separates.
BY_ALNUM = np.zeros(256, bool)
BY_ALNUM[48:58] = BY_ALNUM[65:91] = BY_ALNUM[97:123] = BY_ALNUM[128:] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, first) of the words; row i has words first[i]:first[i+1].
    Words never cross rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = is_word[buf]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, from one prefix sum of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_codes()[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i : i + n])
    return h


class Scratch:
    """Settled tables that a job drops as soon as later steps no longer read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        self.paths[label] = shared_dir(self.spark, label)
        df.write.parquet(self.paths[label])
        return self.spark.read.schema(df.schema).parquet(self.paths[label])

    def drop(self, *labels: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let the context cleaner find the shuffles of finished steps."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
