"""What the operators share: tables, the cluster's shared folder, vectorised word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_own_dir: str | None = None


#: Rows of an Arrow batch at most: texts are long, and a batch is held several times over on its way through a worker.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own_dir = "file://" + made
    return _own_dir


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexiloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def clear_saved(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that haven't been written are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_by_hash(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """The `most` rows of df with the smallest hashes of columns: a sample that is the same on every run.

    Of many rows only those below a bound, which about a quarter more than `most` pass, are sorted.
    """
    h = F.xxhash64(*columns)
    share = 1.25 * max(most, 1000) / max(df.count(), 1)
    if share < 0.625:
        df = df.where(h <= int(2**64 * share) - 2**63)
    return df.orderBy(h, *columns).limit(most)


# --- hashing -------------------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low and high bits all depend on every input bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + mix(np.array([seed], np.uint64))) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15
_BYTE = constants(77, 256)
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for b in (_BASE, inverse):
            full = np.full(size, b, np.uint64)
            full[0] = 1
            made.append(np.multiply.accumulate(full))
        _powers = tuple(made)
    return _powers


#: Bytes that are hashed at once; longer texts are cut between words.
PIECE = 1 << 21


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts: hash of each, and first[i]:first[i + 1] are those of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.raw = raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        starts, hashes, a = [], [], 0
        while a < len(raw):
            b = min(a + PIECE, len(raw))
            while b < len(raw) and not _WS[raw[b - 1]]:  # a piece ends with white space
                step = np.flatnonzero(_WS[raw[b : b + PIECE]])
                b += int(step[0]) + 1 if len(step) else len(raw[b : b + PIECE])
            piece = _LOWER[raw[a:b]] if lower else raw[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([True], _WS[piece])).view(np.int8)))
            start, end = edge[0::2], edge[1::2]
            power, inverse = powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * power[: len(piece)], out=total[1:])
            hashes.append(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
            starts.append(start + a)
            a = b
        self.start, self.hash = np.concatenate(starts), np.concatenate(hashes)
        offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, offset)


_SHINGLE = constants(5, 64)


def shingle_sets(texts: list[bytes], k: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of a shorter text its whole word sequence as one, of one without words none."""
    words = Words(texts, lower)
    h = words.hash
    n = max(0, len(h) - k + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(k):
        mixed += h[j : j + n] * _SHINGLE[j]
    mixed = mix(mixed)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(mixed[a : b - k + 1]))
        elif b > a:
            short = (h[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64) ^ _SHINGLE[60]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def batched(texts: list[bytes], limit: int = 1 << 19):
    """Index ranges of texts with about limit bytes in each, so that the arrays made of them stay small."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def int64s(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Groups:
    """Consecutive rows with equal keys of sorted Arrow batches, as lists of row dicts, one group in memory at a time."""

    def __init__(self, batches, key: str):
        self.batches, self.key = batches, key

    def __iter__(self):
        now, rows = None, []
        for batch in self.batches:
            for row in batch.to_pylist():
                if rows and row[self.key] != now:
                    yield now, rows
                    rows = []
                now = row[self.key]
                rows.append(row)
        if rows:
            yield now, rows


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
