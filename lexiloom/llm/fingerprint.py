"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every 5-word shingle is hashed once; the upper bits choose one of BINS bins and each bin keeps its least hash.  An empty
bin takes over the value of a bin drawn by a 2-universal sequence of its own (optimal densification), the same for all
documents.  Of each value BITS low bits are packed; the likeness of two fingerprints is the share of equal bins,
corrected for values that agree by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, mix, parallelism, shingle_sets, table

BINS = 256
BITS = 8

_EDGE = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_ROUND = 64


def _draws(first: int) -> np.ndarray:
    """For each bin the bins that it tries as draws first, first + 1, ... of its sequence."""
    j = np.arange(first, first + _ROUND, dtype=np.uint64)
    b = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return (mix(mix(b + np.uint64(99)) + j) >> _SHIFT).astype(np.int64)


_tries = [_draws(0)]


def fingerprint(s: np.ndarray) -> np.ndarray | None:
    """The packed fingerprint of sorted distinct hashes; None of an empty set."""
    if not len(s):
        return None
    at = np.searchsorted(s, _EDGE)
    least = s[np.minimum(at, len(s) - 1)]
    full = (least >> _SHIFT) == (_EDGE >> _SHIFT)
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    k = 0
    while len(empty):
        if k == len(_tries):
            _tries.append(_draws(k * _ROUND))
        tries = _tries[k][empty]
        hit = full[tries]
        got = hit.any(axis=1)
        source[empty[got]] = tries[got, hit[got].argmax(axis=1)]
        empty = empty[~got]
        k += 1
    return (mix(least[source]) & np.uint64(2**BITS - 1)).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The estimated Jaccard similarity, 0 to 1: two empty sets are alike, an empty and another are not."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def packed(f: np.ndarray | None) -> str:
    return "" if f is None else f.tobytes().hex()


def unpacked(s: str) -> np.ndarray | None:
    return np.frombuffer(bytes.fromhex(s), np.uint8) if s else None


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _pairs(batches):
    """Rows sorted by part and place; each row but copies of a later part's head is returned with its successor's likeness."""
    held = None

    def told(rows):
        """All rows but the last, which waits for its successor, and those that are heads."""
        texts = [r[2] for r in rows]
        own = [r for r in range(len(rows) - 1) if not rows[r][3]]
        changed = [edited(texts[r], texts[r + 1]) for r in own]
        sets = []
        every = [t.encode() for t in texts] + [t.encode() for t in changed]
        for a, b in batched(every):
            sets += [fingerprint(s) for s in shingle_sets(every[a:b])]
        prints, new = sets[: len(texts)], sets[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[r][1] for r in own], pa.int64()),
                pa.array([len(texts[r]) for r in own], pa.int64()),
                pa.array([hashlib.sha256(every[len(texts) + k]).hexdigest() for k in range(len(own))], pa.string()),
                pa.array([packed(prints[r]) for r in own], pa.string()),
                pa.array([packed(x) for x in new], pa.string()),
                pa.array([likeness(prints[r], x) for r, x in zip(own, new)], pa.float64()),
                pa.array([likeness(prints[r], prints[r + 1]) for r in own], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    rows, size = [], 0
    for batch in batches:
        for part, doc, text, head in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "head"))):
            rows.append((part, doc, text or "", head))
            size += len(rows[-1][2])
            if size > 1 << 20:
                yield told(rows)
                rows, size = rows[-1:], len(rows[-1][2])
    if rows:
        yield told(rows)


def successors(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, doc_id, text, head): rows dealt into ranges of doc_id; each range ends with a copy (head) of the first row of the next, the last with that of the first.

    The bounds are approximate quantiles, and the heads one id for each range: their number is a parameter.
    """
    spark = docs.sparkSession
    parts = parts or min(10_000, 4 * parallelism(spark))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    cuts = docs.select(F.percentile_approx(place, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    heads = sorted((r[0], r[1]) for r in docs.select(place.alias("p")).groupBy(of("p")).agg(F.min("p")).collect())
    buckets = [b for b, _ in heads]
    before = {b: buckets[i - 1] for i, b in enumerate(buckets)}
    first = {p: before[b] for b, p in heads}

    @F.pandas_udf("array<int>")
    def dealt(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        own = np.searchsorted(cuts, x, side="right")
        return pd.Series([[int(b), first[p]] if p in first else [int(b)] for b, p in zip(own, x.tolist())])

    copies = docs.withColumn("p", place).select("doc_id", "text", F.posexplode(dealt("p")).alias("copy", "part"))
    copies = copies.withColumn("head", F.col("copy") == 1)
    return copies.repartition("part").sortWithinPartitions("part", "head", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("part", "doc_id", "text", "head")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): its fingerprint, that of its edited text, and their likeness.

    The next document is that with the next larger doc_id, after the last one the first; a null doc_id comes first, and
    rows of one doc_id follow each other by a hash of their texts.  A null text is an empty one, whose fingerprint is
    the empty string.  A single row is its own successor.  An empty table gives an empty result.  Other columns are ignored.
    """
    return successors(docs, parts).mapInArrow(
        _pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op3_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op3_one_permutation": op3_one_permutation}
SQL: dict[str, str] = {}
