"""Best-fit packing of documents into training sequences, under conflicts.

A bin holds CAPACITY tokens.  Two documents of one duplicate cluster never share a bin, and at most SAME_SOURCE documents
of one source do.  Bins stand in the order of what is left of them; every bin carries a bitmap of its clusters and one
of the sources that have reached their number.  A document goes to the tightest bin that it fits and that has no
conflict with it: the search starts at the first bin with enough room and goes on from successor to successor.  Bins with
equal room stand in groups of equal bitmaps, so that a source or cluster that is everywhere rules out a group at a time.

Sizes are words and an end mark, or the tokens of a public BPE vocabulary and an end mark; of the latter, sequences() puts
the ids of a bin together.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_batches, default_path, encode, load, unload
from .common import Groups, saved, table

CAPACITY = 2048
SAME_SOURCE = 4
#: Documents that one task packs; documents are dealt at random, so that no source or cluster makes a large share.
SHARD = 20_000
#: Bytes of encodings that a worker keeps for the sizes; less than in encoding alone, since earlier stages' memory lies beside it.
CACHE = 96 << 20

#: Documents of a shard from which on a cluster counts as one that is everywhere.
COMMON = 8


class Bins:
    """Open bins in buckets by what is left, with a bitmap of the buckets that are not empty; clusters in the bitmap common are many bins'."""

    def __init__(self, capacity: int, same_source: int, common: int = 0):
        self.capacity, self.same_source, self.common = capacity, same_source, common
        self.buckets: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.full = 0  # bit r is set if some bin has r left
        self.left: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # bitmap k: sources with more than k documents

    def _put(self, b: int) -> None:
        r = self.left[b]
        self.buckets[r].setdefault((self.clusters[b] & self.common, self.sources[b][-1]), []).append(b)
        self.full |= 1 << r

    def find(self, size: int, cluster: int, source: int) -> int | None:
        """Takes the tightest bin without a conflict out of its bucket."""
        rest = self.full >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            bucket = self.buckets[r]
            for bits, group in bucket.items():
                if bits[0] & cluster or bits[1] & source:
                    continue
                for k, b in enumerate(group):
                    if not self.clusters[b] & cluster:
                        group[k] = group[-1]
                        group.pop()
                        if not group:
                            del bucket[bits]
                            if not bucket:
                                self.full &= ~(1 << r)
                        return b
            rest >>= step + 1
            r += 1
        return None

    def place(self, size: int, cluster: int, source: int, alone: bool = False) -> tuple[int, int]:
        """The bin and the offset in it; cluster and source are bits, 0 where there can be no conflict."""
        b = None if alone else self.find(size, cluster, source)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.clusters.append(0)
            self.sources.append([0] * self.same_source)
        at = self.capacity - self.left[b]
        self.left[b] -= size
        self.clusters[b] |= cluster
        for k in range(self.same_source):
            if not self.sources[b][k] & source:
                self.sources[b][k] |= source
                break
        if self.left[b]:
            self._put(b)
        return b, at


def _pack(batches, capacity: int, same_source: int):
    for shard, rows in Groups(batches, "shard"):
        rows.sort(key=lambda r: (-(r["size"] % capacity or capacity), r["doc_id"] is not None, r["doc_id"], r["order"]))
        count = Counter(r["cluster"] for r in rows)
        clusters: dict = {c: 1 << k for k, c in enumerate(c for c, n in count.items() if n > 1)}
        bins = Bins(capacity, same_source, sum(bit for c, bit in clusters.items() if count[c] >= COMMON))
        sources: dict = {}
        out = []
        for r in rows:
            cluster = clusters.get(r["cluster"], 0)
            source = sources.setdefault(r["source"], 1 << len(sources)) if r["source"] is not None else 0
            pieces = -(-r["size"] // capacity)
            for p in range(pieces - 1):
                b, at = bins.place(capacity, 0, 0, alone=True)
                out.append((r["doc_id"], p, pieces, p * capacity, capacity, shard, b, at))
            last = r["size"] - (pieces - 1) * capacity
            b, at = bins.place(last, cluster, source)
            out.append((r["doc_id"], pieces - 1, pieces, (pieces - 1) * capacity, last, shard, b, at))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "n_pieces", "first_token", "n_tokens", "shard", "bin", "bin_offset"])


def pack(items: DataFrame, capacity: int = CAPACITY, same_source: int = SAME_SOURCE, shard: int = SHARD) -> DataFrame:
    """Packs items (doc_id, size, source, cluster); one row for each piece of a document.

    A document of more than capacity tokens is cut: its full pieces fill bins of their own and the last is packed like
    the others.  An item of size null or below 1 counts as 1.  A null source or cluster conflicts with nothing; a null
    doc_id is packed like any other, and repeated rows are packed each.  An empty table gives an empty result.
    """
    shards = max(1, -(-items.count() // shard))
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(1)), F.lit(1)).alias("size"), F.col("source").cast("string").alias("source"),
        F.when(F.col("cluster").isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("cluster").cast("string")).alias("cluster"), F.monotonically_increasing_id().alias("order"),
    )
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "order"), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard", "doc_id", "order")
    return dealt.mapInArrow(
        lambda b: _pack(b, capacity, same_source), "doc_id long, piece int, n_pieces int, first_token long, n_tokens int, shard int, bin int, bin_offset int"
    )


def _sizes(batches, path: str | None):
    for batch in batches:
        for ids, texts in byte_batches(batch):
            words = [(t.lower() if t.isascii() else t.decode(errors="replace").lower().encode()).split() for t in texts]
            size = [len(x) // 4 + 1 for x, _ in load(path).encode_all(texts, CACHE)] if path else [len(w) + 1 for w in words]
            cluster = [hashlib.blake2b(b" ".join(w), digest_size=16).hexdigest() if w else None for w in words]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(cluster, pa.string())], names=["_at", "size", "cluster"])
    if path:
        unload()


def items_of(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Items (doc_id, size, source, cluster) of docs: the words of the text, or its tokens in the vocabulary at path, and one end mark, and a digest of its words in small letters.

    So clusters are copies up to case and white space; of near copies, minhash.near_duplicates() has the clusters.
    """
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    made = docs.select(at.alias("_at"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _sizes(b, path), "_at struct<doc_id:long,source:string>, size long, cluster string")
    return made.select("_at.doc_id", "size", "_at.source", "cluster")


def packed(docs: DataFrame, path: str | None = None, clusters: DataFrame | None = None, **how) -> DataFrame:
    """The places of docs; clusters (doc_id, component_id), if given, are the duplicate clusters of the documents."""
    items = saved(items_of(docs, path), "items")  # counted and packed, but read once
    if clusters is not None:
        of = clusters.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("component_id").cast("string").alias("component"))
        items = items.join(of, "doc_id", "left").select("doc_id", "size", "source", F.coalesce("component", "cluster").alias("cluster"))
    return pack(items, **how)


def sequences(docs: DataFrame, places: DataFrame, path: str | None = None) -> DataFrame:
    """(shard, bin, doc_ids, ids): the token ids of each bin's pieces in their order, every document's last piece with the end mark.

    docs has distinct ids that aren't null, and places are those of packed() with the vocabulary at path, the default one if none is given.
    """
    path = path or default_path()
    end = load(path).special["<|endoftext|>"]
    ids = encode(docs, path).select("doc_id", F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end))).alias("ids"))
    piece = places.join(ids, "doc_id").select("shard", "bin", "bin_offset", "doc_id", F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens")).alias("ids"))
    whole = piece.groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "ids"))).alias("p"))
    return whole.select("shard", "bin", F.transform("p", lambda x: x.doc_id).alias("doc_ids"), F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit": op7_best_fit}
SQL: dict[str, str] = {}
