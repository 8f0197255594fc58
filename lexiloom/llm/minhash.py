"""Near-duplicate documents: a chosen-path set similarity join over word shingles.

Each document's shingle set is reduced to POSITIONS minhash values.  A tree of the join starts with all documents; at a
node it selects 1 / threshold positions on average, one at least and none twice, and a document goes on to one child for
each selected position: that of its minhash value there.  Two documents stay together with a probability that depends on
their similarity alone, so TREES independent trees reach the recall wanted (missed()).  A node of at most LEAF documents is
compared exhaustively (by sketches of a byte for each position, with a bound that a true link passes); larger ones branch on.  A large node whose
documents are mostly alike would not shrink: it is one candidate block at once, as is what is still large after DEPTH levels.

Beyond the first level a node whose documents are all partners of one document there is dropped before anything is
compared: they stand in one block, and a block's pairs are compared anyway.  Two levels are branched at a time from there on.

Blocks hold every candidate link and are solved on the full shingle sets.  A block of over MEMBERS documents is dealt into
parts; each is solved with the same few pivots of the block, which join the parts' stars.  Only documents outside a
block's largest star visit the other parts afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Groups, batched, constants, int64s, mix, saved, shingle_sets, table, utf8
from .components import connected_components

POSITIONS = 64
TREES = 14
LEAF = 128
#: Levels, and those that large nodes branch at a time beyond the first.
DEPTH = 5
STEP = 2
#: Documents and shingles of a part of a block, about.
MEMBERS = 200
BLOCK = 2_000_000
#: Documents of a block that are solved with each of its parts.
PIVOTS = 4

_MUL = constants(11, POSITIONS)
_SET = constants(12, 2)
_POSITION = np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xD1B54A32D192ED03)


def missed(similarity: float, threshold: float, depth: int, trees: int = TREES) -> float:
    """The probability that no tree brings a pair of the given similarity together in a node of the given depth.

    The pair agrees at a binomial number of the positions, which all trees share; a node selects few or one more of them.
    """
    few = math.floor(1 / threshold)
    more = 1 / threshold - few
    total = 0.0
    for equal in range(POSITIONS + 1):
        s = equal / POSITIONS
        apart = 0.0
        for _ in range(depth):
            step = 1 - s + s * apart
            apart = (1 - more) * step**few + more * step ** (few + 1)
        total += math.comb(POSITIONS, equal) * similarity**equal * (1 - similarity) ** (POSITIONS - equal) * apart**trees
    return total


def signature(s: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of s under POSITIONS hash functions."""
    least = np.full(POSITIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 4096):
        np.minimum(least, (s[a : a + 4096, None] * _MUL).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketches(batches, k):
    for batch in batches:
        texts = utf8(batch.column(1))
        n, h1, h2, sig, low = [], [], [], [], []
        for a, b in batched(texts):
            for s in shingle_sets(texts[a:b], k):
                n.append(len(s))
                h1.append(mix(s ^ _SET[0]).sum(dtype=np.uint64))
                h2.append(mix(s ^ _SET[1]).sum(dtype=np.uint64))
                made = signature(s)
                sig.append(made.tobytes())
                low.append(low_bytes(made).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(int64s(np.array(h1, np.uint64))), pa.array(int64s(np.array(h2, np.uint64))), pa.array(sig, pa.binary()), pa.array(low, pa.binary())],
            names=["doc_id", "n", "h1", "h2", "sig", "low"],
        )


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _sketches(b, k), "doc_id long, n long, h1 long, h2 long, sig binary, low binary"
    )


def _selected(keys: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, its hash) of the positions that the nodes with these keys select."""
    few = min(math.floor(1 / threshold), POSITIONS)
    chance = mix(keys[:, None] + _POSITION)
    least = np.argsort(chance, axis=1)[:, : few + 1]
    more = mix(keys ^ _MORE) < np.uint64(int((1 / threshold - few) * 2**63) << 1)
    taken = np.ones(least.shape, bool)
    taken[:, few:] &= more[:, None]
    row, at = np.nonzero(taken)
    position = least[row, at]
    return row, position, chance[row, position]


def _branch(batches, threshold, trees, steps=1):
    """Rows (key, id, block, sig) to their descendants after so many steps; with trees, rows (id, sig) to the children of the roots of all trees."""
    roots = mix(constants(13, trees)) if trees else None
    for whole in batches:
        for a in range(0, whole.num_rows, 2000):
            batch = whole.slice(a, 2000)
            ids = np.asarray(batch.column("id"))
            blocks = ids if trees else np.asarray(batch.column("block"))
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, POSITIONS)
            if trees:
                _, position, chance = _selected(roots, threshold)
                of = np.tile(np.arange(len(ids)), len(position))
                key = mix(np.repeat(chance, len(ids)) ^ mix(sigs[of, np.repeat(position, len(ids))].astype(np.uint64)))
            else:
                of, key = np.arange(len(ids)), np.asarray(batch.column("key")).view(np.uint64)
                for _ in range(steps):
                    row, position, chance = _selected(key, threshold)
                    of = of[row]
                    key = mix(chance ^ mix(sigs[of, position].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(int64s(key)), pa.array(ids[of]), pa.array(blocks[of])], names=["key", "id", "block"])


def _least_sketch(threshold: float) -> float:
    """The share of equal sketch bytes that a pair at the threshold falls short of once in 10**7."""
    return threshold - 5.2 * (threshold * (1 - threshold) / POSITIONS) ** 0.5


class Forest:
    """Components of 0 .. n - 1; root[i] is the least member of i's."""

    def __init__(self, n):
        self.root = np.arange(n)

    def join(self, x, y):
        x, y = self.root[x], self.root[y]
        if x != y:
            self.root[self.root == max(x, y)] = min(x, y)


def low_bytes(sig: np.ndarray) -> np.ndarray:
    """The sketch that is compared: a byte of each minhash value."""
    return (sig & np.uint32(255)).astype(np.uint8)


def _stacked(lows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(lows), np.uint8).reshape(-1, POSITIONS)


def _leaves(batches, threshold):
    """Each node's spanning forest of the pairs whose sketches and sizes permit a link."""
    least = _least_sketch(threshold)
    for _, rows in Groups(batches, "key"):
        if len(rows) < 2:
            continue
        ids = [r["id"] for r in rows]
        n = np.array([r["n"] for r in rows])
        low = _stacked([r["low"] for r in rows])
        forest = Forest(len(rows))
        _, first, of = np.unique([r["block"] for r in rows], return_index=True, return_inverse=True)
        forest.root = first[of]  # what stands in one block is compared there
        for i in range(len(rows) - 1):
            other = i + 1 + np.flatnonzero(forest.root[i + 1 :] != forest.root[i])
            fits = np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i]) - 1e-9
            for j in other[((low[other] == low[i]).mean(axis=1) >= least) & fits]:
                forest.join(i, int(j))
        pairs = [(ids[forest.root[i]], ids[i]) for i in range(len(rows)) if forest.root[i] != first[of[i]]]
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _alike(batches, threshold):
    """Whether the sketch and the size of each document of a node permit a link with the node's pivot."""
    least = _least_sketch(threshold)
    for batch in batches:
        own, pivot = _stacked(batch.column("low").to_pylist()), _stacked(batch.column("pivot_low").to_pylist())
        n, m = (np.asarray(batch.column(c)) for c in ("n", "pivot_n"))
        fits = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
        like = ((own == pivot).mean(axis=1) >= least) & fits
        kept = ("key", "id", "block", "pivot")
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(like.astype(np.float64))], names=[*kept, "alike"])


def _solve(batches, k, percent):
    """Links within each part on the full sets, as a star for each component; what is joined already isn't compared again.

    Rows with a star are joined if their stars are equal.  Visitors (side 1) are compared with the part's own documents only.
    """
    least = _least_sketch(percent / 100)
    for _, rows in Groups(batches, "part"):
        ids, side, texts = np.array([r["id"] for r in rows]), np.array([r["side"] for r in rows]), [(r["text"] or "").encode() for r in rows]
        star = [r["star"] for r in rows]
        sets = [s for a, b in batched(texts) for s in shingle_sets(texts[a:b], k)]
        del texts, rows
        size = np.array([len(s) for s in sets])
        low = np.array([low_bytes(signature(s)) for s in sets])
        forest = Forest(len(ids))
        for same in (ids.tolist(), star):  # a document of several texts is one
            seen: dict = {}
            for i, x in enumerate(same):
                if x is not None and seen.setdefault(x, i) != i:
                    forest.join(seen[x], i)
        for i in range(len(ids) - 1):
            if not size[i]:
                continue
            other = i + 1 + np.flatnonzero((forest.root[i + 1 :] != forest.root[i]) & ((side[i] == 0) | (side[i + 1 :] == 0)))
            fits = 100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])
            for j in other[((low[other] == low[i]).mean(axis=1) >= least) & fits]:
                if forest.root[i] != forest.root[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        forest.join(i, int(j))
        least_id = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least_id, forest.root, ids)
        yield pa.RecordBatch.from_arrays([pa.array(least_id[forest.root]), pa.array(ids)], names=["a", "b"])


def candidate_blocks(reps: DataFrame, threshold: float, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(id, root): blocks of documents that hold every pair the trees bring together; reps has id, n, sig and low."""
    path = "key long, id long, block long"
    links: list[DataFrame] = []
    rows = saved(reps.select("id", "sig").mapInArrow(lambda b: _branch(b, threshold, trees), path), "paths")
    level = 1
    while True:
        # Written first, so that the join has plain exchanges on both sides and a hot key's rows can be split.
        count = rows.groupBy("key").agg(F.count("*").alias("count"), F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("key", "count")
        live = saved(rows.join(saved(count, "counts"), "key").join(reps.select("id", "n", "low"), "id").select("key", "count", "id", "block", "n", "low"), "nodes")
        small = live.where(F.col("count") <= leaf).select("key", "id", "block", "n", "low").repartition("key").sortWithinPartitions("key", "id")
        found = small.mapInArrow(lambda b: _leaves(b, threshold), "a long, b long")
        large = live.where(F.col("count") > leaf)
        some = bool(large.take(1))
        if some:
            pivot = large.groupBy("key").agg(F.min(F.struct("id", "n", "low")).alias("p")).select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.low").alias("pivot_low"))
            tested = large.join(saved(pivot, "pivots"), "key").mapInArrow(lambda b: _alike(b, threshold), "key long, id long, block long, pivot long, alike double")
            tested = saved(tested, "tested")
            dense = tested.groupBy("key").agg((F.avg("alike") >= (0.0 if level >= depth else 0.5)).alias("dense"))
            tested = tested.join(saved(dense, "dense"), "key")
            found = found.union(tested.where("dense and pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        links.append(saved(found.distinct(), "links"))
        if not some or level >= depth:
            return connected_components(_union(links))
        rest = tested.where("not dense").select("key", "id", "block")
        if level == 1:  # a document's least partner so far: those with the same one stand in one block
            least = links[0].groupBy(F.col("b").alias("id")).agg(F.min("a").alias("least"))
            rest = rest.join(saved(least, "partners"), "id", "left").select("key", "id", F.least("id", "least").alias("block"))
        rows = saved(rest.join(reps.select("id", "sig"), "id").mapInArrow(lambda b: _branch(b, threshold, 0, STEP), path), "paths")
        level += STEP


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _solved(blocks: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int, k: int, members: int, block: int) -> tuple[DataFrame, bool]:
    """Links (a, b) of the blocks (id, root), confirmed on the full sets, as stars; and whether stars may share a document.

    sizes has id and n, texts id and text.  A large block's documents are dealt into parts at random, and each part is
    solved with the block's pivots.  Documents that aren't in the block's largest star then visit, in groups of a part's size,
    every part; so the work beyond one pass grows with what the pivots didn't join.
    """

    def solve(dealt: DataFrame) -> DataFrame:
        work = texts.join(dealt, "id").select("part", "side", "star", "id", "text").repartition("part").sortWithinPartitions("part", "side", "id")
        return saved(work.mapInArrow(lambda b: _solve(b, k, percent), "a long, b long"), "stars")

    sized = saved(blocks.join(sizes, "id").groupBy("id", "root").agg(F.sum("n").alias("n")), "sized")
    parts = sized.groupBy("root").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / block)).cast("int").alias("parts"))
    # Written first, so that the join has plain exchanges on both sides and a large block's rows can be split.
    member = saved(sized.select("id", "root").join(saved(parts, "parts"), "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "blocks")
    none = F.lit(None).cast("long").alias("star")
    large = member.where("parts > 1")
    place = F.struct(F.xxhash64(F.lit(1), "id").alias("h"), "id")
    low = F.xxhash64(F.lit(1), "id").cast("double") / 2.0**64 + 0.5 < 8 * PIVOTS / F.col("size")
    pick = large.where(low).groupBy("root", "parts").agg(F.array_sort(F.collect_list(place)).alias("few"))
    pivots = pick.select("root", "parts", F.explode(F.slice("few", 1, PIVOTS)).alias("p")).select(F.col("p.id").alias("id"), "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    dealt = member.select("id", "root", "own").union(pivots).distinct()
    stars = solve(dealt.select("id", F.xxhash64("root", "own").alias("part"), F.lit(0).alias("side"), none))
    if not large.take(1):
        return stars, False
    joined = connected_components(stars)
    star = saved(large.join(joined.withColumnRenamed("root", "star"), "id"), "star")
    most = star.groupBy("root", "star").agg(F.count("*").alias("c")).groupBy("root").agg(F.max(F.struct("c", "star")).alias("m"), F.sum("c").alias("all")).where(F.col("m.c") < F.col("all"))
    most = saved(most.select("root", F.col("m.star").alias("main"), F.ceil((F.col("all") - F.col("m.c")) / members).cast("int").alias("groups")), "open")
    if not most.take(1):
        return stars, True
    star = saved(star.join(most, "root"), "visits")
    own = star.select("id", "root", "star", "own", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    visitor = star.where("star <> main").select(
        "id", "root", "star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), F.lit(1).alias("side"), F.pmod(F.xxhash64(F.lit(2), "id"), F.col("groups")).cast("int").alias("group")
    )
    return stars.union(solve(own.unionByName(visitor).select("id", F.xxhash64("root", "own", "group").alias("part"), "side", "star"))), True


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, members: int = MEMBERS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Rows of equal sets are joined by the set's hash first, and only one of each goes through the trees.
    A null or empty text, or one without words, has an empty set and is linked with nothing.  A repeated doc_id is one
    document with the links of all its texts; a row is returned for each.  A null doc_id is linked with nothing, and
    its component_id and kept are null.  An empty table gives an empty result.  Other columns are ignored.
    """
    made = saved(sketches(docs, k), "sketches")
    full = made.where("doc_id is not null and n > 0")
    rep = saved(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "sets")
    of = saved(full.select("doc_id", "h1", "h2", "n").join(rep, ["h1", "h2", "n"]).select("doc_id", "h1", "n", "rep").distinct(), "reps")
    chosen = made.join(of.where("doc_id = rep").select("doc_id", "h1", "n"), ["doc_id", "h1", "n"], "left_semi").dropDuplicates(["doc_id", "h1", "n"])
    reps = saved(chosen.select(F.col("doc_id").alias("id"), "n", "sig", "low"), "chosen")
    blocks = candidate_blocks(reps, percent / 100, trees, leaf, depth)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    stars, touch = _solved(blocks, reps.select("id", "n"), texts, percent, k, members, block)
    # A document of several texts can stand in more than one block or set.
    shared = of.groupBy("doc_id").count().where("count > 1")
    ties = of.join(shared, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    if touch or ties.take(1):
        comp = connected_components(stars.union(ties)).select(F.col("id").alias("rep"), F.col("root").alias("component"))
    else:
        comp = stars.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("component"))
    of_row = of.select("doc_id", "h1", "n", "rep").join(comp, "rep", "left").select("doc_id", "h1", "n", F.coalesce("component", "rep").alias("component_id"))
    least = of_row.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return made.select("doc_id", "n").join(least, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the near duplicates of another document; the one with the smallest doc_id of each group stays."""
    verdict = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(verdict, "doc_id", "left_anti").select(docs.columns)


def op1_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_chosen_path": op1_minhash_chosen_path}
SQL: dict[str, str] = {}
