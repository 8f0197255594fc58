"""Exact removal of repeated byte strings: a distributed merge sort of suffixes that carries common prefixes along.

Every byte covered by a string of LENGTH bytes that also starts anywhere else goes.  Suffixes are sorted at anchors only:
of the 8-byte grams that start within the first half of a window of LENGTH bytes the least by hash, leftmost if equal.
Equal windows have their anchors at equal places, so each repeated window lies around two anchors whose suffixes agree in
LENGTH - REACH bytes at least.  Anchors whose suffix is unique to that length drop out by its hash; those left are
sorted with their contexts, REACH bytes to the left and LENGTH to the right.

A task sorts its distinct contexts, cuts the run at splitters and front-codes every piece: each suffix is sent as the
length it shares with its predecessor and the rest.  A loser tree merges the pieces of a bucket; it knows for every
candidate how far it agrees with the last one out, decides by these lengths alone where they differ, and compares from
there on where they don't.  The lengths it puts out delimit groups of suffixes that agree far enough, and within a group
the windows that occur twice are found.

Buckets hold about as many suffixes at any size of the corpus: splitters are bounded in number, and between two of them
suffixes are dealt by the hash of what a group shares, which keeps groups together and each part in order.  Suffixes that
agree with very many others are no task's to merge: their windows are counted by a shuffle.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, DOC_COLUMNS, batched, int64s, least_by_hash, mix, parallelism, powers, saved, table, utf8

LENGTH = 400
GRAM = 8
#: Sorted contexts that one bucket holds about, and bytes of contexts that a task sorts at once.
BUCKET = 30_000
RUN_BYTES = 24 << 20
#: Sampled splitters at most; beyond it the suffixes between two splitters are dealt to several buckets.
SPLITTERS = 20_000
#: Tasks that merge at most; up to it there are as many as buckets, beyond it a task merges one bucket after the other.
MERGERS = 100_000
#: Anchors whose suffixes may be in one group and are merged by a task; the windows of larger groups go through a shuffle.
GROUP = 60_000
#: Bytes of texts whose anchors are looked for at once.
PIECE = 1 << 19
#: Bits of the map of documents that hold a candidate: a proven bound on what is broadcast, 4 MB.
MAP_BITS = 25


def _reach(length: int) -> int:
    return length // 2 - GRAM


def _prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    return total, inverse


def anchors(texts: list[bytes], length: int) -> list[np.ndarray]:
    """The anchors of the windows of each text."""
    width = _reach(length) + 1  # places of a window where its anchor can stand
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    offset = np.cumsum([0] + [len(t) for t in texts])
    if n < length:
        return [np.empty(0, np.int64)] * len(texts)
    gram = np.lib.stride_tricks.sliding_window_view(raw, GRAM).copy().view(np.uint64).ravel()
    key = (mix(gram) & ~np.uint64((1 << 28) - 1)) | np.arange(len(gram), dtype=np.uint64)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[: len(key)] = key
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
    place = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    out = []
    for a, b in zip(offset[:-1], offset[1:]):
        if b - a < length:
            out.append(np.empty(0, np.int64))
            continue
        own = place[a : b - length + 1]
        out.append(np.unique(own[np.concatenate(([True], own[1:] != own[:-1]))]) - a)
    return out


def _hashed(texts: list[bytes], length: int):
    """(anchors, hash of the bytes that equal windows share after each) of texts that are small together."""
    shared = length - _reach(length)
    total, inverse = _prefix(np.frombuffer(b"".join(texts), np.uint8))
    offset = 0
    for text, at in zip(texts, anchors(texts, length)):
        yield at, mix((total[at + offset + shared] - total[at + offset]) * inverse[at + offset]) if len(at) else np.empty(0, np.uint64)
        offset += len(text)


def hashed_anchors(texts: list[bytes], length: int):
    """As _hashed(); a long text in pieces that overlap by a window."""
    for a, b in batched(texts, PIECE):
        small = [t if len(t) <= 2 * PIECE else b"" for t in texts[a:b]]
        for text, found in zip(texts[a:b], _hashed(small, length)):
            if len(text) > 2 * PIECE:
                parts = [(at + p, h) for p in range(0, len(text), PIECE) for at, h in _hashed([text[p : p + PIECE + length - 1]], length)]
                at, once = np.unique(np.concatenate([x for x, _ in parts]), return_index=True)
                found = at, np.concatenate([h for _, h in parts])[once]
            yield found


def _find(batches, length: int):
    """For each text its anchors with their hashes, and now and then the beginning of an anchor's suffix."""
    for batch in batches:
        texts = utf8(batch.column(1))
        rows = []
        for k, text, (at, h) in zip(batch.column(0).to_pylist(), texts, hashed_anchors(texts, length)):
            if len(at):
                some = np.flatnonzero(mix(h) % np.uint64(64) == 0)
                rows.append((k, at.astype(np.int32), int64s(h), [text[p : p + 32] for p in at[some]], int64s(h[some])))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["k", "at", "h", "begin", "begin_h"])


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix of a and b, given that they agree up to start."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def content_id(left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(left + right, digest_size=16, salt=struct.pack("<HH", len(left), len(right))).digest()


def front_coded(entries: list[tuple[bytes, int, int]]) -> bytes:
    """Sorted (key, length of the right part, count) as shared lengths and rests."""
    shared, rest, right, count, before = [], [], [], [], b""
    for key, r, c in entries:
        n = common(before, key)
        shared.append(n)
        rest.append(key[n:])
        right.append(r)
        count.append(c)
        before = key
    heads = [np.array(x, np.uint16).tobytes() for x in (shared, [len(x) for x in rest], right, count)]
    return struct.pack("<I", len(entries)) + zlib.compress(b"".join(heads) + b"".join(rest), 1)


def decoded(blocks):
    """(key, right, count, length shared with the one before) of consecutive blocks of one run."""
    before = b""
    for block in blocks:
        n = struct.unpack_from("<I", block)[0]
        data = zlib.decompress(block[4:])
        shared, size, right, count = (np.frombuffer(data, np.uint16, n, 2 * n * k).tolist() for k in range(4))
        at = 8 * n
        for i in range(n):
            s = shared[i]
            key = before[:s] + data[at : at + size[i]]
            at += size[i]
            # The first of a block is coded against nothing.
            yield key, right[i], count[i], s if i else common(before, key)
            before = key


def merged(runs):
    """Merges runs of (key, right, count, shared with the one before) by a loser tree; the same of the merged sequence.

    agree[i] is how far run i's candidate agrees with the last key that came out past it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [iter(r) for r in runs]
    head = [next(s, None) for s in sources] + [None] * (k - len(runs))
    agree = [0 if h is not None else -1 for h in head]
    lose = [-1] * k

    def better(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes that with the winner."""
        if agree[a] != agree[b]:
            return (a, b) if agree[a] > agree[b] else (b, a)
        if agree[a] < 0:
            return a, b
        x, y = head[a][0], head[b][0]
        n = common(x, y, agree[a])
        first = x[n : n + 1] < y[n : n + 1] or (n == len(x) == len(y) and (head[a][1], a) < (head[b][1], b))
        if first:
            agree[b] = n
            return a, b
        agree[a] = n
        return b, a

    def play(node: int) -> int:
        if node >= k:
            return node - k
        w, lose[node] = better(play(2 * node), play(2 * node + 1))
        return w

    win = play(1)
    while head[win] is not None:
        key, right, count, _ = head[win]
        yield key, right, count, agree[win]
        head[win] = after = next(sources[win], None)
        agree[win] = after[3] if after is not None else -1
        node = (win + k) >> 1
        while node:
            win, lose[node] = better(win, lose[node])
            node >>= 1


def _contexts(batches, length: int, cuts: list[bytes], subs: int, run: str, run_bytes: int):
    """Rows (k, text, places of (at, hot)) to run pieces (kind 0: bucket, block) and each document's (kind 1: k, places, content ids).

    Contexts of hot anchors stand in no run but are rows of their own (kind 2: block and bucket are the context and the
    length of its right part, seq is 2 if the task has it more than once).
    """
    reach = _reach(length)
    shared = length - reach
    held: dict[bytes, list] = {}
    hot: dict[bytes, list] = {}
    size = 0
    number = 0

    def row(kind, **got):
        names = ["kind", "bucket", "run", "seq", "block", "k", "at", "ids"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary())]
        n = len(next(iter(got.values())))
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32())] + [pa.array(got.get(c, [None] * n), t) for c, t in zip(names[1:], kinds[1:])], names=names)

    def sorted_run():
        entries = sorted((key, r, c) for key, r, c in held.values())
        start = [e[0] for e in entries]
        bounds = [0] + [bisect.bisect_left(start, c) for c in cuts] + [len(entries)]
        got: dict[str, list] = {"bucket": [], "run": [], "seq": [], "block": []}
        for b, (x, y) in enumerate(zip(bounds, bounds[1:])):
            parts: dict[int, list] = {0: entries[x:y]} if subs == 1 else {}
            if subs > 1:
                for e in entries[x:y]:
                    parts.setdefault(zlib.crc32(e[0][:shared]) % subs, []).append(e)
            for sub, part in parts.items():
                for seq, a in enumerate(range(0, len(part), 4096)):
                    got["bucket"].append(b * subs + sub)
                    got["run"].append(f"{run}{number}")
                    got["seq"].append(seq)
                    got["block"].append(front_coded(part[a : a + 4096]))
        return row(0, **got)

    def hot_rows():
        return row(2, bucket=[r for _, r, _ in hot.values()], seq=[c for _, _, c in hot.values()], block=[key for key, _, _ in hot.values()], ids=[[c] for c in hot])

    for batch in batches:
        ks, texts, places = batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()
        ids: list[list[bytes]] = []
        for text, at in zip(texts, places):
            own = []
            for p in at:
                left, right = text[max(0, p["at"] - reach) : p["at"]], text[p["at"] : p["at"] + length]
                c = content_id(left, right)
                own.append(c)
                keep = hot if p["hot"] else held
                known = keep.get(c)
                if known is None:
                    keep[c] = [right + left[::-1], len(right), 1]
                    size += len(left) + len(right) + 250
                else:
                    known[2] = 2
            ids.append(own)
            if size >= run_bytes:
                if held:
                    yield sorted_run()
                if hot:
                    yield hot_rows()
                held.clear()
                hot.clear()
                size = 0
                number += 1
        yield row(1, k=ks, at=[[p["at"] for p in at] for at in places], ids=ids)
    if held:
        yield sorted_run()
    if hot:
        yield hot_rows()


def _hot_windows(batches, length: int):
    """Contexts (id, key, right, n) to (id, n, hashes of the windows by distance, null where there is none)."""
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            batch = whole.slice(a, 500)
            members = list(zip(*(batch.column(c).to_pylist() for c in ("key", "right", "n"))))
            hashed, has = _windows(members, length, 0, _reach(length) + 1)
            windows = [[int(x) if y else None for x, y in zip(h, ok)] for h, ok in zip(hashed.view(np.int64), has)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(windows, pa.list_(pa.int64()))], names=["id", "n", "windows"])


def _windows(members, length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the windows with their anchor first..last - 1 bytes from the start, of each member; and whether the member has them."""
    reach = _reach(length)
    context = np.zeros((len(members), reach + length), np.uint8)
    left, right = np.empty(len(members), np.int64), np.empty(len(members), np.int64)
    for i, (key, r, _) in enumerate(members):
        row = np.frombuffer(key, np.uint8)
        context[i, reach : reach + r] = row[:r]
        context[i, reach - (len(row) - r) : reach] = row[r:][::-1]
        left[i], right[i] = len(row) - r, r
    power, inverse = powers(reach + length + 1)
    total = np.zeros((len(members), reach + length + 1), np.uint64)
    np.cumsum(_BYTE[context] * power[: reach + length], axis=1, out=total[:, 1:])
    d = np.arange(first, last)
    start = reach - d
    hashed = mix((total[:, start + length] - total[:, start]) * inverse[start]) ^ mix(d.astype(np.uint64))
    return hashed, (d <= left[:, None]) & (length - d <= right[:, None])


def repeated(members: list[tuple[bytes, int, int]], length: int) -> list[int]:
    """For each member, (right part and reversed left part, size of the right part, count), the bitmap of its distances d whose window occurs twice.

    Window d of a member starts d bytes before its anchor.
    """
    reach = _reach(length)

    def span(low, high):
        return (1 << (high + 1)) - (1 << low) if 0 <= low <= high else 0

    out = [span(max(0, length - r), min(reach, len(key) - r)) if c > 1 else 0 for key, r, c in members]
    if len(members) == 1:
        return out
    if len(members) <= 10:
        rights, lefts = [key[:r] for key, r, _ in members], [key[r:] for key, r, _ in members]
        for i in range(len(members)):
            for j in range(i):
                low, high = length - common(rights[i], rights[j]), min(reach, common(lefts[i], lefts[j]))
                both = span(max(0, low), high)
                out[i] |= both
                out[j] |= both
        return out
    step = max(1, min(reach + 1, 4_000_000 // len(members)))
    weight = np.array([c for _, _, c in members])
    for first in range(0, reach + 1, step):
        last = min(reach + 1, first + step)
        parts = [_windows(members[a : a + 2000], length, first, last) for a in range(0, len(members), 2000)]
        hashed, has = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        who, d = np.nonzero(has)
        _, back = np.unique(hashed[who, d], return_inverse=True)
        twice = np.bincount(back, weights=weight[who])[back] > 1.5
        found = np.zeros(has.shape, bool)
        found[who[twice], d[twice]] = True
        for i in np.flatnonzero(found.any(axis=1)):
            out[i] |= int.from_bytes(np.packbits(found[i], bitorder="little").tobytes(), "little") << first
    return out


def _merge(batches, length: int):
    """The runs of each bucket merged: (id, mask) of contexts with repeated windows."""
    shared = length - _reach(length)
    size = (_reach(length) + 8) // 8

    def solve(runs):
        ids, masks = [], []
        group: list[tuple[bytes, int, int]] = []

        def close():
            for m, bits in zip(group, repeated(group, length)):
                if bits:
                    ids.append(content_id(m[0][m[1] :][::-1], m[0][: m[1]]))
                    masks.append(bits.to_bytes(size, "little"))

        for key, r, c, n in merged([decoded(b) for b in runs.values()]):
            if group and n < shared:
                close()
                group = []
            if group and group[-1][1] == r and group[-1][0] == key:
                group[-1] = (key, r, 2)
            else:
                group.append((key, r, c))
        if group:
            close()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=["id", "mask"])

    bucket, runs = None, {}
    for batch in batches:
        for b, run, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "run", "block"))):
            if b != bucket and runs:
                yield solve(runs)
                runs = {}
            bucket = b
            runs.setdefault(run, []).append(block)
    if runs:
        yield solve(runs)


def _spans(text: bytes, found, length: int) -> np.ndarray:
    """Whether each byte goes, given (at, id, mask) of a text's anchors; those that don't belong to the text are left out."""
    reach = _reach(length)
    step = np.zeros(len(text) + 1, np.int32)
    for p, c, mask in found:
        if p > len(text) or content_id(text[max(0, p - reach) : p], text[p : p + length]) != c:
            continue
        start = p - np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little"))
        step[start] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def _cut(batches, length: int):
    """Adds what is left of each text and the digest columns."""
    for batch in batches:
        rows = []
        for text, found in zip(utf8(batch.column("text")), batch.column("found").to_pylist()):
            gone = _spans(text, [(f["at"], f["id"], f["mask"]) for f in found or ()], length)
            edges = np.diff(np.concatenate(([0], gone.view(np.int8))))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        own = [c for c in batch.schema.names if c not in ("found", "text", "_k")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=own + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _marked(keys: DataFrame, bits: int = MAP_BITS):
    """A test of column _k by a bitmap of the keys of 2**bits bits: true of every key, and of few others while keys are few."""
    place = F.col("k").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    full = np.zeros(1 << (bits - 6), np.uint64)
    full[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)

    @F.pandas_udf("boolean")
    def test(k: pd.Series) -> pd.Series:
        x = k.to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
        return pd.Series((full[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    return test


def repeated_strings(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, run_bytes: int = RUN_BYTES, group: int = GROUP) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text in the place of text.

    Texts are UTF-8 bytes, null and empty ones have none and lose none; matches never cross rows.  A row that is there
    twice repeats itself.  Null ids and other columns stay as they are (but columns with the names of the results are
    replaced).  kept_text leaves out characters of which only a part is kept.  An empty table gives an empty result.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "_k", "found")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [c for c in docs.columns if c != "text"]
    id_parts = [F.col(c) for c in ("doc_id",) if c in docs.columns]
    docs = docs.select(*others, text.alias("text")).withColumn("_k", F.xxhash64(*id_parts, "text"))
    found = saved(docs.select("_k", "text").where(F.octet_length("text") >= length).mapInArrow(lambda b: _find(b, length), "k long, at array<int>, h array<long>, begin array<binary>, begin_h array<long>"), "anchors")
    single = found.select("k", F.explode(F.arrays_zip("at", "h")).alias("a")).select("k", "a.at", "a.h")
    twice = saved(single.groupBy("h").count().where("count > 1").select("h", (F.col("count") > group).alias("hot")), "repeated")
    live = saved(single.join(twice, "h").select("k", "at", "hot"), "live")
    buckets = live.count() // bucket + 1
    subs = -(-buckets // SPLITTERS)
    buckets = -(-buckets // subs)
    begin = found.select(F.explode(F.arrays_zip("begin", "begin_h")).alias("b")).select("b.begin", F.col("b.begin_h").alias("h")).join(twice, "h", "left_semi")
    sample = sorted(bytes(r["begin"]) for r in least_by_hash(saved(begin, "begins"), SPLITTERS, "begin", "h").collect())
    cuts = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []
    marked = _marked(live.select("k").distinct())
    test = marked("_k")
    part = saved(docs.where(F.octet_length("text") >= length).where(test), "candidates")
    places = live.distinct().groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "hot"))).alias("at"))
    work = part.select(F.col("_k").alias("k"), "text").join(places, "k").select("k", "text", "at")
    # Every row counts, so rows of one key are not made one; the run's name tells tasks apart.
    made = saved(work.mapInArrow(lambda b: _contexts(b, length, cuts, subs, _task(), run_bytes), "kind int, bucket long, run string, seq int, block binary, k long, at array<int>, ids array<binary>"), "runs")
    tasks = min(max(parallelism(spark), buckets * subs), MERGERS)
    pieces = made.where("kind = 0").select("bucket", "run", "seq", "block").repartition(tasks, "bucket").sortWithinPartitions("bucket", "run", "seq")
    masks = saved(pieces.mapInArrow(lambda b: _merge(b, length), "id binary, mask binary"), "masks")
    if twice.where("hot").take(1):
        context = made.where("kind = 2").groupBy(F.get("ids", 0).alias("id")).agg(F.first("block").alias("key"), F.first("bucket").alias("right"), F.sum("seq").alias("n"))
        told = saved(context.mapInArrow(lambda b: _hot_windows(b, length), "id binary, n long, windows array<long>"), "windows")
        each = told.select("id", "n", F.posexplode("windows").alias("d", "w")).where("w is not null")
        again = saved(each.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w"), "again")
        bits = each.join(again, "w").groupBy("id").agg(F.collect_set("d").alias("ds"))
        masks = masks.union(bits.select("id", _mask_of(length)("ds")))
    where = made.where("kind = 1").select("k", F.explode(F.arrays_zip("at", "ids")).alias("a")).select("k", "a.at", F.col("a.ids").alias("id")).distinct()
    hit = where.join(masks, "id").groupBy("k").agg(F.collect_list(F.struct("at", "id", "mask")).alias("found"))
    hit = saved(hit, "hits")
    touched = part.join(hit.withColumnRenamed("k", "_k"), "_k", "left").select(*others, "text", "found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(others).schema.fields)
    schema = (schema + ", " if schema else "") + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    cut = touched.mapInArrow(lambda b: _cut(b, length), schema)
    whole = docs.where((F.octet_length("text") < length) | ~test).select(
        *others, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"), F.col("text").alias("kept_text")
    )
    return whole.unionByName(cut)


def _task() -> str:
    return f"{TaskContext.get().partitionId()}-"


def _mask_of(length: int):
    size = (_reach(length) + 8) // 8

    @F.pandas_udf("binary")
    def mask(ds: pd.Series) -> pd.Series:
        return pd.Series([sum(1 << int(d) for d in x).to_bytes(size, "little") for x in ds])

    return mask


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the columns of documents, the text without repeated strings and n_chars that of the new text."""
    made = repeated_strings(docs.select(DOC_COLUMNS), length)
    return made.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def op4_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


QUERIES = {"op4_suffix_merge": op4_suffix_merge}
SQL: dict[str, str] = {}
