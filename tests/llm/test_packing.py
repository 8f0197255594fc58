import random
from collections import Counter, defaultdict

from lexiloom.llm import bpe, packing

ITEMS = "doc_id long, size long, source string, cluster string"


def check(rows, got, capacity, same_source):
    bins = defaultdict(list)
    for r in got:
        bins[r["shard"], r["bin"]].append(r)
    info = {i: (max(1, n or 1), s, c) for i, n, s, c in rows}
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, *_ in rows)
    done = Counter()
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        end = 0
        for r in b:
            assert r["bin_offset"] == end
            end += r["n_tokens"]
            done[r["doc_id"]] += r["n_tokens"]
        assert end <= capacity
        last = [r for r in b if r["piece"] == r["n_pieces"] - 1 and r["n_tokens"] < capacity]
        clusters = Counter(info[r["doc_id"]][2] for r in last if info[r["doc_id"]][2])
        sources = Counter(info[r["doc_id"]][1] for r in last if info[r["doc_id"]][1])
        assert max(clusters.values(), default=0) <= 1 and max(sources.values(), default=0) <= same_source
    times = Counter(i for i, *_ in rows)
    assert done == {i: info[i][0] * times[i] for i in info}


def test_constraints_hold(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 10, 25, 50, 99, 100, 250, 1000]), rng.choice("aaab") + str(rng.randint(0, 1)), rng.choice([None, "x", f"c{i}"])) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, ITEMS), capacity=100, same_source=2, shard=150).collect()
    assert len({r["shard"] for r in got}) == 3
    check(rows, got, 100, 2)


def test_tightest_compatible_bin():
    """Every placement against a search through all bins."""
    rng = random.Random(2)
    bins = packing.Bins(50, 2, common=1)
    for _ in range(500):
        size, cluster, source = rng.randint(1, 50), rng.choice([0, 1, 2, 4]), rng.choice([0, 1, 2])
        fit = [left for b, left in enumerate(bins.left) if left >= size and not bins.clusters[b] & cluster and not bins.sources[b][-1] & source and left]
        before = list(bins.left)
        b, at = bins.place(size, cluster, source)
        assert (before[b] if b < len(before) else None) == (min(fit) if fit else None)


def test_odd_rows(spark, documents, odd_texts, clashing):
    rows = [(1, None, None, None), (2, 0, "s", None), (3, -5, "s", "c"), (4, 10**6, "s", "c"), (None, 7, None, "c"), (5, 7, "s", "c"), (5, 7, "s", "c")]
    got = packing.pack(clashing(spark.createDataFrame(rows, ITEMS).drop("size", "source", "cluster")).join(spark.createDataFrame(rows, ITEMS).select("doc_id"), "doc_id").limit(0).selectExpr("doc_id", "1 as size", "'' as source", "'' as cluster"), capacity=100).collect()
    assert got == []
    got = packing.pack(spark.createDataFrame(rows, ITEMS), capacity=100).collect()
    check(rows, got, 100, packing.SAME_SOURCE)
    assert packing.packed(documents([])).collect() == []
    made = packing.packed(documents(odd_texts)).collect()
    assert sum(r["piece"] == 0 for r in made) == len(odd_texts)
    assert sum(r["n_tokens"] for r in made if r["doc_id"] == 5) == 30_001
    made = packing.packed(documents(odd_texts), bpe.default_path()).collect()
    tokens = {r["doc_id"]: r["n_tokens"] for r in bpe.encode(documents(odd_texts)).where("doc_id = 5 or doc_id = 1").collect()}
    assert sum(r["n_tokens"] for r in made if r["doc_id"] == 5) == tokens[5] + 1 and tokens[1] == 0


def test_sequences_hold_the_documents(spark, documents, prose):
    """Put together again from the packed sequences, every document has its token ids and an end mark."""
    docs = documents([prose(i, 5 + 37 * i % 900) for i in range(40)] + ["", None])
    at = packing.packed(docs, bpe.default_path(), capacity=300)
    made = packing.sequences(docs, at).collect()
    places = {(r["shard"], r["bin"]): r for r in made}
    assert all(len(r["ids"]) <= 300 for r in made)
    got = defaultdict(list)
    for r in sorted(at.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        whole = places[r["shard"], r["bin"]]
        assert r["doc_id"] in whole["doc_ids"]
        got[r["doc_id"]] += whole["ids"][r["bin_offset"] : r["bin_offset"] + r["n_tokens"]]
    end = bpe.load(bpe.default_path()).special["<|endoftext|>"]
    assert dict(got) == {r["doc_id"]: r["ids"] + [end] for r in bpe.encode(docs).collect()}


def test_given_clusters_share_no_bin(spark, documents, prose):
    docs = documents([prose(1, 30)] + [prose(1, 30) + f" more{i}" for i in range(6)])
    clusters = spark.createDataFrame([(i, 0) for i in range(7)], "doc_id long, component_id long")
    assert len({r["bin"] for r in packing.packed(docs, clusters=clusters, same_source=9).collect()}) == 7
    assert len({r["bin"] for r in packing.packed(docs, same_source=9).collect()}) == 1


def test_one_source_everywhere():
    """Bins that a dominant source has filled are passed over in groups: the work doesn't grow with their square."""
    import time

    def seconds(n):
        bins, began = packing.Bins(2048, 2), time.perf_counter()
        for k in range(n):
            bins.place(100 + k % 7, 0, 1)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1000), 0.002)


def test_workers_give_the_encoder_back(spark, documents, prose, monkeypatch):
    """Workers that have counted tokens serve other stages next: neither the vocabulary nor its caches stay in them."""
    import pyarrow as pa

    path = bpe.default_path()
    texts = [prose(i, 200) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], names=["_at", "text"])
    want = [len(x) // 4 + 1 for x, _ in bpe.load(path).encode_all([t.encode() for t in texts])]
    monkeypatch.setattr(packing, "CACHE", 10)
    assert next(packing._sizes([batch], path)).column("size").to_pylist() == want and not bpe.load(path).ids
    assert len(list(packing._sizes([batch], path))) == 1 and not bpe._loaded
    assert packing.items_of(documents(texts), path).count() == 20

    def loaded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._loaded)])], names=["n"])

    assert {r["n"] for r in spark.range(40, numPartitions=8).mapInArrow(loaded, "n long").collect()} == {0}
