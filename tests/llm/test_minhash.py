import re

from lexiloom.llm import common, minhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=85):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both and 100 * both >= percent * either:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(prose, seed, copies, words=120):
    base = prose(seed, words).split(" ")
    return [" ".join(base[:k] + [f"edit{k}x"] + base[k + 1 :]) for k in range(3, 3 + copies * 3, 3)]


def check(df, rows, **how):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, **how).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}
    assert got == want


def test_against_all_pairs(documents, prose):
    texts = [prose(i, 80) for i in range(30)] + family(prose, 100, 12) + [prose(3, 80).upper(), prose(4, 80), "a b c", "A B C", "a b", "", None]
    rows = list(enumerate(texts))
    check(documents(texts), rows)


def test_large_nodes_and_split_blocks(documents, prose):
    """Nodes larger than a leaf branch on, and blocks larger than a task are solved in parts."""
    passage = prose(7, 100)
    texts = family(prose, 200, 30) + [passage + " " + prose(300 + i, 150) for i in range(30)] + [prose(500 + i, 60) for i in range(10)]
    check(documents(texts), list(enumerate(texts)), leaf=3, block=400)


def test_odd_rows(documents, odd_texts, clashing):
    got = minhash.near_duplicates(clashing(documents(odd_texts))).collect()
    assert len(got) == len(odd_texts)
    by = {(r["doc_id"]): r for r in got}
    assert by[6]["kept"] and by[7]["component_id"] == 6 and not by[7]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (1, 2, 3))
    assert by[None]["component_id"] is None and by[None]["kept"] is None
    assert minhash.near_duplicates(documents([])).collect() == []


def test_words_of_long_texts(prose, monkeypatch):
    texts = [prose(1, 500).encode(), b"", b"x" * 900 + b" y", b"\n a\tb \n", prose(2, 300).encode()]
    whole = common.Words(texts, True)
    monkeypatch.setattr(common, "PIECE", 64)
    pieces = common.Words(texts, True)
    assert whole.hash.tolist() == pieces.hash.tolist() and whole.first.tolist() == pieces.first.tolist()


def test_keep_one(documents, prose):
    df = documents(family(prose, 900, 5) + [prose(1, 50), None])
    assert sorted(r["doc_id"] for r in minhash.keep_one(df).collect()) == [0, 5, 6]
    assert minhash.keep_one(df).columns == df.columns


def test_recall_at_depth(spark, prose):
    """Pairs near the threshold that only meet in deep nodes: what is found is what missed() tells."""
    texts = [t for i in range(12) for t in family(prose, 2000 + i, 3, 90)]
    rows = list(enumerate(texts))
    reps = minhash.sketches(spark.createDataFrame(rows, "doc_id long, text string")).select(minhash.F.col("doc_id").alias("id"), "n", "sig", "low")
    blocks = {r["id"]: r["root"] for r in minhash.candidate_blocks(reps, 0.8, leaf=2, depth=4).collect()}
    comps = {i: c for i, (_, c) in brute(rows, 80).items()}
    assert all(blocks.get(i, i) == blocks.get(c, c) for i, c in comps.items())
    assert minhash.missed(0.85, 0.85, 3) < 1e-4 and minhash.missed(0.8, 0.8, 3) < 1e-3
    assert minhash.missed(0.85, 0.85, 1) < 1e-7


def test_rows_grow_with_the_group(spark, documents, prose, monkeypatch):
    """Large groups of near copies: what is compared with pivots and what is solved grows no faster than the group."""
    base = prose(31, 300).split(" ")

    def copies(n):
        return [" ".join(base[: i % 290 + 3] + [f"w{i}"] + base[i % 290 + 4 :]) for i in range(n)]

    counts = {}
    save = minhash.saved

    def count(df, name):
        made = save(df, name)
        counts[name] = counts.get(name, 0) + (made.count() if name in ("tested", "nodes", "stars") else 0)
        return made

    monkeypatch.setattr(minhash, "saved", count)
    seen = []
    for n in (400, 1600):
        counts.clear()
        got = minhash.near_duplicates(documents(copies(n))).collect()
        assert len(got) == n and {r["component_id"] for r in got} == {0}
        seen.append(dict(counts))
    assert all(seen[1][k] <= 5 * seen[0][k] for k in ("tested", "nodes", "stars"))
