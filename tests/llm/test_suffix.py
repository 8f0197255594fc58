import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import suffix


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(np.int8))))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, **how):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeated_strings(df, **how).collect())


@pytest.fixture(scope="module")
def tangled(prose):
    """Passages at the ends and in the middle of texts, within one text, overlapping, periodic, and of just the length."""
    rng = random.Random(5)
    passages = [prose(1000 + i, 40) for i in range(4)]
    texts = [prose(i, rng.randint(5, 120)) for i in range(25)]
    for i in range(30):
        p = rng.choice(passages)
        a, b = sorted(rng.sample(range(len(p)), 2))
        texts.append(prose(50 + i, rng.randint(0, 30)) + p[a:b] * rng.randint(1, 2) + rng.choice(["", prose(90 + i, 20)]) + rng.choice(["", p]))
    exact = prose(2000, 60)
    return texts + ["x" * 500, "ab" * 300, texts[0], texts[0], "é" * 260, exact[:100] + "!" + exact[:99], exact[50:150], "", None]


def test_against_all_strings(documents, tangled):
    assert run(documents(tangled), length=100) == brute(tangled, 100)


def test_small_runs_buckets_and_groups(documents, tangled, monkeypatch):
    """Many runs for the loser tree, many buckets between few splitters, and groups that go through the shuffle."""
    monkeypatch.setattr(suffix, "SPLITTERS", 3)
    assert run(documents(tangled).repartition(5), length=100, bucket=20, run_bytes=4000) == brute(tangled, 100)
    assert run(documents(tangled).repartition(5), length=100, bucket=20, run_bytes=4000, group=2) == brute(tangled, 100)


def test_pieces_of_long_texts(prose, monkeypatch):
    texts = [(prose(i, 700) + "y" * 300).encode() for i in range(3)] + [b"", b"short"]
    whole = list(suffix.hashed_anchors(texts, 100))
    monkeypatch.setattr(suffix, "PIECE", 200)
    for (a, h), (b, g) in zip(whole, suffix.hashed_anchors(texts, 100)):
        assert a.tolist() == b.tolist() and h.tolist() == g.tolist()


def test_runs_merge_in_order():
    rng = random.Random(1)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(400)]
    runs = [sorted((k, len(k), 1) for k in keys[i::7]) for i in range(7)]
    coded = [suffix.decoded([suffix.front_coded(r[a : a + 16]) for a in range(0, len(r), 16)]) for r in runs]
    out = list(suffix.merged(coded))
    assert [k for k, *_ in out] == sorted(keys)
    for (a, *_), (b, _, _, n) in zip(out, out[1:]):
        assert n == suffix.common(a, b)


def test_odd_rows(documents, odd_texts, clashing):
    df = clashing(documents(odd_texts))
    got = suffix.repeated_strings(df, length=100).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute([t for _, t in odd_texts], 100)
    assert suffix.repeated_strings(documents([])).collect() == []
    assert suffix.repeated_strings(documents(["short", None])).count() == 2


def test_texts_without_repeats(documents, prose):
    p = prose(1, 100)
    df = documents([p + " tail", "head " + p, "clean text"])
    got = {r["doc_id"]: r for r in suffix.without_repeats(df).collect()}
    assert got[0]["text"] == " tail" and got[1]["text"] == "head " and got[2]["text"] == "clean text"
    assert got[0]["n_chars"] == 5 and suffix.without_repeats(df).columns == df.columns
