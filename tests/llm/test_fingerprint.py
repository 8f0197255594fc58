import hashlib

import numpy as np
import pytest

from lexiloom.llm import fingerprint as f
from lexiloom.llm.common import shingle_sets


def test_likeness_estimates_jaccard(prose):
    words = prose(1, 1200).split(" ")
    for shared in (200, 600, 1000):
        a, b = shingle_sets([" ".join(words[:1000]).encode(), " ".join(words[1000 - shared : 2000 - shared]).encode()])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert f.likeness(f.fingerprint(a), f.fingerprint(b)) == pytest.approx(true, abs=0.12)


def test_sparse_sets_fill_all_bins():
    for n in (1, 2, 5):
        s = np.sort(f.mix(np.arange(1, n + 1, dtype=np.uint64)))
        x = f.fingerprint(s)
        assert len(x) == f.BINS and f.likeness(x, f.fingerprint(s)) == 1.0


def test_whole_table(documents, odd_texts, clashing):
    rows = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0))
    got = f.fingerprints(clashing(documents(odd_texts)), parts=3).collect()
    assert len(got) == len(rows)
    n_chars = sorted(r["n_chars"] for r in got)
    assert n_chars == sorted(len(t or "") for _, t in rows)
    ids = sorted((i, t or "") for i, t in odd_texts if i is not None and 1 <= i <= 6)
    by = {r["doc_id"]: r for r in got}
    for (i, t), (_, u) in zip(ids, ids[1:]):
        assert by[i]["edited_sha256"] == hashlib.sha256(f.edited(t, u).encode()).hexdigest()
    assert by[6]["fingerprint"] == by[7]["fingerprint"] and by[1]["fingerprint"] == ""
    assert f.fingerprints(documents([])).collect() == []


def test_the_last_is_followed_by_the_first(documents, prose):
    texts = [prose(i, 50) for i in range(20)]
    by = {r["doc_id"]: r for r in f.fingerprints(documents(texts), parts=5).collect()}
    for i, t in enumerate(texts):
        assert by[i]["edited_sha256"] == hashlib.sha256(f.edited(t, texts[(i + 1) % 20]).encode()).hexdigest()
    alone = f.fingerprints(documents(["one two three four five six"])).first()
    assert alone["near_next"] == 1.0


def _mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def plain(hashes):
    """Value by value: the least hash of each bin, an empty bin's taken from the first full one of its sequence."""
    if not hashes:
        return None
    shift = 64 - (f.BINS.bit_length() - 1)
    least = {}
    for h in hashes:
        least[h >> shift] = min(h, least.get(h >> shift, h))
    out = []
    for b in range(f.BINS):
        at, draw = b, 0
        while at not in least:
            at = _mix((_mix((b * 0x9E3779B97F4A7C15 + 99) % 2**64) + draw) % 2**64) >> shift
            draw += 1
        out.append(_mix(least[at]) % 2**f.BITS)
    return bytes(out)


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a is b)
    equal = sum(x == y for x, y in zip(a, b)) / f.BINS
    return min(1.0, max(0.0, (equal - 2.0**-f.BITS) / (1 - 2.0**-f.BITS)))


def test_whole_rows_against_plain_fingerprints(documents, prose):
    """Every column of the query, from fingerprints computed value by value."""
    base = prose(77, 300)
    texts = [prose(i, 3 + 40 * i) for i in range(8)] + [base, base + " tail", "", "one word"]
    sets = {t: [int(h) for h in shingle_sets([t.encode()])[0]] for t in texts}
    got = {r["doc_id"]: r for r in f.fingerprints(documents(texts), parts=3).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new, following = plain(sets[t]), plain([int(h) for h in shingle_sets([changed.encode()])[0]]), plain(sets[after])
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == (own or b"").hex() and got[i]["edited_fingerprint"] == (new or b"").hex()
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own, new)) and got[i]["near_next"] == pytest.approx(plain_likeness(own, following))
