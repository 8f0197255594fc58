import random

import pytest

from lexiloom.llm import unigram


def brute(word, model):
    """Best (score, -tokens) of all segmentations of a marked word."""
    text = unigram.MARK + word
    best = [(0.0, 0)]
    for n in range(1, len(text) + 1):
        size = len(text[n - 1].encode())
        options = [(best[n - 1][0] + model.byte_score * size, best[n - 1][1] - size)]
        options += [(best[a][0] + model.scores[text[a:n]], best[a][1] - 1) for a in range(n) if text[a:n] in model.scores]
        best.append(max(options))
    return best[-1]


def test_against_all_segmentations():
    model = unigram.load(unigram.default_path())
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdeinorst漢é1!") for _ in range(rng.randint(1, 14))) for _ in range(800)}
    model.count_all([" ".join(words).encode()])
    for w in words:
        score, tokens = brute(w, model)
        assert model.score[w.encode()] == pytest.approx(score) and model.count[w.encode()] == -tokens


def test_shared_prefixes_are_computed_once():
    model = unigram.Unigram({unigram.MARK: -1.0, "ab": -1.0, "a": -1.0, "b": -2.0}, -9.0)
    model.add({b"ab", b"abab", b"aba"})
    assert model.count == {b"ab": 2, b"aba": 3, b"abab": 3}


def test_one_very_long_word_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(unigram, "CACHE", 10)
    model = unigram.Unigram({unigram.MARK: -1.0, "ab": -1.0, "a": -1.0, "b": -2.0}, -9.0)
    assert model.count_all([b"ab" * 1_000_000, b"\x1cab ab"]) == [(1, 1_000_001, -1_000_001.0), (2, 5, -13.0)]
    assert not model.count and not model.held


def test_rows(documents, odd_texts, clashing):
    got = {r["doc_id"]: r for r in unigram.token_counts(clashing(documents(odd_texts))).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_tokens"] == 0
    assert got[5]["n_pretokens"] == 30_000 and got[6]["n_tokens"] == got[7]["n_tokens"]
    assert unigram.token_counts(documents([])).collect() == []
