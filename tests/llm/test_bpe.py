import random
import struct

import pytest

from lexiloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def reference(library, texts):
    out = []
    for e in library.encode_batch(texts, add_special_tokens=False):
        out.append((list(e.ids), library.decode(e.ids, skip_special_tokens=False)))
    return out


def test_same_as_the_library(library):
    rng = random.Random(3)
    letters = "abcdeilnorst aAé'ßΣİ漢字12３!?.<|>\n\t\x85\xa0\x1c​\U0001D4B3"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 40))) for _ in range(1000)]
    texts += ["hello <|startoftext|>world<|endoftext|> x<|endoftext|>", "it's they're I'LL 'S", "", "   ", "éá"]
    texts += [a + m for a in "HTWYJIKAhz" for m in "\u0331\u0308\u030a\u030c\u0307\u0301"] + [" \u0301a", "\xa0", "a\xa0 \u2003b", "<|STARTOFTEXT|> A<|endoftext|>B"]
    assert encoded(bpe.WordBpe(bpe.default_path()), texts) == reference(library, texts)


def encoded(b, texts):
    return [(list(struct.unpack(f"<{len(i) // 4}I", i)), d.decode()) for i, d in b.encode_all([t.encode() for t in texts])]


def test_one_very_long_word(library):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdeinorst") for _ in range(300_000))
    b = bpe.WordBpe(bpe.default_path())
    assert encoded(b, [text, "a " + text[:100]]) == reference(library, [text, "a " + text[:100]])


def test_the_cache_starts_anew(library, monkeypatch, prose):
    monkeypatch.setattr(bpe, "CACHE", 10)
    b = bpe.WordBpe(bpe.default_path())
    texts = [prose(i, 30) for i in range(5)]
    for t in texts:
        assert encoded(b, [t]) == reference(library, [t])
        assert not b.ids and not b.chunk_ids


def test_rows(documents, odd_texts, clashing, library):
    got = bpe.encode(clashing(documents(odd_texts))).collect()
    want = reference(library, [t or "" for _, t in odd_texts])
    assert sorted((r["n_tokens"], r["ids"], r["decoded"]) for r in got) == sorted((len(i), i, d) for i, d in want)
    assert bpe.encode(documents([])).collect() == []
