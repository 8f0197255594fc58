"""BPE encoding and decoding by prefix-sharing trie traversal.

The last token of the encoding of every prefix follows from those of its own prefixes: it is the one token that ends
the prefix and may stand after the last token of what is left of it.  Distinct words are therefore laid out as a trie (in
sorted order, which is its depth-first order) and each node's last token is found once, whatever number of words
share the node.  The last symbol of a word is another symbol than the same letter within it, so that a word ends in a
step of its own.  An automaton of the vocabulary finds the tokens that end at each place, the longest first.  Words never cross white space: texts are cut there, and the worker keeps the encodings of words and of
what stands between white space, up to a bound in bytes, and puts texts together from them.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import os
import sys
import unicodedata
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

#: Bytes of encodings that a worker keeps; beyond it starts anew.
CACHE = 256 << 20
#: Bytes that an entry takes besides its contents.
ENTRY = 300
#: Unicode white space, as the tokenizer's pattern has it.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(other.get(b, b)) for b in range(256)]


class WordBpe:
    """A BPE with word ends, read from a tokenizer file; encodes distinct words over their trie."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in (self.vocab | self.special).items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of the merge that makes it, left and right part
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = self.vocab[a], self.vocab[b]
            if pair not in self.rank:
                self.rank[pair] = r
                self.made.setdefault(self.vocab[a + b], (r, *pair))
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.last = {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, self.vocab))
        self.fits_known: dict[int, bool] = {}
        self.whole_known: dict[int, bool] = {}
        self.inner = {t: i for t, i in self.inner.items() if self.whole(i)}
        self.last = {t: i for t, i in self.last.items() if self.whole(i)}
        self.found = ahocorasick.Automaton()
        for t, i in self.inner.items():
            self.found.add_word(t, (i, len(t)))
        self.found.make_automaton()
        self.shown_name = {i: t.encode() for i, t in self.name.items()}
        alphabet = byte_alphabet()
        self.shown = alphabet
        self.letters = {chr(b): alphabet[b] for b in range(256)}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.marks = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.ids: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunk_ids: dict[bytes, bytes] = {}
        self.chunk_pieces: dict[bytes, bytes] = {}
        self.held = 0

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across their border comes before those that make them.

        Merges are undone from the last one on.  While a part is still to be made by a merge of rank r, a merge over
        the border of a smaller rank would have come first; of an equal rank too if it lies to the left.
        """
        first, bound, ok = a << 24 | b, 1 << 60, True
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < bound:
                ok = False
                break
            of_a, of_b = self.made.get(a), self.made.get(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or (of_a is not None and of_a[0] > of_b[0]):
                bound, a = of_a[0], of_a[2]
            else:
                bound, b = of_b[0] + 1, of_b[1]
        if len(self.fits_known) > 4_000_000:
            self.fits_known.clear()
        self.fits_known[first] = ok
        return ok

    def whole(self, t: int) -> bool:
        """Whether a token is the encoding of its own text."""
        known = self.whole_known.get(t)
        if known is None:
            of = self.made.get(t)
            known = of is None or (self.whole(of[1]) and self.whole(of[2]) and self._meet(of[1], of[2], of[0]))
            self.whole_known[t] = known
        return known

    def _meet(self, a: int, b: int, rank: int) -> bool:
        """Whether nothing merges across the border of a and b before the merge of the given rank joins them."""
        bound = 1 << 60
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < min(bound, rank):
                return False
            of_a, of_b = self.made.get(a), self.made.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and of_a[0] > of_b[0]):
                bound, a = of_a[0], of_a[2]
            else:
                bound, b = of_b[0] + 1, of_b[1]

    def _after(self, last: int, token: int) -> bool:
        """Whether token may follow the last token of a prefix, -1 for none."""
        if last < 0:
            return False
        known = self.fits_known.get(last << 24 | token)
        return self.fits(last, token) if known is None else known

    def _descend(self, word: str, last, size) -> None:
        """Add the last tokens of the word's prefixes that aren't known yet, but for the whole word, to last and size."""
        new = len(last)
        for at, (token, n) in self.found.iter(word, max(0, new - self.longest), len(word) - 1):
            at += 1
            if at < new:
                continue
            while len(last) < at:
                last.append(-1)
                size.append(0)
            if len(last) == at and (n == at or self._after(last[at - n], token)):
                last.append(token)
                size.append(n)
        while len(last) < len(word):
            last.append(-1)
            size.append(0)

    def encode_words(self, words) -> None:
        """Encode words, given as the characters of the byte alphabet, into self.ids and self.pieces."""
        last, size = array("i", [-1]), array("H", [0])  # of each prefix of the word: its last token and that one's length
        before = ""
        for word in sorted(words):
            depth = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                depth += 1
            keep = min(depth, len(last) - 1) + 1
            del last[keep:], size[keep:]
            if keep < len(word):
                self._descend(word, last, size)
            before = word
            n, out = len(word), array("I")
            for step in range(min(n, self.longest), 0, -1):
                token = self.last.get(word[n - step :])
                if token is not None and (step == n or self._after(last[n - step], token)):
                    break
            else:
                token = -1
            while token >= 0:
                out.append(token)
                n -= step
                token, step = (last[n], size[n]) if n else (-1, 0)
            if n:
                raise ValueError(f"no encoding of {word[:100]!r}")
            out.reverse()
            if sys.byteorder == "big":
                out.byteswap()
            self.ids[word] = ids = out.tobytes()
            if sys.byteorder == "big":
                out.byteswap()
            self.pieces[word] = pieces = b" ".join([self.shown_name[t] for t in out])
            self.held += ENTRY + 2 * len(word) + len(ids) + len(pieces)

    def split(self, text: str) -> list[str]:
        """The words of a text in the byte alphabet; special tokens stand for themselves after a line break."""
        out: list[str] = []
        at = 0
        for m in self.marks.finditer(text) if self.marks and "<|" in text else ():
            out += self._plain(text[at : m.start()])
            out.append("\n" + m[0])
            at = m.end()
        return out + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[str]:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [w if w.isascii() and w.isprintable() else "".join(map(self.shown.__getitem__, w.encode())) for w in self.words.findall(text)]

    def _add(self, chunks) -> None:
        """Encode what stands between white space into self.chunk_ids and self.chunk_pieces."""
        split = [(c, self.split(c.decode(errors="replace"))) for c in chunks]
        new = {w for _, ws in split for w in ws}.difference(self.ids)
        for w in [w for w in new if w[0] == "\n"]:
            new.discard(w)
            self.ids[w] = self.special[w[1:]].to_bytes(4, "little")
            self.pieces[w] = w[1:].encode()
        self.encode_words(new)
        for c, ws in split:
            self.chunk_ids[c] = ids = b"".join(map(self.ids.__getitem__, ws))
            self.chunk_pieces[c] = pieces = b" ".join(map(self.pieces.__getitem__, ws))
            self.held += ENTRY + 2 * len(c) + (len(ids) + len(pieces) if len(ws) > 1 else 0)

    def encode_all(self, texts: list[bytes], cache: int | None = None) -> list[tuple[bytes, bytes]]:
        """The ids (little-endian, 32 bits each) and the decoded text of each text, all in UTF-8; cache: as CACHE, by default that.

        Texts are cut at the white space of ASCII.  Capitals of ASCII texts are made small at once: no mark can follow them.
        """
        split = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in texts]
        self._add({c for cs in split for c in cs}.difference(self.chunk_ids))
        out = [(b"".join(map(self.chunk_ids.__getitem__, cs)), b" ".join(filter(None, map(self.chunk_pieces.__getitem__, cs)))) for cs in split]
        if self.held > (CACHE if cache is None else cache):
            for kept in (self.ids, self.pieces, self.chunk_ids, self.chunk_pieces):
                kept.clear()
            self.held = 0
        return out

    def decode(self, ids) -> str:
        """The token strings with blanks between them: the tokenizer names no decoder."""
        return " ".join(map(self.name.__getitem__, ids))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def unload() -> None:
    """Give the memory of all that is loaded back to the system: workers are used again, by tasks that encode nothing."""
    _loaded.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def default_path() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    except ImportError:
        return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/word_bpe_49k.json"


def text_batches(batch, limit: int = 1 << 21):
    """(ids, texts) of a batch (doc_id, text) in pieces of about limit characters; null texts are empty."""
    ids, texts, size = [], [], 0
    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(d)
        texts.append(t or "")
        size += len(texts[-1])
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def byte_batches(batch, limit: int = 1 << 21):
    """(ids, texts in UTF-8) of a batch (doc_id, text) in pieces of about limit bytes; null texts are empty."""
    texts = utf8(batch.column(1))
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i + 1 == len(texts):
            yield batch.column(0)[a : i + 1], texts[a : i + 1]
            a, size = i + 1, 0


def _encode(batches, path: str, full: bool):
    bpe = load(path)
    for batch in batches:
        for ids, texts in byte_batches(batch):
            got = bpe.encode_all(texts)
            columns = [ids, pa.array([len(x) // 4 for x, _ in got], pa.int64())]
            names = ["doc_id", "n_tokens"]
            if full:
                columns += [pa.array([list(memoryview(x).cast("I")) for x, _ in got], pa.list_(pa.int32())), pa.array([s.decode() for _, s in got], pa.string())]
                names += ["ids", "decoded"]
            else:
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x, _ in got], pa.string()), pa.array([hashlib.sha256(s).hexdigest() for _, s in got], pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, path: str | None = None, full: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_tokens, and ids and decoded text, or their digests if not full.

    A null or empty text has no tokens and decodes to the empty text.  Texts of any length are encoded whole.  Repeated
    rows give repeated results, a null doc_id is kept; other columns are ignored; an empty table gives an empty result.
    """
    path = path or default_path()
    kept = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _encode(b, path, full), f"doc_id long, n_tokens long, {kept}"
    )


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), full=False)


QUERIES = {"op8_bpe_trie": op8_bpe_trie}
SQL: dict[str, str] = {}
