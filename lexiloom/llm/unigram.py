"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a prefix depends on the prefix alone; an automaton finds the pieces that end at each place.  Distinct pre-tokens are laid out as a trie (in sorted
order, its depth-first order), the forward score and the number of tokens of each node are computed once whatever
number of pre-tokens share it, and the terminal ones are kept for the texts of the worker.

The model is that of a public vocabulary file whose pieces are ordered by rank: a piece's probability falls with its rank
(Zipf's law with Mandelbrot's shift), and a character that no piece holds costs one token for each of its bytes.
"""

from __future__ import annotations

import math
import os
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ENTRY, byte_batches
from .common import table

#: Bytes of scored pre-tokens that a worker keeps; beyond it starts anew.
CACHE = 64 << 20
SHIFT = 2.7
MARK = "▁"


class Unigram:
    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        self.found = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.found.add_word(piece, (score, len(piece)))
        if scores:
            self.found.make_automaton()
        self.count: dict[bytes, int] = {}
        self.score: dict[bytes, float] = {}
        self.held = 0

    @classmethod
    def from_pieces(cls, path: str) -> "Unigram":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        total = math.log(sum(1 / (r + SHIFT) for r in range(len(usual) + 1)))
        scores = {sp.id_to_piece(i): -math.log(r + SHIFT) - total for r, i in enumerate(usual)}
        return cls(scores, -math.log(len(usual) + SHIFT) - total)

    def add(self, words: set[bytes]) -> None:
        """Forward scores of the pre-tokens' trie; of equal scores the one with fewer tokens."""
        best, least = array("d", [0.0]), array("q", [0])  # of each prefix
        before = ""
        longest, byte = self.longest, self.byte_score
        for word in sorted(words):  # the order of UTF-8 is that of code points
            text = MARK + word.decode(errors="replace")
            shared = 0
            for x, y in zip(text, before):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], least[shared + 1 :]
            before = text
            new = len(best)

            def reach(n: int) -> None:
                """Opens the prefixes up to n, by the bytes of their last characters."""
                for k in range(len(best), n + 1):
                    size = len(text[k - 1].encode())
                    best.append(best[k - 1] + byte * size)
                    least.append(least[k - 1] + size)

            for at, (p, size) in self.found.iter(text, max(0, new - longest)) if self.scores else ():
                at += 1
                if at >= new:
                    reach(at)
                    s, k = best[at - size] + p, least[at - size] + 1
                    if s > best[at] or (s == best[at] and k < least[at]):
                        best[at], least[at] = s, k
            reach(len(text))
            self.score[word], self.count[word] = best[len(text)], least[len(text)]
            self.held += ENTRY + len(word)

    def count_all(self, texts: list[bytes]) -> list[tuple[int, int, float]]:
        """Pre-tokens, tokens and log probability of each text in UTF-8; pre-tokens are what the white space of ASCII divides."""
        split = [t.split() for t in texts]
        self.add({w for ws in split for w in ws}.difference(self.count))
        out = [(len(ws), sum(map(self.count.__getitem__, ws)), math.fsum(map(self.score.__getitem__, ws))) for ws in split]
        if self.held > CACHE:
            self.count.clear()
            self.score.clear()
            self.held = 0
        return out


_loaded: dict[str, Unigram] = {}


def load(path: str) -> Unigram:
    if path not in _loaded:
        _loaded[path] = Unigram.from_pieces(path)
    return _loaded[path]


def default_path() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("piece_bpe_32k.model")
    except ImportError:
        return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"


def _count(batches, path: str):
    model = load(path)
    for batch in batches:
        for ids, texts in byte_batches(batch):
            got = model.count_all(texts)
            yield pa.RecordBatch.from_arrays(
                [ids] + [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"]
            )


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_prob) for each row of docs (doc_id, text).

    A null text, an empty one or one without words has no tokens and log_prob 0.  Texts of any length are counted whole;
    repeated rows give repeated results, a null doc_id is kept, other columns are ignored, an empty table gives none.
    """
    path = path or default_path()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _count(b, path), "doc_id long, n_pretokens long, n_tokens long, log_prob double"
    )


def op10_unigram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op10_unigram_trie": op10_unigram_trie}
SQL: dict[str, str] = {}
