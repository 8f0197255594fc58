"""Per-document work that expressions can't do in one pass: lexicon probes of all tokens, segments, tokens.

It runs in Arrow batches.  A lexicon of bounded size travels with the function, so that identification needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F

from ..sources.lexicon import Lexicon
from . import charsets as c


def _class(body: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), body)


LATIN, HAN, KANA, HANGUL, CJK = (_class(x) for x in (c.LATIN, c.HAN, c.KANA, c.HANGUL, c.CJK))
_LATIN_RUN = re.compile(f"[{LATIN}]+")
_CJK_RUN = re.compile(f"[{CJK}]+")
_VI = re.compile(f"[{_class(c.VI_MARKERS)}]")
_FR = re.compile(f"[{c.FR_MARKERS}]")
_SHAPE = tuple(map(re.compile, c.VI_SHAPE))

FUNCTION_TAGS = c.LATIN_TAGS + c.CJK_WORD_TAGS
FIELDS = (
    [f"fw_{t}" for t in FUNCTION_TAGS]
    + [f"{kind}_{t}" for kind in ("excl", "shared") for t in c.LEXICON_TAGS]
    + ["recognized", "ambiguous"]
    + [f"attr_{t}" for t in c.LATIN_TAGS]
    + [f"chars_{t}" for t in c.LATIN_TAGS]
)


#: Decisions on runs of letters that a worker keeps; beyond it starts anew.
DECIDED = 100_000


def attributed(token: str, lexicon: Lexicon) -> str | None:
    """The language of a run of Latin letters, None if neither letters nor lexicons tell."""
    try:
        return lexicon.decided[token]
    except KeyError:
        if len(lexicon.decided) >= DECIDED:
            lexicon.decided.clear()
        lexicon.decided[token] = lang = _decide(token, lexicon)
        return lang


def _decide(token: str, lexicon: Lexicon) -> str | None:
    if _VI.search(token):
        return "vi"
    if _FR.search(token):
        return "fr"
    word = token.lower()
    tags = set(lexicon.tags.get(word, ())) & {"en", "fr", "vi"}
    if not tags:
        return None
    if len(tags) == 1:
        return tags.pop()
    if tags == {"en", "vi"}:
        return "vi" if _SHAPE[0].search(word) and _SHAPE[1].search(word) else "en"
    if tags == {"fr", "vi"}:
        return "fr"
    top = lexicon.top.get(word, ())
    return "fr" if "fr" in top and "en" not in top else "en"


_AT = {f: i for i, f in enumerate(FIELDS)}


def _probed(token: str, lexicon: Lexicon) -> tuple | None:
    """What a run of Latin letters counts for: places of function-word hits, lexicons, and its language; None if for nothing."""
    word = token.lower()
    hits = [_AT[f"fw_{t}"] for t in lexicon.top.get(word, ()) if t in c.LATIN_TAGS]
    known, raw = lexicon.tags.get(word, ()), lexicon.tags.get(token, ())
    tags = [t for t in c.LEXICON_TAGS if t in (known if t in c.LATIN_TAGS else raw)]
    lang = attributed(token, lexicon)
    return (hits, _held(tags), _AT[f"attr_{lang}"] if lang else -1, _AT[f"chars_{lang}"] if lang else -1) if hits or tags or lang else None


def _held(tags) -> list[int]:
    """Places that a token in these lexicons adds one to."""
    if not tags:
        return []
    return [_AT["recognized"]] + [_AT["ambiguous"]] * (len(tags) > 1) + [_AT[f"{'excl' if len(tags) == 1 else 'shared'}_{t}"] for t in tags]


def lexical(norm: str, lexicon: Lexicon) -> list[int]:
    """The counts FIELDS of one normalized text; what a token counts for is looked up once for many texts."""
    out = [0] * len(FIELDS)
    probes = lexicon.probes
    for token, n in Counter(_LATIN_RUN.findall(norm)).items():
        try:
            found = probes[token]
        except KeyError:
            if len(probes) >= DECIDED:
                probes.clear()
            probes[token] = found = _probed(token, lexicon)
        if found is None:
            continue
        hits, held, attr, chars = found
        for at in hits:
            out[at] += n
        for at in held:
            out[at] += 1
        if attr >= 0:
            out[attr] += n
            out[chars] += n * len(token)
    if not norm.isascii() and _CJK_RUN.search(norm):
        blocks = _CJK_RUN.findall(norm)
        for block in blocks:
            for size in (1, 2):
                for i in range(len(block) - size + 1):
                    for t in lexicon.top.get(block[i : i + size], ()):
                        if t in c.CJK_WORD_TAGS:
                            out[_AT[f"fw_{t}"]] += 1
        joined = "".join(blocks)
        for w in {joined[i : i + size] for size in (2, 3, 4) for i in range(len(joined) - size + 1)}:
            for at in _held(lexicon.tags.get(w, ())):
                out[at] += 1
    return out


def lexical_udf(lexicon: Lexicon):
    """Column function: the struct of FIELDS of a normalized text."""

    @F.arrow_udf("struct<" + ",".join(f"`{f}`:int" for f in FIELDS) + ">")
    def score(norm: pa.Array) -> pa.Array:
        rows = [lexical(x or "", lexicon) for x in norm.to_pylist()]
        columns = zip(*rows) if rows else [()] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in columns], FIELDS)

    return score


# --- segments ------------------------------------------------------------------------------------------------------

_PIECE = re.compile(f"(?P<latin>[{LATIN}]+(?: [{LATIN}]+)*)|(?P<han>[{HAN}]+)|(?P<ja>[{KANA}]+)|(?P<ko>[{HANGUL}]+)")
_LETTERS = re.compile(f"(?P<vi>[{_class(c.VI_MARKERS)}]+)|(?P<fr>[{c.FR_MARKERS}]+)|(?P<ascii>[A-Za-z]+)|(?P<rest>.)", re.S)
_REGION = re.compile(f"[^{KANA}{HANGUL}]+")
_FIRST_HAN = re.compile(f"[{HAN}]")


def _override(region: str) -> str | None:
    """The tag of the Han letters of a region between kana, where its markers decide."""
    n = {name: sum(map(letters.__contains__, region)) for name, letters in c.MARKERS.items()}
    if not any(n[k] for k in ("hans", "hant", "yue", "lzh", "hk", "tw")):
        return None
    if n["yue"]:
        return "yue"
    if n["lzh"] >= 3 and len(_FIRST_HAN.findall(region)) >= 4:
        return "lzh"
    if n["hk"] and not n["tw"]:
        return "zh-Hant-HK"
    if n["tw"] and not n["hk"]:
        return "zh-Hant-TW"
    if n["hant"] and not n["hans"]:
        return "zh-Hant"
    if n["hans"] and not n["hant"]:
        return "zh-Hans"
    return None


def han_overrides(norm: str, strategy: str) -> list[tuple[int, int, str]]:
    """(start, end, tag) of regions between kana or Hangul, from their first Han letter on, that aren't Japanese."""
    out = []
    if strategy == "ja":
        for m in _REGION.finditer(norm):
            first = _FIRST_HAN.search(m[0])
            tag = _override(m[0][first.start() :]) if first else None
            if tag:
                out.append((m.start() + first.start(), m.end(), tag))
    return out


def spans(norm: str, vi: int, fr: int, strategy: str, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """(tag, start, end) in characters: maximal runs of one language, joined over white space."""
    pieces: list[tuple[str, int, int]] = []
    overrides = han_overrides(norm, strategy)
    at = 0
    plain = "fr" if fr and not vi else "en"  # of ASCII letters that nothing else decides
    for m in _PIECE.finditer(norm):
        a, b = m.span()
        kind = m.lastgroup
        if kind == "latin":
            words = m[0].split(" ")
            langs = [attributed(w, lexicon) or (plain if w.isascii() else None) for w in words]
            if len(set(langs)) == 1 and langs[0]:
                pieces.append((langs[0], a, b))
                continue
            for word, lang in zip(words, langs):
                if lang:
                    pieces.append((lang, a, a + len(word)))
                else:
                    for x in _LETTERS.finditer(word):
                        tag = x.lastgroup
                        if tag == "ascii":
                            tag = plain
                        elif tag == "rest":
                            tag = "vi" if vi else "fr" if fr else "en"
                        pieces.append((tag, a + x.start(), a + x.end()))
                a += len(word) + 1
        elif kind == "han":
            while at < len(overrides) and overrides[at][1] <= a:
                at += 1
            inside = at < len(overrides) and overrides[at][0] <= a < overrides[at][1]
            pieces.append((overrides[at][2] if inside else strategy, a, b))
        else:
            pieces.append((kind, a, b))
    out: list[tuple[str, int, int]] = []
    for lang, a, b in pieces:
        if out and out[-1][0] == lang and not norm[out[-1][2] : a].strip():
            out[-1] = (lang, out[-1][1], b)
        else:
            out.append((lang, a, b))
    return out


# --- tokens --------------------------------------------------------------------------------------------------------

_BOUNDARY = regex.compile(r"(?V1w)\b")  # the default word boundaries of Unicode
_WRITTEN = re.compile(f"[{CJK}]+|[^{CJK}]+")
#: Letters of a word in the lattice at most, and what a letter that no word holds costs beside the rarest word.
WORD_LETTERS, UNKNOWN = 6, 4.0
#: Bytes of texts whose segments, and tokens that are Python objects at once; all others are Arrow columns by then.
PIECE = 1 << 17


def words_of(text: str) -> Iterator[tuple[int, int]]:
    """The pieces between word boundaries that aren't white space."""
    a = 0
    for m in _BOUNDARY.finditer(text):
        b = m.start()
        if b > a and not text[a:b].isspace():
            yield a, b
        a = b
    if text[a:].strip():
        yield a, len(text)


def lattice(text: str, cost) -> list[tuple[int, int]]:
    """The words of the cheapest way through the lattice of a run; cost(word) is None for what is no word.

    A single letter is always one, at the cost of a rare word if the lexicon has none of it.  Of equally cheap ways the one
    with the longer last words is taken.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for n in range(1, len(text) + 1):
        ways = []
        for a in range(max(0, n - WORD_LETTERS), n):
            c = cost(text[a:n])
            if c is None and n - a == 1:
                c = cost("") + UNKNOWN
            if c is not None:
                ways.append((best[a][0] + c, a))
        best.append(min(ways))
    out, n = [], len(text)
    while n:
        out.append((best[n][1], n))
        n = best[n][1]
    return out[::-1]


def tokens(text: str, lang: str, lexicon: Lexicon) -> Iterator[tuple[str, int, int]]:
    """(token, start, end) in characters: Chinese and Japanese by the lattice of the lexicon's words, all else by word boundaries."""
    if lang not in c.SINITIC and lang != "ja":
        for a, b in words_of(text):
            yield text[a:b], a, b
        return
    cost = lexicon.costs("ja" if lang == "ja" else "zh")
    for m in _WRITTEN.finditer(text):
        found = lattice(m[0], cost) if _CJK_RUN.match(m[0]) else words_of(m[0])
        for a, b in found:
            yield m[0][a:b], m.start() + a, m.start() + b


SEGMENT = "array<struct<language:string,start:int,end:int,text:string,tokens:array<struct<text:string,start:int,end:int>>>>"
_TOKEN_ARROW = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def segments(norm: str, vi: int, fr: int, strategy: str, lexicon: Lexicon) -> list[tuple[str, int, int, str]]:
    """(tag, start, end, text) of the segments of a text, with byte offsets."""
    found = spans(norm, vi, fr, strategy, lexicon)
    if norm.isascii():
        return [(lang, a, b, norm[a:b]) for lang, a, b in found]
    out, byte, at = [], 0, 0
    for lang, a, b in found:
        start = byte + len(norm[at:a].encode())
        text = norm[a:b]
        byte, at = start + len(text.encode()), b
        out.append((lang, start, byte, text))
    return out


def byte_offsets(text: str, start: int) -> Sequence[int]:
    """The byte at which each character of a text that starts at byte start begins, and the end of the text."""
    if text.isascii():
        return range(start, start + len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return start + np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))


def token_lists(found: list[tuple[str, int, int, str]], lexicon: Lexicon) -> pa.Array:
    """The tokens of each segment, (tag, start, end, text), null if there are none; PIECE of them at most are Python objects at once."""
    bounds, parts = [], []
    words: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    done = 0

    def put():
        parts.append(pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(_TOKEN_ARROW)))
        for x in (words, starts, ends):
            x.clear()

    for lang, start, _, text in found:
        offset, first = byte_offsets(text, start), done
        for w, a, b in tokens(text, lang, lexicon):
            words.append(w)
            starts.append(offset[a])
            ends.append(offset[b])
            done += 1
            if len(words) >= PIECE:
                put()
        bounds.append(first if done > first else None)
    put()
    return pa.ListArray.from_arrays(pa.array([*bounds, done], pa.int32()), pa.concat_arrays(parts))


def segment_lists(texts: Iterable[tuple[str | None, int, int, str]], lexicon: Lexicon, tokenize: bool) -> pa.Array:
    """SEGMENT of each (normalized text, vi markers, fr markers, Han strategy)."""
    sizes, rows = [0], []
    for x, a, b, s in texts:
        if x:
            rows += segments(x, a, b, s, lexicon)
        sizes.append(len(rows))
    langs, starts, ends, found = zip(*rows) if rows else ((), (), (), ())
    words = token_lists(rows, lexicon) if tokenize else pa.nulls(len(rows), pa.list_(_TOKEN_ARROW))
    parts = [pa.array(langs, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string()), words]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(parts, ["language", "start", "end", "text", "tokens"]))


def ranges(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of texts with about PIECE bytes in each; one range at least."""
    bounds, size = [0], 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= PIECE:
            bounds.append(i + 1)
            size = 0
    if bounds[-1] < len(texts) or len(texts) == 0:
        bounds.append(len(texts))
    return list(zip(bounds, bounds[1:]))


def segments_udf(lexicon: Lexicon, tokenize: bool = False):
    """Column function (normalized text, vi markers, fr markers, Han strategy) -> SEGMENT, with byte offsets."""

    @F.arrow_udf(SEGMENT)
    def extract(norm: pa.Array, vi: pa.Array, fr: pa.Array, strategy: pa.Array) -> pa.Array:
        columns = norm, vi, fr, strategy
        return pa.concat_arrays([segment_lists(zip(*(v[a:b].to_pylist() for v in columns)), lexicon, tokenize) for a, b in ranges(norm)])

    return extract


def overrides_udf():
    """Column function (normalized text, Han strategy) -> the Han overrides, in characters."""

    @F.pandas_udf("array<struct<start:int,end:int,tag:string>>")
    def extract(norm: pd.Series, strategy: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "tag": t} for a, b, t in han_overrides(x or "", s)] for x, s in zip(norm, strategy)], dtype=object)

    return extract
