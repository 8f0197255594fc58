"""Signals of a normalized text as Column expressions, all of them evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets as c

_HIGH = r"[\x{1100}-\x{11FF}\x{2E80}-\x{10FFFF}]"


def f32(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("float")


def ratio(a: Column, b: Column) -> Column:
    """a / b in single precision; null where b is 0."""
    return (a.cast("float") / F.nullif(b, F.lit(0)).cast("float")).cast("float")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once per row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def round2(x: Column) -> Column:
    return (F.round((x * f32(100)).cast("float"), 0) / f32(100)).cast("float")


def composed(text: Column) -> Column:
    """NFC.  Code points below U+0300 are composed already, so that most texts skip the call."""
    done = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), done).otherwise(text)


def normalized(text: Column) -> Column:
    bare = F.regexp_replace(composed(text), rf"[\x{{0}}{c.CONTROL}]", "")
    return F.trim(F.regexp_replace(bare, f"[{c.SPACE}]+", " "))


def count_class(s: Column, body: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, f"[{body}]", ""))


def count_set(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def count_matches(s: Column, word: str) -> Column:
    """Occurrences of word that don't overlap."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(word), F.lit("")))) / len(word)).cast("int")


def beyond_latin(norm: Column) -> Column:
    """Whether a text has letters that the classes beyond Latin and the Chinese marker sets can hold.

    Keep it as a column: one scan then spares most texts the scans of all these classes.
    """
    return norm.rlike(_HIGH)


def _if(high: Column, x: Column) -> Column:
    return F.when(high, x).otherwise(F.lit(0))


def visible_chars(norm: Column) -> Column:
    return F.length(F.regexp_replace(norm, f"[{c.PUNCTUATION}]", ""))


def script_counts(norm: Column, high: Column) -> dict[str, Column]:
    """Code points of each script; texts without any beyond Latin skip the other classes."""
    latin = count_class(norm, c.LATIN)
    counts = {"latin": latin}
    for name, body in (("hiragana", c.HIRAGANA), ("katakana", c.KATAKANA), ("han", c.HAN), ("hangul", c.HANGUL)):
        counts[name] = _if(high, count_class(norm, body))
    return counts


def other_count(norm: Column, *supported: Column) -> Column:
    out = F.length(F.replace(norm, F.lit(" "), F.lit("")))
    for s in supported:
        out = out - s
    return out


def markers(norm: Column, high: Column) -> dict[str, Column]:
    out = {"vi": count_class(norm, c.VI_MARKERS), "fr": count_set(norm, c.FR_MARKERS)}
    return out | {name: _if(high, count_set(norm, letters)) for name, letters in c.MARKERS.items()}


def latin_text(norm: Column) -> Column:
    return F.lower(F.regexp_replace(norm, f"[^{c.LATIN} ]", ""))


def ngram_hits(norm: Column) -> dict[str, Column]:
    s = latin_text(norm)

    def total(grams):
        out = F.lit(0)
        for g in grams:
            out = out + count_matches(s, g)
        return out

    return {"en_hits": total(c.EN_NGRAMS), "vi_hits": total(c.VI_NGRAMS)}


def ending_hits(norm: Column, high: Column) -> dict[str, Column]:
    out = {}
    for lang, words in c.ENDINGS.items():
        total = F.lit(0)
        for w in words:
            total = total + count_matches(norm, w)
        out[lang] = _if(high, total)
    return out


def sentences(norm: Column) -> Column:
    # Pieces end after a terminator; those beyond the last that counts stay one piece, which isn't looked through.
    pieces = F.slice(F.split(norm, c.SENTENCE_END, c.SENTENCES + 1), 1, c.SENTENCES)
    return F.filter(F.transform(pieces, lambda s: F.ltrim(s)), lambda s: s != "")


def sentence_language(s: Column) -> Column:
    """The language of one sentence, null if no letter of a supported script is in it."""
    dense = ratio(count_class(s, c.VI_MARKERS), count_class(s, c.LATIN)) >= f32(0.05)
    latin = s.rlike(f"[{c.LATIN}]")
    hans, hant = s.rlike(f"[{c.HANS_ONLY}]"), s.rlike(f"[{c.HANT_SENTENCE}]")
    low = F.when(s.rlike(f"[{c.VI_MARKERS}]"), F.when(dense, "vi").otherwise("en")).when(latin, "en")
    return (
        F.when(~s.rlike(_HIGH), low)
        .when(s.rlike(f"[{c.KANA}]"), "ja")
        .when(s.rlike(f"[{c.HANGUL}]"), "ko")
        .when(s.rlike(f"[{c.HAN}]") & ~latin, F.when(hans & ~hant, "zh-Hans").when(hant & ~hans, "zh-Hant").otherwise("zh"))
        .otherwise(low)
    )


CONTEXT_TAGS = ["en", "ja", "ko", "vi", "zh", "zh-Hans", "zh-Hant"]


def context(sentence_array: Column, language_array: Column) -> dict[str, Column]:
    """Sentences of each language, embedded runs of Han letters, and whether the text is one of several languages."""
    def number(tag: str) -> Column:
        return F.size(F.filter(language_array, lambda x: x == tag))

    out = {f"ctx_{t}": number(t) for t in CONTEXT_TAGS}
    runs = F.aggregate(
        F.zip_with(sentence_array, language_array, lambda s, x: F.when(x.isNotNull() & ~x.startswith("zh"), F.when(s.rlike(f"[{c.HAN}]{{5}}"), F.regexp_count(s, F.lit(f"[{c.HAN}]{{5,}}"))).otherwise(0)).otherwise(0)),
        F.lit(0), lambda a, x: a + x,
    )
    groups = F.array(out["ctx_en"], out["ctx_ja"], out["ctx_ko"], out["ctx_vi"], out["ctx_zh"] + out["ctx_zh-Hans"] + out["ctx_zh-Hant"])
    order = F.sort_array(groups, asc=False)
    several = (F.element_at(order, 2) >= 1) & (F.element_at(order, 2) * 5 >= F.element_at(order, 1))
    return out | {"embedded_han_runs": runs, "multi_language": several | (runs >= 2), "ctx_sentences": F.aggregate(groups, F.lit(0), lambda a, x: a + x)}


def macro_of(tag: Column) -> Column:
    return F.when(tag.isin(c.SINITIC), "zh").otherwise(tag)


def variants_of(macro: Column) -> Column:
    out = F.array().cast("array<string>")
    for m, v in c.VARIANTS.items():
        out = F.when(macro == m, F.array(*map(F.lit, v))).otherwise(out)
    return out


def hant_tag(hk: Column, tw: Column) -> Column:
    return F.when((hk > 0) & (tw == 0), "zh-Hant-HK").when((tw > 0) & (hk == 0), "zh-Hant-TW").otherwise("zh-Hant")


def han_strategy(s: dict[str, Column]) -> Column:
    """The tag that Han letters get: `ja` where kana claims them, `zh` where nothing decides."""
    kana, hans, hant = s["kana"], s["hans"], s["hant"]
    flavour = hant_tag(s["hk"], s["tw"])
    return (
        F.when((s["lzh"] >= 3) & (s["han"] >= 4), "lzh")
        .when(s["yue"] > 0, "yue")
        .when((hans > kana) & (hant == 0), "zh-Hans")
        .when((hant > kana) & (hans == 0), flavour)
        .when(kana > 0, "ja")
        .when((hans > 0) & (hant == 0), "zh-Hans")
        .when((hant > 0) & (hans == 0), flavour)
        .otherwise("zh")
    )


def has_yue_marker(text: Column) -> Column:
    return text.rlike(f"[{c.YUE}]")


def is_classical_chinese(text: Column) -> Column:
    """At least four Han letters, three of them classical function words."""
    return (count_class(text, c.HAN) >= 4) & (count_set(text, c.LZH) >= 3)


def resolved_zh(text: Column) -> Column:
    """The Sinitic tag of a text that a classifier calls Chinese."""
    hk, tw = text.rlike(f"[{c.HK}]"), text.rlike(f"[{c.TW}]")
    return (
        F.when(has_yue_marker(text), "yue")
        .when(is_classical_chinese(text), "lzh")
        .when(text.rlike(f"[{c.HANT_ONLY}]"), F.when(hk & ~tw, "zh-Hant-HK").when(tw & ~hk, "zh-Hant-TW").otherwise("zh-Hant"))
        .otherwise("zh-Hans")
    )
