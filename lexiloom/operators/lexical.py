"""Relational forms of the token layers: exploded tokens against a broadcast lexicon.

The lexicon has at most MOST_WORDS words for each of its tags, so that its size on a broadcast is bounded.  Tokens are
counted per document before they meet the lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as c
from ..functions import columns as x
from ..sources.lexicon import bounded, function_words


def runs(s: Column, body: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"([{body}]+)"), F.lit(1))


def _windows(s: Column, n: int) -> Column:
    def cut(i):
        return F.substr(s, i, F.lit(n))

    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), cut)).otherwise(F.array().cast("array<string>"))


def latin_tokens(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token, n): runs of Latin letters in their case, with their number."""
    return df.select(id_col, F.explode(runs(F.col("norm"), c.LATIN)).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def cjk_windows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token, n): substrings of 2 to 4 letters of the text's Han, kana and Hangul, whatever stands between them."""
    only = df.where(x.beyond_latin(F.col("norm"))).select(id_col, F.regexp_replace("norm", f"[^{c.CJK}]", "").alias("s"))
    parts = F.concat(*(_windows(F.col("s"), n) for n in (2, 3, 4)))
    return only.select(id_col, F.explode(parts).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def cjk_grams(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token, n): single Han, kana and Hangul letters and adjacent pairs."""
    blocks = df.where(x.beyond_latin(F.col("norm"))).select(id_col, F.explode(runs(F.col("norm"), c.CJK)).alias("s"))
    parts = F.concat(*(_windows(F.col("s"), n) for n in (1, 2)))
    return blocks.select(id_col, F.explode(parts).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def function_word_hits(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, lang, hits): occurrences of function words of each language."""
    words = function_words(lexicon)
    latin = latin_tokens(df, id_col).withColumn("word", F.lower("token")).join(F.broadcast(words.where(F.col("lang").isin(c.LATIN_TAGS))), "word")
    cjk = cjk_grams(df, id_col).withColumnRenamed("token", "word").join(F.broadcast(words.where(F.col("lang").isin(c.CJK_WORD_TAGS))), "word")
    return latin.select(id_col, "lang", "n").union(cjk.select(id_col, "lang", "n")).groupBy(id_col, "lang").agg(F.sum("n").alias("hits"))


def _probed(df: DataFrame, lexicon: DataFrame, id_col: str) -> DataFrame:
    """(id, token, langs): the distinct tokens of a text and the lexicons that hold them."""
    words = bounded(lexicon).select("lang", "word").distinct()
    latin = F.broadcast(words.where(F.col("lang").isin(c.LATIN_TAGS)).groupBy(F.col("word").alias("low")).agg(F.collect_set("lang").alias("low_langs")))
    raw = F.broadcast(words.where(~F.col("lang").isin(c.LATIN_TAGS)).groupBy(F.col("word").alias("token")).agg(F.collect_set("lang").alias("raw_langs")))
    tokens = latin_tokens(df, id_col).select(id_col, "token").union(cjk_windows(df, id_col).select(id_col, "token"))
    none = F.array().cast("array<string>")
    found = tokens.withColumn("low", F.lower("token")).join(latin, "low", "left").join(raw, "token", "left")
    return found.select(id_col, "token", F.concat(F.coalesce("low_langs", none), F.coalesce("raw_langs", none)).alias("langs")).where(F.size("langs") > 0)


def dictionary_hits(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, lang, hits, exclusive, shared): distinct tokens that a lexicon holds, alone or with others."""
    each = _probed(df, lexicon, id_col).select(id_col, F.explode("langs").alias("lang"), (F.size("langs") == 1).cast("int").alias("alone"))
    return each.groupBy(id_col, "lang").agg(F.count("*").alias("hits"), F.sum("alone").alias("exclusive"), F.sum(1 - F.col("alone")).alias("shared"))


def dictionary_totals(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, recognized, ambiguous): distinct tokens in one lexicon at least, and in two at least."""
    return _probed(df, lexicon, id_col).groupBy(id_col).agg(F.count("*").alias("recognized"), F.sum((F.size("langs") > 1).cast("int")).alias("ambiguous"))


def word_attribution(token: Column, en: Column, fr: Column, vi: Column, top_en: Column, top_fr: Column) -> Column:
    """The language of a run of Latin letters by its marks, then by the lexicons that hold it."""
    word = F.lower(token)
    shape = F.when(word.rlike(c.VI_SHAPE[0]) & word.rlike(c.VI_SHAPE[1]), "vi").otherwise("en")
    return (
        F.when(token.rlike(f"[{c.VI_MARKERS}]"), "vi")
        .when(token.rlike(f"[{c.FR_MARKERS}]"), "fr")
        .when(en & fr, F.when(top_fr & ~top_en, "fr").otherwise("en"))
        .when(en & vi, shape)
        .when(fr, "fr")
        .when(en, "en")
        .when(vi, "vi")
    )


def latin_attribution(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, lang, n_tokens, n_chars): runs of Latin letters attributed to a language."""
    flags = [F.max(((F.col("lang") == t)).cast("int")).cast("boolean").alias(t) for t in c.LATIN_TAGS]
    tops = [F.max(((F.col("lang") == t) & (F.col("rank") <= c.TOP_WORDS)).cast("int")).cast("boolean").alias(f"top_{t}") for t in ("en", "fr")]
    words = F.broadcast(bounded(lexicon).where(F.col("lang").isin(c.LATIN_TAGS)).groupBy("word").agg(*flags, *tops))
    found = latin_tokens(df, id_col).withColumn("word", F.lower("token")).join(words, "word", "left").fillna(False)
    lang = word_attribution(F.col("token"), *(F.col(k) for k in ("en", "fr", "vi", "top_en", "top_fr")))
    tagged = found.withColumn("lang", lang).where("lang is not null")
    return tagged.groupBy(id_col, "lang").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.length("token")).alias("n_chars"))
