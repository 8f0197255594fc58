"""Lexicons: a table (lang, rank, word), ranked by frequency from 1."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.charsets import LATIN, LEXICON_TAGS, LZH_WORDS, SINITIC, TOP_WORDS, YUE_WORDS

SCHEMA = "lang string, rank int, word string"
#: Words of one lexicon at most, so that its size on a broadcast is bounded.
MOST_WORDS = 10_000
#: Parts in which a language's words are ranked first.
PARTS = 64

#: A seed of everyday words, the most frequent first.
SEED = {
    "en": "the of and to in is that it was for on are as with be this from at by not or an we she he market bread fish sea near fresh old small today",
    "fr": "le la les de des du un une et est que qui dans pour sur ce je il nous pas avec plus pain marché soir pluie avant cherche four à on",
    "vi": "là và của không có ở gần cũ mới cá chợ biển bánh tươi nhà mưa trời chúng tôi tranh khanh on",
    "ja": "の は を に が と で 海 市場 魚 店 新しい 近く 山",
    "ko": "는 은 이 가 을 시장 바다 생선 아침 오늘",
    "zh-Hans": "的 是 在 了 我 市场 鱼 水果 便宜 我们 海 山 这个 没有",
    "zh-Hant": "的 是 在 了 我 市場 魚 海邊 這個 海 山",
    "zh-Hant-HK": "街市 的士",
    "zh-Hant-TW": "臺北 計程車",
    "yue": "我哋 佢哋 買嘢",
    "lzh": "不在 而已",
    "nan": "阮 甲",
    "hak": "\U0002828E",
    "wuu": "儂去",
}


def seed_rows() -> list[tuple[str, int, str]]:
    return [(lang, r, w) for lang in LEXICON_TAGS for r, w in enumerate(SEED[lang].split(), 1)]


def seed_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_rows(), SCHEMA)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from Parquet files with (lang, rank, word)."""
    return bounded(spark.read.schema(SCHEMA).parquet(path))


def read_word_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon from text files lexicon_<tag>.txt, one word a line, the most frequent first; empty lines are left out.

    A tag's line number is its rank, so each file is read whole.
    """
    files = spark.read.text(f"{folder}/lexicon_*.txt", wholetext=True).select(F.input_file_name().alias("file"), "value")
    tag = F.replace(F.regexp_extract("file", r"lexicon_([^/]+)\.txt$", 1), F.lit("_"), F.lit("-"))
    words = files.select(tag.alias("lang"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda w: w != "")).alias("rank", "word"))
    return bounded(words.select("lang", (F.col("rank") + 1).alias("rank"), "word"))


def bounded(lexicon: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    return lexicon.where((F.col("rank") <= most) & F.col("lang").isin(LEXICON_TAGS))


def corpus_lexicon(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_WORDS) -> DataFrame:
    """A lexicon derived from texts with a declared language: its words by count, then alphabetically.

    Words are runs of two Latin letters and more, in lower case; counts are partial before the shuffle.
    """
    words = docs.select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"([{LATIN}]{{2,}})"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # A language's first words are among the first of each of its parts, so that no task sorts a language's whole vocabulary.
    part = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return part.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "word", "n")


def derived_lexicon(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_WORDS) -> DataFrame:
    """A lexicon for identify(): that of the corpus for the languages that docs declare and lexicons are known for, the seed for the others."""
    found = corpus_lexicon(docs.where(F.col(lang).isin(LEXICON_TAGS)), text, lang, most).select("lang", F.col("rank").cast("int").alias("rank"), "word")
    return found.unionByName(seed_lexicon(docs.sparkSession).join(found.select("lang").distinct(), "lang", "left_anti").select("lang", "rank", "word"))


def function_words(lexicon: DataFrame) -> DataFrame:
    """(lang, word): the first words of the lexicons that are scored, and the curated tables."""
    top = lexicon.where((F.col("rank") <= TOP_WORDS) & F.col("lang").isin("en", "fr", "vi", "ja", "zh-Hans", "zh-Hant", "ko")).select("lang", "word")
    curated = lexicon.sparkSession.createDataFrame([("yue", w) for w in YUE_WORDS] + [("lzh", w) for w in LZH_WORDS], "lang string, word string")
    return top.union(curated).distinct()


class Lexicon:
    """The words of a lexicon in memory, for the per-document kernel; its size is bounded by MOST_WORDS for each tag."""

    def __init__(self, rows):
        self.tags: dict[str, tuple[str, ...]] = {}
        found: dict[str, list[str]] = {}
        self.top: dict[str, tuple[str, ...]] = {}
        top: dict[str, list[str]] = {}
        rows = list(rows)
        for lang, rank, word in sorted(rows, key=lambda r: (LEXICON_TAGS.index(r[0]), r[1])):
            found.setdefault(word, [])
            if lang not in found[word]:
                found[word].append(lang)
            if rank <= TOP_WORDS and lang in ("en", "fr", "vi", "ja", "zh-Hans", "zh-Hant", "ko"):
                top.setdefault(word, []).append(lang)
        for lang, words in (("yue", YUE_WORDS), ("lzh", LZH_WORDS)):
            for w in words:
                top.setdefault(w, []).append(lang)
        self.tags = {w: tuple(v) for w, v in found.items()}
        self.top = {w: tuple(dict.fromkeys(v)) for w, v in top.items()}
        self.decided: dict[str, str | None] = {}
        self.probes: dict[str, tuple | None] = {}
        self.rank: dict[str, dict[str, int]] = {"ja": {}, "zh": {}}
        for lang, r, word in rows:
            of = "ja" if lang == "ja" else "zh" if lang in SINITIC else None
            if of:
                self.rank[of][word] = min(r, self.rank[of].get(word, r))

    def costs(self, lang: str):
        """Word -> cost in a lattice, by Zipf's law of its rank in the language's lexicons, None for what is no word; of "" that of the rarest."""
        rank = self.rank[lang]
        last = max(rank.values(), default=1)

        def cost(word: str) -> float | None:
            r = last if not word else rank.get(word)
            return None if r is None else math.log(r + 2.7) + 2.0

        return cost

    @classmethod
    def of(cls, lexicon: DataFrame | None) -> "Lexicon":
        if lexicon is None:
            return cls(seed_rows())
        return cls((r["lang"], r["rank"], r["word"]) for r in bounded(lexicon).collect())
