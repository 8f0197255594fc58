"""Identification: layers 0 to 7 and 9, aggregation, macro grouping, calibration.

Everything is a projection of one row: no join, no shuffle, no state, so that the same plan serves batches and streams.
Confidence arithmetic is in single precision, and sums run in the order of the tags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as c
from ..functions import columns as x
from ..functions import kernel
from ..sources.lexicon import Lexicon
from ..sources.shared import bound_batches
from .options import IdentifyOptions

f32 = x.f32


def _zero() -> Column:
    return f32(0)


def with_normalized(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds norm and visible_chars."""
    return df.withColumn("norm", x.normalized(F.col(text_col))).withColumn("visible_chars", x.visible_chars(F.col("norm")))


def with_signals(df: DataFrame, options: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """Adds the signals of all layers as columns of their own; needs norm."""
    norm, high = F.col("norm"), F.col("beyond_latin")
    df = df.withColumn("beyond_latin", x.beyond_latin(norm))
    df = df.select("*", *(v.alias(k) for k, v in x.script_counts(norm, high).items()), *(v.alias(k) for k, v in x.markers(norm, high).items()), *(v.alias(f"end_{k}") for k, v in x.ending_hits(norm, high).items()), x.sentences(norm).alias("sentences"))
    df = df.withColumn("kana", F.col("hiragana") + F.col("katakana")).withColumn("total", F.col("latin") + F.col("kana") + F.col("han") + F.col("hangul"))
    df = df.withColumn("other", F.length(F.replace(norm, F.lit(" "), F.lit(""))) - F.col("total"))
    df = df.withColumn("sentence_languages", F.transform("sentences", x.sentence_language))
    df = df.select("*", *(v.alias(k) for k, v in x.context(F.col("sentences"), F.col("sentence_languages")).items()))
    lexicon = Lexicon.of(options.lexicon)
    df = df.withColumn("strategy", x.han_strategy({k: F.col(k) for k in ("kana", "han", "hans", "hant", "lzh", "yue", "hk", "tw")}))
    kernels = {"lexical": kernel.lexical_udf(lexicon)(norm)}
    if options.segments:
        if options.tokenize:
            bound_batches(df.sparkSession)
        kernels["spans"] = kernel.segments_udf(lexicon, options.tokenize)(norm, "vi", "fr", "strategy")
    df = df.withColumns(kernels).select("*", "lexical.*").drop("lexical")
    # The n-grams decide only where no letter mark and no lexicon does.
    grams = x.ngram_hits(norm)
    undecided = (F.col("latin") > 0) & (F.col("attr_en") + F.col("attr_fr") + F.col("attr_vi") + F.col("vi") + F.col("fr") == 0)
    return df.withColumn("ngram_vi", F.when(undecided, grams["vi_hits"] > 3 * grams["en_hits"]).otherwise(F.lit(False)))


def _share(a: Column) -> Column:
    return F.coalesce(x.ratio(a, F.col("total")), _zero())


def _capped(n: Column, rule: tuple[float, float]) -> Column:
    return F.least((f32(rule[0]) * n.cast("float")).cast("float"), f32(rule[1]))


def script_weights() -> dict[str, list[Column]]:
    """For each tag what the scripts of a text add to its weight, in order."""
    k = F.col
    out: dict[str, list[Column]] = {t: [] for t in c.TAGS}
    out["ko"].append(_share(k("hangul")))
    latin, vi, fr = _share(k("latin")), k("vi"), k("fr")
    known = k("attr_en") + k("attr_fr") + k("attr_vi")
    for t in c.LATIN_TAGS:
        out[t].append(F.when(known > 0, _share(k(f"chars_{t}"))).otherwise(_zero()))
    rest = F.greatest(k("latin") - k("chars_en") - k("chars_fr") - k("chars_vi"), F.lit(0))
    rest_tag = F.when((vi >= 1) & (x.ratio(vi, k("latin")) >= f32(0.10)), "vi").when((fr >= 1) & (k("chars_fr") > 0), "fr").otherwise("en")
    dense_vi, dense_fr = x.ratio(vi, k("latin")) >= f32(0.10), x.ratio(fr, k("latin")) >= f32(0.05)
    vi_part, fr_part = F.least(_share(vi), latin), F.least(_share(fr), latin)
    plain = {
        "vi": F.when(dense_vi, latin).when(dense_fr, _zero()).when(vi >= 1, vi_part).when(fr >= 1, _zero()).when(k("ngram_vi"), latin).otherwise(_zero()),
        "fr": F.when(dense_vi, _zero()).when(dense_fr, latin).when(vi >= 1, _zero()).when(fr >= 1, fr_part).otherwise(_zero()),
        "en": F.when(dense_vi | dense_fr, _zero()).when(vi >= 1, (latin - vi_part).cast("float")).when(fr >= 1, (latin - fr_part).cast("float")).when(k("ngram_vi"), _zero()).otherwise(latin),
    }
    for t in c.LATIN_TAGS:
        out[t].append(F.when(k("latin") == 0, _zero()).when(known == 0, plain[t]).when((rest > 0) & (rest_tag == t), _share(rest)).otherwise(_zero()))
    out["ja"].append(_share(k("kana")))
    han = _share(k("han"))
    proof = k("kana") + k("hans") + k("hant") + k("nan") + k("hak") + k("wuu")
    classical = (k("lzh") >= 3) & (k("han") >= 4)
    hant = x.hant_tag(k("hk"), k("tw"))

    def part(n: Column, even: float) -> Column:
        split = F.when(proof > 0, (han * x.ratio(n, proof)).cast("float")).otherwise((han * f32(even)).cast("float"))
        return F.when((k("han") == 0) | classical | (k("yue") > 0), _zero()).otherwise(split)

    out["lzh"].append(F.when(classical, han).otherwise(_zero()))
    out["yue"].append(F.when(~classical & (k("yue") > 0), han).otherwise(_zero()))
    out["ja"].append(part(k("kana"), 0.50))
    out["zh-Hans"].append(part(k("hans"), 0.25))
    for t in ("zh-Hant", "zh-Hant-HK", "zh-Hant-TW"):
        out[t].append(F.when(hant == t, part(k("hant"), 0.25)).otherwise(_zero()))
    for t in ("nan", "hak", "wuu"):
        out[t].append(part(k(t), 0.0))
    return out


def _added(parts: list[Column]) -> Column:
    return reduce(lambda a, b: (a + b).cast("float"), parts) if parts else _zero()


def weights(ml: Column | None = None) -> Column:
    """array<struct<tag,w>> of the tags with a weight above 0, by tag."""
    k = F.col
    parts = script_weights()
    for t in c.TAGS:
        if t in kernel.FUNCTION_TAGS:
            parts[t].append(_capped(k(f"fw_{t}"), c.FUNCTION_WORD))
        if t in c.LEXICON_TAGS:
            parts[t] += [_capped(k(f"excl_{t}"), c.EXCLUSIVE), _capped(k(f"shared_{t}"), c.SHARED)]
        if t in ("en", "fr", "vi"):
            parts[t].append(_capped(k(f"attr_{t}"), c.MORPHOLOGY))
        if t in c.ENDINGS:
            parts[t].append(_capped(k(f"end_{t}"), c.MORPHOLOGY))
        if t in x.CONTEXT_TAGS:
            parts[t].append(_capped(k(f"ctx_{t}"), c.CONTEXT))

    def entry(tag: Column, w: Column) -> Column:
        return F.struct(tag.alias("tag"), w.alias("w"))

    known = F.array(*(entry(F.lit(t), _added(parts[t])) for t in c.TAGS))
    if ml is not None:
        scores = F.coalesce(ml, F.array().cast("array<struct<tag:string,conf:float>>"))

        def with_scores(tag: Column, w: Column) -> Column:
            return F.aggregate(F.filter(scores, lambda s: s.tag == tag), w, lambda a, s: (a + F.least((f32(c.ML[0]) * s.conf).cast("float"), f32(c.ML[1]))).cast("float"))

        more = F.array_except(F.array_distinct(F.transform(scores, lambda s: s.tag)), F.array(*map(F.lit, c.TAGS)))
        known = F.concat(F.transform(known, lambda e: entry(e.tag, with_scores(e.tag, e.w))), F.transform(more, lambda t: entry(t, with_scores(t, _zero()))))
    return F.array_sort(F.filter(known, lambda e: e.w > 0))


_ENTRY = "array<struct<language:string,confidence:float>>"


def _ranked(entries: Column) -> Column:
    """By confidence from the top, equal ones by tag."""
    return F.transform(F.array_sort(F.transform(entries, lambda e: F.struct((-e.confidence).alias("o"), e.language.alias("language"), e.confidence.alias("confidence")))), lambda e: F.struct(e.language.alias("language"), e.confidence.alias("confidence")))


def fine_distribution(w: Column) -> Column:
    """Rounded shares of the weights (by tag), ranked."""

    def shares(entries, total):
        found = F.transform(entries, lambda e: F.struct(e.tag.alias("language"), x.ratio(e.w, total).alias("confidence")))
        return F.transform(F.filter(found, lambda e: e.confidence > 0), lambda e: F.struct(e.language.alias("language"), x.round2(e.confidence).alias("confidence")))

    def sums(entries):
        return x.let(F.aggregate(entries, _zero(), lambda a, e: (a + e.w).cast("float")), lambda total: shares(entries, total))

    return _ranked(x.let(w, sums))


def macro_candidates(fine: Column) -> Column:
    def macros(entries):
        tags = F.array_sort(F.array_distinct(F.transform(entries, lambda e: x.macro_of(e.language))))

        def one(m):
            total = F.aggregate(F.filter(entries, lambda e: x.macro_of(e.language) == m), _zero(), lambda a, e: (a + e.confidence).cast("float"))
            return F.struct(m.alias("language"), x.round2(total).alias("confidence"))

        return F.transform(tags, one)

    return _ranked(x.let(fine, macros))


def primary_variant(fine: Column, top_macro: Column) -> Column:
    def best(m):
        own = F.filter(fine, lambda e: x.macro_of(e.language) == m)
        return F.array_max(F.transform(own, lambda e: F.struct(e.confidence.alias("confidence"), e.language.alias("language"))))

    return x.let(top_macro, best)["language"]


def _money(v: Column) -> Column:
    return F.format_string("%.2f", v)


def calibrated(candidates: Column, visible: Column, several: Column) -> Column:
    """struct<status,note,candidates,primary>."""
    ranked = F.struct(F.size(candidates).alias("n"), F.filter(candidates, lambda e: e.confidence >= f32(c.KEEP_FLOOR)).alias("kept"))
    return x.let(ranked, lambda r: _verdict(r.n, r.kept, visible, several))


def _verdict(n: Column, kept: Column, visible: Column, several: Column) -> Column:
    top, lang = F.get(kept, 0)["confidence"], F.get(kept, 0)["language"]
    second = F.coalesce(F.get(kept, 1)["confidence"], _zero())
    gap = (top - second).cast("float")
    strong = F.size(F.filter(kept, lambda e: e.confidence >= f32(c.MIXED_FLOOR)))
    clear = (top >= f32(c.DOMINANT)) | (gap >= f32(c.RESOLVED_GAP))
    mixed = (strong >= 2) & (top < f32(c.MIXED_CEILING)) & (visible >= c.MIXED_VISIBLE)
    none = F.array().cast(_ENTRY)

    def verdict(status, note, found, primary):
        return F.struct(F.lit(status).alias("status"), note.alias("note"), found.alias("candidates"), primary.cast("string").alias("primary"))

    embedded = F.concat(lang, F.lit(c.PRIMARY_NOTE), _money(top), F.lit(c.EMBEDDED_NOTE))
    return (
        F.when((visible == 0) | (n == 0), verdict("unknown", F.lit(c.NO_SCRIPT_NOTE), none, F.lit(None)))
        .when(F.size(kept) == 0, verdict("unknown", F.lit(c.FLOOR_NOTE), none, F.lit(None)))
        .when(clear & several, verdict("ambiguous", F.concat(lang, F.lit(c.PRIMARY_NOTE), _money(top), F.lit(c.DOWNGRADED_NOTE)), kept, lang))
        .when(clear, verdict("resolved", F.when((top >= f32(c.DOMINANT)) & (second < f32(c.KEEP_FLOOR)), F.concat(F.lit(c.SINGLE_NOTE), lang)).otherwise(embedded), kept, lang))
        .when(mixed, verdict("mixed", F.concat(strong.cast("string"), F.lit(c.MIXED_NOTE)), kept, lang))
        .otherwise(verdict("ambiguous", F.concat(F.lit(c.AMBIGUOUS_NOTE[0]), _money(gap), F.lit(c.AMBIGUOUS_NOTE[1])), kept, lang))
    )


def _listed(pairs: list[tuple[str, Column]]) -> Column:
    """`tag:n` of the counts above 0, sorted as text."""
    return F.array_sort(F.filter(F.array(*(F.when(n > 0, F.concat(F.lit(f"{t}:"), n.cast("string"))) for t, n in pairs)), lambda s: s.isNotNull()))


def signal_reasons(ml: Column | None = None) -> Column:
    """What the layers found, in their order, as array<string>."""
    k = F.col

    def when(cond, *parts):
        return F.when(cond, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))

    def text(name):
        return k(name).cast("string")

    def marked(name):
        return when(k(name) > 0, c.MARKER_NOTES[name], text(name))

    kana_note = (
        F.when((k("hans") > k("kana")) | (k("hant") > k("kana")), c.KANA_NOTES[0])
        .when((k("hans") > 0) | (k("hant") > 0), c.KANA_NOTES[1])
        .otherwise(c.KANA_NOTES[2])
    )
    words = _listed([(t, k(f"fw_{t}")) for t in kernel.FUNCTION_TAGS])
    tokens = k("attr_en") + k("attr_fr") + k("attr_vi")
    shapes = _listed([(t, k(f"attr_{t}")) for t in c.LATIN_TAGS] + [(t, k(f"end_{t}")) for t in c.ENDINGS])
    around = _listed([(t, k(f"ctx_{t}")) for t in x.CONTEXT_TAGS])
    notes = [
        F.concat(*(F.concat(F.lit(f"{c.SCRIPT_NOTE if i == 0 else ', '}{n}:"), text(n)) for i, n in enumerate(("latin", "hiragana", "katakana", "han", "hangul")))),
        *map(marked, ("vi", "fr", "hans", "hant", "yue")),
        when((k("lzh") > 0) & (k("han") >= 4), c.CLASSICAL_NOTE[0], text("lzh"), c.CLASSICAL_NOTE[1], text("han"), c.CLASSICAL_NOTE[2]),
        *map(marked, ("hk", "tw", "nan", "hak", "wuu")),
        F.when(k("kana") > 0, kana_note),
        when(F.size(words) > 0, c.WORDS_NOTE, F.array_join(words, ", ")),
        when(k("recognized") > 0, c.DICTIONARY_NOTE[0], text("recognized"), c.DICTIONARY_NOTE[1], text("ambiguous"), c.DICTIONARY_NOTE[2]),
        when(F.size(shapes) > 0, c.MORPHOLOGY_NOTE[0], F.array_join(shapes, ", "), F.when(tokens > 0, F.concat(F.lit(c.MORPHOLOGY_NOTE[1]), tokens.cast("string"), F.lit(c.MORPHOLOGY_NOTE[2]))).otherwise("")),
        when(k("ctx_sentences") > 0, c.CONTEXT_NOTE[0], text("ctx_sentences"), c.CONTEXT_NOTE[1], F.array_join(around, ", "), c.CONTEXT_NOTE[2], F.when(k("multi_language"), c.CONTEXT_NOTE[3]).otherwise("")),
    ]
    if ml is not None:
        notes.append(F.when(ml.isNotNull(), F.concat(F.lit(c.ML_NOTE), F.array_join(F.array_sort(F.transform(ml, lambda s: F.concat(s.tag, F.lit(":"), _money(s.conf)))), ", "))))
    return F.filter(F.array(*notes), lambda s: s.isNotNull())


RESULT = ["candidates", "primary_language", "primary_variant", "status", "reasons", "segments", "normalized_text"]


def scored(df: DataFrame, options: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """Adds weights, fine, macros, and the verdict; needs the signals."""
    ml = F.col(options.ml_scores) if options.ml_scores else None
    df = df.withColumn("weights", weights(ml))
    df = df.withColumn("fine", fine_distribution(F.col("weights")))
    df = df.withColumn("macros", macro_candidates(F.col("fine")))
    return df.withColumn("verdict", calibrated(F.col("macros"), F.col("visible_chars"), F.col("multi_language")))


def identify(df: DataFrame, text_col: str = "text", options: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    """df with the result columns RESULT.

    A null text has null results; one without visible characters is unknown, one of other scripts only unsupported.
    """
    held = [f for f in df.columns if f not in RESULT]
    ml = F.col(options.ml_scores) if options.ml_scores else None
    signals = with_signals(with_normalized(df.select(F.struct(*held).alias("_row"), F.col(text_col).alias("_text"), *([options.ml_scores] if options.ml_scores else []), *([options.unsupported] if options.unsupported else [])), "_text"), options)
    done = scored(signals, options)
    empty = F.col("visible_chars") == 0
    foreign = (F.col("total") == 0) & (F.col("other") > 0)
    refused = F.lit(False)
    refusal = F.lit(None).cast("string")
    if options.unsupported:
        u = F.col(options.unsupported)
        refused = F.coalesce(u["conf"] >= f32(c.ML_UNSUPPORTED), F.lit(False))
        refusal = F.concat(F.lit(c.ML_REFUSED[0]), u["label"], F.lit(c.ML_REFUSED[1]), _money(u["conf"]), F.lit(c.ML_REFUSED[2]))
    none = F.array().cast("array<struct<language:string,variants:array<string>,confidence:float>>")
    variants = F.transform(F.col("verdict.candidates"), lambda e: F.struct(e.language.alias("language"), F.when(F.size(x.variants_of(e.language)) > 0, x.variants_of(e.language)).otherwise(F.array(e.language)).alias("variants"), e.confidence.alias("confidence")))
    live = ~(empty | refused | foreign)

    def only_live(v: Column, other: Column) -> Column:
        return F.when(F.col("norm").isNull(), None).when(live, v).otherwise(other)

    status = F.when(empty, "unknown").when(refused | foreign, "unsupported").otherwise(F.col("verdict.status"))
    reasons = (
        F.when(empty, F.array(F.lit(c.EMPTY_NOTE)))
        .when(refused, F.array(refusal))
        .when(foreign, F.array(F.lit(c.FOREIGN_NOTE)))
        .otherwise(F.concat(signal_reasons(ml), F.array(F.col("verdict.note"))))
    )
    # The row's own columns come back in a step of their own, so that their names meet none of the signals'.
    out = done.select(
        "_row",
        only_live(variants, none).alias("candidates"),
        only_live(F.col("verdict.primary"), F.lit(None)).alias("primary_language"),
        only_live(primary_variant(F.col("fine"), F.get(F.col("macros"), 0)["language"]), F.lit(None)).alias("primary_variant"),
        F.when(F.col("norm").isNotNull(), status).alias("status"),
        F.when(F.col("norm").isNotNull(), reasons).alias("reasons"),
        F.col("norm").alias("normalized_text"),
        *([only_live(F.col("spans"), F.array().cast(kernel.SEGMENT)).alias("segments")] if options.segments else []),
    )
    return out.select("_row.*", *(r for r in RESULT if r in out.columns))


def joined_lines(df: DataFrame, id_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """One text for each id: its rows by order, with line breaks between."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order_col), F.col(text_col))))
    return df.groupBy(id_col).agg(F.array_join(F.transform(rows, lambda r: r[text_col]), "\n").alias(text_col))


def identify_lines(df: DataFrame, id_col: str, order_col: str, text_col: str = "text", options: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    return identify(joined_lines(df, id_col, order_col, text_col), text_col, options)


def result_json(pretty: bool = False) -> Column:
    """The result columns as one JSON object, absent values left out."""
    options = {"pretty": "true"} if pretty else {}
    return F.to_json(
        F.struct("candidates", F.col("primary_language").alias("primaryLanguage"), F.col("primary_variant").alias("primaryVariant"), "status", "reasons", "segments", F.col("normalized_text").alias("normalizedText")), options
    )
