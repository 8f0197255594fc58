"""Name -> query and name -> SQL of the language-identification engine.

Queries read the table documents, and with it the fixture texts under negative ids, for the scripts that the table lacks.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets as c
from ..functions import columns as x
from ..functions import kernel
from ..operators import labels, lexical, reports
from ..operators.identify import identify, identify_lines, result_json, scored, with_normalized, with_signals
from ..operators.ml import language_model_scores
from ..operators.options import IdentifyOptions
from ..sources.lexicon import corpus_lexicon, derived_lexicon, seed_lexicon
from ..streaming.stream import run_to_table
from . import fixtures, oracle

_NO_SEGMENTS = IdentifyOptions(segments=False)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than cores, dealt out to all cores; larger tables are read as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of documents and fixtures."""
    return documents(spark, sf_dir).select("doc_id", "text").union(spark.createDataFrame(fixtures.rows(), "doc_id long, text string"))


def _norm(spark, sf_dir) -> DataFrame:
    return with_normalized(texts(spark, sf_dir))


def _high(spark, sf_dir) -> DataFrame:
    return _norm(spark, sf_dir).withColumn("beyond_latin", x.beyond_latin(F.col("norm")))


def _signals(spark, sf_dir) -> DataFrame:
    return with_signals(_norm(spark, sf_dir), _NO_SEGMENTS)


def _live() -> Column:
    return (F.col("visible_chars") > 0) & (F.col("total") > 0)


def normalize(spark, sf_dir):
    return _norm(spark, sf_dir).select("doc_id", "norm")


def visible_chars(spark, sf_dir):
    return _norm(spark, sf_dir).select("doc_id", "visible_chars")


def script_counts(spark, sf_dir):
    n = F.col("norm")
    df = _high(spark, sf_dir).select("doc_id", "norm", *(v.alias(k) for k, v in x.script_counts(n, F.col("beyond_latin")).items()))
    df = df.withColumn("supported", sum((F.col(k) for k in ("hiragana", "katakana", "han", "hangul")), F.col("latin")))
    return df.select("doc_id", "latin", "hiragana", "katakana", "han", "hangul", "supported", (F.length(F.replace(n, F.lit(" "), F.lit(""))) - F.col("supported")).alias("other"))


def ortho_markers(spark, sf_dir):
    return _high(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in x.markers(F.col("norm"), F.col("beyond_latin")).items()))


def ngram_hits(spark, sf_dir):
    return _norm(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in x.ngram_hits(F.col("norm")).items()))


def cjk_endings(spark, sf_dir):
    return _high(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in x.ending_hits(F.col("norm"), F.col("beyond_latin")).items()))


def latin_tokens(spark, sf_dir):
    return lexical.latin_tokens(_norm(spark, sf_dir))


def cjk_windows(spark, sf_dir):
    return lexical.cjk_windows(_norm(spark, sf_dir))


def function_word_hits(spark, sf_dir):
    return lexical.function_word_hits(_norm(spark, sf_dir), seed_lexicon(spark))


def dictionary_hits(spark, sf_dir):
    return lexical.dictionary_hits(_norm(spark, sf_dir), seed_lexicon(spark))


def dictionary_totals(spark, sf_dir):
    return lexical.dictionary_totals(_norm(spark, sf_dir), seed_lexicon(spark))


def latin_attribution(spark, sf_dir):
    return lexical.latin_attribution(_norm(spark, sf_dir), seed_lexicon(spark))


def _sentences(spark, sf_dir):
    return _norm(spark, sf_dir).select("doc_id", F.posexplode(x.sentences(F.col("norm"))).alias("ord", "sentence"))


def sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


def sentence_language(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "ord", x.sentence_language(F.col("sentence")).alias("language"))


def context_signal(spark, sf_dir):
    df = _norm(spark, sf_dir).withColumn("sentences", x.sentences(F.col("norm"))).withColumn("langs", F.transform("sentences", x.sentence_language))
    made = x.context(F.col("sentences"), F.col("langs"))
    return df.select("doc_id", *(v.alias(k.replace("-", "_").lower()) for k, v in made.items()))


def resolve_zh(spark, sf_dir):
    return _norm(spark, sf_dir).select("doc_id", x.resolved_zh(F.col("norm")).alias("tag"))


def openlid_map(spark, sf_dir):
    rows = [(f"__label__{k}" if i % 3 == 0 else k, "學生嘥時間") for i, (k, _) in enumerate(labels.label_rows())] + [("cmn_Hans", "我们"), ("cmn_Hant", "學生嘥時間"), ("__label__cmn_Hant", ""), ("xxx_Yyyy", "text")]
    return labels.with_tags(spark.createDataFrame(rows, "label string, text string")).select("label", "text", "tag", "supported")


def han_strategy(spark, sf_dir):
    return _signals(spark, sf_dir).select("doc_id", "strategy")


def han_run_overrides(spark, sf_dir):
    found = kernel.overrides_udf()("norm", "strategy")
    return _signals(spark, sf_dir).where("beyond_latin").select("doc_id", F.explode(found).alias("o")).select("doc_id", F.col("o.start").alias("start"), F.col("o.end").alias("stop"), F.col("o.tag").alias("tag"))


def segments(spark, sf_dir):
    done = identify(texts(spark, sf_dir)).select("doc_id", F.posexplode_outer("segments").alias("ord", "s")).where("s is not null")
    return done.select("doc_id", "ord", F.col("s.language").alias("language"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.text").alias("segment"))


def segment_tokens(spark, sf_dir):
    done = identify(texts(spark, sf_dir), options=IdentifyOptions(tokenize=True)).select("doc_id", F.explode_outer("segments").alias("s"))
    return done.select("doc_id", F.col("s.language").alias("language"), F.explode_outer("s.tokens").alias("t")).where("t is not null").select("doc_id", "language", F.col("t.text").alias("token"), F.col("t.start").alias("start"), F.col("t.end").alias("stop"))


def script_weights(spark, sf_dir):
    """The weights of all layers before they are normalized."""
    done = scored(_signals(spark, sf_dir), _NO_SEGMENTS).where(_live())
    return done.select("doc_id", F.explode_outer("weights").alias("e")).where("e is not null").select("doc_id", F.col("e.tag").alias("tag"), F.round(F.col("e.w").cast("double"), 5).alias("w"))


def _pairs(done: DataFrame, name: str) -> DataFrame:
    # An inner explode would have the optimizer test the array in a filter of its own, and compute it twice.
    return done.select("doc_id", F.explode_outer(name).alias("e")).where("e is not null").select("doc_id", F.col("e.language").alias("language"), F.round(F.col("e.confidence").cast("double"), 2).alias("confidence"))


def fine_distribution(spark, sf_dir):
    return _pairs(scored(_signals(spark, sf_dir), _NO_SEGMENTS).where(_live()), "fine")


def macro_candidates(spark, sf_dir):
    return _pairs(scored(_signals(spark, sf_dir), _NO_SEGMENTS).where(_live()), "macros")


def _identified(spark, sf_dir):
    return identify(texts(spark, sf_dir), options=_NO_SEGMENTS)


def primary_variant(spark, sf_dir):
    return _identified(spark, sf_dir).select("doc_id", "primary_variant")


def calibrated_status(spark, sf_dir):
    return _identified(spark, sf_dir).select("doc_id", "status", "primary_language", F.element_at("reasons", -1).alias("note"))


def reasons(spark, sf_dir):
    return _identified(spark, sf_dir).select("doc_id", F.array_join("reasons", " | ").alias("reasons"))




def _flat(done: DataFrame, key: str, *more: Column) -> DataFrame:
    return done.select(key, "status", "primary_language", "primary_variant", F.size("candidates").alias("n_candidates"), F.round(F.get("candidates", F.lit(0))["confidence"].cast("double"), 2).alias("top_confidence"), *more)


def identify_documents(spark, sf_dir):
    return _flat(identify(texts(spark, sf_dir), options=_NO_SEGMENTS), "doc_id")


def identify_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return _flat(identify_lines(turns, "conv_id", "turn", options=_NO_SEGMENTS), "conv_id")


def identify_with_ml(spark, sf_dir):
    rows = [(i, t, s, u) for i, (t, s, u) in enumerate(fixtures.SCORES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, scores array<struct<tag:string,conf:float>>, unsupported struct<label:string,conf:float>")
    options = IdentifyOptions(ml_scores="scores", unsupported="unsupported", segments=False)
    done = identify(df, options=options)
    return _flat(done, "doc_id").join(done.select("doc_id", F.array_join("reasons", " | ").alias("reasons")), "doc_id")


def identify_documents_with_ml(spark, sf_dir):
    """Layer 9 over all documents, the declared language standing in for a classifier's score; unscored fixtures and those of SCORES go with them."""
    lang = F.col("lang")
    pair = "struct<{}:string,conf:float>"
    known = F.array(F.struct(lang.alias("tag"), F.lit(fixtures.DECLARED[0]).cast("float").alias("conf")))
    refused = F.struct(lang.alias("label"), F.lit(fixtures.DECLARED[1]).cast("float").alias("conf"))
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", F.when(lang.isNotNull(), known).cast(f"array<{pair.format('tag')}>").alias("scores"),
        F.when(~lang.isin(c.TAGS) & (F.col("doc_id") % 2 == 0), refused).cast(pair.format("label")).alias("unsupported"),
    )
    rows = [(i, t, None, None) for i, t in fixtures.rows()] + [(fixtures.score_id(i), *r) for i, r in enumerate(fixtures.SCORES)]
    df = docs.union(spark.createDataFrame(rows, docs.schema))
    done = identify(df, options=IdentifyOptions(ml_scores="scores", unsupported="unsupported", segments=False))
    return _flat(done, "doc_id", F.array_join("reasons", " | ").alias("reasons"))


def macro_of(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in [*c.TAGS, "es", "und"]], "tag string").select("tag", x.macro_of(F.col("tag")).alias("macro"))


def variants_of(spark, sf_dir):
    df = spark.createDataFrame([(t,) for t in ("en", "fr", "vi", "ja", "ko", "zh", "es")], "macro string")
    return df.select("macro", F.array_join(x.variants_of(F.col("macro")), ",").alias("variants"))


def identify_json(spark, sf_dir):
    made = identify(texts(spark, sf_dir)).select("doc_id", result_json().alias("json"))
    keys = ["status", "primaryLanguage", "primaryVariant", "normalizedText"]
    return made.select("doc_id", F.json_tuple("json", *keys).alias(*keys))


def corpus_words(spark, sf_dir):
    return corpus_lexicon(documents(spark, sf_dir)).select("lang", "rank", "word", "n")


def status_by_declared_lang(spark, sf_dir):
    return reports.status_by_language(identify(documents(spark, sf_dir), options=_NO_SEGMENTS))


def lang_confusion(spark, sf_dir):
    return reports.confusion(identify(documents(spark, sf_dir), options=_NO_SEGMENTS))


def language_rollup(spark, sf_dir):
    return reports.rollup(identify(documents(spark, sf_dir), options=_NO_SEGMENTS))


def has_yue_marker(spark, sf_dir):
    return _norm(spark, sf_dir).select("doc_id", x.has_yue_marker(F.col("norm")).alias("has_yue_marker"))


def is_classical_chinese(spark, sf_dir):
    return _norm(spark, sf_dir).select("doc_id", x.is_classical_chinese(F.col("norm")).alias("is_classical_chinese"))


def classifier_signals(spark, sf_dir):
    """Scores and signals from predictions (label, confidence) of every text, which its id alone tells."""
    found = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(t).alias("label"), F.lit(p).cast("float").alias("conf")) for i, (t, p) in enumerate(oracle.PREDICTED)))
    rows = texts(spark, sf_dir).select("doc_id", "text", F.explode(found).alias("p")).where((F.abs("doc_id") + F.col("p.place")) % 3 != 0)
    made = labels.classifier_signals(rows.select("doc_id", "text", "p.label", "p.conf"))
    scores = F.array_join(F.transform("scores", lambda s: F.concat(s.tag, F.lit(":"), F.format_string("%.4f", s.conf))), ",")
    return made.select("doc_id", scores.alias("scores"), F.col("unsupported.label").alias("unsupported"), F.col("unsupported.conf").cast("double").alias("unsupported_conf"))


def _corpus_words(spark, sf_dir):
    return derived_lexicon(documents(spark, sf_dir))


def identify_with_corpus_lexicon(spark, sf_dir):
    """identify() with up to 10,000 words of each language that the corpus declares."""
    return _flat(identify(texts(spark, sf_dir), options=IdentifyOptions(segments=False, lexicon=_corpus_words(spark, sf_dir))), "doc_id")


def dictionary_hits_of_corpus_lexicon(spark, sf_dir):
    return lexical.dictionary_hits(_norm(spark, sf_dir), _corpus_words(spark, sf_dir))


def identify_json_lists(spark, sf_dir):
    """Candidates, reasons and segments, read back from the JSON."""
    made = identify(texts(spark, sf_dir)).select("doc_id", result_json().alias("json"))
    kinds = "struct<candidates:array<struct<language:string,confidence:float>>,reasons:array<string>,segments:array<struct<language:string,start:int,end:int>>>"
    r = made.select("doc_id", F.from_json("json", kinds).alias("r"))
    candidates = F.transform("r.candidates", lambda e: F.concat(e.language, F.lit(":"), F.format_string("%.2f", e.confidence)))
    spans = F.transform("r.segments", lambda s: F.concat_ws(":", s.language, s.start.cast("string"), s.end.cast("string")))
    return r.select("doc_id", F.array_join(candidates, ",").alias("candidates"), F.array_join("r.reasons", " | ").alias("reasons"), F.array_join(spans, ",").alias("segments"))


def ml_classifier(spark, sf_dir):
    return language_model_scores(documents(spark, sf_dir)).select("doc_id", F.explode_outer("scores").alias("s")).select("doc_id", F.col("s.tag").alias("tag"), F.col("s.conf").alias("conf"))


def stream_identify(spark, sf_dir):
    return run_to_table(spark, f"{sf_dir}/documents.parquet")


QUERIES = {
    "normalize": normalize, "visible_chars": visible_chars, "script_counts": script_counts, "ortho_markers": ortho_markers, "ngram_hits": ngram_hits, "latin_tokens": latin_tokens,
    "cjk_windows": cjk_windows, "function_word_hits": function_word_hits, "dictionary_hits": dictionary_hits, "dictionary_totals": dictionary_totals, "latin_attribution": latin_attribution,
    "cjk_endings": cjk_endings, "sentences": sentences, "sentence_language": sentence_language, "context_signal": context_signal, "resolve_zh": resolve_zh, "openlid_map": openlid_map,
    "han_strategy": han_strategy, "han_run_overrides": han_run_overrides, "segments": segments, "segment_tokens": segment_tokens, "script_weights": script_weights, "fine_distribution": fine_distribution,
    "macro_candidates": macro_candidates, "primary_variant": primary_variant, "calibrated_status": calibrated_status, "reasons": reasons, "identify": identify_documents,
    "identify_lines": identify_conversations, "identify_with_ml": identify_with_ml, "identify_documents_with_ml": identify_documents_with_ml, "macro_of": macro_of, "variants_of": variants_of, "identify_json": identify_json, "corpus_lexicon": corpus_words,
    "has_yue_marker": has_yue_marker, "is_classical_chinese": is_classical_chinese, "classifier_signals": classifier_signals, "identify_with_corpus_lexicon": identify_with_corpus_lexicon,
    "dictionary_hits_of_corpus_lexicon": dictionary_hits_of_corpus_lexicon, "identify_json_lists": identify_json_lists, "status_by_declared_lang": status_by_declared_lang, "language_rollup": language_rollup, "lang_confusion": lang_confusion, "ml_classifier": ml_classifier, "stream_identify": stream_identify,
}
SQL = oracle.SQL
