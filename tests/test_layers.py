"""Single layers, the relational forms against the kernel, and the plan."""

import re

from pyspark.sql import functions as F

from lexiloom.functions import columns as x
from lexiloom.functions import kernel
from lexiloom.operators import labels, lexical
from lexiloom.operators.identify import identify, with_normalized
from lexiloom.operators.options import IdentifyOptions
from lexiloom.plans import fixtures
from lexiloom.sources.lexicon import Lexicon, corpus_lexicon, seed_lexicon


def table(spark, texts):
    return with_normalized(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_normalization(spark):
    cases = {"  hello   world  ": "hello world", "ab\x07cd": "abcd", "a\rb\x85c": "abc", "café": "café", "a　\xa0b": "a b", "a\nb\tc": "a b c", "": ""}
    got = [r["norm"] for r in sorted(table(spark, list(cases)).collect(), key=lambda r: r["doc_id"])]
    assert got == list(cases.values())
    assert table(spark, ["Bread, fish!"]).first()["visible_chars"] == 9


def test_sentences(spark):
    got = table(spark, ["Bread is old. Is fish fresh? ! tail"]).select(x.sentences(F.col("norm"))).first()[0]
    assert got == ["Bread is old.", "Is fish fresh?", "!", "tail"]
    assert len(table(spark, ["a. " * 80]).select(x.sentences(F.col("norm"))).first()[0]) == 50


def test_attribution_rules():
    lexicon = Lexicon([("en", 60, "table"), ("fr", 3, "table"), ("en", 1, "ngach"), ("vi", 1, "ngach"), ("fr", 60, "duo"), ("vi", 60, "duo"), ("en", 60, "both"), ("fr", 60, "both"), ("en", 1, "plain"), ("vi", 1, "thing2")])
    want = {"table": "fr", "TABLE": "fr", "ngach": "vi", "duo": "fr", "both": "en", "plain": "en", "ơi": "vi", "ça": "fr", "xqz": None}
    assert {t: kernel.attributed(t, lexicon) for t in want} == want


def test_relations_agree_with_the_kernel(spark):
    texts = fixtures.TEXTS + ["The THE the fish pain là nhanh", "的的的 是不是 我哋"]
    df, words = table(spark, texts).cache(), seed_lexicon(spark)
    lexicon = Lexicon.of(None)
    norm = {r["doc_id"]: r["norm"] for r in df.collect()}
    want = {i: dict(zip(kernel.FIELDS, kernel.lexical(n, lexicon))) for i, n in norm.items()}
    for r in lexical.function_word_hits(df, words).collect():
        assert want[r["doc_id"]].pop(f"fw_{r['lang']}") == r["hits"]
    for r in lexical.dictionary_hits(df, words).collect():
        assert want[r["doc_id"]].pop(f"excl_{r['lang']}") == r["exclusive"] and want[r["doc_id"]].pop(f"shared_{r['lang']}") == r["shared"]
    for r in lexical.dictionary_totals(df, words).collect():
        assert want[r["doc_id"]].pop("recognized") == r["recognized"] and want[r["doc_id"]].pop("ambiguous") == r["ambiguous"]
    for r in lexical.latin_attribution(df, words).collect():
        assert want[r["doc_id"]].pop(f"attr_{r['lang']}") == r["n_tokens"] and want[r["doc_id"]].pop(f"chars_{r['lang']}") == r["n_chars"]
    assert not any(n for w in want.values() for n in w.values())


def test_labels(spark):
    rows = [("eng_Latn", "x"), ("__label__yue_Hant", "x"), ("cmn_Hant", "學生嘥時間"), ("cmn_Hans", ""), ("xxx_Yyyy", "x"), ("arb_Latn", "x")]
    got = {r["label"]: (r["tag"], r["supported"]) for r in labels.with_tags(spark.createDataFrame(rows, "label string, text string")).collect()}
    assert got == {"eng_Latn": ("en", True), "__label__yue_Hant": ("yue", True), "cmn_Hant": ("zh-Hant-HK", True), "cmn_Hans": ("zh-Hans", True), "xxx_Yyyy": (None, False), "arb_Latn": ("ar", True)}


def test_predictions_to_signals(spark):
    rows = [(1, "x", "eng_Latn", 0.5), (1, "x", "__label__fra_Latn", 0.25), (1, "x", "xxx_Yyyy", 0.125), (2, "學生嘥時間", "cmn_Hant", 0.5), (2, "學生嘥時間", "deu_Latn", 0.5), (3, "x", "__label__xxx_Yyyy", 0.75), (3, "x", "spa_Latn", 0.25), (4, "x", None, 1.0), (4, "x", "eng_Latn", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label string, conf float")
    got = {r["doc_id"]: ([tuple(s) for s in r["scores"]], r["unsupported"] and tuple(r["unsupported"])) for r in labels.classifier_signals(df).collect()}
    assert got == {1: ([("en", 0.5), ("fr", 0.25)], None), 2: ([("zh-Hant-HK", 0.5), ("de", 0.5)], None), 3: ([("es", 0.25)], ("xxx_Yyyy", 0.75))}
    first = {r["doc_id"]: (len(r["scores"]), r["unsupported"]) for r in labels.classifier_signals(df, top_k=1).collect()}
    assert first[1] == (1, None) and first[3][0] == 0
    told = labels.classifier_signals(df).join(df.select("doc_id", "text").distinct(), "doc_id")
    status = {r["doc_id"]: r["status"] for r in identify(told, options=IdentifyOptions(ml_scores="scores", unsupported="unsupported")).collect()}
    assert status[3] == "unsupported" and status[1] == "resolved"


def test_markers(spark):
    df = spark.createDataFrame([("佢哋",), ("之乎者也",), ("之乎者",), ("",)], "t string")
    got = df.select(x.has_yue_marker(F.col("t")), x.is_classical_chinese(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, False)]


def test_ranked_words_in_parts(spark):
    """The parts of a language's words are ranked together; ties by the word."""
    df = spark.createDataFrame([("en", " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)} " * (1 + i % 5) for i in range(300)))], "lang string, text string")
    got = [(r["rank"], r["word"], r["n"]) for r in corpus_lexicon(df, most=50).orderBy("rank").collect()]
    words = sorted(((1 + i % 5, f"w{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(300)), key=lambda x: (-x[0], x[1]))
    assert got == [(k, w, n) for k, (n, w) in enumerate(words[:50], 1)]


def test_identification_does_not_shuffle(spark):
    df = spark.createDataFrame([("Bread", "en")], "text string, lang string")
    plan = identify(df, options=IdentifyOptions(segments=True))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Join|Aggregate", plan) and plan.count("ArrowEvalPython") == 1


def test_filters_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'fr'").select("doc_id", "text")
    plan = identify(docs)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,fr)" in plan and "n_chars" not in plan
