"""End-to-end cases: status, languages, variants, segments."""

import random

from lexiloom.api import IdentifyOptions, create_identified_view, identify, identify_json, identify_lines, macro_of, read_word_lists, register_functions, variants_of
from lexiloom.functions import kernel
from lexiloom.plans import fixtures
from lexiloom.sources.lexicon import Lexicon


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r for r in sorted(identify(df, options=IdentifyOptions(**options)).collect(), key=lambda r: r["id"])]


CASES = {
    "Market Mercado": ("resolved", "en", None),
    "明日の市場は海の近くです 新しい店で魚を買う": ("resolved", "ja", None),
    "这个市场的鱼很便宜 我们买了水果": ("resolved", "zh", "zh-Hans"),
    "fresh fish at the old market near the sea": ("resolved", "en", None),
    "cá tươi ở chợ cũ gần biển, và bánh mới": ("resolved", "vi", None),
    "這個市場離海邊很遠還會下雨": ("resolved", "zh", "zh-Hant"),
    "ゆっくりあるいてかえりました": ("resolved", "ja", None),
    "テレビカメラ": ("resolved", "ja", None),
    "市": ("ambiguous", "zh", "zh-Hant"),
    "海 山 海 山": ("mixed", None, None),
    "오늘은 market에서 생선을 삽니다": (None, "ko", None),
    "piñata mañana cigüeña": (None, "en", None),
    "fish42 bread7 sea2024": ("resolved", "en", None),
    "🌊🐟☀": ("unsupported", None, None),
    "2024 365 7": ("unsupported", None, None),
    "θάλασσα και ψάρι": ("unsupported", None, None),
    "?? -- !!": ("unknown", None, None),
    "": ("unknown", None, None),
    " \t \n ": ("unknown", None, None),
    "Good bread かいにいこう and fish さかなをたべる": ("mixed", None, None),
    "We bought fish at 시장은 바다 옆에 있습니다 today": ("mixed", None, None),
    "She went to the market early. 魚はとても新鮮です。": ("ambiguous", "en", None),
    "我哋喺街市買嘢": (None, "zh", "yue"),
    "佢係唔係嚟咗": (None, "zh", "yue"),
    "山者，不在高也，其水而不深乎": (None, "zh", "lzh"),
    "海也者，嘅而已矣": (None, "zh", "lzh"),
    "他們說臺北的市場裡有海魚": (None, "zh", "zh-Hant-TW"),
    "他們說嘥時間，靚魚不見": (None, "zh", "zh-Hant-HK"),
    "儂去買魚": (None, "zh", "wuu"),
    "甲魚阮買\U0002A736": (None, "zh", "nan"),
    "je cherche du pain frais avant la pluie ce soir": (None, "fr", None),
    "le pain est dans le four": (None, "fr", None),
    "leçon de façade": (None, "fr", None),
}


def test_cases(spark):
    for r, (text, (status, primary, variant)) in zip(run(spark, list(CASES), segments=False), CASES.items()):
        assert status in (None, r["status"]), (text, r)
        assert primary in (None, r["primary_language"]), (text, r)
        assert variant in (None, r["primary_variant"]), (text, r)


def test_both_languages_are_candidates(spark):
    want = {"市": {"ja", "zh"}, "海": {"ja", "zh"}, "Good bread かいにいこう and fish さかなをたべる": {"en", "ja"}, "He wrote cá tươi ở chợ cũ on a small card": {"en", "vi"}}
    for r in run(spark, list(want), segments=False):
        assert want[list(want)[r["id"]]] <= {c["language"] for c in r["candidates"]}


def test_invariants(spark):
    assert max(c["confidence"] for c in run(spark, ["the " * 500])[0]["candidates"]) <= 1
    for r in run(spark, fixtures.TEXTS + ["the " * 500, None], tokenize=True):
        if r["status"] is None:
            assert r["normalized_text"] is None and r["candidates"] is None and r["segments"] is None
            continue
        conf = [c["confidence"] for c in r["candidates"]]
        assert conf == sorted(conf, reverse=True) and all(0 <= x < 1.03 for x in conf)  # a macro language adds up rounded shares
        whole, end = r["normalized_text"].encode(), 0
        for s in r["segments"]:
            assert end <= s["start"] < s["end"] and whole[s["start"] : s["end"]].decode() == s["text"]
            end = s["end"]
            for t in s["tokens"] or []:
                assert s["start"] <= t["start"] < t["end"] <= s["end"] and whole[t["start"] : t["end"]].decode() == t["text"]
        if r["status"] in ("unknown", "unsupported"):
            assert not r["segments"] and not r["candidates"] and r["primary_language"] is None
        assert all(r["reasons"])


def test_segments(spark):
    one, two, three, four = run(spark, ["We went to the old market", "海の近くの店で 这个市场的鱼很便宜 と聞いた", "海の近くで 魚 を買うのは楽しいです。", "du pain, xyz mañana façade"])
    assert [s["language"] for s in one["segments"]] == ["en"]
    assert [(s["language"], s["text"]) for s in two["segments"]] == [("ja", "海の近くの店で"), ("zh-Hans", "这个市场的鱼很便宜"), ("ja", "と聞いた")]
    assert {s["language"] for s in three["segments"]} == {"ja"}
    assert [(s["language"], s["text"]) for s in four["segments"]] == [("fr", "du pain"), ("fr", "xyz mañana façade")]


def test_tokens(spark):
    """Words of the lattice, and pieces between the word boundaries of Unicode without white space."""
    (r,) = run(spark, ["这个市场的鱼很便宜 don't pay 3.5 now"], tokenize=True)
    assert [t["text"] for s in r["segments"] for t in s["tokens"]][:6] == ["这个", "市场", "的", "鱼", "很", "便宜"]
    lexicon = Lexicon.of(None)
    cases = {"Don't go 3.5 km, e-mail us: it's ok!": ["Don't", "go", "3.5", "km", ",", "e", "-", "mail", "us", ":", "it's", "ok", "!"], "시장은 바다 옆에": ["시장은", "바다", "옆에"], " \u3000": [], "a_b c": ["a_b", "c"]}
    for text, want in cases.items():
        assert [w for w, _, _ in kernel.tokens(text, "en", lexicon)] == want
    assert [w for w, _, _ in kernel.tokens("新しい店で TV を", "ja", lexicon)] == ["新しい", "店", "で", "TV", "を"]


def test_lattice_against_all_ways():
    cost = {"ab": 1.0, "a": 2.0, "b": 2.5, "bc": 0.5, "abc": 3.0, "c": 1.5, "": 4.0}.get

    def every(text):
        if not text:
            return [(0.0, [])]
        out = []
        for n in range(1, min(kernel.WORD_LETTERS, len(text)) + 1):
            c = cost(text[:n])
            if c is None and n == 1:
                c = cost("") + kernel.UNKNOWN
            if c is not None:
                out += [(c + x, [text[:n], *ws]) for x, ws in every(text[n:])]
        return out

    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 8)))
        found = [text[a:b] for a, b in kernel.lattice(text, cost)]
        best = min(every(text))[0]
        assert "".join(found) == text and abs(sum(cost(w) if cost(w) is not None else cost("") + kernel.UNKNOWN for w in found) - best) < 1e-9


def test_lines(spark):
    df = spark.createDataFrame([(1, 2, "魚は新鮮です。"), (1, 1, "海の近くの店です。"), (2, 1, "Some bread."), (2, 2, "More fish.")], "id int, ord int, text string")
    got = {r["id"]: r for r in identify_lines(df, "id", "ord").collect()}
    assert got[1]["primary_language"] == "ja" and got[1]["normalized_text"] == "海の近くの店です。 魚は新鮮です。"
    assert got[2]["primary_language"] == "en"


def test_classifier_scores_tip_the_balance(spark):
    df = spark.createDataFrame([("市", [("zh-Hans", 1.0)])], "text string, scores array<struct<tag:string,conf:float>>")
    r = identify(df, options=IdentifyOptions(ml_scores="scores")).first()
    assert (r["primary_language"], r["primary_variant"]) == ("zh", "zh-Hans") and any("Layer 9" in x for x in r["reasons"])


def test_json_leaves_absent_values_out(spark):
    import json

    df = spark.createDataFrame([("12345",), ("Bread",)], "text string")
    a, b = (json.loads(r["json"]) for r in identify_json(df).collect())
    assert "primaryLanguage" not in a and a["status"] == "unsupported"
    assert b["primaryLanguage"] == "en" and "tokens" not in b["segments"][0] and b["candidates"][0]["variants"] == ["en"]


def test_sql_surface(spark):
    register_functions(spark)
    assert spark.sql("SELECT macro_of('yue') a, macro_of('es') b, size(variants_of('zh')) c, size(variants_of('es')) d").first()[:] == ("zh", "es", 9, 0)
    spark.createDataFrame([(1, "Old bread")], "id int, text string").createOrReplaceTempView("plain_texts")
    create_identified_view(spark, "plain_texts", "told")
    assert spark.sql("SELECT primary_language FROM told WHERE status = 'resolved'").first()[0] == "en"
    assert spark.sql("SELECT json FROM told_json").first()[0].startswith('{"candidates"')


def test_tags():
    assert macro_of("yue") == "zh" and macro_of("es") == "es" and len(variants_of("zh")) == 9 and variants_of("de") == []


def test_word_lists(spark, tmp_path):
    (tmp_path / "lexicon_en.txt").write_text("zorb\n\nquux\n")
    (tmp_path / "lexicon_zh_Hant.txt").write_text("學生\n", encoding="utf-8")
    lexicon = read_word_lists(spark, str(tmp_path))
    assert {tuple(r) for r in lexicon.collect()} == {("en", 1, "zorb"), ("en", 2, "quux"), ("zh-Hant", 1, "學生")}
    df = spark.createDataFrame([("zorb quux",)], "text string")
    assert any("Function-word hits — en:2" == x for x in identify(df, options=IdentifyOptions(lexicon=lexicon)).first()["reasons"])


def test_columns_stay(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Bread",)], "text string").select("*", *(F.lit(1).alias(c) for c in ("norm", "vi", "total", "fine", "kept", "_row", "status")))
    out = identify(df)
    assert out.columns[:7] == ["text", "norm", "vi", "total", "fine", "kept", "_row"] and out.first()["status"] == "resolved"
    assert identify(df.limit(0)).collect() == []


MIXED = ["We went to the old market, don't pay 3.5 now", None, "", "这个市场的鱼很便宜 and 新しい店で TV を", "𝒳 cá tươi 시장은 바다 옆에 façade", "\u3000", "海の近くの店で"]


def _segments(texts, tokenize=True):
    import pyarrow as pa

    n = len(texts)
    return kernel.segments_udf(Lexicon.of(None), tokenize).func(pa.array(texts, pa.string()), pa.array([0] * n), pa.array([0] * n), pa.array(["zh-Hans"] * n))


def test_tokens_in_pieces(monkeypatch):
    """Segments and tokens are the same however few are Python objects at once."""
    whole = _segments(MIXED * 3)
    want = [[s["tokens"] and [(t["text"], t["start"], t["end"]) for t in s["tokens"]] for s in d] for d in whole.to_pylist()]
    for text, found, row in zip(MIXED * 3, want, whole.to_pylist()):
        for s, words in zip(row, found):
            assert words == [(w, s["start"] + len(s["text"][:a].encode()), s["start"] + len(s["text"][:b].encode())) for w, a, b in kernel.tokens(s["text"], s["language"], Lexicon.of(None))] or None
            assert all((text or "").encode()[a:b].decode() == w for w, a, b in words)
    monkeypatch.setattr(kernel, "PIECE", 3)
    for tokenize in (True, False):
        small = _segments(MIXED * 3, tokenize)
        assert small.type == whole.type and [[s["text"] for s in d] for d in small.to_pylist()] == [[s["text"] for s in d] for d in whole.to_pylist()]
        assert (small == whole) == tokenize
    assert len(_segments([])) == 0 and _segments([]).type == whole.type


def test_memory_of_tokens(spark):
    """A batch's tokens, 2 MB of texts and a single long one, are never all Python objects; batches of tokens are small."""
    import tracemalloc

    for texts, most in ((["the old market by the sea " * 80] * 1000, 20), (["the old market by the sea " * 80_000], 180)):
        tracemalloc.start()
        _segments(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most << 20
    run(spark, ["a"], tokenize=True)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 250
