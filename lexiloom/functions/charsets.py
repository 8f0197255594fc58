"""Character classes, marker sets, lexicons of fixed size and thresholds.

The values below are fixed: results are defined by them.  Classes are bodies of regular-expression brackets that Java and
RE2 read alike.
"""

# Script classes.
LATIN = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
HIRAGANA = r"\x{3040}-\x{309F}"
KATAKANA = r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}"
KANA = HIRAGANA + KATAKANA
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"
CJK = HAN + KANA + HANGUL

# Normalization.
CONTROL = r"\x{01}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}"
SPACE = r"\t\n \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PUNCTUATION = r" !-/:-@\[-`{-~\x{3000}-\x{303F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"

# Orthographic markers.
VI_MARKERS = r"ăĂđĐơƠưƯ\x{1E00}-\x{1EFF}"
FR_MARKERS = "çÇœŒæÆ"
HANS_ONLY = "师时这让给们经还实进见问谁长说应听个观议态资产风调语请认识记"
HANT_ONLY = "學國來們經這實會說應讓與沒聽寫認識觀議態資產風調請記權體龜歲數關舊處辭戰對氣灣黨齊豐滿辦齒從總歷當兒兩"
HANT_SENTENCE = HANT_ONLY[:26]
YUE = "嘅嚟唔喺啲咁哋佢係咗由嘞囉仔"
LZH = "之乎者也矣焉哉而於以其吾汝曰"
HK = "嘥冚嘜攞靚"
TW = "臺麵裡著"
NAN = "\U0002A736㑨阮甲"
HAK = "\U0002828E\U00022CB7"
WUU = "儂弗勿"
MARKERS = {"hans": HANS_ONLY, "hant": HANT_ONLY, "yue": YUE, "lzh": LZH, "hk": HK, "tw": TW, "nan": NAN, "hak": HAK, "wuu": WUU}

# N-grams, endings, word shapes.
EN_NGRAMS = "th he in er an ed ng ou the ing and ion ent".split()
VI_NGRAMS = "nh ng ch tr ph ngu trư ngh thư".split()
ENDINGS = {
    "ja": "です ます ました ません ている ない だった でした".split(),
    "ko": "입니다 합니다 했다 이다 하다".split(),
    "zh": "是 不是 没有 这是 也是".split(),
}
VI_SHAPE = ("^(ng|nh|tr|ph|kh|th|ch|gi|qu)", "(ng|nh|ch)$")

# Curated function words; all other tables are the first words of a lexicon.
YUE_WORDS = "嘅嚟唔喺啲咁哋佢係咗嘞囉嘥咩嘢"
LZH_WORDS = "之乎者也矣焉哉而於以其吾汝曰為"
TOP_WORDS = 50

# Language tags.
LEXICON_TAGS = ["en", "fr", "vi", "ja", "ko", "zh-Hans", "zh-Hant", "zh-Hant-HK", "zh-Hant-TW", "yue", "lzh", "nan", "hak", "wuu"]
SINITIC = ["zh", "zh-Hans", "zh-Hant", "zh-Hant-HK", "zh-Hant-TW", "yue", "lzh", "nan", "hak", "wuu"]
LATIN_TAGS = ["en", "fr", "vi"]
CJK_WORD_TAGS = ["ja", "zh-Hans", "zh-Hant", "ko", "yue", "lzh"]
VARIANTS = {"zh": SINITIC[1:], "en": ["en"], "fr": ["fr"], "vi": ["vi"], "ja": ["ja"], "ko": ["ko"]}
TAGS = sorted({*LEXICON_TAGS, "zh"})

# Weights (per hit, most), thresholds and limits.
FUNCTION_WORD = (0.02, 0.10)
EXCLUSIVE = (0.03, 0.20)
SHARED = (0.01, 0.10)
MORPHOLOGY = (0.02, 0.10)
CONTEXT = (0.05, 0.15)
ML = (0.30, 0.30)
DOMINANT, RESOLVED_GAP, MIXED_FLOOR, MIXED_CEILING, MIXED_VISIBLE, KEEP_FLOOR = 0.95, 0.30, 0.20, 0.70, 4, 0.01
ML_UNSUPPORTED = 0.50
SENTENCES = 50
SENTENCE_END = r"(?<=[.!?。！？])"
SENTENCE = r"[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$"

# The texts of the reasons.
MARKER_NOTES = {
    "vi": "Vietnamese diacritic markers detected: ",
    "fr": "French-only letter markers detected: ",
    "hans": "Simplified-Chinese-only markers detected: ",
    "hant": "Traditional-Chinese-only markers detected: ",
    "yue": "Cantonese (yue) particles detected: ",
    "hk": "Hong Kong written-Chinese markers detected: ",
    "tw": "Taiwan written-Chinese markers detected: ",
    "nan": "Min Nan (nan) markers detected: ",
    "hak": "Hakka (hak) markers detected: ",
    "wuu": "Wu (wuu) markers detected: ",
}
CLASSICAL_NOTE = ("Classical Chinese (lzh) function-word density: ", " hits over ", " Han chars")
KANA_NOTES = (
    "Japanese kana present, but Chinese-only markers outweigh kana — Han attributed proportionally",
    "Japanese kana present alongside Chinese-only markers — Han split proportionally",
    "Japanese kana present — Han characters interpreted as kanji",
)
SCRIPT_NOTE = "Script counts — "
WORDS_NOTE = "Function-word hits — "
DICTIONARY_NOTE = ("Dictionary — ", " recognized tokens (", " ambiguous across lexicons)")
MORPHOLOGY_NOTE = ("Morphology — ", " (", " Latin tokens attributed)")
CONTEXT_NOTE = ("Context window — ", " sentences, dominant: {", "}", "; multi-language paragraph")
ML_NOTE = "Layer 9 (ML classifier) — "
ML_REFUSED = ("Layer 9 (ML classifier) detected unsupported language '", "' (confidence ", ") — verdict downgraded to unsupported")
EMPTY_NOTE = "Empty input after normalization"
FOREIGN_NOTE = "Input uses scripts that are not in the supported set"
NO_SCRIPT_NOTE = "No supported script detected in input"
FLOOR_NOTE = "No candidate above confidence floor"
SINGLE_NOTE = "Single language detected: "
PRIMARY_NOTE = " is primary (confidence "
EMBEDDED_NOTE = "); remaining candidates treated as embedded segments"
DOWNGRADED_NOTE = "), but Layer 7 detected sentences in another language — status downgraded to 'ambiguous'"
MIXED_NOTE = " candidates each hold ≥0.20 confidence — input contains multiple languages as first-class content"
AMBIGUOUS_NOTE = ("Confidence gap is small (", "); detection status is 'ambiguous'")
