"""Short texts in the scripts that the driver's tables lack, under negative ids."""

TEXTS = [
    "Market Mercado", "明日の市場は海の近くです 新しい店で魚を買う", "这个市场的鱼很便宜 我们买了水果", "fresh fish at the old market near the sea", "cá tươi ở chợ cũ gần biển, và bánh mới",
    "市", "海", "海 山 海 山", "這個市場離海邊很遠還會下雨", "ゆっくりあるいてかえりました", "テレビカメラ", "오늘은 market에서 생선을 삽니다", "시장은 바다 옆에 있다. 아침에 문을 열다.",
    "Good bread かいにいこう and fish さかなをたべる", "We bought fish at 시장은 바다 옆에 있습니다 today", "🌊🐟☀", "2024 365 7", "θάλασσα και ψάρι", "Свежая рыба", "?? -- !!", "", " \t \n ",
    "déjà goûté", "à côté du marché", "piñata mañana cigüeña", "fish42 bread7 sea2024", "我哋喺街市買嘢", "佢係唔係嚟咗", "山者，不在高也，其水而不深乎", "海也者，嘅而已矣",
    "我们从市场回来，谁让你进这个店", "臺北的市場裡有海魚", "老闆嘥咗魚，靚嘅", "儂去買魚", "甲魚阮買\U0002A736", "\U0002828E買\U00022CB7魚", "je cherche du pain frais avant la pluie ce soir", "le pain est dans le four", "leçon de façade",
    "la sœur et le bœuf", "海の近くの店で 这个市场的鱼很便宜 と聞いた", "海の近くで 魚 を買うのは楽しいです。", "She went to the market early. 魚はとても新鮮です。", "He wrote cá tươi ở chợ cũ on a small card",
    " much   room  here ", "te\x07xt wi\x1fth\r\nco\x85ntrols", "Wide　room and\xa0more", "海辺では新鮮海産物市場調査を行う。町の水産資源保護活動計画がある。", "也是 没有 不是 这是 是", "zxqvbk chợng phương khanh tranh", "Trời mưa lớn. Chúng tôi ở nhà!", "𠀋 ｻｶﾅ Ψά",
    "うみのちかくのみせで 我们买鱼 とかいてありました", "みせのなまえは 學會 といいます", "ともだちは 臺裡 とてがみにかいた", "かのじょは 嘥冚 とよんだ そして 語 もあった",
    "他們說臺北的市場裡有海魚", "他們說嘥時間，靚魚不見",
]


def rows() -> list[tuple[int, str]]:
    return [(-i, t) for i, t in enumerate(TEXTS, 1)]


#: Scores of a classifier for texts: (text, [(tag, confidence)], (unsupported label, confidence) or None).
SCORES = [
    ("市", [("zh-Hans", 1.0)], None),
    ("Market Mercado", [("es", 0.75), ("en", 0.25)], None),
    ("Market Mercado", [], ("xxx_Yyyy", 0.5)),
    ("Market Mercado", [("de", 0.5)], ("xxx_Yyyy", 0.25)),
    ("Свежая рыба", [("ru", 1.0)], None),
    ("海", [("ja", 0.75), ("zh-Hant", 0.25)], None),
    ("?? -- !!", [("en", 1.0)], None),
    ("le pain est dans le four", [("fr", 1.0), ("oc", 0.5)], None),
]

#: Confidences that stand in for a classifier's over the table: of the declared language, and of one as unsupported.
DECLARED = (0.75, 0.5)


def score_id(i: int) -> int:
    """The id of row i of SCORES beside those of TEXTS."""
    return -len(TEXTS) - 1 - i
