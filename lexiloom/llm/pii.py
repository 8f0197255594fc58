"""Surrogates for personal data, with DataFrame functions only.

Detected entities are replaced by surrogates of the same type: every digit by a digit and every letter by one of the same
script and case (of a script without an alphabet here by a Latin one), country codes, issuer digits, top-level domains,
titles and Luhn validity kept, and names made for the gender that the title tells.  A title that tells none leaves it to
the other mentions of the name.  A surrogate is keyed: it derives from a secret, the type and the entity's canonical form,
so that an entity in other spellings has the same surrogate.  Surrogates of different entities differ, and none is
another entity of the corpus: colliding ones are drawn again until none is left, in time longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, saved, table

_L = r"[\p{L}\p{N}._%+\-]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TITLES_M = ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Sir"]
_TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Sra", "Señora"]
_NAME = r"\p{Lu}[\p{L}'’\-]+"
#: Type -> Java pattern; at one place the first that matches holds.
PATTERNS = {
    "email": rf"(?<!{_L}){_L}++(?<![.])@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{{2,}}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}+])[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+(?=(?:[ .()\-]*[0-9]){7})[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,12}(?:[ .\-][0-9]{2,12}){0,4}+|\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}|[0-9]{3}([.\-])[0-9]{3}\1[0-9]{4})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_TITLES_M + _TITLES_F)}|Dr|Prof)\.? {_NAME}(?: {_NAME})?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([.\-])[0-9]{3}\1", r"(?:-[0-9]{3}-|\.[0-9]{3}\.)")

#: What a text with a name holds: the beginnings of all titles.
_TITLE_SIGNS = ["Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Sr", "Señor", "Sir", "Dr", "Prof"]

#: Letters that stand for letters of a script.
_ALPHABETS = {
    "Latin": ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "Cyrillic": ("абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    "Greek": ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    "Armenian": ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՓՔՕՖ"),
    "Hebrew": ("אבגדהוזחטיכלמנסעפצקרשת",) * 2,
    "Arabic": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي",) * 2,
    "Devanagari": ("कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",) * 2,
    "Thai": ("กขคงจฉชซญฐณดตถทธนบปผฝพฟภมยรลวศสหอฮ",) * 2,
    "Hiragana": ("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",) * 2,
    "Katakana": ("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",) * 2,
    "Han": ("安白北成春大東方福高光海和花華江金開林龍明南平青秋仁日山水天文西新星雪陽永玉元月雲長中",) * 2,
    "Hangul": ("가강경고구기나남노다단도라로마명무미민바박보부비사산서성소수시신아안영오우원유은이인자장정조주지진차하한해현호",) * 2,
}
_ONSETS = {"Latin": "b c d f g k l m n p r s t v".split(), "Cyrillic": "б в г д к л м н п р с т".split(), "Greek": "β γ δ κ λ μ ν π ρ σ τ φ".split(), "Armenian": "բ գ դ կ լ մ ն պ ս տ".split()}
_VOWELS = {"Latin": "a e i o u".split(), "Cyrillic": "а е и о у".split(), "Greek": "α ε η ι ο".split(), "Armenian": "ա ե ի ո".split()}
#: Endings of given names by script: of men, of women, and those that tell neither.
_ENDINGS = {
    "Latin": {"m": "us as or in".split(), "f": "a ia ella ina".split(), "n": "is el en ey".split()},
    "Cyrillic": {"m": "ий ор ан ен".split(), "f": "а ия ина ела".split(), "n": "и ель о у".split()},
    "Greek": {"m": "ος ας ης ων".split(), "f": "α ια ινα ελα".split(), "n": "ι υ ω ε".split()},
    "Armenian": {"m": "են ոս ակ".split(), "f": "ա ուհի ինե".split(), "n": "ի ո".split()},
}
#: Draws after which a surrogate's host is drawn anew too, and after which every further draw is a letter or digit longer.
HOST_DRAWS, SAME_LENGTH_DRAWS = 8, 20


def entity_type(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def entities(text: Column) -> Column:
    """The entities of a text in order, as an array of strings."""
    return F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(1))


def _title(v: Column) -> Column:
    return F.regexp_extract(v, r"^(\p{L}+\.?) ", 1)


def canonical(kind: Column, v: Column) -> Column:
    """One form for all spellings of an entity; of a name the words without its title."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when(v.startswith("+"), F.concat(F.regexp_extract(v, r"^\+[0-9]{1,3}?(?=[ .\-(]|[0-9]{8,})", 0), F.lit(" "), digits)).otherwise(digits))
        .when(kind.isin("email", "secret"), F.lower(v))
        .when(kind == "iban", F.replace(v, F.lit(" "), F.lit("")))
        .when(kind == "name", F.lower(F.regexp_replace(v, r"^\p{L}+\.? ", "")))
        .otherwise(v)
    )


def gender(kind: Column, v: Column) -> Column:
    bare = F.regexp_replace(_title(v), r"\.", "")
    return F.when(kind != "name", "").when(bare.isin(_TITLES_F), "f").when(bare.isin(_TITLES_M), "m").otherwise("n")


def has_entities(text: Column) -> Column:
    """Whether a text holds an entity; those without a digit, an at sign or a title are told by quick scans."""
    sign = text.rlike("[@0-9]")
    for t in _TITLE_SIGNS:
        sign = sign | text.contains(t)
    return F.coalesce(sign & text.rlike(_ANY), F.lit(False))


def _number(seed: Column, i, n) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n) if isinstance(n, int) else n).cast("int")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _drawn_from(letters: Column, seed: Column, i) -> Column:
    """One letter of a string."""
    return F.substring(letters, _number(seed, i, F.length(letters)) + 1, F.lit(1))


def _letters_for(c: Column, digits: str) -> Column:
    """The letters that stand for c, null if c is neither letter nor digit."""
    out = F.when(c.rlike("[0-9]"), digits)
    for script, (low, up) in _ALPHABETS.items():
        if up != low:
            out = out.when(c.rlike(rf"^(?=\p{{Is{script}}})\p{{Lu}}$"), up)
        out = out.when(c.rlike(rf"^(?=\p{{Is{script}}})\p{{L}}$"), low)
    return out.when(c.rlike(r"\p{L}"), _ALPHABETS["Latin"][0]).when(c.rlike(r"\p{N}"), digits)


def _mapped(seed: Column, v: Column, digits: str = "0123456789") -> Column:
    """v with every letter and digit replaced by one of its kind; of a script without an alphabet here by one of Latin."""

    def one(c, i):
        return _let(_letters_for(c, digits), lambda letters: F.when(letters.isNull(), c).otherwise(_drawn_from(letters, seed, i)))

    return F.array_join(F.transform(F.split(v, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The weighted digit sum of a number whose last digit is the check digit."""
    size = F.length(digits)

    def weight(c, i):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(size - i, F.lit(2)) == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), weight), F.lit(0), lambda a, x: a + x)


def _octets(seed: Column) -> Column:
    return F.concat_ws(".", *(F.when(F.lit(i > 0), _number(seed, i, 254) + 1).otherwise(_number(seed, i, 223) + 1).cast("string") for i in range(4)))


def _name_word(word: Column, seed: Column, sex: Column, ends: bool, more: Column) -> Column:
    """A made-up word for a word of a name, in its script; ends: with an ending of the gender; with as many more letters."""

    def of(values) -> Column:
        """The value of the word's script, that of Latin if it has none here."""
        out = None
        for script in _ONSETS:
            if script != "Latin":
                cond = word.rlike(rf"\p{{Is{script}}}")
                out = F.when(cond, values(script)) if out is None else out.when(cond, values(script))
        return out.otherwise(values("Latin"))

    endings = of(lambda k: F.when(sex == "f", ",".join(_ENDINGS[k]["f"])).when(sex == "m", ",".join(_ENDINGS[k]["m"])).otherwise(",".join(_ENDINGS[k]["n"])))
    kit = F.struct(of(lambda k: F.lit("".join(_ONSETS[k]))).alias("onsets"), of(lambda k: F.lit("".join(_VOWELS[k]))).alias("vowels"), F.split(endings if ends else F.lit(""), ",").alias("endings"))

    def build(k):
        stem = F.concat(*(F.concat(_drawn_from(k.onsets, seed, 2 * i), _drawn_from(k.vowels, seed, 2 * i + 1)) for i in range(3)), F.repeat(F.left(k.vowels, F.lit(1)), more), _drawn_from(k.onsets, seed, 9))
        if ends:
            return F.concat(stem, F.get(k.endings, _number(seed, 12, F.size(k.endings))))
        return F.concat(stem, _drawn_from(k.vowels, seed, 10), _drawn_from(k.onsets, seed, 11))

    return F.initcap(_let(kit, build))


def _with(entity: Column, *names: str, **more: Column) -> Column:
    return F.struct(*(entity[n].alias(n) for n in names), *(v.alias(k) for k, v in more.items()))


def surrogates(found: Column, attempt, key: str) -> Column:
    """array<struct<kind,v,canon,s>> of array<struct<kind,v,canon,sex>>: s is the surrogate in canonical form, a name in the case it is written in.

    attempt tells an entity's draw.  Each step binds what the next uses, so that nothing is computed twice.
    """

    def seed(*of) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), *(F.lit(x) if isinstance(x, str) else x for x in of)), 256)

    base = ["kind", "v", "canon", "sex"]
    drawn = F.transform(found, lambda e: _with(e, *base, attempt=attempt(e).cast("string")))

    def parts(e):
        c = e.canon
        more = F.greatest(e.attempt.cast("int") - SAME_LENGTH_DRAWS, F.lit(0))
        body = (
            F.when(e.kind.isin("card", "ssn", "secret"), c)
            .when(e.kind == "phone", F.regexp_replace(c, r"^\+[0-9]+ ", ""))
            .when(e.kind == "email", F.regexp_extract(c, r"^(.*)@", 1))
            .when(e.kind == "iban", F.substr(c, F.lit(3)))
            .otherwise("")
        )
        return _with(
            e, *base, seed=seed(e.kind, c, e.attempt), body=F.concat(body, F.repeat(F.when(e.kind == "email", "a").otherwise("0"), more)), host=F.regexp_extract(c, r"@(.*)\.[a-z]+$", 1), code=F.regexp_extract(c, r"^(\+[0-9]+) ", 1),
            given=F.when(e.kind == "name", F.regexp_extract(c, r"^(\S+) ", 1)).otherwise(""), family=F.regexp_extract(c, r"(\S+)$", 1), attempt=e.attempt, more=more,
        )

    def seeds(e):
        # A null is left out of the seed, so that all surrogates of early draws share their hosts' surrogates.
        of_host = seed("host", e.host, F.when(e.attempt.cast("int") >= HOST_DRAWS, e.attempt))
        return _with(e, *base, "seed", "code", "given", "family", "more", "body", new=F.when(e.kind == "secret", "").otherwise(_mapped(e.seed, e.body)), host=_mapped(of_host, e.host), seed_given=seed("given", e.given, e.attempt), seed_family=seed("family", e.family, e.attempt))

    def checked(e):
        card = F.concat(F.left(e.canon, F.lit(1)), F.substr(e.new, F.lit(2), F.length(e.new) - 2))
        return _with(e, *base, "seed", "code", "given", "family", "more", "body", "new", "host", "seed_given", "seed_family", card=F.when(e.kind == "card", card).otherwise(""))

    def digit(e):
        check = F.pmod(10 - F.pmod(_luhn(F.concat(e.card, F.lit("0"))), F.lit(10)), F.lit(10))
        valid = F.pmod(_luhn(e.canon), F.lit(10)) == 0
        last = F.when(e.kind == "card", F.when(valid, check).otherwise(F.pmod(check + 1 + _number(e.seed, 99, 9), F.lit(10))).cast("string"))
        secret = F.when(e.kind == "secret", F.array_join(F.transform(F.split(e.body, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), _number(e.seed, i, 16) + 1, F.lit(1))), ""))
        name = F.when(e.kind == "name", F.concat(F.when(e.given != "", F.concat(_name_word(e.given, e.seed_given, e.sex, True, e.more), F.lit(" "))).otherwise(""), _name_word(e.family, e.seed_family, e.sex, False, e.more)))
        s = (
            F.when(e.kind == "card", F.concat(e.card, last))
            .when((e.kind == "phone") & (e.code != ""), F.concat(e.code, F.lit(" "), F.substr(e.code, F.lit(2)), F.substr(e.new, F.length(e.code))))
            .when(e.kind == "ip", F.concat(_octets(e.seed), F.when(e.more > 0, F.concat(F.lit("."), _number(e.seed, 98, 254).cast("string"))).otherwise("")))
            .when(e.kind == "email", F.concat(e.new, F.lit("@"), e.host, F.regexp_extract(e.canon, r"\.[a-z]+$", 0)))
            .when(e.kind == "secret", secret)
            .when(e.kind == "iban", F.concat(F.left(e.canon, F.lit(2)), e.new))
            .when(e.kind == "name", name)
            .otherwise(e.new)
        )
        return _with(e, "kind", "v", "canon", s=s)

    out = drawn
    for step in (parts, seeds, checked, digit):
        out = F.transform(out, step)
    return out


def written(kind: Column, v: Column, s: Column) -> Column:
    """A surrogate in the spelling of the entity that it replaces; the letters that it is longer by come last."""
    bare = F.regexp_replace(s, r"^\+[0-9]+ ", "")

    def digit(c, i):
        before = F.length(F.regexp_replace(F.left(v, i), "[^0-9A-Z]", ""))
        return F.when(c.rlike("[0-9A-Z]"), F.substr(bare, before + 1, F.lit(1))).otherwise(c)

    spaced = F.concat(F.array_join(F.transform(F.split(v, ""), digit), ""), F.substr(bare, F.length(F.regexp_replace(v, "[^0-9A-Z]", "")) + 1))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), spaced).when(kind == "name", F.concat(_title(v), F.lit(" "), s)).when(kind.isin("email", "secret") & (v == F.upper(v)), F.upper(s)).otherwise(s)


def found_entities(text: Column) -> Column:
    """array<struct<kind,v,canon,sex>> of a text's entities, in order."""
    typed = F.transform(entities(text), lambda v: F.struct(entity_type(v).alias("kind"), v.alias("v")))
    return F.transform(typed, lambda e: _with(e, "kind", "v", canon=canonical(e.kind, e.v), sex=gender(e.kind, e.v)))


def _drawn(rows: DataFrame, key: str) -> DataFrame:
    """rows (kind, canon, sex, attempt) with their surrogates s."""
    one = F.array(F.struct("kind", F.lit("").alias("v"), "canon", "sex", "attempt"))
    made = surrogates(F.transform(one, lambda e: _with(e, "kind", "v", "canon", "sex")), lambda e: F.col("attempt"), key)
    return rows.withColumn("s", F.get(made, 0)["s"])


def known_sex(found: DataFrame) -> DataFrame:
    """(kind, canon, sex, known) of every distinct mention of found: a name whose title tells no sex has that of its other mentions, if they tell one."""
    who = found.where("kind is not null").groupBy("kind", "canon").agg(F.collect_set("sex").alias("sexes"))
    told = F.filter("sexes", lambda x: x.isin("m", "f"))
    mention = who.select("kind", "canon", F.explode("sexes").alias("sex"), F.when(F.size(told) == 1, F.get(told, 0)).alias("one"))
    return mention.select("kind", "canon", "sex", F.when((F.col("sex") == "n") & F.col("one").isNotNull(), F.col("one")).otherwise(F.col("sex")).alias("known"))


def mapping(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sex, attempt, s) of every distinct entity of found (kind, canon, sex), such that all surrogates differ and none is an entity.

    What is drawn again is the entity whose surrogate is another's (all but the least canonical form of a group) or an
    entity of the corpus.  Names of either gender are different entities.  Where a kind has no room for that many surrogates of
    its entities' lengths, draws get longer from SAME_LENGTH_DRAWS on, so that the drawing ends.
    """
    who = ["kind", "canon", "sex"]
    every = saved(found.where("kind is not null").select(who).distinct(), "entities")
    drawn = saved(_drawn(every.withColumn("attempt", F.lit(0)), key), "drawn")
    real = every.select("kind", F.col("canon").alias("plain")).distinct()
    while True:
        plain = drawn.withColumn("plain", F.when(F.col("kind") == "name", F.lower("s")).otherwise(F.col("s")))  # as canonical forms are written
        taken = plain.groupBy("kind", "plain").agg(F.min(F.struct("canon", "sex")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        clash = plain.join(taken, ["kind", "plain"]).where(F.struct("canon", "sex") != F.col("first")).select(who).union(plain.join(real, ["kind", "plain"], "left_semi").select(who))
        clash = saved(clash.distinct(), "clash")
        if not clash.take(1):
            return drawn
        again = drawn.join(clash, who, "left_semi").select(*who, (F.col("attempt") + 1).alias("attempt"))
        drawn = saved(drawn.join(clash, who, "left_anti").unionByName(_drawn(again, key)), "drawn")


def replace_personal_data(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """docs with surrogates for the entities of column text, and n_entities.

    Texts without entities, null and empty ones are returned as they are, with n_entities 0.  Rows are taken as they
    are: repeated rows, null ids and other columns (but one named n_entities, which is replaced) stay.  An empty table gives
    an empty result.  The same entity has the same surrogate in all rows, in whatever spelling.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(columns)
    clear = docs.where(~has_entities(F.col("text"))).withColumn("n_entities", F.lit(0))
    held = docs.where(has_entities(F.col("text"))).select(F.struct(*columns).alias("row"), found_entities(F.col("text")).alias("found"), F.split("text", _ANY, -1).alias("between"))
    held = saved(held.withColumn("rid", F.monotonically_increasing_id()), "private")
    mentions = saved(known_sex(held.select(F.explode("found").alias("e")).select("e.kind", "e.canon", "e.sex")), "mentions")
    chosen = mapping(mentions.select("kind", "canon", F.col("known").alias("sex")), key)
    later = chosen.where("attempt > 0").select("kind", "canon", F.col("sex").alias("known"), "attempt")
    odd = mentions.join(later, ["kind", "canon", "known"], "left").where("attempt > 0 or known <> sex").select("kind", "canon", "sex", F.struct(F.coalesce("attempt", F.lit(0)).alias("attempt"), "known").alias("draw"))
    odd = saved(odd, "odd")
    plain = F.struct(F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("known"))
    if odd.take(1):
        hits = held.select("rid", F.explode("found").alias("e")).select("rid", "e.kind", "e.canon", "e.sex").distinct().join(odd, ["kind", "canon", "sex"])
        hits = hits.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon", "sex"), "draw"))).alias("draws"))
        held = held.join(hits, "rid", "left")

        def draw(e):
            return F.coalesce(F.element_at(F.col("draws"), F.concat_ws("|", e.kind, e.canon, e.sex)), plain)
    else:

        def draw(e):
            return plain

    bound = F.transform(F.transform("found", lambda e: _with(e, "kind", "v", "canon", "sex", draw=draw(e))), lambda e: _with(e, "kind", "v", "canon", sex=F.coalesce(e.draw.known, e.sex), attempt=e.draw.attempt))
    new = F.transform(surrogates(bound, lambda e: e.attempt, key), lambda e: F.when(e.kind.isNull(), e.v).otherwise(written(e.kind, e.v, e.s)))
    held = held.withColumn("new", new)
    text = F.concat(F.array_join(F.transform(F.col("new"), lambda s, i: F.concat(F.get(F.col("between"), i), s)), ""), F.element_at("between", -1))
    made = held.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns), F.size("found").alias("n_entities"))
    return clear.unionByName(made)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents").select(DOC_COLUMNS))


QUERIES = {"op2_surrogates": op2_surrogates}
SQL: dict[str, str] = {}
