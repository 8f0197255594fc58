import re

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import pii

SAMPLES = {
    "email": ["joe.doe+x@mail.example.com", "JOE@EXAMPLE.ORG", "ünal.7@firma.de"],
    "phone": ["+1 (017) 555-7713", "(123) 456-7890", "123-456-7890", "+49 30 1234567"],
    "card": ["4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004"],
    "ip": ["10.0.0.255", "97.51.17.173"],
    "ssn": ["123-45-6789"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"],
    "iban": ["DE89 3704 0044 0532 0130 00"],
    "name": ["Mr. John Smith", "Mrs Anna Keller", "Frau Müller"],
}
CLEAN = ["version 2.0 of 2024-01-01", "pi is 3.14159", "1.2.3.4.5 and 999.1.1.1", "a@b", "12345", "no data here", "deadbeef", "Mr nobody", "build 1.2.3"]


def luhn(s):
    d = [int(x) for x in s if x.isdigit()][::-1]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


def shape(s):
    return re.sub(r"[A-Z]", "A", re.sub(r"[^\W\d_A-Z]", "a", re.sub(r"\d", "9", s)))


def replaced(documents, texts, key="k"):
    return {r["doc_id"]: r["text"] for r in pii.replace_personal_data(documents(texts), key).collect()}


def test_every_type_keeps_its_form(documents):
    flat = [(k, v) for k, vs in SAMPLES.items() for v in vs]
    got = replaced(documents, [f"before {v}, after" for _, v in flat])
    for i, (kind, v) in enumerate(flat):
        new = re.fullmatch("before (.*), after", got[i])[1]
        assert new != v
        if kind == "ip":
            assert all(0 < int(x) < 256 for x in new.split("."))
        elif kind == "name":
            assert new.split(" ")[0] == v.split(" ")[0] and len(new.split(" ")) == len(v.split(" "))
        elif kind == "secret":
            assert len(new) == len(v) and (new == new.upper()) == (v == v.upper())
        elif kind != "email":
            assert shape(new) == shape(v)
        else:
            assert re.sub(r"\w", "a", new) == re.sub(r"\w", "a", v) and new.lower().endswith(v.lower()[v.rindex(".") :])
        if kind == "card":
            assert luhn(new) == luhn(v) and new[0] == v[0]
        if kind == "phone" and v[0] == "+":
            assert new.split(" ")[0] == v.split(" ")[0]


def test_clean_texts_stay(documents):
    assert replaced(documents, CLEAN) == dict(enumerate(CLEAN))


def test_coreference_over_spellings_and_rows(documents):
    got = replaced(documents, ["4111 1111 1111 1111 is 4111111111111111", "4111-1111-1111-1111", "JOE@EXAMPLE.COM joe@example.com", "x@example.com", "Mr. Smith and Mr John Smith"])
    cards = [re.sub(r"\D", "", x) for x in (got[0].split(" is ")[0], got[0].split(" is ")[1], got[1])]
    assert len(set(cards)) == 1
    a, b = got[2].split(" ")
    assert a.lower() == b and got[3].split("@")[1] == b.split("@")[1]
    assert got[4].split(" and ")[0].split(" ")[-1] == got[4].split(" ")[-1]


def test_gender_shows(documents):
    got = replaced(documents, [f"{t} Kim Reed{c}" for c in "abcdefgh" for t in ("Mr", "Mrs")])
    given = [got[i].split(" ")[1] for i in range(16)]
    assert all(g[-1] == "a" for g in given[1::2]) and all(g[-1] != "a" for g in given[::2])


def test_another_key_gives_others(documents):
    assert replaced(documents, ["4111111111111111"], "a") != replaced(documents, ["4111111111111111"], "b")


def test_surrogates_differ_where_room_is_scarce(spark, monkeypatch):
    """With a generator of 300 values, 60 entities get different ones, none of them an entity."""
    found = spark.createDataFrame([("ssn", f"{i:09d}", "") for i in range(60)], "kind string, canon string, sex string")

    def small(rows, key):
        return rows.withColumn("s", F.lpad(F.pmod(F.xxhash64("canon", "attempt"), F.lit(300)).cast("string"), 9, "0"))

    monkeypatch.setattr(pii, "_drawn", small)
    got = pii.mapping(found, "k").collect()
    s = [r["s"] for r in got]
    assert len(s) == len(set(s)) == 60 and not set(s) & {f"{i:09d}" for i in range(60)}


def test_longer_surrogates_where_there_is_no_room(spark, documents, monkeypatch):
    """All one-letter addresses of a host, and then hardly any room at all: draws get longer and nothing fails."""
    texts = [f"{c}@b.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    got = replaced(documents, texts)
    assert len(set(got.values())) == 26 and not set(got.values()) & set(texts)
    monkeypatch.setattr(pii, "SAME_LENGTH_DRAWS", -1)
    texts = ["123-45-6789", "4111 1111 1111 1111", "10.0.0.1", "Mr. John Smith", "joe@b.com", "DE89 3704 0044 0532 0130 00", "+1 (017) 555-7713"]
    longer = replaced(documents, texts)
    assert all(len(longer[i]) > len(t) or "." in t for i, t in enumerate(texts)) and longer[2].count(".") == 4


def test_no_surrogate_is_a_name_of_the_corpus(documents):
    """A name that the first draw would give is in the corpus itself: it is drawn again."""
    drawn = replaced(documents, ["Mr John Smith"])[0]
    got = replaced(documents, ["Mr John Smith", drawn])
    assert got[0] != drawn and got[1] != drawn and got[0] != got[1]


OTHER_SCRIPTS = ["王小明@example.com", "שלום.לוי@example.com", "محمد7@example.com", "νίκος@example.gr", "иван@example.ru", "やまだ@example.jp", "ヤマダ@example.jp", "홍길동@example.kr", "नमन@example.in", "สมชาย@example.th", "արամ@example.am", "ⴰⵢⵓ٣@example.ma"]


def test_no_letter_of_an_entity_stays_by_rule(documents):
    """In any script: other letters of the same script, or of Latin."""
    import unicodedata

    keys = [replaced(documents, OTHER_SCRIPTS, k) for k in ("a", "b", "c")]
    for i, v in enumerate(OTHER_SCRIPTS):
        old = v.split("@")[0]
        for at, c in enumerate(old):
            new = [k[i].split("@")[0][at] for k in keys]
            if c.isalnum():
                assert set(new) != {c}
                script = unicodedata.name(c).split(" ")[0]
                assert all(unicodedata.name(x).split(" ")[0] == script or script in ("TIFINAGH", "ARABIC-INDIC") for x in new)


def test_names_in_other_scripts(documents):
    got = replaced(documents, ["Mr. Νίκος Παπαδόπουλος", "Mrs. Анна Иванова", "Dr. Արամ Խաչատրյան"])
    assert re.fullmatch(r"Mr\. [Α-Ωα-ω]+ [Α-Ωα-ω]+", got[0]) and re.fullmatch(r"Mrs\. [А-Яа-я]+ [А-Яа-я]+", got[1]) and re.fullmatch(r"Dr\. [Ա-և]+ [Ա-և]+", got[2])


def test_one_person_with_titles_that_tell_and_that_do_not(documents):
    got = replaced(documents, ["Mrs. Anna Keller and Dr. Anna Keller", "Prof. Anna Keller", "Dr. Kim Reed", "Mr Kim Lee, Mrs Kim Lee and Dr Kim Lee"])
    a, b = (x.split(" ", 1)[1] for x in got[0].split(" and "))
    assert a == b == got[1].split(" ", 1)[1] and a.split(" ")[0][-1] == "a"
    assert got[2].split(" ")[1].endswith(("is", "el", "en", "ey"))
    men, women, neither = (re.sub(r"^\S+ ", "", x) for x in re.split(", | and ", got[3]))
    assert len({men, women, neither}) == 3


def test_against_a_plain_version(documents):
    """Addresses and numbers of the first draw, computed letter by letter."""
    import hashlib

    xxhash = pytest.importorskip("xxhash")

    def number(seed, i, n):
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(seed.encode(), seed=42))
        return (h - 2**64 if h >= 2**63 else h) % n

    def seed(*of):
        return hashlib.sha256("|".join(("k", *of)).encode()).hexdigest()

    def mapped(by, v):
        kinds = ["0123456789", *(x for pair in list(pii._ALPHABETS.values()) for x in pair)]
        out = ""
        for i, c in enumerate(v):
            letters = next((x for x in kinds if c in x), None)
            out += letters[number(by, i, len(letters))] if letters else c
        return out

    emails, ssns = ["joe.doe+x@mail.example.com", "иван@b.org", "王小明@example.com"], ["123-45-6789", "987-65-4321"]
    emails[2] = "中文@example.com"
    got = replaced(documents, emails + ssns)
    for i, v in enumerate(emails):
        local, host, top = re.fullmatch(r"(.*)@(.*)(\.[a-z]+)", v).groups()
        assert got[i] == mapped(seed("email", v, "0"), local) + "@" + mapped(seed("host", host), host) + top
    for i, v in enumerate(ssns, len(emails)):
        digits = v.replace("-", "")
        new = mapped(seed("ssn", digits, "0"), digits)
        assert got[i] == f"{new[:3]}-{new[3:5]}-{new[5:]}"


def test_draws_reach_the_texts(spark, documents, monkeypatch):
    """Texts show the surrogates that the mapping chose, whatever draw they are from."""
    whole = pii.mapping

    def twice(found, key):
        return pii._drawn(whole(found, key).select("kind", "canon", "sex", (F.col("attempt") + 1).alias("attempt")), key)

    texts = ["a 123-45-6789 b 10.1.2.3", "10.1.2.3 c"]
    plain = replaced(documents, texts)
    monkeypatch.setattr(pii, "mapping", twice)
    again = replaced(documents, texts)
    assert again[1] != plain[1] and again[0].endswith(again[1].split(" ")[0])


def test_no_python_on_executors(documents):
    plan = pii.replace_personal_data(documents(["joe@example.com"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(documents, odd_texts, clashing):
    df = clashing(documents(odd_texts + [(20, "joe@example.com"), (None, "joe@example.com")]))
    got = pii.replace_personal_data(df)
    assert got.columns == df.columns + ["n_entities"] and got.count() == len(odd_texts) + 2
    texts = {r["doc_id"]: r["text"] for r in got.where("doc_id < 10").collect()}
    assert texts == {i: t for i, t in odd_texts if i is not None}
    assert len({r["text"] for r in got.where("n_entities = 1").collect()}) == 1
    assert pii.replace_personal_data(documents([])).collect() == []
