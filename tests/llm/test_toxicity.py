import itertools
import random
import time
import zlib

import pytest

from lexiloom.llm import toxicity as t


@pytest.fixture(scope="module")
def grammar():
    return t.Grammar({w + " ": 1.0 for w in t.INSULTS} | {"blerg": 1.0})


@pytest.mark.parametrize(
    "worse, better",
    [("you idiot", "the idiot"), ("you are an idiot", "you are not an idiot"), ("you idiot", "she said you idiot"), ("i will kill you. you kill", "kill the process"), ("blergish you", "ablerg you"), ("you moron. you scum", "you moron"), ("idiot, you", "idiot"), ("you idiot", "you idiot, he said")],
)
def test_grammar_reads_clauses(grammar, worse, better):
    assert grammar.read(worse) > grammar.read(better)


def every_path(machines, marks):
    """The sum over all ways through all machines, one after the other, that end in final states."""
    total = accepted = 0

    def go(at, states, factors):
        nonlocal total, accepted
        if at == len(marks):
            if all(s in m.finals for s, m in zip(states, machines)):
                accepted += 1
                total += sum(f * w for f, (_, w) in zip(factors, marks))
            return

        def through(k, mark, factor, after):
            if k == len(machines):
                go(at + 1, after, factors + [factor])
                return
            for written, f, to in machines[k].arcs.get((states[k], mark), ()):
                through(k + 1, written, factor * f, after + [to])

        through(0, marks[at][0], 1.0, [])

    for starts in itertools.product(*(m.starts for m in machines)):
        go(0, list(starts), [])
    return accepted, total


def test_composition_against_all_paths():
    machine, rng = t.composed(t.parts()), random.Random(4)
    for _ in range(300):
        marks = [(m, rng.choice([0.5, 1.0]) if m in t.WEIGHED else 0.0) for m in rng.choices(t.MARKS, k=rng.randint(0, 7))]
        accepted, total = every_path(t.parts(), marks)
        assert accepted == 1 and machine.weight(marks) == pytest.approx(total)


def test_long_texts_take_time_in_proportion(grammar):
    def seconds(n):
        began = time.perf_counter()
        grammar.read("you idiot and more words of no weight " * n)
        grammar.read("you idiot. and more words of no weight " * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(32_000) < 40 * max(seconds(2000), 0.005)


def test_no_carrying_over_clauses(grammar):
    assert grammar.clause("not you idiot".split()) < grammar.clause("you idiot".split())
    assert grammar.read("not. you idiot") > grammar.read("not you idiot")
    assert grammar.read("") == (0.0, 0.0)


def _corpus(spark, prose):
    docs, labels = [], []
    for i in range(600):
        words = prose(i, 40).split(" ")
        toxic = i % 4 == 0
        if toxic:
            words[5], words[20], words[30] = "zarg" + words[5], "zarg" + words[20], "fool"
        docs.append((i, " ".join(words), "xx", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark, prose):
    docs, labels = _corpus(spark, prose)
    got = t.toxicity(docs, t.train(docs, labels)).collect()
    assert len(got) == 600
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.97 * len(held)
    kept = t.without_toxic(docs, t.train(docs, labels))
    assert kept.columns == docs.columns and 430 <= kept.count() <= 460


def test_held_out_labels_are_not_read(spark, prose):
    docs, labels = _corpus(spark, prose)
    from pyspark.sql import functions as F

    lies = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert t.train(docs, labels) == t.train(docs, lies)


def test_odd_rows(spark, documents, odd_texts, clashing):
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    df = documents(odd_texts)
    grammar = t.train(df, none)
    got = t.toxicity(clashing(df), grammar).collect()
    assert len(got) == len(odd_texts) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert t.toxicity(documents([]), grammar).collect() == []
    assert t.train(documents([]), none.limit(0)).insults
    assert t.without_toxic(clashing(df), grammar).count() == len(odd_texts)


@pytest.mark.parametrize("of_ten", [3, 5, 8])
def test_stems_whatever_the_balance(spark, prose, of_ten):
    """Toxic documents without a seed word are caught where labels are balanced or mostly toxic, too."""
    docs = [(i, " ".join(("zarg" if i % 10 < of_ten and k in (5, 20, 30) else "") + w for k, w in enumerate(prose(i, 40).split(" ")))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    grammar = t.train(df, spark.createDataFrame([(i, int(i % 10 < of_ten)) for i in range(600)], "doc_id long, toxic int"))
    assert grammar.insult("zargword") > 0
    got = t.toxicity(df, grammar).where("held_out").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 10 < of_ten) for r in got) >= 0.97 * len(got)


def test_ratio_test_comes_before_the_limit(spark):
    """Stems of more toxic texts that fail the ratio test don't take the place of one that passes it."""
    rows = []
    for toxic in (1, 0):
        for i in range(200):
            words = [chr(0x4E00 + 1000 * toxic + 5 * i + k) for k in range(5)]
            words += [f"b{c}b" for j, c in enumerate("cdefgh") if (11 * j <= i < 11 * j + 11 if toxic else 2 * j <= i < 2 * j + 2)]
            rows.append((" ".join(words + ["zar"] * (toxic and 100 <= i < 110)), toxic))
    stems = t.learned_stems(spark.createDataFrame(rows, "text string, toxic int"), most=1)
    assert set(stems) - {w + " " for w in t.INSULTS} == {"zar"}
