"""Quality rules: a learned decision list over text statistics, applied as ordered Spark conditionals.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled rows by information gain
and pruned on the other third.  If it is precise enough the rows that it covers are set aside; if not, its first condition
is, and no later rule begins with it.  The next rule is grown on what is left, until no bad rows or conditions are.  Rows that
the base rule rejects are no rows to learn from.  The rules reject; what no rule covers is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import Words, least_by_hash, table

#: Labelled rows that the list is learned from, those with the smallest hash of doc_id if there are more.
LABELLED = 20_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_stutters"]
#: Statistics that rules may test: shares, so that a text's length alone decides nothing.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "stutter_share": ("n_stutters", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def statistics(text: str) -> tuple[int, ...]:
    """The counts _COUNTS of one text."""
    raw = text.encode()
    words = Words([raw])
    n = len(words.hash)
    if not n:
        return (0,) * len(_COUNTS)
    byte = words.raw
    per = np.bincount(byte, minlength=256)
    # Code points in words: bytes that are neither white space nor continuations.
    chars = int(per[:128].sum() + per[192:].sum()) - int(per[[32, 9, 10, 11, 12, 13]].sum())
    symbols = int(per[_SYMBOLS].sum())
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line and not line.strip("\x20\x09\x0a\x0b\x0c\x0d") == "":
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    h = words.hash
    if n >= 9:
        window = np.zeros(n - 7, np.uint64)
        for j in range(8):
            window = window * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n - 7]
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
        if len(again):
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, again, 1)
            np.add.at(step, again + 8, -1)
            repeat = int((np.cumsum(step[:n]) > 0).sum())
    upper = int(per[65:91].sum()) if text.isascii() else sum(map(str.isupper, text))
    return n, chars, symbols, dup, repeat, lines, upper, int(per[48:58].sum()), int(per[33:48].sum() + per[58:65].sum()), int((h[1:] == h[:-1]).sum())


def _statistics(batches):
    for batch in batches:
        for ids, texts in text_batches(batch):
            rows = [statistics(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", *_COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _statistics, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
    )


@dataclass(frozen=True)
class Rule:
    """Covers rows with all of the conditions (feature, at_least, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, up, t in self.conditions:
            out &= x[f] >= t if up else x[f] <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, up, t in self.conditions:
            out = out & (feature(f) >= t if up else feature(f) <= t)
        return out


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


def _gain(p0, n0, p, n):
    """FOIL's gain of a refinement that leaves p of p0 positive and n of n0 negative rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(p0 / max(p0 + n0, 1))), -np.inf)


def _grow(x, y, rows, barred=frozenset()) -> list[tuple[str, bool, float]]:
    """Conditions by gain, four at most; the first is none of the barred (feature, at_least)."""
    out: list[tuple[str, bool, float]] = []
    while len(out) < 4:
        p0, n0 = int(y[rows].sum()), int((~y[rows]).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f, v in x.items():
            v = v[rows]
            order = np.argsort(v, kind="stable")
            s, pos = v[order], y[rows][order]
            cp, cn = np.cumsum(pos), np.cumsum(~pos)
            cut = np.flatnonzero(s[1:] > s[:-1])  # between cut and cut + 1
            if not len(cut):
                continue
            mid = (s[cut] + s[cut + 1]) / 2
            for up, p, n in ((False, cp[cut], cn[cut]), (True, p0 - cp[cut], n0 - cn[cut])):
                if not out and (f, up) in barred:
                    continue
                g = _gain(p0, n0, p, n)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), (f, up, float(mid[k])))
        if best[1] is None:
            break
        out.append(best[1])
        f, up, t = best[1]
        rows = rows[x[f][rows] >= t] if up else rows[x[f][rows] <= t]
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray, precision: float = 0.9, most: int = 12) -> list[Rule]:
    """Rules that cover bad rows; order deals rows to the growing (not a multiple of 3) and the pruning set.

    A rule counts as precise by Laplace's estimate over the rows of both sets that it covers, and if no more than one
    in four of the pruning rows that it covers, which it wasn't grown on, is good.
    """
    grow, prune = np.flatnonzero(order % 3 != 0), np.flatnonzero(order % 3 == 0)
    rules: list[Rule] = []
    barred: set[tuple[str, bool]] = set()
    while len(rules) < most and bad[grow].sum() >= 3:
        conditions = _grow(x, bad, grow, barred)
        if not conditions:
            break

        def covered(c, rows):
            hit = Rule(tuple(c)).covers({f: v[rows] for f, v in x.items()})
            return int((hit & bad[rows]).sum()), int((hit & ~bad[rows]).sum())

        def worth(c):
            p, n = covered(c, prune)
            return (p - n) / max(p + n, 1), p

        best = max(range(len(conditions), 0, -1), key=lambda k: worth(conditions[:k]))
        rule = Rule(tuple(conditions[:best]))
        (p, n), (p_all, n_all) = covered(rule.conditions, prune), covered(rule.conditions, np.concatenate([grow, prune]))
        if p < 1 or 3 * n > p or (p_all + 1) / (p_all + n_all + 2) < precision:
            barred.add(conditions[0][:2])
            continue
        rules.append(rule)
        hit = rule.covers(x)
        grow, prune = grow[~hit[grow]], prune[~hit[prune]]
    return rules


def learned_rules(stats: DataFrame, labels: DataFrame, most_rows: int = LABELLED) -> list[Rule]:
    """Rules learned from the statistics of labelled documents that pass the base rule, at most most_rows of them; without labels of both kinds none."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = least_by_hash(known, most_rows, "doc_id")
    rows = stats.where(~base_failed()).join(F.broadcast(known), "doc_id").select("doc_id", "quality", F.xxhash64("doc_id").alias("order"), *_COUNTS).orderBy("doc_id", *_COUNTS).toPandas()
    if rows["quality"].nunique() < 2:
        return []
    x = {f: rows[a].to_numpy(np.float64) / np.maximum(rows[b].to_numpy(np.float64), 1) for f, (a, b) in FEATURES.items()}
    return learn(x, rows["quality"].to_numpy() == 0, rows["order"].to_numpy())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, rule (the number of the first rule that rejects, else null) and kept."""
    rule = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        rule = F.when(rules[k].column(), F.lit(k)).otherwise(rule)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, most_rows: int = LABELLED) -> DataFrame:
    """One row for each row of docs (doc_id, text) with its statistics and verdict.

    A null or empty text has no words and fails the base rule.  A row whose doc_id is null or repeated is judged like any
    other; of a document's labels the lowest quality holds.  Without labels of both kinds only the base rule decides.  Other columns
    are ignored, an empty table gives an empty result.  Labels, ids and sources are no input of a verdict.
    """
    stats = text_statistics(docs)
    few = least_by_hash(labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), most_rows, "doc_id")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id", "left_semi")
    # Of several texts of a document one is read, so that the sample's bound holds.
    sample = text_statistics(labelled.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    rules = learned_rules(sample, labels, most_rows)
    return judge(stats, rules)


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op9_decision_list": op9_decision_list}
SQL: dict[str, str] = {}
