"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are read as marks: insult, threat, target (the reader, a person, a thing pointed at), negation, report or other.
Five transducers pass the marks of a clause on and weigh the insults and threats among them: insults count in full;
threats hardly without a target in the clause; insults more with one; either less within a negation's reach; and either
less in reported speech.  Where a target or a report may stand on either side, a transducer guesses at the clause's start
whether one is there, and only the path that guessed right ends in a final state.  The grammar is the composition of the
five.  A clause's weight is the sum of what its accepted path weighs, up to a bound; a text's score is logistic in its
clauses' weights.

Insults are a seed list and stems learned from labelled rows: beginnings of words that toxic texts hold far more often than
others, by a likelihood ratio that allows for the number of stems tried.  The logistic weights are fitted to the same rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, batched, least_by_hash, saved, shingle_sets, table, utf8

#: Labelled rows that the stems and weights are learned from, those with the smallest hash of doc_id if there are more.
LABELLED = 12_000
#: Stems that a model holds at most, those that occur in most toxic texts.
STEMS = 5_000
#: How many times the share of toxic texts with a stem must exceed that of the others.
LIFT = 4
REJECT = 0.7

INSULTS = "idiot idiots moron morons stupid imbecile scum loser losers trash worthless pathetic disgusting clown fool fools dumb dumbass jerk vermin garbage idiote crétin imbécile connard dummkopf arschloch idiota imbécil estúpido".split()
THREATS = "kill hurt destroy strangle crush stab shoot punch smash töten tuer matar".split()
TARGETS = "you your yours yourself u he she they him her them his their this that these those du dich dir ihr euch tu te toi vous tú ti usted".split()
NEGATIONS = "not no never nobody nothing neither nor without isn't aren't wasn't don't doesn't didn't can't won't nicht kein keine nie pas jamais aucun nunca jamás".split()
REPORTS = "said says say wrote writes told reported claimed called calls quoted according alleged sagte schrieb dit écrit dijo escribió".split()
#: Words after a negation within its reach.
REACH = 3
#: What an insult with a target in its clause, a threat without one, and either when negated or reported, count.
TARGETED, UNTARGETED, NEGATED, REPORTED = 1.5, 0.1, 0.2, 0.4
#: Most that one clause counts.
CLAUSE = 3.0
MARKS = ("insult", "threat", "target", "negation", "report", "other")
WEIGHED = ("insult", "threat")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE_END = re.compile(r"[.!?;\n\r]")
_FEATURES = 2


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, mark read) -> (mark written, factor, next state) of each way to go on."""

    starts: frozenset
    finals: frozenset
    arcs: dict

    def compose(self, other: "Transducer") -> "Transducer":
        """The transducer that reads what self reads and passes what self writes through other; factors multiply."""
        starts = frozenset((p, q) for p in self.starts for q in other.starts)
        arcs: dict = {}
        states, open_ = set(starts), list(starts)
        while open_:
            p, q = open_.pop()
            for read in MARKS:
                ways = [(written, f * g, (p2, q2)) for between, f, p2 in self.arcs.get((p, read), ()) for written, g, q2 in other.arcs.get((q, between), ())]
                if ways:
                    arcs[(p, q), read] = ways
                for _, _, to in ways:
                    if to not in states:
                        states.add(to)
                        open_.append(to)
        return Transducer(starts, frozenset((p, q) for p, q in states if p in self.finals and q in other.finals), arcs)

    def trimmed(self) -> "Transducer":
        """Without the states from which no final one can be reached; states are numbers."""
        back: dict = {}
        for (p, _), ways in self.arcs.items():
            for _, _, to in ways:
                back.setdefault(to, set()).add(p)
        useful, open_ = set(self.finals), list(self.finals)
        while open_:
            for p in back.get(open_.pop(), ()):
                if p not in useful:
                    useful.add(p)
                    open_.append(p)
        number = {p: i for i, p in enumerate(sorted(useful, key=repr))}
        arcs = {(number[p], m): [(w, f, number[to]) for w, f, to in ways if to in useful] for (p, m), ways in self.arcs.items() if p in useful}
        return Transducer(frozenset(number[p] for p in self.starts if p in useful), frozenset(number[p] for p in self.finals), arcs)

    def weight(self, clause: list[tuple[str, float]]) -> float:
        """The sum, over the accepted paths of (mark, weight) pairs, of weights times factors."""
        now = {p: (1, 0.0) for p in self.starts}
        for mark, w in clause:
            after: dict = {}
            for p, (paths, value) in now.items():
                for _, factor, to in self.arcs.get((p, mark), ()):
                    n, v = after.get(to, (0, 0.0))
                    after[to] = n + paths, v + value + paths * factor * w
            now = after
        return sum(v for p, (_, v) in now.items() if p in self.finals)


def _loop(state, to, **factors: float) -> dict:
    """Arcs from state to to that pass every mark on, with factors."""
    return {(state, m): [(m, factors.get(m, 1.0), to)] for m in MARKS}


def insult_transducer() -> Transducer:
    return Transducer(frozenset([0]), frozenset([0]), _loop(0, 0))


def _if_present(mark: str, **factors: tuple[float, float]) -> Transducer:
    """Weighs marks by whether mark is anywhere in the clause: factors are (if not, if so)."""
    arcs = _loop("none", "none", **{m: f[0] for m, f in factors.items()})
    del arcs["none", mark]
    for state in ("awaited", "seen"):
        arcs |= _loop(state, state, **{m: f[1] for m, f in factors.items()})
    arcs["awaited", mark] = [(mark, 1.0, "seen")]
    return Transducer(frozenset(["none", "awaited"]), frozenset(["none", "seen"]), arcs)


def threat_transducer() -> Transducer:
    return _if_present("target", threat=(UNTARGETED, 1.0))


def target_transducer() -> Transducer:
    return _if_present("target", insult=(1.0, TARGETED))


def report_transducer() -> Transducer:
    return _if_present("report", **{m: (1.0, REPORTED) for m in WEIGHED})


def negation_transducer() -> Transducer:
    """The state is the number of words that the last negation still reaches."""
    arcs = {}
    for k in range(REACH + 1):
        arcs |= _loop(k, max(k - 1, 0), **(dict.fromkeys(WEIGHED, NEGATED) if k else {}))
        arcs[k, "negation"] = [("negation", 1.0, REACH)]
    return Transducer(frozenset([0]), frozenset(range(REACH + 1)), arcs)


def parts() -> list[Transducer]:
    return [insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), report_transducer()]


def composed(machines: list[Transducer]) -> Transducer:
    out = machines[0]
    for m in machines[1:]:
        out = out.compose(m).trimmed()
    return out


@dataclass
class Grammar:
    """insults: stem -> weight, a stem that ends in a blank being a whole word."""

    insults: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [-4.0, 4.0, 1.0])

    def __post_init__(self):
        self.found = ahocorasick.Automaton()
        for s in self.insults:
            self.found.add_word(s.rstrip(), len(s.rstrip()))
        for s in THREATS:
            self.found.add_word(s, len(s))
        self.found.make_automaton()
        self.classes = {w: "target" for w in TARGETS} | {w: "negation" for w in NEGATIONS} | {w: "report" for w in REPORTS} | {w: "threat" for w in THREATS}
        self.sizes = sorted({len(s) for s in self.insults if s[-1] != " "}, reverse=True)
        self.machine = composed(parts())

    def insult(self, word: str) -> float:
        known = self.insults.get(word + " ")
        if known is not None:
            return known
        for n in self.sizes:
            known = self.insults.get(word[:n]) if len(word) >= n else None
            if known is not None:
                return known
        return 0.0

    def marks(self, words: list[str]) -> list[tuple[str, float]]:
        """(mark, weight) of each word; a word that is an insult is no other mark, and only insults and threats weigh."""
        out = []
        for w in words:
            weight = self.insult(w)
            kind = "insult" if weight else self.classes.get(w, "other")
            out.append((kind, weight or float(kind == "threat")))
        return out

    def clause(self, words: list[str]) -> float:
        """What the grammar weighs the words of one clause, up to CLAUSE."""
        marks = self.marks(words)
        if not any(m in WEIGHED for m, _ in marks):
            return 0.0
        return min(self.machine.weight(marks), CLAUSE)

    def read(self, text: str) -> tuple[float, float]:
        """Logs of one plus the sum of the clause weights, and of one plus what it comes to for every 600 characters.

        A clause is looked for from the end of the last one on, so that every character is seen a few times only.
        """
        text = text.lower()
        done = 0
        total = 0.0
        for last, size in self.found.iter(text):
            first = last - size + 1
            if first < done or (first and text[first - 1].isalnum()):
                continue
            ends = max(text.rfind(c, done, first) for c in ".!?;\n\r")
            stop = _CLAUSE_END.search(text, first)
            begin, done = max(ends + 1, done), stop.start() if stop else len(text)
            total += self.clause(_WORD.findall(text, begin, done))
        return float(np.log1p(total)), float(np.log1p(600 * total / max(len(text), 100)))

    def score(self, features) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


# --- learning ------------------------------------------------------------------------------------------------------


def _families(batches):
    """Adds the least shingle hash, which near copies mostly share."""
    for batch in batches:
        texts = utf8(batch.column(0))
        least = [int(s[0]) >> 1 if len(s) else 0 for a, b in batched(texts) for s in shingle_sets(texts[a:b])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "toxic", "family"])


def _stems(batches):
    """(stem, toxic texts, their words with it, other texts, their words with it) of a batch; a null stem counts all texts and words."""
    for batch in batches:
        seen: dict[str | None, list[int]] = {None: [0, 0, 0, 0]}
        for text, toxic in zip(*(batch.column(c).to_pylist() for c in range(2))):
            at = 0 if toxic else 2
            words = Counter(w for w in _WORD.findall((text or "").lower()) if len(w) < 40)
            stems: Counter = Counter()
            for w, n in words.items():
                stems[w + " "] += n
                for k in range(3, min(len(w), 10) + 1):
                    stems[w[:k]] += n
            stems[None] = sum(words.values())
            for s, n in stems.items():
                if s not in seen:
                    seen[s] = [0, 0, 0, 0]
                seen[s][at] += 1
                seen[s][at + 1] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())] + [pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4)], names=["stem", "toxic", "toxic_words", "other", "other_words"])


def _ratio(t: F.Column, n: F.Column, all_t: int, all_n: int) -> F.Column:
    """Twice the log likelihood ratio of t of all_t toxic and n of all_n other texts against one common share."""

    def part(k, m, share):
        return k * F.log(F.greatest(k, F.lit(1e-9)) / (m * share)) + (m - k) * F.log(F.greatest(m - k, F.lit(1e-9)) / (m * (1 - share)))

    t, n = t.cast("double"), n.cast("double")
    share = F.least(F.greatest((t + n) / (all_t + all_n), F.lit(1e-9)), F.lit(1 - 1e-9))
    return 2 * (part(t, all_t, share) + part(n, all_n, share))


def learned_stems(sample: DataFrame, most: int = STEMS) -> dict[str, float]:
    """Stem -> weight: how much more often words with it stand in toxic texts, on a logarithmic scale up to 1.

    Near copies count once.  A stem is taken if it stands in LIFT times the share of toxic texts and its likelihood ratio would hardly arise once among as many stems by
    chance; of nested stems the shortest stays unless a longer one stands in nearly the same toxic texts.
    """
    one = sample.select("text", "toxic").mapInArrow(_families, "text string, toxic int, family long").dropDuplicates(["family", "toxic"])
    names = ["toxic", "toxic_words", "other", "other_words"]
    counts = one.select("text", "toxic").mapInArrow(_stems, "stem string, " + ", ".join(f"{c} long" for c in names)).groupBy("stem").agg(*(F.sum(c).alias(c) for c in names))
    counts = saved(counts, "stems")
    whole = counts.where("stem is null").first()
    kept: dict[str, float] = {w + " ": 0.8 for w in INSULTS}
    if whole is None or not whole["toxic"] or not whole["other"]:
        return kept
    tried = counts.where("toxic >= 3").count()
    rare = 2 * np.log(max(tried, 10)) + 8
    # Shares of the texts of either kind are compared, so that the labels' balance doesn't tell what can be learned.
    lifted = F.col("toxic") * whole["other"] > LIFT * F.col("other") * whole["toxic"]
    rows = counts.where((F.col("toxic") >= 3) & lifted & F.col("stem").isNotNull()).where(_ratio(F.col("toxic"), F.col("other"), whole["toxic"], whole["other"]) >= float(rare))
    rows = rows.orderBy(F.desc("toxic"), "stem").limit(most).toPandas()
    found = {r.stem: r for r in rows.itertuples()}
    for r in counts.where(F.col("stem").isin(list(kept))).where("other >= 5 and other > toxic").select("stem").collect():
        del kept[r["stem"]]
    # A stem gives way to a longer one that stands in most of its toxic texts and in few or no more of the others.
    loose = set()
    for s in found:
        for n in range(3, len(s)):
            short, long = found.get(s[:n]), found[s]
            if short is not None and (long.toxic >= 0.9 * short.toxic and long.other <= short.other or long.toxic >= 0.6 * short.toxic and 10 * long.other <= short.other):
                loose.add(s[:n])
    for s in sorted(set(found) - loose, key=lambda s: (len(s), s)):
        if s in kept or not any(s[:n] in kept for n in range(3, len(s))):
            lift = ((found[s].toxic_words + 0.5) / whole["toxic_words"]) / ((found[s].other_words + 0.5) / whole["other_words"])
            kept[s] = float(np.clip(np.log(lift) / np.log(100), 0.2, 1))
    return kept


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps; no weight of a feature is below zero."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(4):
        w = np.where(keep, w, 0.0)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + 0.1 * w * np.r_[0, np.ones(len(w) - 1)]
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.where(keep, np.linalg.solve(h[np.ix_(keep, keep)], g[keep]) @ np.eye(len(w))[keep], 0.0)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
        keep[1:] &= w[1:] >= 0
    return [float(v) for v in w]


def _features(batches, grammar: Grammar):
    for batch in batches:
        got = [grammar.read(t or "") for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1)] + [pa.array([g[k] for g in got], pa.float64()) for k in range(_FEATURES)], names=["toxic", "f0", "f1"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Grammar:
    """The grammar learned from the labelled rows that are not held out; without labels of both kinds the seeds and fixed weights.

    Of a document's labels the highest toxic holds; null labels and ids are no labels.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_doc"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("_doc")))
    known = least_by_hash(known.groupBy("_doc").agg(F.max("toxic").alias("toxic")), most, "_doc")
    sample = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_doc")
    # Of several texts of a document one is read, so that the sample's bound holds.
    sample = sample.groupBy("_doc").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    sample = saved(sample.select("text", "toxic"), "labelled")
    grammar = Grammar(learned_stems(sample))
    rows = sample.select("text", "toxic").mapInArrow(lambda b: _features(b, grammar), "toxic int, f0 double, f1 double").toPandas().sort_values(["toxic", "f0", "f1"])
    y = rows["toxic"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return grammar
    return Grammar(grammar.insults, _fit(rows[["f0", "f1"]].to_numpy(), y))


def _score(batches, grammar: Grammar):
    for batch in batches:
        got = [grammar.read(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grammar.score(g) for g in got], pa.float64())], names=["doc_id", "score"])


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); the score is one of the text alone.

    A null or empty text has the score of a text without matches.  A null doc_id is not held out; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _score(b, grammar), "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def _keep(batches, grammar: Grammar, at: int):
    for batch in batches:
        fine = [grammar.score(grammar.read(t or "")) < REJECT for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(fine, pa.bool_()))


def without_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _keep(b, grammar, at), docs.schema)


def op6_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(DOC_COLUMNS)
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_clause_grammar": op6_clause_grammar}
SQL: dict[str, str] = {}
