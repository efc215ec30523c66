"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import fold, parts_of, words_of
from driftwood.llm.minhash import shingles
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Closed word classes in the languages of the corpus, and words to begin with where labels are few.
TARGETS = frozenset("you your yours u ur he him his she her they them their these those tu toi vous ton votre il elle ils "
                    "du dich dir ihr euch er sie tú ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor cannot isn aren wasn don didn doesn ne pas jamais ni nicht kein keine nie "
                      "nunca tampoco".split())
REPORTS = frozenset("said says say wrote writes called calls quote quoted quoting reported claims claimed told dit disait "
                    "écrit sagte sagt schrieb dijo dice escribió".split())
THREATS = frozenset("kill hurt destroy punish beat murder strangle tuer frapper töten schlagen matar golpear".split())
INSULTS = frozenset("idiot moron stupid scum trash loser pathetic worthless disgusting clown".split())

STEMS = (4, 5, 6)        # characters of a word's beginning that may stand for all its forms
FIT_ROWS = 20_000        # labelled rows that the lexicon and the weights are fitted on
EVENTS = "iqjazhg"       # insult, quoted, negated, aimed at a target, threat at a target, other threat, one taken back
# Weights before any label is seen: intercept, then one per event; fitting starts and is held there.
PRIOR = np.array([-3.0, 4.0, 1.0, 0.5, 4.5, 4.0, 0.5, 0.0])
OTHER = ("o", 0.0)
REMEMBERED = 100_000    # words whose class a task keeps at hand
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n|\"«»]")
_BREAK = frozenset(".!?;:\n|")
_QUOTE = frozenset("\"«»")


class Transducer:
    """A weighted finite-state transducer: arcs ``(state, symbol) -> (output, weight, state)``, one per symbol.

    ``final`` has the weight for ending in a state. Weights add up along a path; a symbol that was itself weighted, as
    an insult is by the transducer of its letters, multiplies the weight of the arc that reads it.
    """

    def __init__(self, start, arcs: dict, final: dict):
        self.start, self.arcs, self.final = start, arcs, final

    def compose(self, other: "Transducer") -> "Transducer":
        """Feeds this transducer's outputs to the other."""
        start = (self.start, other.start)
        arcs, final, todo, seen = {}, {}, [start], {start}
        while todo:
            a, b = state = todo.pop()
            if a in self.final and b in other.final:
                final[state] = self.final[a] + other.final[b]
            for (origin, symbol), (output, weight, target) in self.arcs.items():
                if origin != a or (b, output) not in other.arcs:
                    continue
                result, more, goal = other.arcs[b, output]
                following = (target, goal)
                arcs[state, symbol] = (result, weight + more, following)
                if following not in seen:
                    seen.add(following)
                    todo.append(following)
        return Transducer(start, arcs, final)

    def run(self, symbols) -> list[str]:
        """The outputs along the path."""
        state, outputs = self.start, []
        for symbol in symbols:
            output, _, state = self.arcs[state, symbol]
            outputs.append(output)
        return outputs

    def weigh(self, symbols, scales=None) -> float:
        """The weight of the path; ``scales`` are the weights of the symbols, 1 where they have none."""
        state, total = self.start, 0.0
        for i, symbol in enumerate(symbols):
            _, weight, state = self.arcs[state, symbol]
            total += weight if scales is None else weight * scales[i]
        return total + self.final[state]


# Symbols: o other, i insult, h threat, t target, n negation, r verb of reporting, " quotation mark; the grammar makes
# of insults and threats: a aimed at a target, j negated, q quoted, z threat at a target, g negated or quoted threat.


def negation_transducer(reach: int = 3) -> Transducer:
    """``j`` for an insult and ``g`` for a threat up to ``reach`` words behind a negation."""
    arcs = {}
    for state in range(reach + 1):
        for s in 'oithr"':
            arcs[state, s] = ({"i": "j", "h": "g"}.get(s, s) if state else s, 0.0, max(0, state - 1))
        arcs[state, "n"] = ("o", 0.0, reach)
    return Transducer(0, arcs, dict.fromkeys(range(reach + 1), 0.0))


def report_transducer() -> Transducer:
    """What follows a verb of reporting or stands between quotation marks is quoted: insults ``q``, threats ``g``."""
    arcs = {}
    for state in ("own", "reported", "quoted"):
        for s in "oijthg":
            arcs[state, s] = (s if state == "own" else {"i": "q", "h": "g"}.get(s, s), 0.0, state)
        arcs[state, "r"] = ("o", 0.0, "reported" if state == "own" else state)
        arcs[state, '"'] = ("o", 0.0, "own" if state == "quoted" else "quoted")
    return Transducer("own", arcs, dict.fromkeys(("own", "reported", "quoted"), 0.0))


def target_transducer(reach: int = 6, weights: dict[str, float] | None = None) -> Transducer:
    """``a`` for an insult and ``z`` for a threat up to ``reach`` words behind a target.

    ``weights`` are those of the arcs, by the event they put out.
    """
    def arc(output, state):
        return output, (weights or {}).get(output, 0.0), state

    arcs = {}
    for state in range(reach + 1):
        for s in "oijqhgaz":
            arcs[state, s] = arc({"i": "a", "h": "z"}.get(s, s) if state else s, max(0, state - 1))
        arcs[state, "t"] = arc("t", reach)
    return Transducer(0, arcs, dict.fromkeys(range(reach + 1), 0.0))


class Grammar:
    """All transducers composed into one that reads a clause forwards; the targets' alone then reads it backwards.

    What an insult or a threat is in the end shows on the way back, so the arcs of that way carry the weights of events.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.forwards = negation_transducer().compose(report_transducer()).compose(target_transducer())
        self.backwards = target_transducer(weights=None if weights is None else dict(zip(EVENTS, np.asarray(weights)[1:].tolist())))

    def events(self, symbols: str) -> list[str]:
        return self.backwards.run(self.forwards.run(symbols)[::-1])[::-1]

    def weigh(self, symbols: str, scales: list[float]) -> float:
        """The weight of a clause's path: of each event the arc's weight times that of the word."""
        return self.backwards.weigh(self.forwards.run(symbols)[::-1], scales[::-1])


class Letters:
    """The transducer of words: it reads letters, and insults and threats have paths whose arcs carry their weights.

    An entry for a word ends with the word; one for a beginning, written with a hyphen, loops on any letters behind it.
    Of the paths of a word the heaviest counts.
    """

    def __init__(self, insults: dict[str, float], threats: dict[str, float]):
        # A state is what was read. Its arcs go to the next letter; ``ends`` and ``loops`` weigh the paths' last arcs.
        self.arcs: dict[tuple[str, str], str] = {}
        self.ends: dict[str, tuple[float, str]] = {}
        self.loops: dict[str, tuple[float, str]] = {}
        for symbol, entries in (("h", threats), ("i", insults)):
            for entry, weight in entries.items():
                word = entry.removesuffix("-")
                for n in range(len(word)):
                    self.arcs[word[:n], word[n]] = word[:n + 1]
                place = self.loops if entry.endswith("-") else self.ends
                place[word] = max(place.get(word, (0.0, symbol)), (weight, symbol))

    def read(self, word: str) -> tuple[str, float]:
        state, best = "", (0.0, "o")
        for letter in word:
            state = self.arcs.get((state, letter))
            if state is None:
                break
            best = max(best, self.loops.get(state, best))
        else:
            best = max(best, self.ends.get(state, best))
        return best[1], best[0]


class Lexicon:
    """Word classes; an insult has a weight, from the entry for the word or for its beginning."""

    def __init__(self, learned: dict[str, float]):
        self.letters = Letters(dict.fromkeys(INSULTS, 1.0) | learned, dict.fromkeys(THREATS, 1.0))
        self.known: dict[str, tuple[str, float]] = {}

    def of(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[word] = self._of(word)
        return found

    def _of(self, word: str) -> tuple[str, float]:
        for classes, symbol in ((TARGETS, "t"), (NEGATIONS, "n"), (REPORTS, "r"), (THREATS, "h")):
            if word in classes:
                return symbol, 1.0
        found = self.letters.read(word)
        return found if found[1] > 0 else OTHER


def clauses(tokens: list[str]):
    part: list[str] = []
    for token in tokens:
        if token in _BREAK:
            if part:
                yield part
            part = []
        else:
            part.append(token)
    if part:
        yield part


def matched_clauses(text: str, lexicon: Lexicon):
    """Symbols and weights of the words of each clause that has an insult or a threat."""
    tokens = _TOKEN.findall(text.lower())
    if not any(lexicon.of(w)[0] in "ih" for w in set(tokens)):
        return
    for part in clauses(tokens):
        classes = [('"', 0.0) if w in _QUOTE else lexicon.of(w) for w in part]
        symbols = "".join([c[0] for c in classes])
        if "i" in symbols or "h" in symbols:
            yield symbols, [c[1] for c in classes]


def evidence(text: str, lexicon: Lexicon, machine: Grammar) -> np.ndarray:
    """How often each kind of event is found, words by their weights, and last the number of matched clauses.

    A clause is matched if the grammar finds an insult or a threat in it.
    """
    found = np.zeros(len(EVENTS) + 1)
    for symbols, scales in matched_clauses(text, lexicon):
        for event, weight in zip(machine.events(symbols), scales):
            if event in EVENTS:
                found[EVENTS.index(event)] += weight
        found[-1] += 1
    return found


def weighed(text: str, lexicon: Lexicon, machine: Grammar, intercept: float) -> tuple[float, int]:
    """The sum of the weights of a text's matched clauses, from the intercept, and their number."""
    total, number = intercept, 0
    for symbols, scales in matched_clauses(text, lexicon):
        total += machine.weigh(symbols, scales)
        number += 1
    return total, number


def _features(found: np.ndarray) -> np.ndarray:
    """Intercept and events: with the arcs' weights they make the sum of the clauses' weights."""
    return np.concatenate([[1.0], found[:len(EVENTS)]])


def _sketched(batches):
    known: dict[bytes, int] = {}
    for part, texts in (p for batch in batches for p in parts_of(batch)):
        runs = [shingles(words_of(t), 5, known) for t in texts]
        least = [int(r.min()) - 2**63 if len(r) else 0 for r in runs]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], names=["text", "label", "sketch"])


def _vocabulary(batches):
    counts: Counter = Counter()
    for part, texts in (p for batch in batches for p in parts_of(batch)):
        for text, label in zip(texts, part.column("label").to_pylist()):
            words = {t for t in _TOKEN.findall(text.lower()) if len(t) > 2}
            counts.update((w, label) for w in words)
            counts.update({(w[:n] + "-", label) for w in words for n in STEMS if len(w) >= n})
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
        names=["word", "label", "n"],
    )


def _evidence_batches(batches, learned, columns):
    lexicon, machine = Lexicon(learned), Grammar()
    for part, texts in (p for batch in batches for p in parts_of(batch)):
        found = [evidence(t, lexicon, machine) for t in texts]
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], names=[*columns, "evidence"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS, folds: int = 5, held: int = 0) -> tuple[dict[str, float], np.ndarray]:
    """Learned lexicon entries and event weights, from at most ``rows`` labelled documents outside fold ``held``.

    The rows are those first in hash order of their ids, near-copies aside. A word, or a beginning of words, enters the lexicon if
    documents marked toxic hold it much more often than the others; its weight grows with that ratio. The weights of
    the grammar's events come from a logistic regression that starts from, and is held near, ``PRIOR``. Labels that
    are null do not count; of several labels of one id the highest does.
    """
    labelled = labels.filter("toxic is not null").select(F.col(key).alias("_label_id"), F.col("toxic").cast("int").alias("_toxic"))
    labelled = labelled.filter(F.col("_label_id").isNotNull() & (fold(F.col("_label_id"), folds) != held))
    chosen = labelled.groupBy("_label_id").agg(F.max("_toxic").alias("label")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(rows)
    # At most ``rows`` ids and labels are broadcast.
    sample = docs.select(key, "text").join(F.broadcast(materialise(chosen, "toxic-ids")), F.col(key) == F.col("_label_id"))
    # Copies of one document would make all its words telling: of texts with the same smallest run of words one stays,
    # the one with the smallest label and text.
    sample = sample.select("text", "label").mapInArrow(_sketched, "text string, label int, sketch long")
    one = F.min(F.struct("label", "text")).alias("one")
    sample = materialise(sample.groupBy("sketch").agg(one).select("one.text", "one.label"), "toxic-sample")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sum(n for k, n in size.items() if k > 0), size.get(0, 0)
    counted = sample.mapInArrow(_vocabulary, "word string, label int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("label") > 0, F.lit(0)).otherwise(F.col("n"))).alias("no"))
    odds = F.log((F.col("yes") + 0.5) / (toxic + 1.0)) - F.log((F.col("no") + 0.5) / (other + 1.0))
    counted = materialise(counted.filter("yes >= 4"), "toxic-words")
    # So many toxic documents in a row that chance would not bring them up for any of the words looked at.
    row = (math.log(max(counted.count(), 1)) + 2) / max(-math.log(toxic / max(toxic + other, 1)), 0.1) if toxic else 0
    strong = counted.withColumn("odds", odds).filter((F.col("odds") > 3.5) & (F.col("yes") >= row))
    # The words of at most ``rows`` documents.
    entries = strong.orderBy(F.desc("odds"), "word").collect() if toxic and other else []
    learned = {r["word"]: min(r["odds"] / 6.0, 2.0) for r in entries}
    weighed = sample.mapInArrow(lambda b: _evidence_batches(b, learned, ["label"]), "label int, evidence array<double>")
    found = weighed.groupBy("label", "evidence").agg(F.count(F.lit(1)).alias("n")).collect()
    return learned, _regression(found)


def _regression(rows, steps: int = 400, hold: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton steps on grouped rows, held near ``PRIOR``."""
    if not rows:
        return PRIOR
    x = np.array([_features(np.array(r["evidence"])) for r in rows])
    y = np.array([float(r["label"] > 0) for r in rows])
    n = np.array([float(r["n"]) for r in rows])
    weights = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (y - p)) - hold * (weights - PRIOR)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def _scored(batches, learned, weights):
    lexicon, machine = Lexicon(learned), Grammar(weights)
    for part, texts in (p for batch in batches for p in parts_of(batch)):
        found = [weighed(t, lexicon, machine, float(weights[0])) for t in texts]
        scores = [1 / (1 + math.exp(-min(max(total, -30.0), 30.0))) for total, _ in found]
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(scores), pa.array([n for _, n in found], pa.int64())], names=["id", "score", "matched"])


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``score`` (0 to 1) and ``matched``, the number of clauses that the grammar matched.

    Null texts are empty; a text without a matched clause has the score of the intercept. Only the text is looked at.
    """
    learned, weights = fit(docs, labels, key, rows)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _scored(batches, learned, weights), f"id {kind}, score double, matched long")


def _clean(batches, learned, weights):
    lexicon, machine = Lexicon(learned), Grammar(weights)
    for part, texts in (p for batch in batches for p in parts_of(batch)):
        keep = [weighed(t, lexicon, machine, float(weights[0]))[0] < 0 for t in texts]
        yield part.filter(pa.array(keep, pa.bool_()))


def only_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, whole as they are: they are judged where they lie."""
    learned, weights = fit(docs, labels, key, rows)
    return docs.mapInArrow(lambda batches: _clean(batches, learned, weights), docs.schema)
