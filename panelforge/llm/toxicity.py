"""Toxicity scores: a learned lexicon, matched by Levenshtein automata, and the context of each match."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import drop, materialize

#: Letters and digits, as digits stand for letters in misspellings; so do a few signs within a word.
WORD = re.compile(r"[^\W_]+(?:[@$*|][^\W_]+)*")
#: Labelled rows that the lexicon and the classifier are learned from: at most so many of each label, chosen by a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 4000, 8000
#: Words on either side of a match that count as its context.
WINDOW = 8
# Words that report, name or reject an expression rather than use it, and words that address someone.
REPORTING = set("said says say called calls term word words quote quoted quotes slur insult insulting insults offensive hurtful phrase phrases spelling means meaning writes wrote reported alleged dictionary define defined definition never nobody".split())
ADDRESSING = set("you your youre yourself u ur du dich ihr euch tu te vous toi usted".split())
_QUOTES = "\"“”„«»‘’'`‹›"
#: A rule, not learned: where all matches are both quoted and reported, so much is taken off the log odds; of some of them, their share.
QUOTATION = 6.0
FEATURES = ("any", "log_hits", "log_terms", "density", "exact", "weight", "quoted", "reported", "addressed", "loud")


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    errors: int
    stem: bool


class Automaton:
    """The lexicon's trie intersected with the Levenshtein automata of its terms, determinised as it is used.

    A state is a set of (trie node, errors so far); a word is read a character
    at a time until no state is left.
    """

    def __init__(self, terms: list[Term], known: frozenset[str] = frozenset()):
        self.terms, self.known = terms, known
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.allow: list[int] = [0]
        for k, t in enumerate(terms):
            node = 0
            self.allow[0] = max(self.allow[0], t.errors)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.allow.append(0)
                node = self.children[node][c]
                self.allow[node] = max(self.allow[node], t.errors)
            self.ends[node] = k
        self.letters = {c for t in terms for c in t.text}
        self.states: list[frozenset[tuple[int, int]]] = []
        self.index: dict[frozenset[tuple[int, int]], int] = {}
        self.accepts: list[list[tuple[int, int]]] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})
        self.heads: dict[str, bool] = {}
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _state(self, now: set[tuple[int, int]]) -> int:
        """The state's number, after leaving out term letters and dropping what a smaller error count covers; -1 for none."""
        best: dict[int, int] = {}
        todo = list(now)
        while todo:
            node, e = todo.pop()
            if e > self.allow[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.children[node].values()]
        state = frozenset(best.items())
        if not state:
            return -1
        if state not in self.index:
            self.index[state] = len(self.states)
            self.states.append(state)
            self.accepts.append([(k, e) for n, e in state if (k := self.ends[n]) >= 0 and e <= self.terms[k].errors])
        return self.index[state]

    def _step(self, state: int, c: str) -> int:
        if c not in self.letters:
            c = "\0"
        key = state, c
        if key not in self.steps:
            now: set[tuple[int, int]] = set()
            for node, e in self.states[state]:
                now.add((node, e + 1))
                for d, n in self.children[node].items():
                    now.add((n, e if d == c else e + 1))
            self.steps[key] = self._state(now)
        return self.steps[key]

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the best match: fewest errors, then the longest term; None if there is none.

        A stem may be followed by anything, another term by two letters at most.
        A word with errors that is known from clean texts is no match.
        """
        head = word[:4]
        alive = self.heads.get(head)
        if alive is None:
            state = self.start
            alive = bool(self.accepts[state]) if state >= 0 else False
            for c in head:
                state = self._step(state, c)
                if state < 0:
                    break
                alive = alive or bool(self.accepts[state])
            alive = alive or state >= 0
            if len(self.heads) > 500_000:
                self.heads.clear()
            self.heads[head] = alive
        if not alive:
            return None
        if word in self.memo:
            return self.memo[word]
        state, best = self.start, None
        for i, c in enumerate(word):
            state = self._step(state, c)
            if state < 0:
                break
            for k, e in self.accepts[state]:
                t = self.terms[k]
                if (t.stem or len(word) - i - 1 <= 2) and (best is None or (e, -len(t.text)) < best[1]):
                    best = (k, e), (e, -len(t.text))
        out = best[0] if best and not (best[1][0] and word in self.known) else None
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def features(self, text: str) -> list[float]:
        """What the classifier looks at, of a whole text; context decides between quoting a term and using it."""
        words = WORD.findall(text.lower())
        hits: dict[str, tuple[int, int]] = {}
        for w in set(words):
            if len(w) >= 3 and (m := self.match(w)):
                hits[w] = m
        if not hits:
            return [0.0] * len(FEATURES)
        low = text.lower()
        spots = [m for m in WORD.finditer(low) if m[0] in hits]
        places = [i for i, w in enumerate(words) if w in hits]
        quoted = reported = addressed = loud = exact = weight = 0.0
        for m, i in zip(spots, places):
            k, e = hits[m[0]]
            near = set(words[max(0, i - WINDOW) : i]) | set(words[i + 1 : i + 1 + WINDOW])
            before, after = low[max(0, m.start() - 2) : m.start()].strip(), low[m.end() : m.end() + 2].strip()
            quoted += bool(before and before[-1] in _QUOTES and after and after[0] in _QUOTES)
            reported += not near.isdisjoint(REPORTING)
            addressed += not near.isdisjoint(ADDRESSING)
            loud += "!" in low[m.end() : m.end() + 40]
            exact += e == 0
            weight += self.terms[k].weight
        n = len(spots)
        return [
            1.0, float(np.log1p(n)), float(np.log1p(len({k for k, _ in hits.values()}))), min(1.0, 20 * n / len(words)),
            exact / n, weight / n, quoted / n, reported / n, addressed / n, loud / n,
        ]


def _beginnings(rows: DataFrame, least: int, scale: float) -> list:
    """(p, toxic, clean, whole) of the words' beginnings that may mark toxic texts: in how many texts of each label, and as a whole word in how many toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter(), Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                counts[0 if y else 1].update({w[:k] for w in words for k in range(3, min(len(w), 16) + 1)})
                if y:
                    counts[2].update(words)
            keys = list(set().union(*counts))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["p", "toxic", "clean", "whole"])

    parts = rows.select("y", "text").mapInArrow(run, "p string, toxic long, clean long, whole long")
    sums = parts.groupBy("p").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "whole")))
    # a little wider than learn_lexicon's own rule, so that longer forms of what it takes are here too
    return sums.where((F.col("toxic") >= least) & (F.col("clean") * scale <= F.col("toxic") * 0.03 + scale)).collect()


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int, least: int = 3, precision: float = 0.9) -> list[Term]:
    """Terms that mark toxic texts, of (doc_id, y, text) rows; texts are read on the executors.

    The shortest beginnings of 4 letters or more that are in `least` toxic texts
    or more, and almost never in clean ones, are taken, and lengthened while all
    their texts agree. A term is a stem if its words end in many ways.
    """
    least = max(least, n_toxic // 400)
    scale = n_toxic / max(1, n_clean)
    found = _beginnings(rows, least, scale)
    in_toxic, in_clean, whole = ({r["p"]: r[c] for r in found} for c in ("toxic", "clean", "whole"))

    def good(p: str) -> bool:
        return in_toxic[p] / (in_toxic[p] + scale * in_clean[p] + 0.5 * scale) >= precision and in_clean[p] * scale <= 0.02 * in_toxic[p] + 0.5 * scale

    taken: set[str] = set()
    for p in sorted((p for p in in_toxic if len(p) >= 4 or whole[p] >= least), key=lambda p: (len(p), p)):
        if (len(p) >= 4 or whole[p] >= 0.9 * in_toxic[p]) and good(p) and not any(p[:k] in taken for k in range(3, len(p))):
            taken.add(p)
    letters = sorted({c for p in in_toxic for c in p})
    terms = {}
    for p in taken:
        while longer := [p + c for c in letters if in_toxic.get(p + c, 0) >= 0.98 * in_toxic[p]]:
            p = longer[0]
        odds = np.log((in_toxic[p] + 0.5) / (scale * in_clean[p] + 0.5))
        stem = whole[p] < 0.7 * in_toxic[p]
        errors = 0 if len(p) < 5 else 1 if len(p) < 9 else 2
        terms[p] = Term(p, float(min(odds, 8.0)) / 8, errors, stem)
    return sorted(terms.values(), key=lambda t: t.text)


def known_words(rows: DataFrame, terms: list[Term]) -> frozenset[str]:
    """Words of clean texts, and of no toxic one, that match a term: these are no misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Automaton(terms)
        for batch in batches:
            seen: dict[str, int] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(WORD.findall(text.lower())):
                    if near.match(w):
                        seen[w] = max(y, seen.get(w, 0))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int32())], ["w", "y"])

    words = rows.select("y", "text").mapInArrow(run, "w string, y int").groupBy("w").agg(F.max("y").alias("y"))
    return frozenset(r["w"] for r in words.where("y = 0").collect())


def features_of(rows: DataFrame, terms: list[Term], known: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of (doc_id, y, text) rows, in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms, known)
        for batch in batches:
            x = [automaton.features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = sorted((r["doc_id"], r["y"], r["x"]) for r in rows.mapInArrow(run, "doc_id long, y int, x array<double>").collect())
    return np.array([r[2] for r in found], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in found], float)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton's method; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta


#: The automaton of the model that a worker used last: what it has determinised serves the worker's next tasks.
_READY: dict[str, Automaton] = {}


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    known: frozenset[str]
    beta: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def automaton(self) -> Automaton:
        if self.key not in _READY:
            _READY.clear()
            _READY[self.key] = Automaton(self.terms, self.known)
        return _READY[self.key]

    def score(self, automaton: Automaton, text: str | None) -> float:
        x = automaton.features(text or "")
        z = float(np.dot(x, self.beta[:-1]) + self.beta[-1]) - QUOTATION * min(x[FEATURES.index("quoted")], x[FEATURES.index("reported")])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: int) -> bool:
    """Whether labels of the document are kept from learning."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """A model from at most most_toxic + most_clean labelled texts, none of them held out.

    All of them give the lexicon and the classifier; their texts stay on the
    executors, and the driver gets counts and features. Each class weighs as it does
    in all labels. Of several labels of a document the largest counts; null labels
    and ids count for nothing. Without toxic labels the lexicon is empty, and every
    text gets the share of toxic labels.
    """
    own = (
        labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    )
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = own.where("y = 1").orderBy(order).limit(most_toxic).union(own.where("y = 0").orderBy(order).limit(most_clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(rows, "labelled")
    found = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    terms = learn_lexicon(rows, found.get(1, 0), found.get(0, 0)) if found.get(1) else []
    total = max(1, sum(counts.values()))
    if not terms:
        rate = (counts.get(1, 0) + 0.5) / (total + 1)
        return Model([], frozenset(), np.array([0.0] * len(FEATURES) + [np.log(rate / (1 - rate))]))
    known = known_words(rows, terms)
    x, y = features_of(rows, terms, known)
    drop(rows)
    weight = np.array([counts.get(int(k), 1) / max(1, (y == k).sum()) for k in y])
    return Model(terms, known, fit_logistic(x, y, weight))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row's whole text; a null text is an empty one, and scores as a text without terms. The model is of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.automaton()
        for batch in batches:
            scores = [model.score(automaton, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
