"""Toxicity scores from a learned lexicon, misspelled terms included.

Terms (whole words, and stems written `stem*`) are learned from labelled documents by how much more often toxic ones hold
them. They are stored in a trie; Levenshtein automata of all terms run over that trie together: a state is the set of trie
nodes reached with the fewest edits, its transitions are found once and kept, so a word costs one lookup for each letter.
Each hit gets a context score: inside quotation marks or near words of reporting it counts as quotation, else as abuse.
A small logistic model over both sums gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.blocks import release_memory

TOKEN = re.compile(r'[^\W_]+|["“”„«»‘’‹›]')
OPENING, CLOSING = set("“„«‘‹"), set("”“»’›")  # “ closes what „ opened
MARKS = OPENING | CLOSING
# Words that report what others said, in the four languages of the corpus.
REPORTING = {"said", "says", "wrote", "writes", "called", "quote", "quoted", "quoting", "sagte", "sagt", "schrieb", "nannte", "zitat", "dit", "écrit", "appelé", "citation", "dijo", "dice", "escribió", "llamó", "cita"}
CONTEXT = 8  # tokens on each side
STEMS = range(4, 8)  # lengths of stems that are tried
KNOWN_WORDS = 100_000  # kept by a task, with what was found for them


def edits_allowed(term: str) -> int:
    """Misspellings are looked for in whole words only: one edit from 5 letters, two from 9. Terms of weak evidence get none."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms, intersected with the trie of the terms and made deterministic as words arrive."""

    def __init__(self, terms: dict[str, int]):
        """terms: with the edits allowed for each."""
        self.allowed = terms
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.room = [0]  # most edits that any term below allows
        for term, allowed in terms.items():
            node = 0
            for c in term.removesuffix("*"):
                self.room[node] = max(self.room[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.room.append(0)
                node = self.children[node][c]
            self.room[node] = max(self.room[node], allowed)
            if term.endswith("*"):
                self.stem[node] = term
            else:
                self.term[node] = term
        self._forget()

    def _forget(self) -> None:
        self.states: list[dict[int, int]] = []
        self.ids: dict[tuple, int] = {}
        self.moves: dict[tuple[int, str], int] = {}
        self.known: dict[str, tuple[str, int] | None] = {}
        self.start = self._intern(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving letters of a term out."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def _intern(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(state)
        return self.ids[key]

    def _move(self, at: int, c: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.room[node] and after.get(node, 99) > e or not e:
                after[node] = min(e, after.get(node, 99))

        for node, e in self.states[at].items():
            for letter, child in self.children[node].items():
                reach(child, e if letter == c else e + 1)
            reach(node, e + 1)
        return self._intern(self._closed(after))

    def look(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its number of edits; a stem that begins the word comes first. None: no term is near enough."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > KNOWN_WORDS or len(self.moves) > KNOWN_WORDS:
            self._forget()
        at, found = self.start, None
        for c in word:
            after = self.moves.get((at, c))
            if after is None:
                after = self.moves[at, c] = self._move(at, c)
            at = after
            state = self.states[at]
            if not state:
                break
            stems = [self.stem[n] for n, e in state.items() if not e and self.stem[n]]
            if stems:
                found = (stems[0], 0)
        else:
            near = [(e, self.term[n]) for n, e in self.states[at].items() if self.term[n] and e <= self.allowed[self.term[n]]]
            if near and (found is None or min(near)[0] == 0):
                found = min(near)[::-1]
        self.known[word] = found
        return found


def quotation(tokens: list[str], i: int) -> float:
    """0 (abuse) to 1 (quotation) for the token at i, from the tokens around it."""
    before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
    straight = before.count('"') % 2 == 1 and '"' in after
    marks = [t for t in before if t in MARKS]
    curved = bool(marks) and marks[-1] in OPENING and any(t in CLOSING for t in after)
    return 0.7 * (straight or curved) + 0.3 * any(t in REPORTING for t in (*before, *after))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # of terms: log of the ratio of document shares
    logistic: list[float] = field(default_factory=lambda: [-4.0, 0, 0, 0, 0])
    ordinary: frozenset[str] = frozenset()  # words near a term that ordinary texts hold
    _automaton: LexiconAutomaton | None = field(default=None, repr=False, compare=False)

    @property
    def automaton(self) -> LexiconAutomaton:
        if self._automaton is None:
            strong = 0.6 * max(self.weights.values(), default=0)
            self._automaton = LexiconAutomaton({t: edits_allowed(t) if w >= strong else 0 for t, w in sorted(self.weights.items())})
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def forget(self) -> None:
        """Give back what a task has gathered: workers live on."""
        self._automaton = None
        release_memory()

    def hits(self, text: str | None) -> tuple[list[tuple[str, str, int, float]], int]:
        """Word, term, edits and quotation score of every hit; the number of tokens."""
        tokens = TOKEN.findall((text or "").lower())
        look = self.automaton.look
        found = []
        for i, found_term in enumerate(map(look, tokens)):
            if found_term is not None:
                found.append((tokens[i], *found_term, quotation(tokens, i)))
        return found, len(tokens)

    def features(self, hits: list[tuple[str, str, int, float]], n_tokens: int) -> list[float]:
        """A misspelling counts nearly as the term does, unless it is a word of ordinary texts."""
        counted = [((1 - q) * self.weights[t] / 1.25**e, q * self.weights[t]) for w, t, e, q in hits if not e or w not in self.ordinary]
        abuse, quoted = (sum(x[i] for x in counted) for i in (0, 1))
        return [1.0, math.log1p(abuse), float(abuse > 0), math.log1p(quoted), math.log1p(100 * abuse / max(n_tokens, 20))]

    def score(self, hits: list, n_tokens: int) -> float:
        z = sum(a * b for a, b in zip(self.logistic, self.features(hits, n_tokens), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms_of(text: str | None) -> dict[str, int]:
    """Words and stems of a text, each with a 64-bit mark of the words that come before it."""
    marks: dict[str, int] = {}
    previous = ""
    for w in TOKEN.findall((text or "").lower()):
        if len(w) > 2:
            mark = 1 << (zlib.crc32(previous.encode()) % 63)
            for term in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)):
                marks[term] = marks.get(term, 0) | mark
        previous = w
    return marks


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, toxic_rows: int, other_rows: int) -> DataFrame:
    """doc_id, text, toxic of a bounded sample: of either label the rows whose hashed id is smallest."""
    known = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(order).limit(toxic_rows).unionByName(known.filter("toxic = 0").orderBy(order).limit(other_rows))
    # At most toxic_rows + other_rows ids of a few bytes.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, toxic_rows: int = 4000, other_rows: int = 8000, max_terms: int = 1000, least_evidence: float = 40.0) -> Model:
    """Fit lexicon and logistic model on at most toxic_rows + other_rows labelled documents that `usable` allows.

    Documents with equal texts count once. Without usable rows of both labels the model has no terms and scores every
    text alike, by the share of toxic labels.
    """
    from barlight.session import staged

    sample = staged(labelled_sample(docs, labels, usable, toxic_rows, other_rows))
    shares = {r.toxic: r.n for r in labels.filter(usable & F.col("toxic").isNotNull()).groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    if not sizes.get(0) or not sizes.get(1):
        return Model({}, [math.log(prior / (1 - prior)), 0, 0, 0, 0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        before: dict[str, int] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                marks = terms_of(text)
                seen[toxic].update(marks.keys())
                if toxic:
                    for term, mark in marks.items():
                        before[term] = before.get(term, 0) | mark
        terms = list(seen[1].keys() | seen[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64()), pa.array([before.get(t, 0) for t in terms], pa.int64())], names=["term", "toxic", "other", "before"])

    counted = sample.select("text", "toxic").mapInArrow(count, "term string, toxic bigint, other bigint, before bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"), F.bit_count(F.bit_or("before")).alias("contexts"))
    n1, n0 = float(sizes[1]), float(sizes[0])
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    gain = F.log((a / (n1 + 1)) / (b / (n0 + 1)))
    evidence = 2 * F.col("a") * gain  # about G²: weight of evidence over all toxic documents
    # A word of one text and its near copies always follows the same word; a term of abuse follows many.
    top = counted.filter((F.col("a") >= 4) & (F.col("contexts") >= 4)).withColumn("gain", gain).withColumn("evidence", evidence).filter((F.col("gain") > math.log(12)) & (F.col("evidence") > least_evidence))
    rows = top.orderBy(F.desc("evidence"), "term").limit(20 * max_terms).collect()  # bounded
    model = Model(pruned([(r.term, r.a, r.gain) for r in rows], max_terms))

    def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {w for batch in batches for t in batch.column(0).to_pylist() for w, _, e, _ in model.hits(t)[0] if e}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])

    harmless = sample.filter("toxic = 0").select("text").mapInArrow(near_words, "word string").distinct().collect()  # bounded by the sample
    model.ordinary = frozenset(r.word for r in harmless)

    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(*model.hits(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], schema=schema)

    fitted = sample.select("text", "toxic").mapInArrow(describe, "toxic int, x array<double>").collect()  # bounded by the sample
    y = np.array([r.toxic for r in fitted], float)
    model.logistic = logistic_fit(np.array([r.x for r in fitted]), y, np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())))
    return model


def pruned(terms: list[tuple[str, int, float]], max_terms: int) -> dict[str, float]:
    """Terms in order of evidence; of a stem and the terms that begin with it, the most special one that is nearly as frequent.

    What a chosen stem covers, and stems of a chosen word, are left out.
    """
    chosen: dict[str, float] = {}
    for term, count, gain in terms:
        body = term.removesuffix("*")
        if any(body[:k] + "*" in chosen for k in STEMS if k < len(body) or (k == len(body) and not term.endswith("*"))):
            continue
        if term.endswith("*"):
            if any(t.removesuffix("*").startswith(body) for t in chosen):
                continue
            same = [(not t.endswith("*"), len(t), t, g) for t, n, g in terms if t.removesuffix("*").startswith(body) and n >= 0.95 * count]
            _, _, term, gain = max(same)
        chosen[term] = gain
        if len(chosen) >= max_terms:
            break
    return chosen


def logistic_fit(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> list[float]:
    """Newton steps on the ridge-penalised log loss; weights of evidence for toxicity can't be negative, but for quotations."""
    free = np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            penalty = ridge * np.r_[0.001, np.ones(x.shape[1] - 1)]
            grad = x.T @ (sample_weight * (p - y)) + penalty * w
            hess = (x.T * (sample_weight * p * (1 - p))) @ x + np.diag(penalty + 1e-9)
            step = np.zeros_like(w)
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        wrong = np.array([False, w[1] < 0, w[2] < 0, False, w[4] < 0])
        if not wrong.any():
            break
        free &= ~wrong
    return w.tolist()


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.list_(pa.struct([("word", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("quotation", pa.float64())])))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and hits of every row. A null text counts as empty; an empty text gets the score of no evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1).to_pylist():
                found, n = model.hits(text)
                scores.append(model.score(found, n))
                hits.append([{"word": w, "term": t, "edits": e, "quotation": q} for w, t, e, q in found])
            release_memory()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(hits, SCORED.field("hits").type)], schema=SCORED)

        model.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, hits array<struct<word:string,term:string,edits:int,quotation:double>>")


def kept_rows(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all their columns, whose text scores below the threshold."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.score(*model.hits(t)) < threshold for t in batch.column(at).to_pylist()]
            release_memory()
            yield batch.filter(pa.array(clean, pa.bool_()))
        model.forget()

    return docs.mapInArrow(run, schema)
