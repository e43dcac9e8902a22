"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel compares two words by the triples of letters they share in order, gaps allowed: a triple
weighs DECAY to the power of the stretch it spans, and the kernel is normalised. Characters that are
no letters only widen gaps, and letters set apart by spaces are one word, so an insult that is
spaced out or has characters put in stays close to itself.

Learning goes from documents to words. Labelled sentences give, per word, the toxic and the clean
documents that use it; words used far more often in toxic ones are examples of one class, other
words of the other. Landmarks are the strongest words of both classes; the Nystrom map of a word is
its kernel with them times the inverse root of their kernel matrix. A linear machine is trained on
it and folded into one weight for each letter triple, which is the same function and cheap. A
document is scored from its highest words by a logistic model fitted on other labelled documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import ROWS_AT_ONCE, bounded, row_slices, stored

DECAY = 0.5
#: Labelled documents, example words of a class, and landmarks, at most.
TRAIN_DOCS, TOXIC_WORDS, CLEAN_WORDS, LANDMARKS = 20_000, 2_000, 12_000, 256
#: A toxic word's documents differ from chance by this log-likelihood ratio (G squared) at least, and
#: the odds of being toxic are so many times those of all documents.
MIN_RATIO, MIN_ODDS = 16.0, 6.0
#: Rounds in which the clean words that the machine takes for toxic join the examples, and how many.
ROUNDS, HARD_WORDS = 3, 3_000
#: Longer words are read in windows of this many letters that overlap by half.
WINDOW = 24
#: Weight of the errors of each class against the machine's smoothness.
WEIGHT = 4_000.0
#: Words above this margin count towards a document's score.
NOTICED = 0.0
#: Distinct words a task remembers before it starts afresh.
KEPT = 500_000
CODES = 64
THRESHOLD = 0.7

_SPACED = re.compile(r"(?:\s[^\W\d_]){4,}(?!\S)")


def code_of(letter: str) -> int:
    """0 for what is no letter; a to z have their own codes, other letters share the rest."""
    if "a" <= letter <= "z":
        return ord(letter) - 96
    return 27 + ord(letter) % (CODES - 27) if letter.isalpha() else 0


def words_in(text: str) -> set[str]:
    """Distinct words in lower case, and those whose letters stand apart."""
    lower = text.lower()
    words = set(lower.split())
    for spaced in _SPACED.findall(" " + lower):
        words.add("".join(spaced.split()))
    return words


def windows(word: str) -> list[str]:
    """A word without characters at its ends that are no letters; in windows, if it is long."""
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while end > start and not word[end - 1].isalpha():
        end -= 1
    word = word[start:end]
    if len(word) <= WINDOW:
        return [word] if len(word) >= 3 else []
    return [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


@dataclass
class _Length:
    """What words of one length share: places of all triples, their weights, decay between places."""

    places: np.ndarray
    weights: np.ndarray
    decay: np.ndarray


def _length(n: int) -> _Length:
    i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    rising = (i < j) & (j < k)
    places = np.stack([i[rising], j[rising], k[rising]])
    gaps = np.arange(n)[:, None] - np.arange(n)[None, :]
    return _Length(places, DECAY ** (places[2] - places[0] + 1.0), np.where(gaps > 0, DECAY ** np.maximum(gaps, 0.0), 0.0))


class Kernel:
    """Letter triples of words, in matrices of words of equal length."""

    def __init__(self):
        self._lengths: dict[int, _Length] = {}
        self._codes: dict[str, int] = {}

    def matrices(self, words: list[str]):
        """Per length: places in ``words``, triples of each word, their weights, root of K(w, w)."""
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for n, chosen in by_length.items():
            if n not in self._lengths:
                self._lengths[n] = _length(n)
            shared = self._lengths[n]
            step = max(1, 2_000_000 // max(1, len(shared.weights)))
            for start in range(0, len(chosen), step):
                some = chosen[start : start + step]
                letters = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le"), np.uint32)
                distinct, back = np.unique(letters, return_inverse=True)
                table = np.array([self._code(chr(c)) for c in distinct], np.int32)
                codes = table[back].reshape(len(some), n)
                a, b, c = (codes[:, p] for p in shared.places)
                triples = (a * CODES + b) * CODES + c
                weights = np.where((a > 0) & (b > 0) & (c > 0), shared.weights, 0.0)
                yield np.array(some), triples, weights, np.sqrt(self._own(codes, shared.decay))

    def _code(self, letter: str) -> int:
        if letter not in self._codes:
            self._codes[letter] = code_of(letter)
        return self._codes[letter]

    @staticmethod
    def _own(codes: np.ndarray, decay: np.ndarray) -> np.ndarray:
        same = ((codes[:, :, None] == codes[:, None, :]) & (codes > 0)[:, :, None]).astype(np.float64)
        pairs = same * (decay @ same @ decay.T)
        return (same * (decay @ pairs @ decay.T)).sum((1, 2)) * DECAY**2

    def landmarks(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised weights, a row for each word and a column for each triple met; and each triple's
        column. Triples that no landmark has share the last column, which is empty."""
        rows, triples, weights = [], [], []
        for chosen, t, w, own in self.matrices(words):
            rows.append(np.repeat(chosen, t.shape[1]))
            triples.append(t.ravel())
            weights.append((w / np.where(own > 0, own, np.inf)[:, None]).ravel())
        row, triple, weight = map(np.concatenate, (rows, triples, weights))
        met = np.unique(triple[weight > 0])
        column = np.full(CODES**3, len(met))
        column[met] = np.arange(len(met))
        out = np.zeros((len(words), len(met) + 1))
        np.add.at(out, (row, column[triple]), weight)
        return out, column

    def against(self, words: list[str], landmarks: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Normalised kernel of words with landmarks."""
        by_triple, out = np.ascontiguousarray(landmarks.T), np.zeros((len(words), len(landmarks)))
        for rows, triples, weights, own in self.matrices(words):
            for row, t, w, norm in zip(rows, column[triples], weights, own):
                if norm > 0:
                    out[row] = w @ by_triple[t] / norm
        return out

    def margins(self, words: list[str], model: Words) -> np.ndarray:
        out = np.full(len(words), model.bias)
        for rows, triples, weights, own in self.matrices(words):
            total = (model.weights[triples] * weights).sum(1)
            out[rows] += np.where(own > 0, total / np.where(own > 0, own, 1.0), 0.0)
        return out


@dataclass
class Words:
    """Trained machine over words: a weight for each triple, and a constant."""

    weights: np.ndarray
    bias: float


@dataclass
class Model:
    words: Words | None = None
    #: Of the logistic model over ``document_features``: constant first.
    document: list[float] = field(default_factory=lambda: [-20.0, 0.0, 0.0, 0.0, 0.0])


def train_words(toxic: list[tuple[str, float]], clean: list[tuple[str, float]]) -> Words | None:
    """Words with their importance, strongest first, of the two classes."""
    if not toxic or not clean:
        return None
    kernel = Kernel()
    n = min(LANDMARKS * 3 // 4, len(toxic))
    marks = [w for w, _ in toxic[:n]] + [w for w, _ in clean[: LANDMARKS - n]]
    features, column = kernel.landmarks(marks)
    values, vectors = np.linalg.eigh(features @ features.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = kernel.against([w for w, _ in toxic + clean], features, column) @ root
    x = np.column_stack([x, np.ones(len(x))])
    y = np.repeat([1.0, -1.0], [len(toxic), len(clean)])
    c = np.array([v for _, v in toxic + clean], float)
    for label in (1.0, -1.0):
        c[y == label] *= WEIGHT / c[y == label].sum()
    w = _squared_hinge(x, y, c)
    return Words(((root @ w[:-1]) @ features)[column], float(w[-1]))


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss in the primal: Newton steps over the support vectors."""
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6

    def loss(w):
        return w @ penalty @ w + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    now = loss(w)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xs, cs = x[inside], c[inside]
        step = np.linalg.solve(penalty + xs.T @ (xs * cs[:, None]), xs.T @ (cs * y[inside])) - w
        length, before = 1.0, now
        while (now := loss(w + length * step)) > before and length > 1e-6:
            length /= 2
        w = w + length * step
        if before - now < 1e-9 * before:
            break
    return w


class Scorer:
    """Margins of the noticed words of texts; words met before are remembered."""

    def __init__(self, words: Words):
        self.words, self._kernel = words, Kernel()
        self._met: set[str] = set()
        self._noticed: dict[str, float] = {}

    def features(self, texts: list[str]) -> list[tuple[float, ...]]:
        """Per text: highest and second highest margin, sum of the noticed, logarithm of the words."""
        per_text = [words_in(text) for text in texts]
        new = set().union(*per_text) - self._met
        if len(self._met) + len(new) > KEPT:
            self._met, self._noticed = set(), {}
            new = set().union(*per_text)
        self._met |= new
        parts = [(word, part) for word in new for part in windows(word)]
        distinct = list({part for _, part in parts})
        margins = dict(zip(distinct, self._kernel.margins(distinct, self.words).tolist()))
        for word, part in parts:
            margin = margins[part]
            if margin > NOTICED and margin > self._noticed.get(word, NOTICED):
                self._noticed[word] = margin
        out = []
        for words in per_text:
            found = sorted((self._noticed[w] for w in self._noticed.keys() & words), reverse=True)
            top = [*found[:2], NOTICED, NOTICED][:2]
            out.append((top[0], top[1], math.log1p(sum(m - NOTICED for m in found)), math.log1p(len(words))))
        return out


def fit_documents(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic model by Newton steps: constant, then a weight for each feature."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(penalty + x.T @ (x * (p * (1 - p) + 1e-9)[:, None]), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1


def _with_margins(words: Words):
    def run(batches):
        kernel = Kernel()
        for batch in batches:
            found = kernel.margins(batch.column(0).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["word", "good", "margin"])

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = TRAIN_DOCS) -> Model:
    """Trained on at most (about) ``most`` labelled documents that are not held out.

    ``labels`` has doc_id and toxic; rows with a null in either teach nothing, and of several labels
    of a document the highest counts. Words are learned on one half of the documents, the scoring of
    documents on the other. Without both classes every score is next to 0.
    """
    taught = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = bounded(taught, F.col("doc_id"), most).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    # about `most` rows at most, hence small enough for every executor
    taught = taught.select(F.col("doc_id").alias("taught_id"), F.col("toxic").cast("int").alias("toxic"), "half")
    rows = docs.select(F.col("doc_id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(taught), F.col("doc_id") == F.col("taught_id")
    )
    rows = stored(rows.select("text", "toxic", "half"), "toxic-training")

    def distinct_words(batches):
        for texts, toxic, _ in row_slices(batches):
            pairs = [(w, label) for value, label in zip(texts, toxic) for w in {p for x in words_in(value or "") for p in windows(x)}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32())], names=["word", "toxic"]
            )

    counts = rows.filter("half = 0").mapInArrow(distinct_words, "word string, toxic int").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("good")
    )
    counts = stored(counts, "toxic-words")
    n = {row.toxic: row["count"] for row in rows.filter("half = 0").groupBy("toxic").count().collect()}
    n_bad, n_good = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    if not n_bad or not n_good:
        return Model()
    odds = (F.col("bad") + 0.5) / (F.col("good") + 0.5) * (n_good / n_bad)
    share = n_bad / (n_bad + n_good)
    met = F.col("bad") + F.col("good")
    strength = 2 * sum(
        F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (met * p))).otherwise(0.0) for c, p in (("bad", share), ("good", 1 - share))
    )
    is_toxic = (strength >= MIN_RATIO) & (odds >= MIN_ODDS)
    toxic = counts.filter(is_toxic).orderBy(F.desc(strength), "word").limit(TOXIC_WORDS).select("word", strength.alias("n")).collect()
    others = counts.filter(~is_toxic & (F.col("good") > 0)).select("word", "good")
    common = others.orderBy(F.desc("good"), "word").limit(CLEAN_WORDS // 3).collect()
    any_ = bounded(others, F.col("word"), CLEAN_WORDS * 2 // 3).collect()
    clean = {row.word: row.good for row in [*common, *any_]}
    bad_words = [(row.word, math.sqrt(row.n)) for row in toxic]
    words = None
    for turn in range(ROUNDS + 1):
        good_words = sorted(((w, math.log1p(g)) for w, g in clean.items()), key=lambda x: (-x[1], x[0]))
        words = train_words(bad_words, good_words)
        if words is None:
            return Model()
        if turn < ROUNDS:
            hard = others.mapInArrow(_with_margins(words), "word string, good long, margin double").filter("margin > -0.5")
            hard = hard.orderBy(F.desc("margin"), "word").limit(HARD_WORDS * (turn + 1)).collect()
            clean |= {row.word: row.good for row in hard}

    def features(batches):
        scorer = Scorer(words)
        for texts, labels_, _ in row_slices(batches):
            x = np.array(scorer.features([value or "" for value in texts])).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels_, pa.int32()), *(pa.array(c, pa.float64()) for c in x.T)], names=["y", "a", "b", "c", "d"]
            )

    found = rows.filter("half = 1").mapInArrow(features, "y int, a double, b double, c double, d double").collect()
    table = np.array(sorted(tuple(row) for row in found), float).reshape(-1, 5)
    if len(np.unique(table[:, 0] == 1)) < 2:
        return Model(words)
    return Model(words, fit_documents(table[:, 1:], (table[:, 0] == 1).astype(float)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row.

    Whole texts are scored; null and empty ones as texts without words. The key decides nothing but
    ``held_out`` (false if null). Rows keep their multiplicity; other columns are left out.
    """
    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    schema = source.select(key).schema.add("score", "double")

    def run(batches):
        scorer = Scorer(model.words) if model.words is not None else None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                texts = [value or "" for value in part.column(1).to_pylist()]
                x = np.array(scorer.features(texts) if scorer else [(NOTICED, NOTICED, 0.0, 0.0)] * len(texts))
                z = model.document[0] + x @ np.array(model.document[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[key, "score"]
                )

    out = source.mapInArrow(run, schema)
    return out.select(
        key,
        F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
