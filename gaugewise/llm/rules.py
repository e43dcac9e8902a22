"""Document quality by a sparse ensemble of rules.

Small trees are grown on statistics of labelled texts, each on the errors of those before it. Every
path from a root to a node is a rule, a conjunction of thresholds on statistics. A logistic model
with a lasso penalty weighs the rules, which sets most weights to zero. The rules that are left
become Spark column expressions, so scoring is one projection over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import bounded
from gaugewise.llm.quality import _shift, form_counts

#: Labelled texts that a model is fitted on, at most (about; see ``bounded``).
SAMPLE = 20_000
#: Trees, their depth, texts a leaf needs, statistics and share of the texts each tree sees.
TREES, DEPTH, LEAF, SEEN, SHARE = 40, 3, 8, 6, 0.7
#: How far each tree moves the model; cuts tried for each statistic.
STEP, CUTS = 0.3, 48
#: Lasso penalties tried, from strong to weak; folds that judge them; steps of descent, in the end too.
PENALTIES, FOLDS, ROUNDS, LAST_ROUNDS = (0.02, 0.01, 0.005, 0.002, 0.001), 3, 200, 1000
SEED = 11

#: Score from which a text counts as good.
GOOD = 0.7

STATISTICS = (
    "words", "word_length", "upper", "digits", "symbols", "bangs", "stops", "marked", "single", "short",
    "distinct", "again", "repeated", "line_words", "same_lines", "spaces",
)


def statistics(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of every whole text; shares are 0 where there is nothing to share."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    counts = form_counts(docs.withColumn("_text", text), F.col("_text"), [*keep, "_text"])
    step = counts.select(
        *keep,
        "_text",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.size(F.array_distinct("hashes")).alias("n_distinct"),
        F.size(F.filter(F.zip_with("hashes", _shift(F.col("hashes"), 1), lambda a, b: a == b), lambda same: same)).alias("n_again"),
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def count(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern))

    values = {
        "words": F.col("n_words"),
        "word_length": F.col("word_chars") / words,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count(r"[0-9]") / chars,
        "symbols": F.col("n_symbols") / chars,
        "bangs": count("!") / words,
        "stops": count(r"[.?;:]") / words,
        # words that end in a character which is neither letter, digit nor common punctuation
        "marked": count(r"[^\p{L}\p{N}\s.,;:!?'\")\]](?=\s|$)") / words,
        "single": count(r"(?<!\S)\S(?!\S)") / words,
        "short": count(r"(?<!\S)\S{1,3}(?!\S)") / words,
        "distinct": F.col("n_distinct") / words,
        "again": F.col("n_again") / words,
        "repeated": F.col("n_repeat_words") / words,
        "line_words": F.col("n_words") / (1 + count("\n")),
        "same_lines": F.col("n_dup_lines") / (1 + count("\n")),
        "spaces": count(r"\s{2,}") / words,
    }
    return step.select(*keep, *(values[name].cast("double").alias(name) for name in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, at least, threshold) does; ``at least`` False means below."""

    terms: tuple[tuple[str, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        held = np.ones(len(x), bool)
        for name, least, cut in self.terms:
            column = x[:, STATISTICS.index(name)]
            held &= (column >= cut) if least else (column < cut)
        return held

    def column(self) -> Column:
        held = F.lit(True)
        for name, least, cut in self.terms:
            held &= (F.col(name) >= F.lit(cut)) if least else (F.col(name) < F.lit(cut))
        return held

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>=' if least else '<'} {cut:.6g}" for name, least, cut in self.terms)


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((weight * rule.on(x) for rule, weight in self.rules), np.zeros(len(x)))

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total += F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cut_points(column: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values, thinned to evenly spaced ranks."""
    values = np.unique(column)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) <= CUTS:
        return middles
    at = np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1])
    return np.unique(np.concatenate([middles[np.searchsorted(middles, at).clip(0, len(middles) - 1)], middles[[0, -1]]]))


def _split(bins: np.ndarray, error: np.ndarray, some: np.ndarray, n_cuts: list[int]) -> tuple[float, int, int] | None:
    """The statistic and the number of the cut that lower the squared error most."""
    best, n, total = None, len(error), error.sum()
    for j in some:
        if not n_cuts[j]:
            continue
        # texts below each cut, and their error
        below = np.cumsum(np.bincount(bins[:, j], minlength=n_cuts[j] + 1))[:-1]
        sums = np.cumsum(np.bincount(bins[:, j], error, n_cuts[j] + 1))[:-1]
        fits = np.flatnonzero((below >= LEAF) & (n - below >= LEAF))
        if not len(fits):
            continue
        below, sums = below[fits], sums[fits]
        gain = sums**2 / below + (total - sums) ** 2 / (n - below) - total**2 / n
        k = int(gain.argmax())
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), int(j), int(fits[k]))
    return best


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list[Rule]:
    """The paths of ``trees`` trees, each grown on the errors that those before it leave."""
    cuts = [cut_points(x[:, j]) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]).astype(np.int16)
    n_cuts = [len(c) for c in cuts]
    rng, margin, paths = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(trees):
        chance = sigmoid(margin)
        error, slope = y - chance, chance * (1 - chance)
        seen = np.zeros(len(y), bool)
        seen[rng.permutation(len(y))[: max(1, int(SHARE * len(y)))]] = True
        some = rng.permutation(x.shape[1])[:SEEN]

        def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
            """Adds each path below the root, and moves the margins of the texts of each leaf."""
            taught = rows[seen[rows]]
            cut = _split(bins[taught], error[taught], some, n_cuts) if depth and len(taught) >= 2 * LEAF else None
            if cut is None:
                value = error[taught].sum() / (slope[taught].sum() + 1e-6)
                margin[rows] += STEP * np.clip(value, -4, 4)
                return
            _, j, k = cut
            high = bins[rows, j] > k
            for least, part in ((True, rows[high]), (False, rows[~high])):
                longer = (*path, (STATISTICS[j], least, float(cuts[j][k])))
                paths.append(Rule(longer))
                grow(part, longer, depth - 1)

        grow(np.arange(len(y)), (), DEPTH)
    return paths


def distinct_rules(paths: list[Rule], x: np.ndarray) -> list[Rule]:
    """Of rules that hold on the same texts, or on just the others, the shortest; none that always or never holds."""
    kept: dict[bytes, Rule] = {}
    for rule in sorted(paths, key=lambda r: (len(r.terms), str(r))):
        held = rule.on(x)
        if held.any() and not held.all():
            kept.setdefault(min(np.packbits(held).tobytes(), np.packbits(~held).tobytes()), rule)
    return list(kept.values())


def lasso(
    held: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray | None = None, start=None, rounds: int = ROUNDS
) -> tuple[float, np.ndarray]:
    """Bias and weights of least logistic loss plus ``penalty`` times the weights' absolute sum.

    ``weight`` says how many texts a row stands for, of which the share ``y`` is labelled 1. Accelerated
    proximal gradient descent; the bias carries no penalty.
    """
    weight = np.ones(len(y)) if weight is None else weight
    share = weight / weight.sum()
    z = np.column_stack([np.ones(len(y)), held]).astype(np.float64)
    # the largest curvature, by a few power steps
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (share * (z @ v))
        v /= np.linalg.norm(v)
    pace = 1 / (share @ (z @ v) ** 2 / 4 * 1.05 + 1e-12)
    w = np.zeros(z.shape[1]) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        step = ahead - pace * (z.T @ (share * (sigmoid(z @ ahead) - y)))
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - pace * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = step + (t - 1) / later * (step - w)
        moved, w, t = np.abs(step - w).max(), step, later
        if moved < 1e-6:
            break
    return float(w[0]), w[1:]


def patterns(held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts on which the same rules hold as one row: the rules, the share labelled 1, their number."""
    rows, of, n = np.unique(np.packbits(held, axis=1), axis=0, return_inverse=True, return_counts=True)
    return np.unpackbits(rows, axis=1, count=held.shape[1]).astype(bool), np.bincount(of.ravel(), y) / n, n.astype(float)


def log_loss(y: np.ndarray, chance: np.ndarray) -> float:
    chance = chance.clip(1e-9, 1 - 1e-9)
    return float(-(y * np.log(chance) + (1 - y) * np.log(1 - chance)).mean())


def ensemble(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules and weights; the penalty is the one of least loss on folds left out. One class: its share."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), ())
    rules = distinct_rules(tree_paths(x, y), x)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    held = np.column_stack([r.on(x) for r in rules])
    fold = np.random.default_rng(SEED).permutation(len(y)) % FOLDS
    loss = np.zeros(len(PENALTIES))
    for f in range(FOLDS):
        left_out, start = fold == f, None
        if not left_out.any() or y[~left_out].min() == y[~left_out].max():
            continue
        rows, share, n = patterns(held[~left_out], y[~left_out])
        for k, penalty in enumerate(PENALTIES):
            bias, w = lasso(rows, share, penalty, n, start)
            start = np.concatenate([[bias], w])
            loss[k] += log_loss(y[left_out], sigmoid(bias + held[left_out] @ w))
    rows, share, n = patterns(held, y)
    bias, w = lasso(rows, share, PENALTIES[int(loss.argmin())], n, rounds=LAST_ROUNDS)
    chosen = sorted(((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6), key=lambda p: (-abs(p[1]), str(p[0])))
    return Model(bias, tuple(chosen))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> Model:
    """A model of ``label`` (0 or 1) from about ``most`` labelled texts at most, none of them held out.

    Rows without key or label teach nothing. A key labelled both ways counts as good if at least half
    of its labels are. Rows that repeat a key teach once each.
    """
    taught = labels.select(F.col(key).alias("taught_key"), F.col(label).cast("double").alias("y")).where(
        "taught_key IS NOT NULL AND y IN (0, 1)"
    )
    taught = taught.where(~held_out(F.col("taught_key"))).groupBy("taught_key").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    # at most about `most` rows, hence small enough for every executor and the driver
    taught = bounded(taught, F.col("taught_key"), most)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(taught), F.col("k") == F.col("taught_key"))
    rows = bounded(rows.select("k", "t", "y"), F.xxhash64("k", "t"), 2 * most)
    # read once in an order that depends on content only, so that reruns give the same model
    found = statistics(rows, F.col("t"), ["k", "y"]).toPandas().sort_values(["k", *STATISTICS], ignore_index=True)
    return ensemble(found[list(STATISTICS)].to_numpy(np.float64), found["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` and the statistics of every row.

    Null texts count as empty and get a score as well; repeated rows are scored alike; other columns
    are left out, so their names cannot clash. Texts are read whole.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_source"))
    step = statistics(rows, F.col("_source"), ["_key"])
    step = step.withColumn("score", model.score())
    return step.select(
        F.col("_key").alias(key),
        held_out(F.col("_key")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
        *STATISTICS,
    )
