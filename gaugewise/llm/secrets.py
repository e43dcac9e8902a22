"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two first-order Markov chains over the characters of tokens are counted from labelled samples:
values that the fixed patterns caught (random strings), and ordinary identifiers. A long token
whose log-likelihood ratio between the two is high, in total and per character, is a secret too.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import ROWS_AT_ONCE, bounded, row_slices

#: Documents whose tokens the models are counted from, at most (about; see ``bounded``).
SAMPLE_DOCS = 20_000

KINDS = ("assign", "access", "hex", "markov")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ASSIGN_HINT = ("passw", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_-]{5,}")
_DIGIT = re.compile(r"[0-9]")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_CODE = {c: k for k, c in enumerate(SYMBOLS)}
N = len(SYMBOLS)

#: Weight, in characters, of single characters against pairs.
BACKING = 10.0

#: Total log-likelihood ratio, and its mean per character, from which a token is a secret.
MIN_TOTAL, MIN_MEAN = 20.0, 0.7


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: start, end (exclusive, in code points) and kind."""
    out = []
    lower = text.lower()
    if any(hint in lower for hint in _ASSIGN_HINT):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def samples(text: str) -> tuple[list[str], list[str]]:
    """Labelled samples of a text: values of the fixed patterns, and identifiers outside of them and
    of the tokens that are to be judged."""
    spans = base_spans(text)
    secret = [text[a:b] if kind != "assign" else _ASSIGN.match(text, a)[2] for a, b, kind in spans]
    unknown = [(m.start(), m.end()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0])]
    covered = sorted([(a, b) for a, b, _ in spans] + unknown)
    plain, k = [], 0
    for m in _IDENTIFIER.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or m.end() <= covered[k][0]:
            plain.append(m[0])
    return secret, plain


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS) -> list[list[float]]:
    """Log-likelihood ratio of each character pair, random against ordinary.

    Counted over about ``most`` documents at most, chosen by a hash of their key.
    """

    def count(batches):
        pairs: list[Counter] = [Counter(), Counter()]
        for (texts,) in row_slices(batches):
            for value in texts:
                plain_and_secret = samples(value or "")[::-1]
                for label, found in enumerate(plain_and_secret):
                    for token in found:
                        pairs[label].update(zip(token, token[1:]))
        rows = [(label, a, b, n) for label in (0, 1) for (a, b), n in pairs[label].items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:3]), pa.array(columns[3], pa.int64())],
            names=["label", "a", "b", "n"],
        )

    chosen = bounded(docs.select(F.col(key), F.col(text).cast("string").alias("text")), F.col(key), most)
    counted = chosen.select("text").mapInArrow(count, "label int, a string, b string, n long")
    counts = np.zeros((2, N, N))
    for row in counted.groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():  # a row for each pair at most
        counts[row.label, _CODE[row.a], _CODE[row.b]] += row.n
    logs = np.log(chain(counts))
    return (logs[1] - logs[0]).tolist()


def chain(counts: np.ndarray) -> np.ndarray:
    """Transition probabilities; a rare first character leans on how often the second one is met at all."""
    single = counts.sum(-2, keepdims=True) + 1
    single = single / single.sum(-1, keepdims=True)
    return (counts + BACKING * single) / (counts.sum(-1, keepdims=True) + BACKING)


def markov_spans(text: str, ratio: list[list[float]]) -> list[tuple[int, int, str]]:
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if _DIGIT.search(token):
            codes = [_CODE[c] for c in token]
            total = math.fsum(ratio[a][b] for a, b in zip(codes, codes[1:]))
            if total >= MIN_TOTAL and total >= MIN_MEAN * (len(token) - 1):
                out.append((m.start(), m.end(), "markov"))
    return out


def spans(text: str, ratio: list[list[float]]) -> list[tuple[int, int, str]]:
    """All spans by start and kind; a Markov span never touches one of the fixed patterns."""
    base = base_spans(text)
    covered = sorted((a, b) for a, b, _ in base)
    found, k, reach = [], 0, 0  # both lists rise, so one walk over each is enough
    for span in markov_spans(text, ratio):
        while k < len(covered) and covered[k][0] < span[1]:
            reach, k = max(reach, covered[k][1]), k + 1
        if reach <= span[0]:
            found.append(span)
    return sorted(base + found, key=lambda s: (s[0], KINDS.index(s[2])))


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: list[list[float]] | None = None) -> DataFrame:
    """``key``, number of spans by kind, ``base_spans`` and ``spans`` (kind:start:end, comma-joined).

    Null and empty texts have none. Texts are read whole and rows keep their multiplicity; other
    columns are left out, so their names cannot clash.
    """
    ratio = fit(docs, key, text) if ratio is None else ratio
    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    schema = source.select(key).schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_spans", "string").add("spans", "string")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                found = [spans(value or "", ratio) for value in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array([sum(s[2] == kind for s in some) for some in found], pa.int64()) for kind in KINDS),
                        pa.array([written([s for s in some if s[2] != "markov"]) for some in found], pa.string()),
                        pa.array([written(some) for some in found], pa.string()),
                    ],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return scanned.select(
        key,
        *(f"n_{kind}" for kind in KINDS),
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )
