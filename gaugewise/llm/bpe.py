"""BPE encoding and decoding through a minimal acyclic transducer of the frequent words.

The words that make up most of the corpus are compiled, with the ids of their pieces, into an
acyclic automaton whose equal suffixes are shared. Every transition carries a number; their sum
along a word is the word's rank, which addresses its ids. The file is distributed by Spark and
memory-mapped by the Python workers, so the workers of a machine share its pages. Words that are
not in it are merged by the ranks of the vocabulary file, one pair at a time, exactly as the
tokenizer defines it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugewise.llm.common import SPACE, stored
from gaugewise.session import checkpoint_dir

#: A word belongs to the lexicon if it makes up this share of all words; so there are at most
#: a million of them, whatever the size of the corpus.
MIN_SHARE = 1 / 1_000_000

#: Rows encoded at once, and distinct stretches between white space that a task keeps at hand before it starts afresh.
ROWS, KEPT = 512, 150_000

#: Words with more letters are merged alone.
LONG = 40

NEVER = np.iinfo(np.int32).max
END = "</w>"
_LATIN = range(0x180)
_DOTTED_I = 0x130  # its lower case has a code point beyond _LATIN
_BLANK = "\t\n\v\f\r \x85\xa0"


def _of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _LATIN if unicodedata.category(chr(c))[0] == kind)


#: Words, and the line feeds that part the stretches.
_PIECES = re.compile(
    "'(?:s|t|re|ve|m|ll|d)|[{L}]+|[{N}]|[^{B}{L}{N}]+|\n".format(L=_of("L"), N=_of("N"), B=_BLANK)
)
#: Code points that keep a text from being cut here, among them those that only Python calls white space.
_BEYOND = re.compile(f"[^\\x00-{chr(_LATIN.stop - 1)}]|[\\x1c-\\x1f{chr(_DOTTED_I)}]")


def byte_letters() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow 0x100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Vocabulary file of a word-end BPE: how it cuts texts into words and merges words into ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        if model["end_of_word_suffix"] != END or model.get("unk_token") or content["decoder"]:
            raise ValueError(f"{path}: not a word-end BPE without unknown token")
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.added = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.tokens = {number: token for token, number in (self.ids | self.added).items()}
        self.letters = byte_letters()
        self._library = Tokenizer.from_file(path)
        self.names = [str(k) for k in range(max(self.tokens) + 1)]
        codes = np.full(0x200, -1, np.int64)
        for letter in self.letters:
            codes[ord(letter)] = self.ids[letter]
        self._inner = codes
        self._last = codes.copy()
        for letter in self.letters:
            self._last[ord(letter)] = self.ids[letter + END]
        left = np.array([self.ids[a] for a, _ in self.ranks], np.int64)
        right = np.array([self.ids[b] for _, b in self.ranks], np.int64)
        order = np.argsort(left << 20 | right)
        self._pairs = (left << 20 | right)[order]
        self._pair_ranks = order.astype(np.int32)
        self._merged = np.array([self.ids[a + b] for a, b in self.ranks], np.int32)

    def library_words(self, text: str) -> list[str]:
        """Words in byte letters by the library's steps, for texts with letters beyond Latin.

        Its Unicode tables may differ from Python's, so such texts are left to it as a whole.
        """
        steps = self._library
        return [w for w, _ in steps.pre_tokenizer.pre_tokenize_str(steps.normalizer.normalize_str(text))]

    def words(self, text: str) -> list[str]:
        """Words of a text without added tokens, in byte letters."""
        if _BEYOND.search(text):
            return self.library_words(text)
        return [self.lettered(word) for stretch in text.split() for word in _PIECES.findall(stretch.lower())]

    def lettered(self, word: str) -> str:
        if word.isascii() and word.isprintable():  # and no space, in a word
            return word
        return "".join(map(self.letters.__getitem__, word.encode()))

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text, and whether each is an added token."""
        if "<|" not in text:
            yield text, False
            return
        for k, part in enumerate(self.marks.split(text)):
            if part:
                yield part, k % 2 == 1

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Ids of words in byte letters, for many words at once.

        Each round merges one pair in every word that has any: that of lowest rank, the leftmost of
        equal ones. Words of similar length share a matrix; very long ones are merged alone.
        """
        out: list = [None] * len(words)
        by_length = sorted((k for k, w in enumerate(words) if len(w) <= LONG), key=lambda k: len(words[k]))
        for start in range(0, len(by_length), 8192):
            chosen = by_length[start : start + 8192]
            for k, ids in zip(chosen, self._merge_matrix([words[k] for k in chosen])):
                out[k] = ids
        for k, word in enumerate(words):
            if out[k] is None:
                out[k] = self.merge(word)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where(self._pairs[at] == keys, self._pair_ranks[at], NEVER)

    def _merge_matrix(self, words: list[str]) -> Iterator[list[int]]:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = np.full((len(words), width), -1, np.int32)
        inside = np.arange(width) < sizes[:, None]
        symbols[inside] = self._inner[letters]
        symbols[np.arange(len(words)), sizes - 1] = self._last[letters[np.cumsum(sizes) - 1]]
        ranks = np.full((len(words), max(width - 1, 1)), NEVER, np.int32)
        if width > 1:
            pairs = inside[:, 1:]
            ranks[pairs] = self._rank(symbols[:, :-1][pairs], symbols[:, 1:][pairs])
        done: list = [None] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            best = ranks.argmin(1)
            rank = ranks[np.arange(len(rows)), best]
            ended = rank == NEVER
            if ended.any():
                lengths = (symbols[ended] >= 0).sum(1).tolist()
                for row, ids, n in zip(rows[ended].tolist(), symbols[ended].tolist(), lengths):
                    done[row] = ids[:n]
                keep = ~ended
                rows, symbols, ranks, best, rank = rows[keep], symbols[keep], ranks[keep], best[keep], rank[keep]
                if not len(rows):
                    break
            every, at = np.arange(len(rows)), np.arange(symbols.shape[1] - 1)
            symbols[every, best] = self._merged[rank]
            symbols = np.take_along_axis(symbols, at + (at > best[:, None]), 1)
            if symbols.shape[1] == 1:
                ranks = np.full((len(rows), 1), NEVER, np.int32)
                continue
            at = at[:-1]
            ranks = np.take_along_axis(ranks, at + (at >= best[:, None]), 1)
            for k, some in ((best - 1, best > 0), (best, best < symbols.shape[1] - 1)):
                r, c = every[some], k[some]
                ranks[r, c] = self._rank(symbols[r, c], symbols[r, c + 1])
        return iter(done)

    def merge(self, word: str) -> list[int]:
        """Ids of a word in byte letters: the pair of lowest rank is merged, the leftmost first."""
        parts = self._merge_long([*word[:-1], word[-1] + END])
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[str | None]) -> list[str]:
        """By a heap, so that a word of a million letters takes n log n steps."""
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, k, k + 1, p) for k, p in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, n, pair = heapq.heappop(heap)
            if parts[k] != pair[0] or after[k] != n or parts[n] != pair[1]:
                continue
            parts[k], parts[n] = pair[0] + pair[1], None
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, b, (parts[a], parts[b])))
        return [p for p in parts if p is not None]


def compile_lexicon(entries: Iterable[tuple[str, list[int]]]) -> bytes:
    """Minimal acyclic transducer of (word in byte letters, ids), as bytes ready to be mapped.

    Words enter in order; when the next word leaves a branch, the branch's states are replaced by
    equal ones seen before. The number on a transition counts the words that sort before those it
    leads to, so a path's sum is the word's rank.
    """
    words = sorted(dict(entries).items())
    seen: dict[tuple, int] = {}
    done: list[tuple[bool, list[tuple[int, int]]]] = []  # (is a word's end, its transitions)
    path: list[list] = [[False, []]]  # states of the current word that may still grow
    last = ""

    def freeze(down_to: int) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in seen:
                seen[key] = len(done)
                done.append((final, edges))
            path[-1][1].append((ord(last[depth - 1]), seen[key]))

    for word, _ in words:
        common = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        freeze(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    freeze(0)
    done.append((path[0][0], path[0][1]))

    reach, finals, edges_of, targets, before = [], [], [], [], []
    for state, (final, edges) in enumerate(done):  # targets come before the states that lead to them
        total = int(final)
        for letter, target in edges:
            edges_of.append(state << 9 | letter)
            targets.append(target)
            before.append(total)
            total += reach[target]
        reach.append(total)
        finals.append(int(final))
    numbers, starts = [], [0]
    for _, ids in words:
        numbers.extend(ids)
        starts.append(len(numbers))
    arrays = [np.array(a, "<i8") for a in (edges_of, targets, before, finals, starts, numbers)]
    return struct.pack("<6q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon mapped into memory: a transition is found by its state and letter."""

    def __init__(self, path: str):
        whole = np.asarray(np.memmap(path, "<i8", "r"))
        ends = 6 + np.cumsum(whole[:6])
        parts = [whole[end - n : end] for n, end in zip(whole[:6], ends)]
        self.edges, self.targets, self.before, self.finals, self.starts, self.numbers = parts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def find_many(self, words: list[str]) -> list[list[int] | None]:
        """Ids of each word in byte letters, or None where the lexicon lacks it."""
        out: list = [None] * len(words)
        if not words or not len(self):
            return out
        sizes = np.array([len(w) for w in words])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        rows = np.arange(len(words))
        state, rank = np.full(len(words), len(self.finals) - 1), np.zeros(len(words), np.int64)
        depth = 0
        while len(rows):
            over = sizes[rows] == depth
            for row, r in zip(rows[over & (self.finals[state] == 1)].tolist(), rank[over & (self.finals[state] == 1)]):
                out[row] = self.numbers[self.starts[r] : self.starts[r + 1]].tolist()
            rows, state, rank = rows[~over], state[~over], rank[~over]
            key = state << 9 | letters[starts[rows] + depth]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[at] == key
            rows, state, rank, depth = rows[on], self.targets[at[on]], rank[on] + self.before[at[on]], depth + 1
        return out


class Encoder:
    """Ids of texts, joined by one space; stretches and words met before are kept at hand."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._words: dict[str, str] = {}
        self._stretches: dict[str, str] = {}
        self._marks = {text: str(number) for text, number in vocabulary.added.items()}

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """From the lexicon; words that it lacks are merged."""
        found = self.lexicon.find_many(words) if self.lexicon else [None] * len(words)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.vocabulary.merge_many([words[k] for k in unseen])):
            found[k] = ids
        return found

    def encode(self, texts: list[str]) -> list[str]:
        cut = [
            [part if is_mark or _BEYOND.search(part) else part.split() for part, is_mark in segments]
            for segments in map(self.vocabulary.segments, texts)
        ]
        met: set[str] = set()
        for parts in cut:
            for part in parts:
                if isinstance(part, list):
                    met.update(part)
        if len(self._stretches) + len(met) > KEPT:
            self._stretches, self._words = {}, {}
        self._learn([stretch for stretch in met if stretch not in self._stretches])
        ids = self._stretches.__getitem__
        out = []
        for parts in cut:
            of_text: list[str] = []
            for part in parts:
                if isinstance(part, list):
                    of_text.extend(map(ids, part))
                elif part in self._marks:
                    of_text.append(self._marks[part])
                else:
                    of_text.extend(self._named(self.vocabulary.library_words(part)))
            out.append(" ".join(of_text))
        return out

    def _named(self, words: list[str]) -> Iterator[str]:
        names = self.vocabulary.names.__getitem__
        return (" ".join(map(names, ids)) for ids in self.ids_of(words))

    def _learn(self, stretches: list[str]) -> None:
        """Ids of stretches between white space: all are cut at once, parted by line feeds."""
        if not stretches:
            return
        pieces = _PIECES.findall("\n".join(stretches).lower())
        words = [word for word in set(pieces) if word not in self._words and word != "\n"]
        self._words.update(zip(words, self._named(list(map(self.vocabulary.lettered, words)))))
        self._words["\n"] = "\n"
        ids = " ".join(map(self._words.__getitem__, pieces)).split(" \n ")
        self._stretches.update(zip(stretches, ids))


class Decoder:
    """The text of ids: the tokens joined by one space, as of a tokenizer without decoder."""

    def __init__(self, vocabulary: Vocabulary):
        self._tokens = {str(number): token for number, token in vocabulary.tokens.items()}

    def decode(self, ids: str) -> str:
        return " ".join(map(self._tokens.__getitem__, ids.split(" "))) if ids else ""


def frequent_stretches(docs: DataFrame, text: str = "text", share: float = MIN_SHARE) -> list[str]:
    """Stretches between white space, in lower case, that make up at least ``share`` of all
    stretches met more than once; so there are 1 / share of them at most."""
    stretches = docs.select(F.explode(F.split(F.lower(F.col(text).cast("string")), SPACE + "+")).alias("stretch"))
    counts = stretches.filter("stretch <> ''").groupBy("stretch").agg(F.count("*").alias("n")).filter("n > 1")
    counts = stored(counts, "bpe-stretches")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [row.stretch for row in counts.filter(F.col("n") >= total * share).select("stretch").collect()]


def publish_lexicon(spark: SparkSession, texts: list[str], vocabulary_path: str) -> str:
    """Compiles the words of short texts, has Spark hand the file to every executor; its name.

    The file is written to the shared checkpoint folder; executors that join later fetch it too.
    """
    vocabulary = Vocabulary(vocabulary_path)
    words = list({word for text in texts for word in vocabulary.words(text)})
    content = compile_lexicon(zip(words, vocabulary.merge_many(words)))
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:32]}.fst"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/gaugewise-llm/{name}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(path, True)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString())
    return name


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    key: str = "doc_id",
    text: str = "text",
    frequent: list[str] | None = None,
) -> DataFrame:
    """``key``, ``ids`` (decimal, joined by one space), ``decoded`` and ``n_tokens`` of every row.

    Null and empty texts have no ids. Other columns are left out, so their names cannot clash. Rows
    keep their multiplicity. The lexicon holds the words of ``frequent``; without it, those of the
    stretches that are frequent in all texts.
    """
    spark = docs.sparkSession
    frequent = frequent_stretches(docs, text) if frequent is None else frequent
    name = publish_lexicon(spark, frequent, vocabulary_path)
    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    schema = source.select(key).schema.add("ids", "string").add("decoded", "string").add("n_tokens", "long")

    def run(batches):
        vocabulary = Vocabulary(vocabulary_path)
        encoder, decoder = Encoder(vocabulary, Lexicon(SparkFiles.get(name))), Decoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = encoder.encode([value or "" for value in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(ids, pa.string()),
                        pa.array([decoder.decode(x) for x in ids], pa.string()),
                        pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                    ],
                    names=[key, "ids", "decoded", "n_tokens"],
                )

    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids and SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        F.col(key),
        "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
