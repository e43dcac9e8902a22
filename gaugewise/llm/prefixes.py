"""Trie of conversation prefixes by range minimums over sorted common-prefix lengths.

A turn is a record of fixed length (digest and size of its text), a conversation the string of its
turns. Conversations are sorted; next to each stands the number of turns it shares with the one before
(LCP). All conversations with a common prefix then form an interval, whose ends are the nearest places
where the LCP falls below the prefix length. Every prefix finds them for itself by two binary searches
over a sparse table of range minimums; nothing is carried from one prefix to another.

Long conversations are cut into segments of ``SEGMENT`` turns, sorted by what precedes the segment, so
none has to be held by one task. The sorted order is cut into chunks, each with a table of its own.
Intervals that reach over the edge of a chunk are the prefixes of its first or last conversation; their
parts add up by the digest of the prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import before, stored

#: Bytes of a turn: digest of role and text, code points of the text.
DIGEST, TURN = 16, 20
#: Turns of a segment; conversations and turns of a chunk.
SEGMENT, CHUNK, CHUNK_TURNS = 256, 50_000, 1_000_000
#: A conversation opens with up to HEADS - 1 turns of the first one of its hundred.
FAMILY, HEADS = 100, 6

_ORDER = ["s", "p1", "p2", "turns", "conv_id"]


def turn_record(role: Column, text: Column) -> Column:
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))


def _no_bytes() -> Column:
    return F.lit(bytearray()).cast("binary")


def _pieces_joined(pieces: Column) -> Column:
    """Bytes of an array of (at, turns), in order."""
    return F.aggregate(F.array_sort(pieces), _no_bytes(), lambda done, p: F.concat(done, p["turns"]))


def _part(turns: Column, start: Column, n: Column) -> Column:
    """``n`` turns from ``start`` (from 0) on."""
    return F.substring(turns, (start * TURN + 1).cast("int"), (F.greatest(n, F.lit(0)) * TURN).cast("int"))


def runs_of(turns: DataFrame, segment: int) -> DataFrame:
    """Turns (conv_id, turn, record) sorted and packed: conv_id, start (from 0) and bytes of each run.

    A conversation may lie in several partitions; where it starts in each follows from the counts of the
    conversations at partition edges, two rows a partition at most.
    """

    def pack(batches):
        part, conv, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            data = b"".join(batch.column(1).to_pylist())
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            rows = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)]):
                if ids[a] != conv:
                    conv, seen = ids[a], 0
                for at in range(a, b, segment):
                    to = min(b, at + segment)
                    rows.append((part, int(conv), seen, to - at, data[at * TURN : to * TURN]))
                    seen += to - at
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["part", "conv_id", "start", "n", "turns"],
            )

    # the last key only lets many equal turns lie in several partitions
    order = ["conv_id", "turn", "record"]
    ranged = turns.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order, "any").sortWithinPartitions(*order)
    runs = ranged.select("conv_id", "record").mapInArrow(pack, "part int, conv_id long, start long, n long, turns binary")
    runs = stored(runs, "runs")
    edges = runs.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id"))
    crossing = runs.join(F.broadcast(edges), ["part", "conv_id"]).groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    offsets = before(crossing, ["conv_id"], F.col("part"), {"offset": "n"}).select("part", "conv_id", "offset")
    runs = runs.join(F.broadcast(offsets), ["part", "conv_id"], "left")
    return runs.select("conv_id", (F.col("start") + F.coalesce("offset", F.lit(0))).alias("start"), "n", "turns")


def rebuilt(runs: DataFrame, segment: int) -> DataFrame:
    """Segments of the rebuilt conversations: conv_id, s, and turns s * segment + 1 ... (s + 1) * segment + 1.

    The last turn of a segment is the first of the next; a conversation that ends where a segment begins
    has an empty one there, and one without turns an empty first.
    """
    own = F.col("conv_id")
    heads = runs.where((own % FAMILY == 0) & (F.col("start") < HEADS - 1)).groupBy(own.alias("base"))
    heads = heads.agg(_pieces_joined(F.collect_list(F.struct(F.col("start").alias("at"), "turns"))).alias("head"))
    rows = runs.withColumn("base", own - own % FAMILY).join(heads, "base", "left")
    rows = rows.withColumn("h", F.crc32(own.cast("string").cast("binary")) % HEADS)
    rows = rows.withColumn("given", F.least("h", F.coalesce(F.floor(F.length("head") / TURN), F.lit(0))))
    skip = F.greatest(F.col("h") - F.col("start"), F.lit(0))
    left = _part(F.col("turns"), skip, F.col("n") - skip)
    opening = F.when(F.col("start") == 0, F.coalesce(_part(F.col("head"), F.lit(0), F.col("given")), _no_bytes())).otherwise(_no_bytes())
    at = F.when(F.col("start") == 0, F.lit(0)).otherwise(F.greatest("start", "h") - F.col("h") + F.col("given"))
    pieces = rows.select("conv_id", at.alias("at"), F.concat(opening, left).alias("turns"))
    # a later run that lies wholly within the turns left out adds nothing
    end = F.col("at") + F.floor(F.length("turns") / TURN)
    pieces = pieces.withColumn("end", end).where("end > at OR at = 0")
    spread = F.sequence(F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / segment), F.floor(F.col("end") / segment))
    pieces = pieces.withColumn("s", F.explode(spread))
    low = F.greatest(F.col("at"), F.col("s") * segment)
    high = F.least(F.col("end"), (F.col("s") + 1) * segment + 1)
    piece = F.struct(low.alias("at"), _part(F.col("turns"), low - F.col("at"), high - low).alias("turns"))
    return pieces.groupBy("conv_id", "s").agg(_pieces_joined(F.collect_list(piece)).alias("turns"))


def preceded(segments: DataFrame, segment: int) -> DataFrame:
    """``segments`` with a 128-bit digest (p1, p2) of all turns before each, zero before the first."""
    whole = F.length("turns") >= segment * TURN
    hashes = segments.where((F.col("s") > 0) | whole).select(
        "conv_id",
        "s",
        F.xxhash64("s", F.substring("turns", 1, segment * TURN)).alias("h1"),
        F.xxhash64(F.lit("second"), "s", F.substring("turns", 1, segment * TURN)).alias("h2"),
    )
    digests = before(hashes, ["conv_id"], F.col("s"), {"p1": "h1", "p2": "h2"}, how=F.bit_xor).drop("h1", "h2")
    first = segments.where("s = 0").select("s", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "turns", "conv_id")
    later = segments.where("s > 0").join(digests, ["conv_id", "s"]).select(*_ORDER)
    return first.unionByName(later)


def common_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[: middle * TURN] == b[: middle * TURN]:
            low = middle
        else:
            high = middle
    return low


def _shared(a: tuple | None, b: tuple | None) -> int:
    """Turns that two sorted neighbours (s, p1, p2, turns) share; -1 if other turns precede them."""
    return -1 if a is None or b is None or a[:3] != b[:3] else common_turns(a[3], b[3])


def sorted_with_lcp(segments: DataFrame, chunk: int, chunk_turns: int) -> DataFrame:
    """Segments in order, with place and chunk in their partition, LCP to the one before and the one after."""
    names = ["part", "chunk", "place", *_ORDER, "lcp", "next_lcp"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    schema = "part int, chunk int, place long, s long, p1 long, p2 long, turns binary, conv_id long, lcp int, next_lcp int"

    def compare(batches):
        part, held, place, number, rows, turns = TaskContext.get().partitionId(), None, 0, 0, 0, 0
        out = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lcp = None
                if held is not None:
                    lcp = _shared(held[3:7], row)
                    out.append((*held, lcp))
                size = len(row[3]) // TURN
                if rows >= chunk or (rows and turns + size > chunk_turns):
                    number, rows, turns = number + 1, 0, 0
                held = (part, number, place, *row, lcp)
                place, rows, turns = place + 1, rows + 1, turns + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*held, None), kinds)], names)

    ranged = segments.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    frame = stored(ranged.select(*_ORDER).mapInArrow(compare, schema), "sorted")

    def meet(batches):
        """First and last rows of all partitions, in order: the values missing between partitions."""
        before_, rows = None, []
        for batch in batches:
            for part, place, *row in zip(*(c.to_pylist() for c in batch.columns)):
                row = tuple(row)
                if before_ is not None and before_[0] != part:
                    shared = _shared(before_[2], row)
                    rows += [(before_[0], before_[1], None, shared), (part, place, shared, None)]
                before_ = (part, place, row)
        if rows:
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "place", "a", "b"])

    # two rows for each partition at most, in one task
    edges = frame.where("lcp IS NULL OR next_lcp IS NULL").select("part", "place", "s", "p1", "p2", "turns")
    edges = edges.repartition(1).sortWithinPartitions("part", "place").mapInArrow(meet, "part int, place long, a int, b int")
    edges = edges.groupBy("part", "place").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    fixed = frame.join(F.broadcast(edges), ["part", "place"], "left")
    missing = F.lit(-1)
    return fixed.withColumns({"lcp": F.coalesce("lcp", "a", missing), "next_lcp": F.coalesce("next_lcp", "b", missing)}).drop("a", "b")


@dataclass(frozen=True)
class Sizes:
    """Turns of neighbouring records, one after the other, and sums of their code points."""

    first: np.ndarray
    n: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, turns: list[bytes]) -> Sizes:
        n = np.array([len(t) // TURN for t in turns], np.int64)
        data = np.frombuffer(b"".join(turns), np.uint8).reshape(-1, TURN)
        sizes = np.ascontiguousarray(data[:, DIGEST:]).view(">u4").astype(np.int64).ravel()
        return cls(np.concatenate([[0], np.cumsum(n)])[:-1], n, np.concatenate([[0], np.cumsum(sizes)]))

    def upto(self, record: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Code points of the first ``turns`` turns of each record."""
        return self.sums[self.first[record] + turns] - self.sums[self.first[record]]


def own_share(sizes: Sizes, s, lcp, next_lcp, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each record, in its segment: code points, those of nodes that no record before has, leaves that none after has."""
    every, counted = np.arange(len(sizes.n)), np.minimum(sizes.n, segment)
    text = sizes.upto(every, counted)
    new = text - sizes.upto(every, np.minimum(np.maximum(lcp, 0), counted))
    leaf = (sizes.n <= segment) & ((sizes.n > 0) | (s == 0)) & (next_lcp < sizes.n)
    return text, new, leaf.astype(np.int64)


def with_later(records: DataFrame, segment: int) -> DataFrame:
    """``records`` with what the later segments of their conversation hold (text, new, leaves)."""
    kinds = "conv_id long, s long, text long, new long, leaves long"

    def share(batches):
        for batch in batches:
            conv, s, lcp, following = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3))
            if len(conv):
                found = own_share(Sizes.of(batch.column(4).to_pylist()), s, lcp, following, segment)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (conv, s, *found)], ["conv_id", "s", "text", "new", "leaves"])

    cut = (F.col("s") > 0) | (F.length("turns") >= segment * TURN)
    shares = records.where(cut).select("conv_id", "s", "lcp", "next_lcp", "turns").mapInArrow(share, kinds)
    names = {f"later_{c}": c for c in ("text", "new", "leaves")}
    later = before(shares, ["conv_id"], -F.col("s"), names).drop("text", "new", "leaves")
    none = {name: F.lit(0).cast("long") for name in names}
    return records.where(~cut).withColumns(none).unionByName(records.where(cut).join(later, ["conv_id", "s"]))


def minimum_table(values: np.ndarray) -> list[np.ndarray]:
    """Minimums of 1, 2, 4, ... neighbouring values, by where they begin."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    return levels


def range_minimum(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values low ... high - 1 (not empty): two overlapping entries of the table."""
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << int(k))])
    return out


def right_ends(table: list[np.ndarray], record: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First record after ``record`` whose LCP is below ``depth``: binary search by falling powers of two."""
    n, at = len(table[0]), record + 1
    for k in range(len(table) - 1, -1, -1):
        fits = at + (1 << k) <= n
        step = fits & (table[k][np.where(fits, at, 0)] >= depth)
        at = at + (step << k)
    return at


def left_ends(table: list[np.ndarray], record: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last record up to ``record`` whose LCP is below ``depth``, or the first of all."""
    at = record + 1
    for k in range(len(table) - 1, -1, -1):
        start = at - (1 << k)
        fits = start >= 0
        step = fits & (table[k][np.where(fits, start, 0)] >= depth)
        at = at - (step << k)
    return np.maximum(at - 1, 0)


_OUT = {
    "part": pa.int32(), "chunk": pa.int32(), "open": pa.bool_(), "shown": pa.bool_(), "key": pa.binary(), "parent_key": pa.binary(),
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(),
}
_SCHEMA = (
    "part int, chunk int, open boolean, shown boolean, key binary, parent_key binary, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)


def chunk_nodes(part: int, chunk: int, columns: dict[str, list], segment: int) -> pa.RecordBatch:
    """The nodes of one chunk of sorted records, those that reach over its edges as parts."""
    s, p1, p2, conv, lcp = (np.array(columns[c], np.int64) for c in ("s", "p1", "p2", "conv_id", "lcp"))
    turns, after = columns["turns"], np.array(columns["next_lcp"], np.int64)
    sizes, m = Sizes.of(turns), len(s)
    text, new, leaf = own_share(sizes, s, lcp, after, segment)
    prefix = {
        name: np.concatenate([[0], np.cumsum(own + np.array(columns[f"later_{name}"], np.int64))])
        for name, own in (("text", text), ("new", new), ("leaves", leaf))
    }

    # places (record, depth) where a prefix is met for the first time; depth 0 where other turns precede
    fresh = np.maximum(sizes.n - lcp, 0)
    record = np.repeat(np.arange(m), fresh)
    depth = np.arange(len(record)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + lcp[record] + 1
    met = np.sort(depth * (m + 1) + record)

    carried = np.arange(0, min(lcp[0], segment) + 1)  # prefixes that the chunk before has as well
    record, depth = np.concatenate([np.zeros(len(carried), np.int64), record]), np.concatenate([carried, depth])
    inside = depth <= segment
    record, depth = record[inside], depth[inside]

    table, lowest = minimum_table(lcp), minimum_table(conv)
    edge = after[-1]

    def interval(record, depth):
        low, high = left_ends(table, record, depth), right_ends(table, record, depth)
        over = ((low == 0) & (lcp[0] >= depth)) | ((high == m) & (edge >= depth))
        return low, high, over

    low, high, open_ = interval(record, depth)
    begins = lcp[record] < depth
    children = np.searchsorted(met, (depth + 1) * (m + 1) + high) - np.searchsorted(met, (depth + 1) * (m + 1) + low)
    # all of a member's text from this node on, less that of nodes which are counted once
    upto = sizes.upto(record, np.maximum(depth - 1, 0))
    saved = prefix["text"][high] - prefix["text"][low] - (high - low) * upto - (prefix["new"][high] - prefix["new"][low])
    saved += np.where(begins, upto - sizes.upto(record, np.minimum(np.maximum(lcp[record], 0), np.maximum(depth - 1, 0))), 0)
    leaves = prefix["leaves"][high] - prefix["leaves"][low]

    below = depth > 0
    parent, parent_open = np.zeros(len(record), np.int64), np.zeros(len(record), bool)
    up_low, up_high, parent_open[below] = interval(record[below], depth[below] - 1)
    parent[below] = range_minimum(lowest, up_low, up_high)

    def key(i: int, d: int) -> bytes:
        return hashlib.md5(b"%d:%d:%d:%d:" % (s[i], p1[i], p2[i], d) + turns[i][: d * TURN]).digest()

    # runs of conversations that end at one node: equal neighbours, in the order of their ids
    alike = np.concatenate([[False], (lcp[1:] == sizes.n[1:]) & (sizes.n[1:] == sizes.n[:-1])]) if m else np.zeros(0, bool)
    run_end = np.append(np.flatnonzero(~alike)[1:], m)
    run_of = np.cumsum(~alike) - 1
    names = [str(c) for c in conv.tolist()]
    shown = (depth > 0) | (s[record] == 0)
    keep = np.flatnonzero(shown | open_)
    out: dict[str, list] = {name: [] for name in ("key", "parent_key", "ends")}
    nothing = hashlib.sha256(b"").hexdigest()
    for i, d, is_open, up_open in zip(record[keep].tolist(), depth[keep].tolist(), open_[keep].tolist(), parent_open[keep].tolist()):
        ids = ",".join(names[i : run_end[run_of[i]]]) if sizes.n[i] == d else ""
        out["key"].append(key(i, d) if is_open else None)
        out["parent_key"].append(key(i, d - 1) if up_open else None)
        out["ends"].append(ids if is_open else hashlib.sha256(ids.encode()).hexdigest() if ids else nothing)
    parents = np.ma.array(parent[keep], mask=~below[keep] | parent_open[keep])
    values = [
        np.full(len(keep), part, np.int32), np.full(len(keep), chunk, np.int32), open_[keep], shown[keep], out["key"], out["parent_key"],
        range_minimum(lowest, low[keep], high[keep]), (s[record] * segment + depth)[keep], parents.tolist(),
        (high - low)[keep], children[keep], leaves[keep], saved[keep], out["ends"],
    ]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _OUT.values())], list(_OUT))


def parts_of_nodes(records: DataFrame, segment: int) -> DataFrame:
    names = ["part", "chunk", "place", *_ORDER, "lcp", "next_lcp", "later_text", "later_new", "later_leaves"]

    def work(batches):
        at, held = None, {n: [] for n in names}

        def made(slices) -> Iterator[pa.RecordBatch]:
            batch = chunk_nodes(*at, slices, segment)
            for start in range(0, batch.num_rows, CHUNK):
                yield batch.slice(start, CHUNK)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(columns[0], columns[1]))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                if at is not None and keys[a] != at:
                    yield from made(held)
                    held = {n: [] for n in names}
                at = keys[a]
                for name, values in zip(names, columns):
                    held[name] += values[a:b]
        if at is not None:
            yield from made(held)

    dealt = records.select(*names).repartition("part", "chunk").sortWithinPartitions("part", "chunk", "place")
    return stored(dealt.mapInArrow(work, _SCHEMA), "nodes")


def merged(parts: DataFrame) -> DataFrame:
    """Nodes that reach over chunks: their parts, in the order of the chunks, added up as they stream by."""
    names = ["key", "parent_key", "shown", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    kinds = [_OUT[n] for n in names]

    def work(batches):
        now, digest, written = None, None, False

        def closed():
            return (*now, digest.hexdigest())

        for batch in batches:
            rows = []
            for key, up, shown, conv, depth, n, children, leaves, saved, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != key:
                    if now is not None:
                        rows.append(closed())
                    now, digest, written = (key, up, shown, conv, depth, 0, 0, 0, 0), hashlib.sha256(), False
                now = (key, up, shown, min(now[3], conv), depth, now[5] + n, now[6] + children, now[7] + leaves, now[8] + saved)
                if ids:
                    digest.update((("," if written else "") + ids).encode())
                    written = True
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), kinds)], names)

    parts = parts.repartition("key").sortWithinPartitions("key", "part", "chunk").select(*names)
    schema = (
        "key binary, parent_key binary, shown boolean, conv_id long, depth long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends string"
    )
    return stored(parts.mapInArrow(work, schema), "merged")


def trie(
    conversations: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, chunk_turns: int = CHUNK_TURNS
) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Turns stand in the order of ``turn``, null first; turns with one number in the order of the MD5 of
    their role and text. Repeated rows are turns of their own. A null role or text is empty; rows without
    conv_id belong to no conversation. The first turns come from the conversation conv_id - conv_id % 100,
    the remainder having the sign of conv_id. An empty table has no node. Only the named columns are read.
    Turns count as equal if the MD5 of role and text is.
    """
    turns = conversations.select("conv_id", "turn", turn_record(F.col("role"), F.col("text")).alias("record"))
    turns = stored(turns.where("conv_id IS NOT NULL"), "turns")
    segments = stored(rebuilt(runs_of(turns, segment), segment), "segments")
    records = with_later(sorted_with_lcp(preceded(segments, segment), chunk, chunk_turns), segment)
    found = parts_of_nodes(records, segment)
    parts = found.where("open")
    whole = merged(parts)
    # of each chunk, the few nodes that reach over its edges: a join key never has more rows than a chunk
    known = parts.select("part", "chunk", "key").join(whole.select("key", F.col("conv_id").alias("up")), "key")
    known = known.withColumnRenamed("key", "parent_key")
    inner = found.where("NOT open").join(known, ["part", "chunk", "parent_key"], "left")
    across = whole.where("shown").join(
        whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up")), "parent_key", "left"
    )
    return inner.select(*_columns(F.coalesce("parent_conv_id", "up"))).unionByName(across.select(*_columns(F.col("up"))))


def _columns(parent: Column) -> list[Column]:
    return [
        F.col("conv_id"), F.col("depth"), parent.alias("parent_conv_id"), F.col("n_convs"), F.col("n_children"), F.col("n_leaves"),
        F.col("saved_tokens"), F.col("ends").alias("ends_sha256"),
    ]
