"""Quality, lines, mixing, near copies, search, archives and the pipeline against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gaugewise.llm.catalogue import QUERIES
from gaugewise.llm import graycopies, lines, minhash, mixing, quality, simhash, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def form_slowly(text):
    words = WORD.findall(text or "")
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) for j in range(5) if windows[tuple(words[k : k + 5])] > 1}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)
    )


def random_text(choose, n):
    return "".join(choose.choice(["ab", "cd", "é", "#x", "a|b"]) + choose.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    choose = random.Random(1)
    return [None, "", " \n ", "one", "a b c d e a b c d e", "x " * 4000, "same\nsame\n\nsame "] + [random_text(choose, n) for n in range(1, 60)]


def ratios_slowly(texts, trusted):
    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
        # a hash of two longs in a row: the first one's hash is the seed of the second's
        pairs = [
            xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])
        ]
        signed = [x - (1 << 64) if x >> 63 else x for x in h + pairs]
        return [x % quality.BUCKETS for x in signed]

    raw, target = Counter(), Counter()
    for k, text in texts:
        raw.update(buckets(text))
        if k in trusted:
            target.update(buckets(text))
    n, m, s = sum(raw.values()), sum(target.values()), quality.SMOOTHING
    out = {}
    for b, count in raw.items():
        share = count / n
        out[b] = round(1000 * np.log((target[b] + s * share * quality.BUCKETS) / (m + s * quality.BUCKETS) / share))
    return out, buckets


def test_quality(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(k, t, True, "h") for k, t in rows] + [(None, "a b", False, "")], "doc_id long, text string, kept boolean, hashes string")
    trusted = spark.createDataFrame([(k,) for k in range(10, 40)] + [(None,)], "doc_id long")
    ratios = quality.fit(docs, trusted)
    wanted, buckets = ratios_slowly([*rows, (None, "a b")], set(range(10, 40)))
    assert {b: r for b, r in enumerate(ratios) if b in wanted} == wanted
    found = {r.doc_id: r for r in quality.judge(docs, ratios, ["doc_id"]).collect()}
    for k, text in rows:
        r = found[k]
        n, chars, symbols, dup, repeat = form_slowly(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        failed = n < 10 or 100 * repeat > 20 * n
        score = sum(wanted[b] for b in buckets(text))
        assert (r.base_failed, r.score) == (failed, score)
        assert r.kept == (not failed and score >= quality.THRESHOLD * len(buckets(text)))
    assert quality.fit(docs.limit(0), trusted) == [0] * quality.BUCKETS
    assert quality.judge(docs.limit(0), ratios, ["doc_id"]).count() == 0


def test_keep_good_keeps_columns(spark):
    clean = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, clean, "x", 1), (2, "short", "y", 2), (1, clean, "x", 1)], "doc_id long, text string, row string, kept int")
    kept = quality.keep_good(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, clean, "x", 1)] * 2


def test_lines(spark):
    sites = [f"s{k}" for k in range(12)]
    rows = [(k, f"own line {k}\n  Common here \n\nLast {k}", "en", sites[k], 0) for k in range(12)]
    rows += [(20 + k, f"text {k}\nNearly common", "en", sites[k % 7], 0) for k in range(30)]
    rows += [(60, "Common here", "en", "s1", 0), (60, "Common here", "en", "s1", 0), (61, None, "en", None, 0), (62, "", None, "s2", 0)]
    rows += [(None, "Common here\nnew", "en", "s3", 0)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    found = lines.dedup(docs).select("row.doc_id", "text", "n_lines", "n_removed").collect()
    wanted = []
    for k, text, *_ in rows:
        parts = text.split("\n") if text is not None else []
        left = [x for x in parts if x.strip() != "Common here" or k == 0]
        wanted.append((k, text if text is None else "\n".join(left), len(parts), len(parts) - len(left)))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    out = lines.without_boilerplate(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.filter("n_chars <> length(text)").count() == 0
    assert lines.dedup(docs.limit(0)).count() == 0


def targets_slowly(sizes):
    """Words wanted of each source: the sources that are full are taken out one round after another."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, n in enumerate(names)}
    rest, open_, out = mixing.SHARE * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        full = [n for n in open_ if rest * weight[n] / total > mixing.MOST_USES * sizes[n]]
        for n in full or open_:
            out[n] = float(mixing.MOST_USES * sizes[n]) if full else rest * weight[n] / total
        rest -= sum(mixing.MOST_USES * sizes[n] for n in full)
        open_ = [n for n in open_ if n not in out]
    return out


def test_targets(spark):
    choose = random.Random(2)
    for sizes in (
        {None: 10, "b": 100, "a": 10, "c": 30}, {"a": 0}, {}, {"a": 0, "b": 7}, {"": 5, None: 5},
        {f"s{k}": choose.choice([0, 1, 50, 1000, 90_000]) for k in range(40)},
    ):
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r.source: r.target for r in mixing.targets(frame).collect()}
        wanted = targets_slowly(sizes)
        assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) <= 1e-9 * (1 + wanted[k]) for k in wanted)


@pytest.mark.parametrize("block", [1, 16])
def test_blocks_go_to_the_highest_quotients(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    choose = random.Random(3)
    rows = [(shard, rank, choose.choice([1, 3, 40, 200]) * (1 + rank % 2)) for rank in range(6) for shard in range(0, 9000, 97)]
    size = {rank: sum(w for _, r, w in rows if r == rank) for rank in range(6)}
    target = {rank: size[rank] * (0.2, 0.9, 1.3, 1.75, 2.0, 0.0)[rank] for rank in size}
    parts = spark.createDataFrame([(s, r, w, size[r], target[r]) for s, r, w in rows], "shard long, rank int, words long, source_size long, target double")
    found = {(q.shard, q.rank): q.quota for q in mixing.quotas(parts).collect()}
    for rank in size:
        passed, held = 0, 0
        for shard, _, words in sorted(row for row in rows if row[1] == rank):
            passed, before_ = passed + words, held
            while target[rank] * passed / size[rank] / (2 * held + 1) >= block / 2:
                held += 1
            assert found[shard, rank] == min(block * (held - before_), 2 * words)


def test_mix(spark):
    rows = [(k, "w " * (k % 50), "en", None if k % 7 == 0 else "hot" if k % 3 else f"s{k % 5}", 0) for k in range(3000)]
    rows += [(None, "a b c", "en", "hot", 0), (5, "x y", "en", "s1", 0), (5, "x y", "en", "s1", 0), (6, None, "en", "empty", 0)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and found and all(0 <= r.taken <= 2 * r["size"] for r in found)
    taken, target = defaultdict(int), {}
    for r in found:
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target[key] = r.target
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert abs(words - sum(target.values())) < 0.05 * sum(target.values())
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [(3, 1, 2), (40, 1, 2)])
def test_thin_source_over_shards(spark, sf_dir, tmp_path, monkeypatch, weights):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 400)
    monkeypatch.setattr(mixing, "WEIGHTS", weights)
    rows = [(k, "w " * 390, "en", "hot", 0) for k in range(300)]
    # two at their limit, one that gives a part of its words only
    rows += [(1000 + k, "w " * (1 + k % 3), "en", "short", 0) for k in range(90)]
    rows += [(2000 + k, "w " * (10 + k % 2), "en", None, 0) for k in range(60)]
    rows += [(4000 + k, "w " * (1 + k % 30), "en", "a", 0) for k in range(9000)]
    rows += [(None, f"w {k}", "en", "b", 0) for k in range(200)] + [(7, "w w w", "en", "c", 0)] * 50
    docs = spark.createDataFrame(rows, DOCUMENT)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    target = targets_slowly(sizes)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    # the query's own function: it has no source column, but a source's size and target name it here
    taken = defaultdict(int)
    for r in QUERIES["op6_source_mix"](spark, path).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert len(taken) == len(sizes) and spark.read.parquet(f"{path}/documents.parquet").count() / 50 > 50
    found = dict(mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.size_of(F.col("text")))).collect())
    for source, wanted in target.items():
        longest = max(len(r[1].split()) for r in rows if r[3] == source)
        assert abs(taken[sizes[source], round(wanted, 6)] - wanted) <= 1, source
        assert abs(found.get(source, 0) - wanted) <= longest + 1, source


def test_equal_rows_without_id_lie_in_several_shards(spark):
    docs = spark.createDataFrame([(None, f"text {k}", "en", "s", 0) for k in range(9000)], DOCUMENT)
    _, parts = mixing._placed(docs, "doc_id", "text", "source", mixing.SEED)
    assert parts.count() >= 3


def fingerprint_slowly(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_slowly(fps):
    label = list(range(len(fps)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                label[find(a)] = find(b)
    return [find(k) for k in range(len(fps))]


def test_fingerprint():
    for text in ("", "ÀB c", "One two", "a b c d E f g", "x\x1cy z\x85w q r", "long " * 70000 + "end of it"):
        if len(text) < 1000:
            assert simhash.fingerprint(text) % (1 << 64) == fingerprint_slowly(text)
        else:
            assert isinstance(simhash.fingerprint(text), int)


def test_gray_rank(spark):
    row = spark.range(64).select("id", simhash.gray_rank(F.col("id").bitwiseXOR(F.shiftright("id", 1))).alias("back"))
    assert row.filter("id <> back").count() == 0  # id ^ (id >> 1) is the Gray code of id


def test_tree_links():
    choose = np.random.default_rng(4)
    for n, m in ((1, 1), (40, 3), (300, 700)):
        start = choose.integers(0, 1 << 63, 5, dtype=np.uint64)
        a, b = (np.unique(start[choose.integers(0, 5, k)] ^ np.uint64(1) << choose.integers(0, 64, k).astype(np.uint64)) for k in (n, m))
        for x, y in ((a, None), (a, b)):
            found = set(zip(*(z.tolist() for z in simhash.links(x, y))))
            other = a if y is None else y
            wanted = {
                (i, j) for i in range(len(x)) for j in range(len(other)) if (y is not None or i < j) and int(x[i] ^ other[j]).bit_count() <= 3
            }
            assert found == wanted


@pytest.mark.parametrize("chunk", [8, 1024])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    choose = random.Random(7)
    fps = []
    for _ in range(12):
        fp = choose.getrandbits(64)
        for _ in range(choose.randint(1, 25)):  # chains and clusters
            fp = fp ^ (1 << choose.randrange(64)) ^ (1 << choose.randrange(64)) if choose.random() < 0.6 else fp ^ (1 << choose.randrange(8))
            fps.append(fp)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = dict(simhash.components(edges).collect())
    wanted = components_slowly(fps)
    of_root = defaultdict(set)
    for f, k in zip(signed, wanted):
        of_root[k].add(f)
    assert {f: min(g) for g in of_root.values() for f in g} == {f: roots.get(f, f) for f in signed}


def test_near_copies_frame(spark):
    body = " ".join(f"w{k}" for k in range(400))
    rows = [(3, body), (2, body.upper().replace("W", "w")), (9, body + " more"), (5, None), (7, ""), (8, "alone here now"), (8, "alone here now"), (None, body)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCUMENT)
    found = {(r.doc_id, r.component_id) for r in simhash.components_of(docs).collect()}
    assert found == {(3, 2), (2, 2), (9, 2), (5, 5), (7, 5), (8, 8), (None, 2)}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 8]
    assert simhash.components_of(docs.limit(0)).count() == 0
    # rows of one id and text that differ elsewhere: the same one stays, however they are dealt out
    equal = spark.createDataFrame([(1, body, "en", f"s{k}", k) for k in range(9)], DOCUMENT)
    assert len({simhash.keep_first(equal.repartition(n)).first().source for n in (1, 4, 7)}) == 1


def shingles_slowly(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("chunk, size, propose", [(512, 1 << 22, True), (7, 1 << 22, False), (7, 5000, True)])
def test_edited_copies(spark, monkeypatch, chunk, size, propose):
    monkeypatch.setattr(graycopies, "CHUNK", chunk)
    monkeypatch.setattr(graycopies, "CHUNK_BYTES", size)
    monkeypatch.setattr(graycopies, "PROPOSE", propose)
    choose = random.Random(11)
    rows = [(None, "a b"), (3, None), (4, ""), (5, "a b"), (6, "A b"), (7, "a b c d e"), (8, "a b c d f")]
    for group in range(15):
        words = [f"g{group}w{choose.randrange(400)}" for _ in range(choose.randint(8, 300))]
        for _ in range(choose.randint(2, 20)):  # from equal to Jaccard below 0.8, some in chains
            copy = [w if choose.random() > 0.02 else f"new{choose.random()}" for w in words]
            words = copy if choose.random() < 0.3 else words
            rows.append((1000 - len(rows), " ".join(copy)))
    sets = [shingles_slowly(text) for _, text in rows]
    label = list(range(len(rows)))
    missed_by_bits = 0
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                one, two = label[a], label[b]
                label = [two if x == one else x for x in label]
                missed_by_bits += (fingerprint_slowly(rows[a][1]) ^ fingerprint_slowly(rows[b][1])).bit_count() > 3
    assert missed_by_bits > 20
    wanted = [min(k if k is not None else 9999 for (k, _), x in zip(rows, label) if x == own) for own in dict.fromkeys(label)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCUMENT)
    kept = corpus_pipeline.near_dedup(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), None).count() == 0


def simhash_slowly(text):
    """Two words: the majority of the shingles' hashes, and of their SplitMix64 finalizers."""

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h = (h ^ h >> 27) * 0x94D049BB133111EB % (1 << 64)
        return h ^ h >> 31

    first = [xxhash.xxh64_intdigest(" ".join(s).encode(), 43) for s in shingles_slowly(text)]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) for hashes in (first, [mixed(h) for h in first]))


def test_stage_orders_and_compares_simhash(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(graycopies, "stored", lambda frame, name, f=graycopies.stored: seen.setdefault(name, f(frame, name)))
    choose = random.Random(12)
    rows = []
    for group in range(20):
        words = [f"g{group}w{choose.randrange(300)}" for _ in range(choose.randint(6, 200))]
        rows += [(10 * group, " ".join(words)), (10 * group + 1, " ".join(words[:-1] + ["Other"]))]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCUMENT)
    corpus_pipeline.near_dedup(spark, docs, None)
    fingerprints = {r.fp: (r.one, r.two) for r in seen["sketches"].collect()}
    wanted = sorted(simhash_slowly(t) for _, t in rows)
    assert sorted(tuple(x % (1 << 64) for x in words) for words in fingerprints.values()) == wanted
    # the index sorts, keeps and compares the same words
    chunks = seen["gray-chunks"].collect()
    inside = [tuple(x) for c in chunks for x in zip(*(np.frombuffer(c[n], "<i8").tolist() for n in ("fp", "one", "two")))]
    assert len(chunks) and all(fingerprints[fp] == (one, two) for fp, one, two in inside) and len({x[0] for x in inside}) > 20


def test_simhash_of_near_copies_within_the_radius():
    draw = np.random.default_rng(13)
    for common, one, two in ((4, 0, 1), (12, 1, 2), (20, 2, 3), (100, 0, 25), (800, 100, 100)):  # Jaccard of exactly 0.8
        apart = []
        for _ in range(150):
            hashes = draw.integers(0, 1 << 64, common + one + two, dtype=np.uint64)
            a, b = minhash.fingerprint(hashes[: common + one]), minhash.fingerprint(np.delete(hashes, np.arange(common, common + one)))
            apart.append(int(np.bitwise_count((a ^ b).view("<u8")).sum()))
        assert max(apart) <= graycopies.RADIUS and 14 < np.mean(apart) < 28


def test_gray_tree_finds_all_within_its_radius():
    draw = np.random.default_rng(5)
    heads = draw.integers(0, 1 << 64, (12, 3), dtype=np.uint64)
    rows = heads[draw.integers(0, 12, 300)].copy()
    for row in rows:  # up to forty bits changed in the code, none in the block value
        for bit in draw.integers(64, 192, draw.integers(0, 40)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows = rows[np.lexsort(rows.T[::-1])]
    bits = np.bitwise_count(rows[:, None, 1:] ^ rows[None, :, 1:]).sum(2)
    near = (rows[:, None, 0] == rows[None, :, 0]) & (bits <= graycopies.RADIUS)
    i, j, apart = graycopies.links(rows)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    assert (apart == bits[i, j]).all() and len(i) > 500
    i, j, _ = graycopies.links(rows[:120], rows[120:])
    assert set(zip(i.tolist(), (j + 120).tolist())) == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(near))) if a < 120 <= b}


def search_slowly(rows, k):
    def numbers(v):
        return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * float(x))) for x in v]

    kept = [(i, numbers(v)) for i, v in rows if i is not None and numbers(v) is not None]
    out = []
    for q, v in {i: v for i, v in kept if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_topk(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    choose = np.random.default_rng(5)
    rows = [(k, choose.normal(size=6).astype(np.float32).tolist()) for k in range(400)]
    rows += [(400 + k, rows[7][1]) for k in range(150)]  # ties
    rows += [(901, None), (902, [1.0, None]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (None, [1.0] * 6), (905, []), (906, [1.0]), (401, rows[7][1])]
    if kind == "double":
        rows += [(950, [3e7, -2.5, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int")
    found = topk.search(frame, F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5)
    assert sorted(map(tuple, found.collect())) == search_slowly(rows, 5)
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5).count() == 0
    two = topk.search(frame.filter("vec_id < 2"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5)
    assert [r.vec_id for r in two.collect()] == [1]


def test_topk_drops_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 2)
    pairs = []
    monkeypatch.setattr(topk, "stored", lambda frame, name, f=topk.stored: pairs.append((name, f(frame, name))) or pairs[-1][1])
    choose = np.random.default_rng(8)
    centres = choose.normal(size=(12, 8)) * 6
    rows = [(k, (centres[k % 12] + choose.normal(size=8) * 0.2).tolist()) for k in range(1200)]
    rows += [(50, [9.0] * 8), (50, [-9.0] * 8), (100, rows[100][1])]  # an id with several vectors: the smallest asks
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = sorted(map(tuple, topk.search(frame, F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5).collect()))
    asked = {k: min(v for i, v in rows if i == k) for k, _ in rows if k % 50 == 0}
    numbers = {k: np.floor(256 * np.array(v)).astype(np.int64) for k, v in asked.items()}
    every = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    wanted = []
    for q, v in numbers.items():
        best = sorted((-int(v @ w), i) for i, w in every if i != q)[:5]
        wanted += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert found == sorted(wanted)
    sizes = {name: frame.count() for name, frame in pairs}
    assert 0 < sizes["block-pairs"] < 0.7 * sizes["pivot-table"] * sizes["query-blocks"]


def test_archive_audit(spark):
    choose = random.Random(9)
    rows = [(k, f"http://h/{k}", "x" * choose.randint(0, 9000), 1) for k in range(1500)] + [(None, None, None, 1), (3, "u", "", 1), (3, "u", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    records = warc.archive(pages)
    assert warc.audit(records, records.repartition(5)).count() == 0
    bad = records.filter("record_id IS NULL OR record_id <> 700").withColumn(
        "record", F.when(F.col("record_id").isin(11, 1200), F.concat("record", F.lit("~"))).otherwise(F.col("record"))
    )
    found = sorted((r.record_id, r.status) for r in warc.audit(records, bad).collect())
    assert found == [(11, "changed"), (700, "missing"), (1200, "changed")]
    assert [r.status for r in warc.audit(bad, records).filter("record_id = 700").collect()] == ["extra"]
    assert warc.audit(records.limit(0), records.limit(0)).count() == 0
    # digests in place of records give the same places, and the same damage
    index = warc.index(pages, copy=warc.digest_of(F.col("record")))
    assert index.select("archive", "offset", "length", "record_id").exceptAll(records.drop("record")).count() == 0
    assert index.count() == records.count() and warc.audit(index.drop("copy"), records).count() == 0
    found = sorted((r.record_id, r.status) for r in warc.audit(index.drop("copy"), bad).collect())
    assert found == [(11, "changed"), (700, "missing"), (1200, "changed")]
    first = records.filter("record_id = 0").first()
    assert first.offset == 0 and first.length == len(first.record.encode()) and first.record.startswith("WARC/1.1\r\n")


def mixed_slowly(rows):
    """Uses of every row (doc_id, text, source) where all fit into one shard."""
    sizes, groups, uses = defaultdict(int), defaultdict(list), {}
    for k, text, source in rows:
        size = len(WORD.findall(text or ""))
        digest = hashlib.md5((text or "").encode()).hexdigest()
        place = int(hashlib.md5(f"{mixing.SEED + 1}:{k}:{digest}".encode()).hexdigest()[:8], 16)
        sizes[source] += size
        groups[source].append((place, k, size))
    for source, target in targets_slowly(sizes).items():
        quota, end = int(target + 0.5), 0
        for _, k, size in sorted(groups[source]):
            taken = 0
            for use in range(mixing.MOST_USES):
                taken += max(0, min(size, quota - use * sizes[source] - end))
            end += size
            uses[k] = taken // size + (2 * (taken % size) >= size) if size else 0
    return uses


def test_pipeline(spark, tmp_path):
    choose = random.Random(6)
    vocabulary = ["".join(choose.choice("abcdefghij") for _ in range(choose.randint(2, 8))) for _ in range(150)]
    rows = []
    for k in range(90):
        words = [choose.choice(vocabulary) for _ in range(choose.randint(30, 90))]
        text = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
        rows.append((k, f"{text}\nAll rights reserved by the site" if k % 3 else text, f"s{k % 10}"))
    for k in range(12):  # edited copies, exact copies
        text = rows[k][1].split(" ")
        text[len(text) // 2] += "x"
        rows.append((200 + k, " ".join(text) if k % 2 else rows[k][1], f"s{k % 10}"))
    rows += [(300 + k, " ".join(choose.choice(["@@@", "###", "$$", "xx%%"]) for _ in range(60)), "s1") for k in range(25)]
    rows += [(400, None, "s1"), (401, "", None), (402, "too short", "s2"), (403, "again and again " * 30, "s3"), (404, rows[5][1], None)]
    sf_dir = str(tmp_path)
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], DOCUMENT)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    good = [k for k in range(60)]
    spark.createDataFrame([(k, 1, 0) for k in good], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")

    # every stage on what the slow version of the one before has kept
    ratios, buckets = ratios_slowly([(k, t) for k, t, _ in rows], set(good))
    kept = []
    for k, text, source in rows:
        n, _, _, _, repeat = form_slowly(text)
        if n >= 10 and 100 * repeat <= 20 * n and sum(ratios[b] for b in buckets(text)) >= quality.THRESHOLD * len(buckets(text)):
            kept.append((k, text, source))
    assert 80 < len(kept) < len(rows) - 10
    sites = defaultdict(set)
    for _, text, source in kept:
        for line in text.split("\n"):
            sites[line.strip()].add(source or "")
    wide, first, lined = {line for line, of in sites.items() if len(of) >= lines.MIN_SITES}, set(), []
    for k, text, source in sorted(kept):
        left = []
        for line in text.split("\n"):
            if line.strip() not in wide or line.strip() not in first:
                left.append(line)
            first.add(line.strip())
        lined.append((k, "\n".join(left), source))
    assert wide and sum(len(t) for _, t, _ in lined) < sum(len(t) for _, t, _ in kept)
    sets, label = [shingles_slowly(text) for _, text, _ in lined], list(range(len(lined)))
    for a in range(len(lined)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    single = [next(row for row, x in zip(lined, label) if x == own) for own in dict.fromkeys(label)]
    assert len(single) < len(lined) - 5
    uses = mixed_slowly(single)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = []
    for k, text, _ in single:
        ids = library.encode(text, add_special_tokens=False).ids
        wanted += [(k, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))] * uses[k]

    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "gaugewise-llm"
    there = {p.name for p in folder.iterdir()} if folder.exists() else set()
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, out.select("doc_id", "n_tokens", "ids", "decoded").collect())) == sorted(wanted)
    # besides the lexicon, which executors that join later still fetch
    left = {p.name.split("-")[0] for p in folder.iterdir() if p.name not in there}
    assert left - {"lexicon", ".lexicon"} == {"pipeline"}
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:4]:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0, name


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0



def test_many_boilerplate_lines_in_long_texts(spark):
    common = "\n".join(f"line number {k} of the notice" for k in range(60_000))
    rows = [(k, f"own {k}\n{common}\nend {k}", "en", f"s{k}", 0) for k in range(9)]
    began = time.time()
    found = {r.row.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, DOCUMENT)).collect()}
    assert time.time() - began < 60
    assert found[0].n_removed == 0 and found[0].text == rows[0][1]
    assert all(found[k].n_removed == 60_000 and found[k].text == f"own {k}\nend {k}" for k in range(1, 9))
