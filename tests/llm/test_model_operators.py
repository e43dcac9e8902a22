"""Rule ensemble, whitening and conversation trie against held-out labels, dense algebra and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.llm import prefixes, rules, whitening
from gaugewise.llm.common import before, table


def trie_slowly(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for _, _, t in sorted(found)] for c, found in turns.items()}
    whole = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
    out = []
    for node, own_members in members.items():
        ends = ",".join(str(c) for c in own_members if len(whole[c]) == len(node))
        up = members[node[:-1]][0] if node else None
        out.append(
            (own_members[0], len(node), up, len(own_members), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def conversations(spark, rows):
    # other columns with names that the operator uses itself
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return frame.withColumns({"s": F.lit("x"), "part": F.lit(1), "turns": F.lit(None).cast("string")})


def trie_of(spark, rows, **sizes):
    return sorted(map(tuple, prefixes.trie(conversations(spark, rows), **sizes).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"segment": 2, "chunk": 5, "chunk_turns": 9}, {"segment": 3, "chunk": 50, "chunk_turns": 11}])
def test_trie(spark, sizes):
    choose, rows = random.Random(13), []
    for c in [*range(0, 40), *range(95, 130), *range(230, 236), -5, -100, -230]:
        n = choose.choice([1, 1, 2, 3, 4, 6, 9])
        opening = choose.randint(0, n)
        for t in range(n):
            text = f"common {t}" if t < opening else choose.choice(["", "ä", "b" * 50, "c"])
            rows.append((c, choose.choice([t, t, None, 3]), choose.choice(["u", "u", None]), choose.choice([text, text, None])))
    rows += [(None, 1, "u", "lost"), (7, 1, "u", "again"), (7, 1, "u", "again")]
    # one long conversation, one that is all equal turns, and a crowd of copies
    rows += [(300, t, "u", f"long {t % 3}") for t in range(40)] + [(500, t, "u", f"long {t % 3}") for t in range(44)]
    rows += [(600, 0, "u", "same")] * 30 + [(c, t, "u", f"copy {t}") for c in range(1000, 1060) for t in range(7)]
    assert trie_of(spark, rows, **sizes) == trie_slowly(rows)


def test_trie_of_little(spark):
    # 203 takes its first turns from a conversation that is absent, so none are left
    rows = [(c, 0, "u", "x") for c in range(201, 240)]
    wanted = trie_slowly(rows)
    assert trie_of(spark, rows) == wanted and len(wanted) <= 2
    assert prefixes.trie(conversations(spark, rows).limit(0)).count() == 0
    nothing = [(c, 0, "u", "x") for c in range(201, 240) if zlib.crc32(str(c).encode()) % 6]
    assert trie_of(spark, nothing) == trie_slowly(nothing) and len(trie_slowly(nothing)) == 1
    lone = [(None, None, None, None)] * 3
    assert trie_of(spark, lone) == []


def test_range_minimum_searches():
    choose = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        values = choose.integers(-1, 6, n)
        tables = prefixes.minimum_table(values)
        record, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(0, 7)))
        right, left = prefixes.right_ends(tables, record, depth), prefixes.left_ends(tables, record, depth)
        for r, d, a, b in zip(record, depth, left, right):
            assert b == next((j for j in range(r + 1, n) if values[j] < d), n)
            assert a == next((j for j in range(r, -1, -1) if values[j] < d), 0)
            assert prefixes.range_minimum(tables, np.array([a]), np.array([b]))[0] == values[a:b].min()


def test_before(spark):
    rows = [(k % 3, i, (i * 7919) % 101) for i in range(60) for k in range(3)]
    frame = spark.createDataFrame(rows, "k long, i long, v long")
    for how, fold in ((F.sum, lambda a, b: a + b), (F.bit_xor, lambda a, b: a ^ b)):
        for k, i, v, total in before(frame, ["k"], F.col("i"), {"total": "v"}, how, width=7).collect():
            wanted = 0
            for a, j, w in rows:
                wanted = fold(wanted, w) if a == k and j < i else wanted
            assert total == wanted


def dense(rows, components):
    width = max((len(v) for v in rows), default=0)
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for v in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    centred = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    return deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize(("n", "width", "components"), [(700, 40, 8), (300, 6, 32), (12, 30, 32)])
def test_whitening(spark, n, width, components):
    choose = np.random.default_rng(n)
    base = choose.normal(size=(n, width)) @ np.diag(np.geomspace(9, 0.6, width))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(k, rows[3][1]) for k in range(5000, 5003)] + [(3, rows[4][1]), (None, rows[5][1]), (6000, rows[6][1][:2])]
    bad = [(7000, None), (7001, [1.0, None]), (7002, [float("nan")] * 3), (7003, [float("-inf")])]
    frame = spark.createDataFrame([(k, v, "x") for k, v in rows + bad], "vec_id long, embedding array<double>, n string")
    out = whitening.whiten(frame, components=components).toPandas()
    deviation, whitened, explained = dense([v for _, v in rows], components)
    k = whitened.shape[1]
    assert len(out) == len(rows) * k and (out["n"] == len(rows)).all() and out["identity_error"].max() < 1e-9
    got, wanted = defaultdict(list), defaultdict(list)
    for key, component, d, w, e in zip(out["vec_id"].fillna(-1), out["component"], out["deviation"], out["whitened"], out["explained"]):
        got[int(key), int(component)].append((int(d), float(w)))
        assert abs(e - explained[component - 1]) < 1e-12
    for (key, _), d, w in zip(rows, deviation, whitened):
        for component in range(k):
            wanted[-1 if key is None else key, component + 1].append((int(d), float(w[component])))
    sign = {}
    for (key, component), pairs in wanted.items():
        found = got[key, component]
        assert sorted(d for d, _ in found) == sorted(d for d, _ in pairs)
        if len(pairs) == 1 and abs(pairs[0][1]) > 0.1:
            assert sign.setdefault(component, np.sign(found[0][1] * pairs[0][1])) == np.sign(found[0][1] * pairs[0][1])
            assert abs(abs(found[0][1]) - abs(pairs[0][1])) < 1e-7


def test_whitening_of_little(spark):
    def count(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count()

    assert count([]) == 0 and count([(1, None)]) == 0 and count([(1, [])]) == 0 and count([(1, [1.0, 2.0])]) == 0
    assert count([(k, [1.0, 2.0]) for k in range(9)]) == 0 and count([(k, [float(k), 2.0]) for k in range(9)]) == 9
    # far beyond 64 bits once multiplied: whole numbers stay exact, and what does not fit is null
    large = spark.createDataFrame([(k, [float(k) * 2.0**40, 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(large).collect()
    exact = dense([[k * 2.0**40, 1.0] for k in range(5)], 2)[0]
    assert len(rows) == 5 and all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in rows)


def test_filter_uses_few_products():
    choose = np.random.default_rng(2)
    turn, _ = np.linalg.qr(choose.normal(size=(120, 120)))
    values = np.concatenate([np.geomspace(50, 2, 16), np.linspace(1.5, 0.1, 104)])
    matrix = (turn * values) @ turn.T
    found = whitening.eigenpairs(lambda q: matrix @ q, 120, 16, values.sum())
    assert np.abs(found.values - values[:16]).max() < 1e-11 and found.passes < 150
    assert np.abs(np.abs((turn[:, :16] * found.vectors).sum(0)) - 1).max() < 1e-12


def test_rule_ensemble_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rules.fit(docs, labels)
    assert 3 <= len(model.rules) <= 200 and str(model) == str(rules.fit(docs.repartition(5), labels.repartition(3)))
    out = rules.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert len(out) > 60
    good, bad = out[out["quality"] == 1], out[out["quality"] == 0]
    assert (good["predicted"] == 1).mean() >= 0.97 and (bad["predicted"] == 0).mean() >= 0.9
    # the column expressions and the rules give the same margins
    margin = model.margin(out[list(rules.STATISTICS)].to_numpy(float))
    assert np.abs(1 / (1 + np.exp(-margin)) - out["score"].to_numpy()).max() < 1e-9


def test_rule_ensemble_of_little(spark):
    def frame(rows, schema="doc_id long, text string, words string, score int"):
        return spark.createDataFrame(rows, schema)

    texts = [(1, None, "x", 1), (2, "", "x", 1), (None, "word " * 9, "x", 1), (3, "word " * 9, "x", 1), (3, "word " * 9, "x", 1), (4, "é" * 200_000, "x", 1)]
    nothing = frame([], "doc_id long, quality int, toxic int")
    model = rules.fit(frame(texts), nothing)
    rows = rules.score(frame(texts), model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert not [r for r in rows if r.held_out != (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)]
    one = frame([(3, 1, 0), (1, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert not rules.fit(frame(texts), one).rules
    assert rules.score(frame(texts).limit(0), model).count() == 0
    assert not rules.fit(frame(texts).limit(0), one).rules


def test_lasso_drops_what_does_not_help():
    choose = np.random.default_rng(4)
    held = choose.random((800, 30)) < 0.5
    y = (held[:, 3] & ~held[:, 7]).astype(float)
    _, weights = rules.lasso(held, y, 0.02)
    assert weights[3] > 0 > weights[7] and (np.abs(np.delete(weights, [3, 7])) < 0.05).all()
