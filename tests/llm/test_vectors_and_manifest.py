"""op11, op12 and op13 against brute force, over rows with nulls, ties, repeats, odd lengths and clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from trafficloom.llm import angle_mining, impact_search, merkle, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score string, rank string, v string, `a.b` string, angles string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, path string, `root.x` string, rank string, n string"
INF, NAN = float("inf"), float("nan")


def embedding_rows(n: int = 900, seed: int = 3, dims: int = 8) -> list[tuple]:
    g = np.random.default_rng(seed)
    base = g.normal(size=(n, dims)) * g.choice([0.2, 1.0, 3.0], size=(n, 1))
    base[100:180] = base[3] + g.normal(size=(80, dims)) * 1e-3  # near copies of one row
    base[200:240] = base[4]  # and copies, which tie
    base[250] = 0  # no direction
    rows = [(i, [float(x) for x in v], int(g.integers(0, 4))) for i, v in enumerate(base)]
    rows += [(1000, None, 1), (1100, [0.5, None], 1), (1200, [NAN, 1.0], 1), (1300, [1.0, -INF], 2), (None, [1.0] * dims, 1), (1400, [1.0] * dims, None)]
    rows += [(1500, [], 0), (1600, [2.0, -1.0], 1), (1700, [0.5] * (dims + 3), 2)]  # lengths of their own
    rows += [rows[10], rows[100], rows[100]]  # repeated, 100 is a query and an anchor
    return [(*r, "clash", "clash", "clash", "clash", "clash") for r in rows]


def taking_part(rows, labelled):
    kept = [(r[0], [int(np.floor(256 * float(np.float32(x)))) for x in r[1]], r[2]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in kept if label is not None] if labelled else kept


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def first(found, k=5):
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("small", [False, True])
def test_impact_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, passes and steps
        monkeypatch.setattr(impact_search, "ROWS", 50)
        monkeypatch.setattr(vectors, "PASS_BYTES", 8 * 28 * 6)
    rows = embedding_rows()
    got = collections.Counter(map(tuple, impact_search.nearest_report(spark.createDataFrame(rows, EMBEDDINGS).repartition(3)).collect()))
    kept, want = taking_part(rows, False), collections.Counter()
    for i, v in {i: v for i, v, _ in kept if i % 50 == 0}.items():
        for rank, (j, score) in enumerate(first([(j, dot(v, w)) for j, w, _ in kept if j != i])):
            want[i, rank + 1, j, score] += 1
    assert got == want and len(want) > 80


@pytest.mark.parametrize("small", [False, True])
def test_angle_mining_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(angle_mining, "ROWS", 20)
        monkeypatch.setattr(angle_mining, "ANCHORS", 3)
        monkeypatch.setattr(angle_mining, "REFERENCES", 5)
        monkeypatch.setattr(vectors, "PASS_BYTES", 8 * 28 * 4)
    rows = embedding_rows()
    got = collections.Counter(map(tuple, angle_mining.noisy_report(spark.createDataFrame(rows, EMBEDDINGS).repartition(3)).collect()))
    kept, want = taking_part(rows, True), collections.Counter()
    for i, (v, label) in {i: (v, label) for i, v, label in kept if i % 100 == 0}.items():
        for p, ps in first([(j, dot(v, w)) for j, w, other in kept if j != i and other == label]):
            between = [(j, dot(v, w)) for j, w, other in kept if j != i and other != label]
            for rank, (j, ns) in enumerate(first([x for x in between if 80 * ps <= 100 * x[1] <= 100 * ps])):
                want[i, p, rank + 1, j, ps, ns] += 1
    assert got == want and len(want) > 30


def test_bounds_hold_every_score():
    g = np.random.default_rng(1)
    for dims in (2, 5, 64):
        ints = np.floor(g.normal(size=(300, dims)) * g.choice([1, 40, 3000], size=(300, 1))).astype(np.int64)
        ints[7], ints[8] = 0, -ints[9]
        rows = vectors.Vectors(np.arange(300), ints, label=np.zeros(300, np.int64))
        references = angle_mining.directions(rows, 6)
        found = angle_mining.angles(rows, references)
        anchors = rows.take(np.arange(0, 300, 7))
        for part in np.array_split(np.argsort(found[:, 0]), 20):
            own = rows.take(part)
            window = angle_mining.Window({"n": len(part), "ids": own.ids.tobytes(), "labels": own.more["label"].tobytes(), "ints": own.ints.tobytes(), "low": found[part].min(axis=0).tobytes(), "high": found[part].max(axis=0).tobytes()})
            lower, upper = window.bounds(anchors.norms, found[::7].astype(np.float64))
            scores = anchors.dot(own)
            assert (scores.min(axis=1) >= lower).all() and (scores.max(axis=1) <= upper).all()


def test_windows_apart_are_not_scored(spark):
    g = np.random.default_rng(2)
    centres = np.eye(6)[g.integers(0, 6, 600)]
    rows = vectors.Vectors(np.arange(600), np.floor(256 * (centres + g.normal(size=(600, 6)) * 0.02)).astype(np.int64), label=np.zeros(600, np.int64))
    references = angle_mining.directions(rows)
    found = angle_mining.angles(rows, references)
    order = np.lexsort((found.min(axis=1), found.argmin(axis=1)))
    made = []
    for part in np.array_split(order, 30):
        own = rows.take(part)
        made.append({"n": len(part), "ids": own.ids.tobytes(), "labels": own.more["label"].tobytes(), "ints": own.ints.tobytes(), "low": found[part].min(axis=0).tobytes(), "high": found[part].max(axis=0).tobytes()})

    class Batch:
        def to_pylist(self):
            return made

    anchors = rows.take(np.arange(60))
    near = sum(len(some) for some, _, _ in angle_mining.scored([Batch()], anchors, found[:60].astype(np.float64), lambda part: (np.full(60, 40_000), np.inf)))
    assert 0 < near < 0.4 * 60 * 30


def test_products_that_pass_64_bits_are_an_error():
    big = vectors.Vectors(np.array([1]), np.array([[1 << 40, 3]]))
    assert vectors.Vectors(np.array([2]), np.array([[1 << 14, 5]])).dot(big)[0, 0] == (1 << 54) + 15
    with pytest.raises(OverflowError):
        big.dot(big)


def test_top_lists():
    g, lists, all_ = random.Random(4), vectors.TopLists(7, 3), collections.defaultdict(list)
    for _ in range(20):
        new = [(g.randrange(7), g.choice([-5, 0, 1, 2, 1 << 60]), g.randrange(50)) for _ in range(g.randrange(6))]
        for a, s, i in new:
            all_[a].append((i, s))
        lists.add(*(np.array([x[k] for x in new], np.int64) for k in range(3)))
    got = collections.defaultdict(list)
    for a, s, i in zip(*lists.found()):
        got[int(a)].append((int(i), int(s)))
    assert got == {a: first(x, 3) for a, x in all_.items()}


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][a : a + 16])) for a in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, place):
    made = []
    for level in levels[:-1]:
        a = place // 16 * 16
        made.append(("".join(level[a:place]), "".join(level[place + 1 : a + 16])))
        place //= 16
    return made


def merkle_by_hand(rows):
    trees, made = collections.defaultdict(list), collections.Counter()
    for r in rows:
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: tree_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = tree_of([levels[s][-1][0] for s in names])
    for at, s in enumerate(names):
        for place, (_, _, leaf, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path, node = path_of(levels[s], place) + path_of(top, at), leaf
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf_of(r, r[1].translate(LOWER))
            for left, right in path:
                node = sha(left + node + right)
            made[r[0], leaf, levels[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]] += 1
    return made


def document_rows(n=700):
    g = random.Random(8)
    rows = [(i, g.choice(["Some Text", "lower only", "", None, "ÄÖ Ü", "x" * 9]) and f"Some Text {i}", g.choice(["en", None]), "big" if i % 3 else g.choice([None, "", "ä", "Z", "a"]), i % 9 or None) for i in range(n)]
    rows += [(10_000 + i, "" if i % 2 else None, "de", f"one-{i}", 0) for i in range(270)]  # more trees than a block holds, of one leaf each
    rows += [(None, "No Id", None, "big", 1), (None, None, None, None, None), (5, "Very Long " * 200_000, "en", "big", 1), rows[0], rows[0], rows[1]]
    return [(*r, "clash", "clash", "clash", "clash") for r in rows]


def test_merkle_equals_brute_force(spark):
    rows = document_rows()
    got = collections.Counter(map(tuple, merkle.tamper_report(spark.createDataFrame(rows, DOCUMENTS).repartition(5)).collect()))
    assert got == merkle_by_hand(rows)
    assert 0 < sum(n for r, n in got.items() if not r[-1]) < sum(got.values())


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_merkle_sizes(spark, n):
    rows = [(i, "T", "en", "s", 1, "", "", "", "") for i in range(n)]
    got = collections.Counter(map(tuple, merkle.tamper_report(spark.createDataFrame(rows, DOCUMENTS)).collect()))
    assert got == merkle_by_hand(rows)


def test_ranks_of_a_hot_tree(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('t', id % 40)) as tree", "cast(id * 7919 % 5000 as int) as key")
    got = merkle.ranked(rows, "tree", ["key"]).collect()
    for tree, own in collections.Counter(r.tree for r in got).items():
        mine = sorted((r.key, r["rank"]) for r in got if r.tree == tree)
        assert [r for _, r in mine] == list(range(own)) and {r.n for r in got if r.tree == tree} == {own}


def test_empty_tables(spark):
    assert merkle.tamper_report(spark.createDataFrame([], DOCUMENTS)).collect() == []
    none = spark.createDataFrame([], EMBEDDINGS)
    assert impact_search.nearest_report(none).collect() == [] and angle_mining.noisy_report(none).collect() == []
    few = spark.createDataFrame([(100, [1.0], 1, "", "", "", "", ""), (107, None, 1, "", "", "", "", "")], EMBEDDINGS)
    assert impact_search.nearest_report(few).collect() == [] and angle_mining.noisy_report(few).collect() == []
