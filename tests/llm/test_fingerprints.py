"""Operator 6 against a plain SimHash and classes by brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from trafficloom.llm import queries, simhash

SCHEMA = "doc_id long, text string, fingerprint string, range int"
ALL = (1 << 64) - 1


def plain(text: str) -> int:
    """Votes of each word with its successor, one bit after the other."""
    words = re.split("[ \\t-\\r]+", text.lower())
    votes = [0] * 64
    for (word, after), n in collections.Counter(zip(words, [*words[1:], None])).items():
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        if after is not None:
            h = xxhash.xxh64_intdigest(after.encode(), h)
        for b in range(64):
            votes[b] += (1 if h >> b & 1 else -1) * n * (1 + min(3, len(word) // 4))
    return sum(1 << b for b in range(64) if votes[b] > 0)


def classes_of(prints: set[int], radius: int) -> dict[int, int]:
    """The smallest member that each is linked with, by looking at all pairs."""
    found = {p: p for p in prints}

    def top(p: int) -> int:
        while found[p] != p:
            p = found[p]
        return p

    for a in prints:
        for b in prints:
            if ((a ^ b) & ALL).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                found[y] = x
    return {p: top(p) for p in prints}


def test_all_columns_by_brute_force(spark):
    g = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "international", "été", "naïve", "x", "42", "日本", "re-do"]
    texts = [" ".join(g.choice(words) for _ in range(g.randrange(1, 60))) for _ in range(40)]
    long = " ".join(f"word{k % 5000}" for k in range(300_000))  # 2.6 MB
    texts += [texts[0], texts[0], *(" ".join([*[str(k) for k in range(400)], f"end{m}"]) for m in range(12)), "", None, " \n\t ", "one", " a", long, long + " more"]
    rows = [*enumerate(texts), (3, texts[3]), (3, "another text of the same id"), (None, "no id"), (None, texts[5])]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(4)
    got = simhash.edit_report(docs).collect()

    least = lambda r: (r[0] is not None, r[0] or 0, _signed(xxhash.xxh64_intdigest(r[1].encode(), 42)))
    order = sorted(((i, t or "") for i, t in rows), key=least)
    prints = {t: plain(t) for _, t in order}
    root = classes_of(set(prints.values()), 3)
    members = collections.defaultdict(list)
    for i, t in order:
        members[root[prints[t]]].append(i)
    alike = lambda a, b: 1 - ((a ^ b) & ALL).bit_count() / 64
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        other = t[: len(t) - half] + after[:half]
        own = members[root[prints[t]]]
        want[(
            i, len(t), hashlib.sha256(other.encode()).hexdigest(), f"{prints[t]:016x}", f"{plain(other):016x}", alike(prints[t], plain(other)), alike(prints[t], prints[after]),
            len(own) > 1, min((x for x in own if x is not None), default=None), len(own),
        )] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert max(r.class_size for r in got) > 2


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


@pytest.mark.parametrize("radius, crowd", [(2, 0), (3, 0), (3, 3), (3, 128)])
def test_links_connect_all_within_the_radius(spark, radius, crowd):
    """Chains, dense balls and lone fingerprints: the same classes whether keys are crowded or not."""
    g = random.Random(radius)
    prints = {g.getrandbits(64) for _ in range(30)}
    for p in list(prints)[:4]:  # dense balls
        prints |= {p ^ sum(1 << b for b in g.sample(range(64), g.randrange(1, 4))) for _ in range(40)}
    for p in list(prints)[:20]:  # chains whose ends are far apart
        for _ in range(6):
            p ^= sum(1 << b for b in g.sample(range(64), radius))
            prints.add(p)
    table = spark.createDataFrame([(k, _signed(p)) for k, p in enumerate(sorted(prints))], "doc_id long, fingerprint long")
    found = simhash.links(table.select("fingerprint"), radius, crowd=crowd).collect()
    assert all(r.a < r.b and ((r.a ^ r.b) & ALL).bit_count() <= radius for r in found)
    assert len(found) == len(set(found))
    ids = {p: k for k, p in enumerate(sorted(prints))}
    root = classes_of(prints, radius)
    members = collections.defaultdict(set)
    for p in prints:
        members[root[p]].add(ids[p])
    got = {r.fingerprint: (r.class_id, r.class_size) for r in simhash.classes(table, radius, crowd=crowd).collect()}
    assert got == {_signed(p): (min(members[root[p]]), len(members[root[p]])) for p in prints if len(members[root[p]]) > 1}


@pytest.mark.parametrize("bits", [5, 11])
def test_dense_groups_make_fewer_links_than_pairs(spark, bits):
    """All fingerprints over some bits, as few as make no crowded key or more: connected, by less than half of their pairs."""
    n, centre = 1 << bits, random.Random(2).getrandbits(64)
    links = simhash.links(spark.createDataFrame([(_signed(centre ^ k),) for k in range(n)], "fingerprint long")).collect()
    linked = simhash.components(spark.createDataFrame(links))
    assert linked.agg(F.count_distinct("node"), F.count_distinct("component")).first() == (n, 1)
    assert len(links) < n * (bits + math.comb(bits, 2) + math.comb(bits, 3)) / 4


def test_edited_texts_need_no_classes(spark, sf_dir, monkeypatch):
    """The query of the edited texts alone makes no fingerprints, and gives what the whole report gives."""
    whole = simhash.edit_report(queries.read_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256").collect()
    monkeypatch.setattr(simhash, "fingerprints", None)
    monkeypatch.setattr(simhash, "classes", None)
    assert sorted(queries.edited_texts(spark, sf_dir).collect()) == sorted(whole)
