"""The filter of operator 10 keeps its bits at every size, and its shards don't hold documents."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficloom.llm import bloom_lm

SCHEMA = "doc_id long, text string"


def test_slices_keep_bits_and_hashes():
    for n in (1_000, 300_000):
        keys, counts = bloom_lm.mix(np.arange(n).astype(np.uint64)), 1 + np.arange(n) % 9
        made = bloom_lm.FilterSlice(keys, counts, 4)
        assert made.hashes == 4 and len(made.data) * 8 >= 5.8 * bloom_lm.levels(counts).sum()
        assert (made.levels(keys) >= bloom_lm.levels(counts)).all()
        with pytest.raises(ValueError):  # never a thinner slice
            bloom_lm.FilterSlice(keys, counts, 4, 1 << 10)


def test_answers_do_not_depend_on_the_shard():
    g = np.random.default_rng(3)
    keys, counts = np.unique(bloom_lm.mix(np.arange(50_000).astype(np.uint64))), g.integers(1, 30, 50_000)
    asked = np.concatenate([keys, bloom_lm.mix(np.arange(50_000, 100_000).astype(np.uint64))])
    found = []
    for shards in (1, 16, 64):
        of, level = bloom_lm._shard_of(keys, shards), np.zeros(len(asked), np.int64)
        for k in range(shards):
            mine = bloom_lm._shard_of(asked, shards) == k
            level[mine] = bloom_lm.FilterSlice(keys[of == k], counts[of == k], 6).levels(asked[mine])
        found.append(level)
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()
    assert 0.001 < (found[0][50_000:] > 0).mean() < 0.06  # 2 ** -6, and cuts of few entries


def exact(monkeypatch):
    """Levels as they are counted, without the filter."""
    class Known:
        def __init__(self, keys, counts, hashes):
            self.known = dict(zip(keys.tolist(), bloom_lm.levels(counts).tolist()))

        def levels(self, keys):
            return np.array([self.known.get(k, 0) for k in keys.tolist()], np.int64)

    monkeypatch.setattr(bloom_lm, "FilterSlice", Known)


def test_shards_and_files_change_no_score(spark, sf_dir, monkeypatch):
    """Equal scores for 16 and 64 shards and other files; the filter's mistakes move a score by less than 0.01 a token."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = F.col("doc_id") % 5 != 1
    few, many = ({r.doc_id: r for r in bloom_lm.score(d, train, shards=n).collect()} for d, n in ((docs, 16), (docs.repartition(7), 64)))
    assert few == many or all(abs(few[i].score - many[i].score) < 1e-6 * abs(few[i].score) for i in few)
    exact(monkeypatch)
    true = {r.doc_id: r for r in bloom_lm.score(docs, train).collect()}
    off = [abs(few[i].score - true[i].score) / few[i].n_tokens for i in few]
    assert np.mean(off) < 0.01 and max(off) < 0.1


def test_scores_equal_the_model(spark):
    """Every row's scores against counts by brute force, with chunks of few texts and several shards' answers."""
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(1 + i % 13)) for i in range(60)] + ["", None, "w1 w1"]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "w2")], SCHEMA).repartition(5)
    got = bloom_lm.score(docs, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))).collect()
    rows = [*enumerate(texts), (3, texts[3]), (None, "w2")]
    words, pairs = collections.Counter(), collections.Counter()
    for i, t in rows:
        if i is None or i % 3:
            own = [*(t or "").split(), None]
            words.update(own)
            pairs.update(zip([None, *own], own))
    n, v = sum(words.values()), len(words)
    at = lambda c: float(bloom_lm.level_count(bloom_lm.levels(np.array([c])))[0]) if c else 0.0
    p = lambda a, b: math.log10((min(at(pairs[a, b]), at(words[a]), at(words[b])) + 2000 * min(1, (at(words[b]) + 0.5) / (n + 0.5 * (v + 1)))) / (at(words[a]) + 2000))
    want = {i: sum(p(a, b) for a, b in zip([None, *(t or "").split()], [*(t or "").split(), None])) for i, t in rows}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(abs(r.score - want[r.doc_id]) < 1e-2 for r in got)  # false hits may move a score slightly
    assert np.median([abs(r.score - want[r.doc_id]) for r in got]) < 1e-9


def test_word_shards_hold_no_documents(spark):
    """A word in every document is one entry of a chunk, whatever the number of documents."""
    def sent(n: int) -> list[tuple]:
        docs = spark.createDataFrame([(i, "the same words") for i in range(n)], SCHEMA).coalesce(1)
        chunks = bloom_lm._chunks(docs, F.lit(True))
        return sorted((r.shard, len(r.keys)) for r in bloom_lm._entries(chunks, 1, 1).collect())

    assert sent(3) == sent(3_000) == [(0, 8 * 4), (1, 8 * 4)]  # three words and the end token; four pairs
