"""The net of operator 3 is fitted on whole texts."""

import numpy as np

from trafficloom.llm import quality_cnn


def test_trains_on_whole_texts(spark, monkeypatch):
    texts = {i: "".join(f"{i}:{j} " for j in range(5 + 900 * i)) for i in range(4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(quality_cnn.ByteConvNet, "train", lambda self, docs, labels: got.extend(docs))
    quality_cnn.learn(docs, labels)
    assert [bytes(d) for d in got] == [t.encode() for t in texts.values()]


def test_pooling_in_parts_is_the_same():
    net, chunks = quality_cnn.ByteConvNet(), quality_cnn.chunks_of(np.random.default_rng(3).bytes(10_000))
    for a, b in zip(net.pooled(chunks, True), net.pooled_parts(chunks, 7)):
        assert np.allclose(a, b, atol=1e-5)
