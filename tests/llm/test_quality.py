import random

import numpy as np
import zstandard

from voxelweave.llm import quality

from .cases import documents, empty

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=240):
    rng = random.Random(9)
    words = ["stream", "house", "under", "green", "walking", "of", "the", "and", "never", "window", "maybe", "letter"]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) if good else rng.choice(words).upper() + "!!#" for _ in range(rng.randrange(30, 200)))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = {r.doc_id: r for r in quality.digest(docs, labels).collect()}
    assert len(rows) == 240
    out = [r for r in rows.values() if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(240) if quality.crc_fold(i) == 1}
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_held_out_labels_do_not_count(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert sorted(quality.digest(docs, labels).collect()) == sorted(quality.digest(docs, turned).collect())


def test_odd_rows(spark):
    docs = documents(spark)
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 0, 0), (5, 1, 0), (10_000, 1, 1)], LABELS)
    out = quality.digest(docs, odd)
    assert out.count() == docs.count() and out.where("score is null or predicted is null").count() == 0
    _, labels = corpus(spark)
    model = quality.train(docs, labels)
    assert quality.classify(docs, model).columns == [*docs.columns[:5], docs.columns[6], "score", "predicted"]
    assert quality.digest(empty(spark), labels).count() == 0


def test_against_plain_compression(spark):
    """Every score again by compressing the text by hand, and the weights by their gradient."""
    docs, labels = corpus(spark)
    docs = docs.unionByName(documents(spark).selectExpr("doc_id + 1000 AS doc_id", "text"))
    model = quality.train(docs, labels)
    press = [zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for d in (model.bad, model.good)]

    def plain(text):
        raw = (text or "").encode()
        a, b = (sum(len(c.compress(raw[i : i + 1024])) - 6 for i in range(0, len(raw), 1024)) for c in press)
        x = (a - b + 64 * model.mean[0]) / (len(raw) + 64), (a - b + 64 * model.mean[1]) / (max(a, b, 0) + 64)
        return x, 1 / (1 + np.exp(-(model.weights[0] + 10 * (model.weights[1] * x[0] + model.weights[2] * x[1]))))

    rows = quality.classify(docs, model).collect()
    assert max(abs(plain(r.text)[1] - r.score) for r in rows) < 1e-9
    assert {r.score for r in rows if not r.text} == {plain("")[1]}
    x = np.random.default_rng(1).normal(size=(300, 2))
    good = (x @ [1.0, -0.5] + np.random.default_rng(2).normal(size=300) > 0).astype(float)
    w = np.array(quality.calibrate(x, good, ridge=0.0))
    left = 1 / (1 + np.exp(-(w[0] + 10 * x @ w[1:]))) - good
    assert np.abs(left @ np.column_stack((np.ones(300), x))).max() < 1e-6
