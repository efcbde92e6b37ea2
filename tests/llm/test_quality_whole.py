from voxelweave.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def test_every_training_text_is_in_a_dictionary(spark):
    n = 900
    docs = spark.createDataFrame([(i, "".join(f"<{i}>" for _ in range(400))) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], LABELS)
    model = quality.train(docs, labels)
    half = [i for i in range(n) if quality.crc_fold(i) != 1]
    found = {q: {i for i in half if f"<{i}>".encode() in content} for q, content in ((0, model.bad), (1, model.good))}
    assert all(i % 2 == q for q, ids in found.items() for i in ids)
    taken = found[0] | found[1]
    assert 0.4 * len(half) < len(taken) < 0.6 * len(half)
    # High ids as often as low ones, and no more bytes than a dictionary has.
    assert abs(sum(i >= n // 2 for i in taken) - len(taken) / 2) < 0.1 * len(taken)
    assert max(len(model.bad), len(model.good)) <= quality.DICT_BYTES


def test_middle_of_the_whole_text(spark):
    text = "a" * 60_000 + "MIDDLE" + "b" * 60_000
    docs = spark.createDataFrame([(i, text + str(i)) for i in range(60)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS))
    assert b"MIDDLE" in model.bad and b"MIDDLE" in model.good


def test_even_share():
    assert quality.even_share([5, 5, 100, 100], 60) == 25
    assert quality.even_share([3, 4], 100) >= 4 and quality.even_share([], 9) == 0
    pieces = [bytes([65 + k % 26]) * 1500 for k in range(2000)]
    assert len(quality.dictionary(pieces).split(b"\n")) == 2000


def test_few_texts_fill_a_dictionary(spark):
    """No text is cut before its share: two texts of a label give all they have up to the dictionary's size."""
    texts = spark.createDataFrame([(k, k % 2, k, " ".join(f"{k}w{i}" for i in range(9000))) for k in range(4)], "__id long, q int, h long, text string")
    bad, good = quality.dictionaries(texts, 50_000)
    assert all(49_000 <= len(d) <= 50_000 for d in (bad, good))
    assert all(f"{k}w4500 ".encode() in d for d, ids in ((bad, (0, 2)), (good, (1, 3))) for k in ids)
    whole = quality.dictionaries(texts, 1 << 20)
    assert whole[0] == b"\n".join(" ".join(f"{k}w{i}" for i in range(9000)).encode() for k in (0, 2))
    assert quality.dictionaries(texts.limit(0), 100) == (b"", b"") and quality.dictionaries(texts, 1) == (b"", b"")


def test_shared_lines(spark):
    rows = [(1, 0, 30, "notice\nbad one\nboth"), (2, 0, 10, "notice\nbad two\nbad two"), (3, 0, 20, "notice"), (4, 1, 5, "good one\nboth\n"), (5, 1, 6, "")]
    kept = {r["__id"]: r["text"] for r in quality.telling_lines(spark.createDataFrame(rows, "__id long, q int, h long, text string")).collect()}
    assert kept == {1: "bad one", 2: "notice\nbad two", 4: "good one\n"}
