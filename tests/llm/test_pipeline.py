import pytest

from . import cases, test_quality
from .test_similar import plain_kept
from .test_tokens import library_ids

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    docs, labels = test_quality.corpus(spark)
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "CASE WHEN doc_id % 5 = 0 THEN 'b' ELSE 'a' END AS source", "length(text) AS n_chars")
    extra = cases.documents(spark).where("doc_id is not null").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(extra).write.parquet(str(out / "documents.parquet"))
    labels.write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "line_stage", "near_duplicate_stage", "mixing_stage", "token_stage"]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], folder)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{folder}/stage{k}")
        tables.append(spark.read.parquet(f"{folder}/stage{k}"))
    _, kept, lines, unique, mixed, coded = tables
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    good = [i for i in range(240) if i % 3]
    assert len(set(good) - set(ids(kept))) <= 0.03 * len(good) and sum(i % 3 == 0 for i in ids(kept) if i < 240) <= 4
    assert sorted(ids(lines)) == sorted(ids(kept)) and lines.where("n_chars <> length(text)").count() == 0
    rows = lines.collect()
    want = plain_kept([(r.doc_id, r.text) for r in rows])
    assert want <= set(ids(unique)) and len(set(ids(unique)) - want) <= 0.05 * (len(rows) - len(want))
    assert set(ids(mixed)) == set(ids(unique)) and mixed.count() >= unique.count()
    assert coded.count() == mixed.count() and coded.where("NOT round_trip").count() == 0
    texts = {r.doc_id: r.text for r in unique.collect()}
    assert all(r.ids == library_ids(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in coded.collect())


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
