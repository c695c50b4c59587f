"""The pipeline's stages, each beside what its operator decides on the same rows."""

import pytest

import corpus_pipeline
from barlens.llm import bpe, exact_dedup, minhash, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "bpe"]


def test_each_stage_takes_effect(spark, tmp_path):
    if not (tmp_path and __import__("os").path.isdir(SF)):
        pytest.skip("test tables are not here")
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name == "toxicity":
            want = ids(toxicity.score_documents(docs, labels).where("predicted = 0"))
        elif name == "exact_dedup":
            want = ids(exact_dedup.exact_groups(docs).where("kept"))
        elif name == "minhash_near_dedup":
            want = ids(minhash.near_groups(docs).where("kept"))
        elif name == "mixing":
            want = ids(mixing.sample_documents(docs).where("sampled"))
        else:
            want = ids(bpe.encode_decode(docs))
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        got = spark.read.parquet(path)
        assert ids(got) == want
        if k < 4:
            assert got.columns == docs.columns
            docs = got
    assert ids(corpus_pipeline.run(spark, SF)) == want
