"""The pipeline's stages: what each keeps, and that decisions take effect."""

import corpus_pipeline as p
from metaloom.llm import common, decontaminate, pii, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents").cache()
    model = toxicity.train(docs, common.table(spark, SF, "labels"))
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) == out.count()
        if name == "toxicity":
            assert before - after == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
        elif name == "simhash":
            groups = simhash.near_duplicates(docs).collect()
            assert after == {r.component_id for r in groups}
        elif name == "decontaminate":
            assert before - after == {r.doc_id for r in decontaminate.contaminated(docs, common.table(spark, SF, "benchmark")).collect()}
        elif name == "pii":
            assert after == before and pii.scan(out).where("base <> ''").count() == 0
            assert out.where("n_chars <> length(text)").count() == 0
        else:
            assert after == before
        docs = out


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash", "decontaminate", "pii", "bpe"]
    out = p.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
