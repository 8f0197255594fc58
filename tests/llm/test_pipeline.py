import corpus_pipeline
from lexiloom.llm import minhash, packing, pii, suffix, toxicity
from lexiloom.llm.common import DOC_COLUMNS
from test_minhash import brute, family


def test_stages(spark, sf_dir):
    """Every stage against its operator's own brute force is in the tests beside this one; here, what goes and what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    grammar = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf_dir)
        assert now.columns == DOC_COLUMNS
        a, b = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "toxicity":
            assert set(b) == {i for i, t in a.items() if grammar.score(grammar.read(t)) < toxicity.REJECT}
        elif name == "near duplicates":
            assert set(b) == {r["doc_id"] for r in minhash.near_duplicates(before, corpus_pipeline.ALIKE).collect() if r["kept"]} and all(a[i] == t for i, t in b.items())
        elif name == "repeated strings":
            assert set(b) == set(a)
            assert {r["doc_id"]: r["kept_text"] for r in suffix.repeated_strings(before, corpus_pipeline.PASSAGE).collect()} == b
        else:
            assert set(b) == set(a) and pii.replace_personal_data(now.limit(0)).collect() == []
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} <= set(rows)
    assert packed.where("piece = 0").count() == now.count()
    assert packed.groupBy("shard", "bin").sum("n_tokens").where(f"`sum(n_tokens)` > {packing.CAPACITY}").count() == 0


def test_run_and_odd_tables(spark, sf_dir, documents, odd_texts):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    for texts in ([], odd_texts):
        now = documents(texts)
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
        assert now.count() >= (10 if texts else 0)


def test_near_duplicates_by_brute_force(spark, sf_dir, documents, prose):
    """The stage against all pairs at 0.8; the first two texts are 0.811 alike (86 of 106 shingles)."""
    base = prose(1, 100).split(" ")
    texts = [" ".join(base), " ".join(base[:30] + ["editx"] + base[31:70] + ["edity"] + base[71:]), *family(prose, 40, 6), *(prose(100 + i, 60) for i in range(20))]
    rows = list(enumerate(texts))
    want, tighter = ({i for i, (_, c) in brute(rows, p).items() if i == c} for p in (80, 85))
    assert want != tighter
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(texts), sf_dir).collect()} == want
