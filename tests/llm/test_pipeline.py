"""The pipeline against a plain version of its stages."""

import corpus_pipeline
from fleetlens.llm import catalog
from tests.llm import brute
from tests.llm.test_results import check_packing


def test_stages_are_named_functions():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r["doc_id"], r["text"] or "") for r in table.collect()]
    chain = catalog.toxicity_chain(table, spark.read.parquet(f"{sf}/labels.parquet"))
    p = chain.probabilities([t for _, t in docs])[:, 1]
    clean = [d for d, x in zip(docs, p) if round(x, 6) < 0.5]
    assert 0 < len(docs) - len(clean) < 0.25 * len(docs)
    first = {}
    for i, t in sorted(clean):
        first.setdefault(brute.SPACES.sub(" ", t), i)
    distinct = [d for d in clean if d[0] in set(first.values())]
    names = brute.components(distinct)
    left = [d for d in distinct if names[d[0]][1] == d[0]]
    used, least = check_packing(corpus_pipeline.run(spark, sf).collect(), left)
    assert used <= least + 2


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
