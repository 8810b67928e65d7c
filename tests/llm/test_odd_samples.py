"""Models learnt from nothing, and samples of labelled rows with repeated ids."""

import zlib
from math import isfinite, log10

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import pitman_yor, toxicity


def test_without_training_rows_every_token_is_unknown(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    texts = ["a river runs", "", None, "a river runs by a river"]
    rows = pitman_yor.score_documents(spark.createDataFrame(list(zip(held, texts)), "doc_id long, text string")).collect()
    assert len(rows) == 4 and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    for r in rows:
        assert isfinite(r["score"]) and r["score"] < 0
        # one place for unknown words: log10((0 + 0.5) / (0 + 0.5 * (0 + 1)))
        assert r["base_score"] == pytest.approx(r["n_tokens"] * log10(0.5 / 0.5))
    by_tokens = {r["n_tokens"]: r["score"] for r in rows}
    assert by_tokens[4] == pytest.approx(4 * by_tokens[1]) and by_tokens[7] == pytest.approx(7 * by_tokens[1])


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.range(500).select((F.col("id") % 5).alias("doc_id"), F.concat(F.lit("text "), F.lpad("id", 4, "0")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3, "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, {"toxic": F.col("toxic")}, 2, "doc_id", "text").collect()
    assert len(sample) == 2
    again = toxicity.labelled_sample(docs.repartition(7), labels, {"toxic": F.col("toxic")}, 2, "doc_id", "text").collect()
    assert sorted(sample) == sorted(again) and all(r["text"] in {f"text {i:04d}" for i in range(5)} for r in sample)
