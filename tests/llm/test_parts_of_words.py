"""The language model keeps no row per token, and words with parts of their own are scored as others."""

import numpy as np
import pytest

from fleetlens.llm import pitman_yor


def test_no_stored_table_has_a_row_per_token(spark, sf, monkeypatch):
    rows = {}

    def counted(df, name, stored=pitman_yor.stored):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(pitman_yor, "stored", counted)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    tokens = sum(r["n_tokens"] for r in pitman_yor.score_documents(docs).collect())
    assert rows and max(rows.values()) < tokens / 2


def test_hot_words_are_scored_as_others(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("the" if i % 3 == 0 else f"w{rng.integers(1 + rng.integers(1, 300))}" for i in range(90)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r for r in pitman_yor.score_documents(docs).collect()}
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 800)
    lexicons = []
    build = pitman_yor.Lexicon.__init__
    monkeypatch.setattr(pitman_yor.Lexicon, "__init__", lambda self, counts: (build(self, counts), lexicons.append(self))[0])
    parted = {r["doc_id"]: r for r in pitman_yor.score_documents(docs).collect()}
    assert lexicons[0].parts > lexicons[0].shared > 1
    assert whole.keys() == parted.keys()
    for i, r in whole.items():
        assert (r["n_tokens"], r["n_known"]) == (parted[i]["n_tokens"], parted[i]["n_known"])
        assert r["base_score"] == pytest.approx(parted[i]["base_score"], rel=1e-12)
    change = [(parted[i]["score"] - r["score"]) / r["n_tokens"] for i, r in whole.items()]
    assert abs(np.mean(change)) < 0.02
