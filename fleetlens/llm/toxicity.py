"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic models over counts of words and
word beginnings (1 + log of the count); each model also gets the log-odds of the categories before it. In training
these come from models of the other folds, so that a later model learns how far an earlier
prediction on unseen text can be trusted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import giving_back, text_slices
from fleetlens.llm.common import private, stored, text_or_empty

SAMPLE_ROWS = 20_000    # the models are fitted on at most so many labelled rows
FEATURES = 512          # features per category, those that tell its labels apart best
MIN_DIFFERENCE = 4.5    # in standard errors; less is chance among so many words
MIN_DOCUMENTS = 3       # a feature must occur in so many labelled rows
FOLDS = 5
PENALTY = 0.2
THRESHOLD = 0.5
BEGINNINGS = (3, 4, 5)
CACHED = 200_000        # words whose features a worker remembers
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> Counter[str]:
    """Counts of a text's words in lower case, and of their beginnings (marked by a hyphen)."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for w, count in words.items():
        for n in BEGINNINGS:
            if len(w) > n:
                out[w[:n] + "-"] += count
    return out


@dataclass
class Linear:
    """A logistic model over its own features (columns of the vocabulary), then the categories
    before it."""

    columns: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.hstack([x[:, self.columns], earlier]) @ self.weights + self.bias


ROWS_AT_ONCE = 2048


def fit_linear(x: np.ndarray, y: np.ndarray, use: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Penalised logistic regression on the rows marked in ``use``, by damped Newton steps;
    without both classes a constant. The last column of ``x`` is the constant 1."""
    n, positive = int(use.sum()), float(y[use].sum())
    rate = (positive + 0.5) / (n + 1.0)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < positive < n:
        return w[:-1], float(w[-1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = (x @ v.astype(x.dtype)).astype(float)
        return float((np.logaddexp(0, z) - z * y)[use].sum() + 0.5 * (ridge * v * v).sum())

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30).astype(float)))
        gradient = x.T @ np.where(use, p - y, 0).astype(x.dtype) + ridge * w
        curve = np.where(use, p * (1 - p) + 1e-9, 0).astype(x.dtype)
        second = np.diag(ridge)
        for at in range(0, len(x), ROWS_AT_ONCE):
            part = x[at:at + ROWS_AT_ONCE]
            second += (part * curve[at:at + ROWS_AT_ONCE, None]).T @ part
        step = np.linalg.solve(second, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-6 * max(1.0, abs(before)):
            break
    return w[:-1], float(w[-1])


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    models: list[Linear] = field(default_factory=list)
    seen: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def values(self, text: str) -> tuple[list[int], list[float]]:
        """The vocabulary's features that a text has, and their values."""
        counts: dict[int, int] = {}
        for word, count in Counter(WORD.findall(text.lower())).items():
            for i in self.places(word):
                counts[i] = counts.get(i, 0) + count
        return list(counts), [1 + math.log(c) for c in counts.values()]

    def places(self, word: str) -> list[int]:
        known = self.seen.get(word)
        if known is None:
            names = [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]
            known = [self.vocabulary[x] for x in names if x in self.vocabulary]
            if len(self.seen) > CACHED:
                self.seen.clear()
            self.seen[word] = known
        return known

    def matrix(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)))
        for row, text in zip(x, texts):
            at, values = self.values(text)
            row[at] = values
        return x

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for model in self.models:
            out = np.hstack([out, model.log_odds(x, out)[:, None]])
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.matrix(texts)), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int,
                    id_col: str, text_col: str) -> DataFrame:
    """fold, text and one 0/1 column per category of at most ``rows`` labelled documents, in the
    order of a hash of their ids. A row with null in a category does not count for it. Of several
    rows with one id the smallest text is taken, so there are never more rows than ids."""
    marks = labels.select(F.col(id_col).alias("_id"), *[c.cast("int").alias(k) for k, c in categories.items()])
    marks = marks.filter("_id is not null").groupBy("_id").agg(*[F.max(k).alias(k) for k in categories])
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(rows)      # few: may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "_id").groupBy("_id", *categories).agg(F.min("text").alias("text"))
    return stored(joined.select((F.abs(F.hash("_id")) % FOLDS).alias("fold"), "text", *categories), "toxicity-sample")


@giving_back
def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text"):
        found = [sorted(features_of(t)) for t in part.column("text").to_pylist()]
        sizes = np.array([len(f) for f in found], np.int64)
        row = pa.array(np.repeat(np.arange(len(found)), sizes))
        marks = [part.column(i).take(row) for i, n in enumerate(part.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for f in found for x in f], pa.string()), *marks],
            names=["feature", *[n for n in part.schema.names if n != "text"]])


def choose_features(sample: DataFrame, categories: list[str], most: int) -> dict[str, list[str]]:
    """For each category the ``most`` features with the largest difference between the shares
    of its documents and the others that have them, in standard errors."""
    rows = sample.select("text", *categories).mapInArrow(
        _feature_rows, "feature string, " + ", ".join(f"{c} int" for c in categories))
    totals = sample.agg(*[F.count(c).alias(f"n_{c}") for c in categories],
                        *[F.sum(c).alias(f"y_{c}") for c in categories]).head()
    counts = rows.groupBy("feature").agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in categories],
                                         *[F.sum(c).alias(f"y_{c}") for c in categories])
    counts = stored(counts.filter(F.col("rows") >= MIN_DOCUMENTS), "toxicity-features")
    chosen: dict[str, list[str]] = {c: [] for c in categories}
    for c in categories:
        n, y = totals[f"n_{c}"] or 0, totals[f"y_{c}"] or 0
        if not 0 < y < n:
            continue
        share = F.col(f"n_{c}") / n
        z = F.abs(F.col(f"y_{c}") / y - (F.col(f"n_{c}") - F.col(f"y_{c}")) / (n - y)) / F.sqrt(
            share * (1 - share) * (1 / y + 1 / (n - y)) + F.lit(1e-12))
        top = counts.filter(z >= MIN_DIFFERENCE).orderBy(F.desc(F.round(z, 6)), "feature").limit(most)
        top = top.select("feature").collect()
        chosen[c] = [r["feature"] for r in top]
    return chosen


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = SAMPLE_ROWS,
              features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain over ``categories`` (name -> 0/1 column of ``labels``), in their order.

    What the driver gets is bounded: ``features`` names per category, and for each of at most
    ``sample_rows`` documents the list of those it has. A category without both kinds of labels
    gets a constant model, a chain without labelled rows predicts a half everywhere.
    """
    names = list(categories)
    sample = labelled_sample(docs, labels, categories, sample_rows, id_col, text_col)
    chosen = choose_features(sample, names, features)
    chain = Chain(names, {f: i for i, f in enumerate(sorted(set().union(*chosen.values())))})

    @giving_back
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            have, values = zip(*(chain.values(t) for t in part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(have, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())),
                 *[part.column(c) for c in ("fold", *names)]], names=["have", "values", "fold", *names])

    rows = sample.mapInArrow(
        present, "have array<int>, values array<double>, fold int, " + ", ".join(f"{c} int" for c in names)).toArrow()
    n = len(rows)
    have, values = rows.column("have").combine_chunks(), rows.column("values").combine_chunks()
    row = np.repeat(np.arange(n), have.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) if n else np.empty(0, int)
    at, held = have.flatten().to_numpy(), values.flatten().to_numpy()
    fold = rows.column("fold").to_numpy()
    odds = np.zeros((n, 0), np.float32)
    for name in names:
        columns = np.array([chain.vocabulary[f] for f in chosen[name]], np.int64)
        marks = rows.column(name)
        known = ~marks.is_null().to_numpy()
        y = marks.fill_null(0).to_numpy().astype(float)
        # the category's features, the odds of the categories before, and a constant
        full = np.ones((n, len(columns) + odds.shape[1] + 1), np.float32)
        full[:, :len(columns)], full[:, len(columns):-1] = 0, odds
        place = np.full(len(chain.vocabulary), -1)
        place[columns] = np.arange(len(columns))
        mine = place[at] >= 0
        full[row[mine], place[at[mine]]] = held[mine]
        unseen = np.zeros(n, np.float32)
        for f in range(FOLDS):
            test = fold == f
            w, b = fit_linear(full, y, known & ~test)
            unseen[test] = full[test, :-1] @ w + b
        w, b = fit_linear(full, y, known)
        chain.models.append(Linear(columns, w, b))
        odds = np.hstack([odds, np.clip(unseen, -30, 30)[:, None]])
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the probability of each category (rounded to 6 places) of every row of ``docs``.
    Null and empty texts get what the models say of a text without features; null ids stay
    null; repeated rows give equal rows; the whole text counts, whatever its length."""
    names = chain.categories

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            p = np.round(chain.probabilities(part.column("text").to_pylist()), 6)
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c) for c in p.T]],
                                             names=["id", *[f"p_{c}" for c in names]])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    schema = "id long, " + ", ".join(f"p_{c} double" for c in names)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD,
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose probability is below ``threshold``."""
    at, names, scored = chain.categories.index(category), docs.columns, private(docs, "_scored")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, scored):
            p = np.round(chain.probabilities(part.column(scored).to_pylist())[:, at], 6)
            yield part.select(names).filter(pa.array(p < threshold))

    return docs.withColumn(scored, text_or_empty(text_col)).mapInArrow(run, docs.schema)
