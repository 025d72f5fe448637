"""Toxicity by a chain of linear classifiers.

The categories stand in a fixed order. Each has a logistic model over the presence of
words; its input also holds the probabilities of the earlier categories. In training
those come from models that have not seen the row (out-of-fold), so that a later model
learns how far an earlier one can be trusted on new texts.

The models are fitted on the driver on a bounded sample of the labelled rows; scoring
is a narrow pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeforge.llm.hashing import Texts, sliced

#: Texts are taken by so many bytes at a time.
SLICE_BYTES = 1 << 19
#: ASCII characters that are neither letters nor digits part words.
_TOKEN = np.arange(256, dtype=np.uint8)
_TOKEN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of each distinct lower-cased word of each text, words as 64-bit fingerprints."""
    texts = Texts(column, lower=True)
    texts.data = _TOKEN[texts.data]
    words = texts.words()
    key, row = words.hashes(), words.text_of_word()
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, bool)
    return row[fresh], key[fresh]


@dataclass
class Linear:
    """A logistic model: known words, their weights, weights of earlier probabilities, bias."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def probability(self, row: np.ndarray, key: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = np.full(len(earlier), self.bias) + earlier @ self.chain
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
            hit = self.words[at] == key
            z += np.bincount(row[hit], self.weight[at[hit]], len(earlier))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(row: np.ndarray, key: np.ndarray, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, n_words: int, rounds: int = 200, ridge: float = 1e-3) -> Linear:
    """On the rows `use`, over the `n_words` words that tell the classes apart best (at least 3 rows hold each)."""
    n = int(use.sum())
    positive = int(y[use].sum())
    if n == 0 or positive in (0, n):
        rate = (positive + 0.5) / (n + 1.0)
        return Linear(chain=np.zeros(earlier.shape[1]), bias=float(np.log(rate / (1 - rate))))
    inside = use[row]
    words, of, count = np.unique(key[inside], return_inverse=True, return_counts=True)
    hot = np.bincount(of, y[row[inside]], len(words))
    p1, p0, p = hot / positive, (count - hot) / (n - positive), count / n
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / positive + 1 / (n - positive)) + 1e-12)
    z[count < 3] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:n_words])
    best = best[z[best] > 0]
    place = np.full(len(words), -1)
    place[best] = np.arange(len(best))
    at = place[of]
    dense = np.cumsum(use) - 1
    r, c = dense[row[inside]][at >= 0], at[at >= 0]
    x, t = earlier[use], y[use].astype(float)
    k = len(best)
    w = np.zeros(k + x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(positive / (n - positive))
    for i in range(1, rounds + 1):  # Adam on the whole sample
        score = np.bincount(r, w[:k][c], n) + x @ w[k:-1] + w[-1]
        err = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - t) / n
        g = np.concatenate([np.bincount(c, err[r], k), err @ x, [err.sum()]])
        g[:-1] += ridge * w[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Linear(words[best], w[:k], w[k:-1], float(w[-1]))


def fit_chain(row: np.ndarray, key: np.ndarray, labels: np.ndarray, n_words: int, folds: int) -> list[Linear]:
    """One model a category, in order; `labels` has a column for each."""
    n, kinds = labels.shape
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    chain = []
    for j in range(kinds):
        chain.append(fit(row, key, earlier, labels[:, j], np.ones(n, bool), n_words))
        if j + 1 < kinds:
            unseen = np.zeros(n)
            for f in range(folds):
                unseen[fold == f] = fit(row, key, earlier, labels[:, j], fold != f, n_words).probability(row, key, earlier)[fold == f]
            earlier = np.column_stack([earlier, unseen])
    return chain


def classify(
    df: DataFrame,
    labels: DataFrame,
    categories: list[tuple[str, int]],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    max_train_rows: int = 8000,
    n_words: int = 2000,
    folds: int = 3,
    threshold: float = 0.5,
    suffix: str = "",
) -> DataFrame:
    """Adds each category's probability to the texts, and `rejected`: the last category's is at least `threshold`.

    `categories`: in order of the chain, each a column of `labels` and the value that means "yes". Labelled rows
    with a null id or label don't count; of several rows with one id the greatest values do. The sample: the
    `max_train_rows` labelled ids with the least hash, so it is the same whatever the partitions. With no usable
    labels, or one class, a category's probability is its smoothed rate. Returns id_col, the columns `keep`,
    p_<category> and rejected, each name with `suffix`, which tells them from columns of `keep`; one row per input
    row, repeated and null ids too; null and empty texts have no words. Texts are scored by half a MB at a time, a very
    long one alone. Other columns don't take part, whatever their names; an empty table gives no rows.
    """
    keep = [id_col, *[c for c in keep or [] if c != id_col]]
    names = [c for c, _ in categories]
    made = [*(f"p_{c}{suffix}" for c in names), f"rejected{suffix}"]
    if clash := {*made} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} of keep are made here: give a suffix")
    sample = labels.where(" and ".join(f"`{c}` is not null" for c in [id_col, *names])).groupBy(F.col(id_col).alias("id")).agg(*(F.max(F.col(c)).alias(f"y{i}") for i, c in enumerate(names)))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(max_train_rows)
    # At most max_train_rows rows of a few numbers: always small enough to send.
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", SLICE_BYTES):
                row, key = features(batch.column("text"))
                at = np.searchsorted(row, np.arange(batch.num_rows + 1))
                raw = key.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(batch.column(f"y{i}") for i in range(len(names))), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())],
                    names=["id", *(f"y{i}" for i in range(len(names))), "words"],
                )

    fields = [T.StructField("id", df.schema[id_col].dataType), *(sample.schema[f"y{i}"] for i in range(len(names))), T.StructField("words", T.BinaryType())]
    # One text an id, so that repeated ids don't lift the bound.
    texts = known.mapInArrow(words_of, T.StructType(fields)).groupBy("id").agg(*(F.first(f"y{i}").alias(f"y{i}") for i in range(len(names))), F.min("words").alias("words"))
    found = sorted(texts.toLocalIterator(), key=lambda r: r["id"])
    y = np.array([[r[f"y{i}"] == yes for i, (_, yes) in enumerate(categories)] for r in found], float).reshape(len(found), len(names))
    keys = [np.frombuffer(r["words"], np.uint64) for r in found]
    row = np.repeat(np.arange(len(found)), [len(k) for k in keys]) if found else np.zeros(0, np.int64)
    chain = fit_chain(row, np.concatenate(keys) if found else np.zeros(0, np.uint64), y, n_words, folds)
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in made[:-1]), T.StructField(made[-1], T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, whole.num_columns - 1, SLICE_BYTES):
                r, k = features(batch.column(batch.num_columns - 1))
                p = np.zeros((batch.num_rows, 0))
                for model in chain:
                    p = np.column_stack([p, model.probability(r, k, p)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keep))), *(pa.array(p[:, j]) for j in range(len(names))), pa.array(p[:, -1] >= threshold)],
                    names=schema.names,
                )

    text = "__text"
    while text in keep:
        text += "_"
    return df.select(*keep, df[text_col].alias(text)).mapInArrow(score, schema)
