"""Quality classifier: supervised subword embeddings.

A text's features are its words, their character n-grams, and one for each pair of neighbouring words that are the same
(the only word pairs that mean the same in every language), hashed into ``buckets`` rows of a matrix of learned vectors. The text's vector is the mean of its features' vectors; a softmax over the two classes follows. Vectors and
output weights are trained by stochastic gradient descent in numpy, over a bounded sample of the labelled rows.

The output is linear in the mean, so for scoring each feature's vector shrinks to one number (its share of the
difference of the two classes' logits), and a word's features to their sum: scoring is a narrow pass over the texts.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import filter_rows, map_batches, narrow, words_of

#: Rows of labelled text that training looks at, at most (those with the smallest hashes of id and text); the bound on
#: the memory of the one task that trains.
TRAIN_ROWS = 4_000
BUCKETS = 1 << 16
DIM = 8
EPOCHS = 6
RATE = 0.4
SHORTEST, LONGEST = 3, 4
#: A repeated word counts as often as a word has n-grams, or they would drown it.
REPEAT_TIMES = 8
SEED = 7


def features(word: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the word and of each of its character n-grams, ends marked."""
    digest = xxhash.xxh3_64_intdigest
    marked = f"<{word}>"
    out = [digest("w" + word)]
    for n in range(SHORTEST, LONGEST + 1):
        out += [digest(marked[i:i + n]) for i in range(len(marked) - n + 1)]
    return (np.array(out, np.uint64) % np.uint64(buckets)).astype(np.int32)


def repeats(words: list[str]) -> int:
    """How many words are the same as the one before."""
    return sum(map(eq, words, words[1:]))


def repeat_bucket(buckets: int) -> int:
    return xxhash.xxh3_64_intdigest("=") % buckets


class Bags:
    """Words -> features, remembered."""

    def __init__(self, buckets: int):
        self.buckets, self.memo = buckets, {}

    def of(self, text: str) -> np.ndarray:
        found, words = [], words_of(text)
        for w in words:
            f = self.memo.get(w)
            if f is None:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                f = self.memo[w] = features(w, self.buckets)
            found.append(f)
        found.append(np.full(repeats(words) * REPEAT_TIMES, repeat_bucket(self.buckets), np.int32))
        return np.concatenate(found)


def train(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Weights of all features and, last, the bias: what a text's mean feature and 1 add up to is the logit of label 1.

    One text is one step; the rate falls linearly to nothing. Classes weigh alike, so a rare class is learned too.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    bags = Bags(buckets)
    counted = []
    for t in texts:
        which, times = np.unique(bags.of(t), return_counts=True)
        counted.append((which, times / max(1, times.sum())))
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    steps, at = epochs * len(texts), 0
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            lr = rate * (1 - at / steps)
            at += 1
            which, times = counted[k]
            hidden = times @ vectors[which] if len(which) else np.zeros(dim)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= lr * weight[labels[k]]
            back = out @ p
            out -= np.outer(hidden, p)
            bias -= p
            if len(which):
                # a feature's step is scaled up by the number of features, as each has only a small share of the mean
                vectors[which] -= np.outer(times * min(len(which), 50), back)
    return np.append(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        where: Column | None = None, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Learned weights (see ``train``) from the labelled texts, of which at most ``rows`` take part.

    Labels other than 0 and 1, null ids and rows outside ``where`` (a condition on the id column ``doc_id``) are left
    out; of several labels for one id the largest counts. Without labelled rows all weights are 0. Training runs in one
    task over the bounded sample; only the weights reach the driver.
    """
    known = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label IN (0, 1)")
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows)  # at most ``rows`` small rows
    sample = (narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").orderBy("h", F.xxhash64("text")).limit(rows)
              .select("text", "label"))

    def learn(batches):
        texts, marks = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            marks += b.column(1).to_pylist()
        weights = train(texts, np.array(marks, int)) if texts else np.zeros(BUCKETS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary())], names=["weights"])

    got = sample.coalesce(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(got[0][0], "<f8") if got else np.zeros(BUCKETS + 1)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (probability of label 1), then the columns named in ``keep``.

    Whole texts; null and empty ones have the score of the bias alone. A narrow pass; the weights have a fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = narrow(docs, id_col, text_col, **{f"kept_{c}": docs[c] for c in keep})
    names = ["doc_id", "score", *[f"kept_{c}" for c in keep]]
    schema = "doc_id bigint, score double" + "".join(f", kept_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def build():
        table = WordSums(sent.value)

        def work(batch):
            logits = np.array([table.logit(t) for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500)))), *batch.columns[2:]], names=names)

        return work

    return map_batches(rows, build, schema).withColumnsRenamed({f"kept_{c}": c for c in keep})


def drop_poor(docs: DataFrame, weights: np.ndarray, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores below ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    limit = float(np.log(least / (1 - least)))

    def build():
        table = WordSums(sent.value)
        return lambda text: np.array([table.logit(t) >= limit for t in text.to_pylist()], bool)

    return filter_rows(docs, text_col, build)


class WordSums(dict):
    """word -> sum of its features' weights + 1j * their number, remembered for a bounded number of words."""

    def __init__(self, weights: np.ndarray, limit: int = 300_000):
        super().__init__()
        self.weights, self.bias, self.buckets, self.limit = weights[:-1], float(weights[-1]), len(weights) - 1, limit
        self.list = self.weights.tolist()
        self.repeat = complex(self.list[repeat_bucket(self.buckets)], 1) * REPEAT_TIMES

    def __missing__(self, word: str) -> complex:
        digest, w, n = xxhash.xxh3_64_intdigest, self.list, self.buckets
        marked = f"<{word}>"
        size = len(marked)
        total = w[digest("w" + word) % n]
        count = 1
        for k in range(SHORTEST, LONGEST + 1):
            if size >= k:
                count += size - k + 1
                for i in range(size - k + 1):
                    total += w[digest(marked[i:i + k]) % n]
        if len(self) >= self.limit:
            self.clear()
        value = complex(total, count)
        if size <= 40:
            self[word] = value
        return value

    def logit(self, text: str) -> float:
        words = words_of(text)
        total = sum(map(self.__getitem__, words), repeats(words) * self.repeat)
        return self.bias + (total.real / total.imag if total.imag else 0.0)
